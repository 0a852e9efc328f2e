"""The pipeline, stage by stage, against plain restatements."""

import re
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_against_brute_force import BASE, SCHEMA, WORD, shingles, texts


def plain_near(rows):
    sets, parent = [shingles(r[1], 5) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [r for i, r in enumerate(rows) if find(i) == i]


def plain_substrings(rows):
    seen, out = {}, []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            seen[tuple(w[s : s + 20])] = min(seen.get(tuple(w[s : s + 20]), (i, s)), (i, s))
    for i, t, *rest in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] < (i, s):
                gone |= set(range(s, s + 20))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t, *rest))
    return out


def plain_secrets(text):
    spans = sorted((m.start(), m.end()) for _, p, ok in BASE for m in re.finditer(p, text or "") if ok(m))
    out, end = [], 0
    for a, b in spans:
        if a >= end:
            out += [text[end:a], "[SECRET]"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if spans else text


def test_pipeline(spark, tmp_path):
    rows = [(i, x, "en", "s", len(x or ""), None, None) for i, x in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    near = plain_near(kept)
    cut = plain_substrings(near)
    clean = [(i, plain_secrets(t), *rest) for i, t, *rest in cut]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, want in enumerate((kept, near, cut, clean)):
        stage = corpus_pipeline.STAGES[k][1](spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        got = sorted(tuple(r) for r in stage.select("doc_id", "text").collect())
        if names[k] == "language":  # a text whose letters are in no profile may go as well
            assert {i for i, _ in got} <= {r[0] for r in want}
            assert {r[0] for r in want} - {i for i, _ in got} <= {r[0] for r in want if len(WORD.findall(r[1])) < 8}
            lost = {r[0] for r in want} - {i for i, _ in got}
            assert not lost, lost
        else:
            assert got == sorted((r[0], r[1]) for r in want)
        stage.write.parquet(f"{tmp_path}/{k}")
        stage = spark.read.parquet(f"{tmp_path}/{k}")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(int)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by[p["doc_id"]] += p["length"]
    assert by == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in clean}


def test_pipeline_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark):
    """Columns named like those that stages use inside pass through, values and all."""
    names = ["row", "score", "language", "_row", "cls", "doc", "own", "marks", "label", "text_hash", "n", "a", "b", "token"]
    filler = ["le chat noir dort sur la table", "the black cat sleeps on the table", "die schwarze Katze schläft auf dem Tisch"]
    rows = [(i, f"{filler[i % 3]} {' '.join(f'mot{(i * 7 + j) % 50}' for j in range(8))}", "fr en de".split()[i % 3], "s", 1, *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    want = {r[0]: r[5:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.columns
        got = out.collect()
        assert got and all(tuple(r[n] for n in names) == want[r["doc_id"]] for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("doc_id is null").count() == 0


def test_language_stage_rejects(spark):
    """Texts without letters, null texts and texts in a script that no learned language has go; others stay."""
    rows = [(i, f"{'the black cat sleeps on the table and the dog' if i % 2 else 'le chat noir dort sur la table avec le chien'} {i}", "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    rows += [(100, "Το μαύρο γατάκι κοιμάται πάνω στο τραπέζι a", None, "s", 1), (101, "12 34", None, "s", 1), (102, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()) == list(range(40))
