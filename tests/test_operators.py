"""Operators whose result is fixed by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import identity, metrics
from quillon.operators import clean, filters, graph, models, nodes, rank, route, search, store, tree
from quillon.sources import files
from quillon.streaming import ingest


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def digest(*parts):
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    return h.hexdigest()


def test_node_identity(spark):
    row = spark.createDataFrame([("text", "héllo🙂", ["b", "a"], 3)], "m string, c string, p array<string>, o int")
    got = row.select(identity.node_id(F.col("m"), F.col("c"), F.col("p"), F.col("o")).alias("r")).first()["r"]
    assert got == digest("text", "héllo🙂", "a", "b", "3")


def test_hash_embedding(spark):
    got = one(spark, "abc", lambda c: identity.hash_embedding(c, 3))
    want = [int.from_bytes(hashlib.sha256(b"abc" + i.to_bytes(4, "big")).digest()[:8], "big") / 2**64 * 2 - 1 for i in range(3)]
    assert got == want


def test_cleaners(spark):
    assert one(spark, " a \t b  \n\n\n\nc ", clean.whitespace) == "a b\n\nc"
    assert one(spark, "exam-\n ple", clean.hyphenation) == "example"
    assert one(spark, "keep\n Page 12 \n****\n\nok", clean.artifacts).split("\n")[0] == "keep"
    assert "****" not in one(spark, "keep\n****\nok", clean.artifacts)
    assert one(spark, "name     price    x\nshort", clean.linearize_tables) == "name\nprice\nx\nshort"
    assert one(spark, "wcelu zawsze Dokument zamek przezdom", clean.polish_spacing) == "w celu zawsze Dokument zamek przez dom"
    assert one(spark, "cafÃ©", clean.normalize_unicode) == "café"


def test_clean_keeps_lineage_and_routes(spark):
    docs = spark.createDataFrame([(1, "wcelu", "pl"), (2, "wcelu", "en")], "doc_id long, text string, lang string")
    out = {r["sources"][0]: r for r in clean.clean(nodes.roots(docs), "polish-dictionary-spacing").collect()}
    assert out["1"]["content"] == "w celu" and out["1"]["parents"] == [digest("text", "wcelu", "0")]
    assert out["2"]["content"] == "wcelu" and out["2"]["parents"] == []


def test_fixed_size_short_tail(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "🙂" * 5)], "doc_id long, text string")
    out = nodes.fixed_size(nodes.roots(docs), 4, 1).orderBy("sources", "ordinal").collect()
    assert [r["content"] for r in out if r["sources"] == ["1"]] == ["abcd", "defg", "ghij", "j"]
    assert [r["content"] for r in out if r["sources"] == ["3"]] == ["🙂" * 4, "🙂🙂"]
    assert not [r for r in out if r["sources"] == ["2"]]
    with pytest.raises(ValueError):
        nodes.fixed_size(nodes.roots(docs), 4, 4)


def test_keywords(spark):
    assert one(spark, "The cat and the dog: dog-house CAT it's ox", nodes.keywords) == ["cat", "dog", "dog-house", "it's"]
    assert one(spark, "", nodes.keywords) == []


def test_filters_refuse(spark):
    df = spark.createDataFrame([(1, "a", ["s"], [1, 2]), (2, None, [], None)], "id int, content string, sources array<string>, tags array<int>")
    ids = lambda f: sorted(r["id"] for r in filters.matching(df, f).collect())
    assert ids({"op": "ne", "field": "content", "value": "a"}) == [2]
    assert ids({"op": "ne", "field": "ext.tags", "value": 2}) == [2]
    assert ids({"op": "gt", "field": "ext.tags", "value": 1}) == [1]
    assert ids({"op": "exists", "field": "lineage.sources"}) == [1]
    for bad in ({"op": "lt", "field": "content", "value": 1}, {"op": "eq", "field": "ext.tags", "value": 1.5}, {"op": "gt", "field": "ext.tags", "value": "x"}, {"op": "and", "clauses": []}):
        with pytest.raises(ValueError):
            filters.predicate(bad, df.schema)


def test_predicate_is_pushed_down(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters.matching(docs, {"op": "eq", "field": "ext.lang", "value": "de"}).select("doc_id")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("lang") == "de").select("doc_id").explain("formatted")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in capsys.readouterr().out


def hits(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, list_idx int, arm string, node_id long, score double, rank int")


def test_fusers(spark):
    h = hits(spark, (1, 0, "a", 10, 3.0, 0), (1, 0, "a", 11, 1.0, 1), (1, 1, "b", 11, 5.0, 0), (1, 1, "b", 12, 5.0, 1))
    rrf = [(r["node_id"], r["score"]) for r in rank.reciprocal_rank(h).orderBy("rank").collect()]
    assert rrf == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]
    norm = {r["node_id"]: r["score"] for r in rank.normalized_scores(h).collect()}
    assert norm == {10: 1.0, 11: 1.0, 12: 1.0}
    both = [r["node_id"] for r in rank.boolean_combine(h, ("and", 0, 1)).collect()]
    assert both == [11]
    assert [r["node_id"] for r in rank.boolean_combine(h, ("and", 0, ("not", 1))).collect()] == [10]
    for bad in (("not", 0), ("or", 0, ("not", 1)), ("and", ("not", 0))):
        with pytest.raises(ValueError):
            rank.boolean_combine(h, bad)
    with pytest.raises(Exception, match="more than one list"):
        rank.single_list(h).collect()


def test_shingles_keep_the_first(spark):
    rows = [(1, 1, 9.0, 0, "a b c d e f"), (1, 2, 8.0, 1, "a b c d e f"), (1, 3, 7.0, 2, "u v w x y z"), (1, 4, 6.0, 3, "a b c d e g")]
    df = spark.createDataFrame(rows, "query_id long, node_id long, score double, rank int, content string")
    assert [(r["node_id"], r["rank"]) for r in rank.shingle_resemblance(df, 0.5, 3).orderBy("rank").collect()] == [(1, 0), (3, 1)]


def test_mmr_prefers_novelty(spark):
    rows = [(1, 1, 0, [1.0, 0.0], [1.0, 0.2]), (1, 2, 1, [1.0, 0.01], [1.0, 0.2]), (1, 3, 2, [0.0, 1.0], [1.0, 0.2])]
    df = spark.createDataFrame(rows, "query_id long, node_id long, rank int, vector array<double>, asked array<double>")
    assert [r["node_id"] for r in rank.mmr(df, weight=0.3).orderBy("rank").collect()] == [2, 3, 1]


def test_collapse_absorbs(spark):
    rows = [(1, "q1", ["p"], "question", 0.9, 0), (1, "p", [], None, 0.5, 1), (1, "s", ["p", "r"], None, 0.4, 2), (1, "r", [], None, 0.3, 3)]
    df = spark.createDataFrame(rows, "query_id long, node_id string, parents array<string>, representation string, score double, rank int")
    assert [(r["node_id"], r["score"]) for r in rank.collapse(df).orderBy("rank").collect()] == [("p", 0.9), ("r", 0.3)]


def test_repack(spark):
    rows = [(1, i, 1.0, i, "w " * n) for i, n in enumerate([4, 4, 4, 50])]
    df = spark.createDataFrame(rows, "query_id long, node_id long, score double, rank int, content string")
    labels = lambda m: [r["label"] for r in rank.repack(df, budget=20, method=m).orderBy("rank").collect()]
    assert labels("forward") == [1, 2, 3] and labels("reverse") == [3, 2, 1] and labels("sides") == [1, 3, 2]
    with pytest.raises(Exception, match="over budget"):
        rank.repack(df, budget=2).collect()


def test_anchors(spark):
    got = one(spark, 'Does "max pool" of `x y` break CVE-2019-4102 at 5GHz in 2nd fooBar v1 snake_case 1.2.3 12 or v1?', lambda c: route.anchors(c))
    assert [(a["text"], a["kind"]) for a in got] == [("max pool", "quoted"), ("x y", "quoted"), ("CVE-2019-4102", "identifier"), ("fooBar", "identifier"), ("v1", "identifier"), ("snake_case", "identifier"), ("1.2.3", "identifier")]
    named = one(spark, "Ask Acme Corp about Acme", lambda c: route.anchors(c, ["Acme Corp"]))
    assert [a["text"] for a in named] == ["Acme Corp"]


def test_boolean_parser():
    assert route.parse_boolean('a and not ("b c" or d)') == ("and", "a", ("not", ("or", "b c", "d")))
    assert route.parse_boolean("a or b and c") == ("or", "a", ("and", "b", "c"))
    for bad in ("a and", "(a", "a b", "((((a))))", ")"):
        with pytest.raises(ValueError):
            route.parse_boolean(bad)


def test_routes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "query_id int, x double")
    assert [r["route"] for r in route.ladder(df, [("small", [("x", "<", 10)])], "other").orderBy("query_id").collect()] == ["small", "other"]
    with pytest.raises(ValueError):
        route.ladder(df, [("r", [("y", "<", 1)])], "other")
    hedge = spark.createDataFrame([("I'm not sure",), ("Yes",), (None,)], "t string").select(route.hedged(F.col("t")).alias("r"))
    assert [r["r"] for r in hedge.collect()] == ["insufficient", "sufficient", "unobserved"]


def test_names_and_graph(spark):
    text = "The Board met New York City Council in Paris."
    assert one(spark, text, graph.candidate_names) == ["Board", "New York City Council", "Paris"]
    assert one(spark, text, lambda c: graph.candidate_names(c, 2)) == ["Board", "New York", "City Council", "Paris"]
    assert one(spark, "Saint Petersburg Institute", lambda c: graph.subspans(graph.candidate_names(c))) == ["Saint Petersburg Institute", "Saint Petersburg", "Petersburg Institute", "Saint", "Petersburg", "Institute"]
    rel = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    near = graph.neighbourhood(spark.createDataFrame([("a",)], "entity string"), rel, 2)
    assert sorted((r["entity"], r["distance"]) for r in near.collect()) == [("b", 1), ("c", 2)]
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "x")], "node_id int, name string")
    assert [(r["a"], r["middle"], r["b"]) for r in graph.bridges(graph.cooccurrences(found), found).collect()] == [("a", "b", "c"), ("b", "a", "x")]


def test_resolution(spark):
    entities = spark.createDataFrame([("Reciprocal Rank Fusion", [1.0, 0.0]), ("Reciprocal Rank Fusions", [1.0, 0.0]), ("RRF", [1.0, 0.0]), ("Other", [0.0, 1.0])], "name string, vector array<double>")
    same = graph.similar_names(entities)
    assert [(r["a"], r["b"]) for r in same.collect()] == [("Reciprocal Rank Fusion", "Reciprocal Rank Fusions")]
    assert graph.acronym_pairs(entities).count() == 0  # two expansions
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)], "a string, b string")
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(42)], "name string")
    out = {r["name"]: r["entity"] for r in graph.resolve(names, chain).collect()}
    assert out["n040"] == "n000" and out["n041"] == "n041"


def test_delete_narrows(spark):
    made = spark.createDataFrame([("n", "a", "a"), ("n", "b", "b"), ("m", "a|b", "a"), ("m", "a|b", "b"), ("k", "c", "c")], "node_id string, production string, source string")
    out = {r["node_id"]: (r["sources"], r["deleted"]) for r in store.delete_sources(made, spark.createDataFrame([("a",)], "source string")).collect()}
    assert out == {"n": (["b"], False), "m": ([], True)}


def test_targets_and_writer(spark, tmp_path):
    t = store.Targets(f"file://{tmp_path}/t", str(tmp_path / "pointer.json"))
    for name in ("blue", "green"):
        t.write(name, spark.createDataFrame([(name,)], "x string"), {"model": "hash", "width": 2})
    with pytest.raises(ValueError):
        t.write("blue", spark.range(1), {"model": "other", "width": 2})
    with pytest.raises(ValueError):
        t.read(spark)
    t.promote("blue")
    t.promote("green")
    assert t.read(spark).first()["x"] == "green"
    t.rollback()
    assert t.read(spark).first()["x"] == "blue"
    with pytest.raises(ValueError):
        t.drop("green")
    with store.WriterClaim(str(tmp_path / "lock")), pytest.raises(RuntimeError), store.WriterClaim(str(tmp_path / "lock")):
        pass


def test_metrics(spark):
    h = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "query_id long, node_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "query_id long, node_id long")
    out = {r["query_id"]: r for r in metrics.ranking_scores(h, rel, 3).collect()}
    assert out[1]["precision"] == pytest.approx(1 / 3) and out[1]["recall"] == 0.5 and out[1]["reciprocal_rank"] == 0.5 and out[1]["average_precision"] == 0.25
    assert out[2]["recall"] == 0 and out[2]["ndcg"] == 0
    df = spark.createDataFrame([("the cat sat on the mat", "the cat is on the mat")], "a string, b string")
    r = df.select(metrics.token_f1(F.col("a"), F.col("b")).alias("f"), metrics.rouge_l("a", "b").alias("l"), metrics.rouge_n(F.col("a"), F.col("b"), 2).alias("r2")).first()
    assert (r["f"], r["l"], r["r2"]) == (pytest.approx(10 / 12), pytest.approx(10 / 12), pytest.approx(0.6))
    assert metrics.bootstrap_interval([0.5]) is None
    low, high = metrics.bootstrap_interval([0.0, 1.0] * 20)
    assert low < 0.5 < high and (low, high) == metrics.bootstrap_interval([0.0, 1.0] * 20)


def test_vectors_of_another_width(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    n = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "node_id long, vector array<double>")
    assert [(r["node_id"], r["score"]) for r in search.vector_top_k(q, n).collect()] == [(1, 1.0), (3, 0.0)]
    with pytest.raises(Exception, match="width"):
        search.vector_top_k(q, spark.createDataFrame([(1, [1.0])], "node_id long, vector array<double>")).collect()


def test_models(spark):
    assert models.rescue_json('noise {"a": [1, 2]} tail') == {"a": [1, 2]} and models.rescue_json("```json\n[1]\n```") == [1] and models.rescue_json("none") is None
    assert models.looping("start " + "again and again " * 4) and not models.looping("an ordinary sentence.")
    chunk = spark.createDataFrame([("c", "text")], "id string, content string")
    asked = models.hypothetical_questions(chunk, models.Scripted([("questions", "1. What?\n- what?\n* Why  so?\n")]))
    assert [r["content"] for r in asked.orderBy("ordinal").collect()] == ["What?", "Why so?"]
    passages = spark.createDataFrame([(1, 7, 1, "x"), (1, 8, 2, "y")], "query_id long, node_id long, label int, content string")
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, text string")
    out = {r["query_id"]: r for r in models.cited_answers(passages, queries, models.Scripted([], "It is so [2].")).collect()}
    assert out[1]["citations"] == [8] and out[2]["stance"] == "not-in-corpus"
    facts = [("n", i, s, "T", p, t, "T") for i, (s, p, t) in enumerate([("a", "p", "b"), ("A", "p", "b"), ("x and y", "p", "b"), ("a", "q", "b"), ("", "p", "b"), ("c", "p", "d"), ("e", "p", "f")])]
    df = spark.createDataFrame(facts, "node_id string, position int, source string, source_type string, predicate string, target string, target_type string")
    schema = spark.createDataFrame([("T", "p", "T")], "source_type string, predicate string, target_type string")
    assert [r["reason"] for r in models.gated_facts(df, schema, 2).orderBy("position").collect()] == [None, "duplicate", "not-atomic", "off-schema", "incomplete", None, "over-limit"]


def test_tree(spark):
    rows = [("s", f"n{i}", [1.0, 0.01 * i] if i < 3 else [0.01 * i, 1.0], 100) for i in range(6)]
    leaves = spark.createDataFrame(rows, "scope string, node_id string, vector array<double>, chars int")
    made = tree.cluster(leaves, size=3, threshold=0.9)
    groups = {}
    for r in made.collect():
        groups.setdefault(r["cluster"], set()).add(r["node_id"])
    assert sorted(map(sorted, groups.values())) == [["n0", "n1", "n2"], ["n3", "n4", "n5"]]
    held = tree.centroids(made.join(leaves, "node_id")).withColumn("scope", F.lit("s"))
    new = spark.createDataFrame([("s", "z1", [1.0, 0.0]), ("s", "z2", [-1.0, 0.0]), ("s", "z3", [1.0, 0.0])], "scope string, node_id string, vector array<double>")
    out = {r["node_id"]: r["cluster"] for r in tree.join_clusters(new, held, 4, 0.8).collect()}
    assert out["z1"] == 0 and out["z2"] is None and out["z3"] is None


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hé")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF")
    root = f"file://{tmp_path}/in"
    refs = files.inventory(spark, root).cache()
    assert [(r["size"], r["content_hash"]) for r in refs.collect()] == [(3, hashlib.sha256("hé".encode()).hexdigest())]
    assert [r["content"] for r in files.text_nodes(files.load(spark, root, refs)).collect()] == ["hé"]
    (tmp_path / "in/a.txt").write_text("changed")
    with pytest.raises(Exception, match="changed since inventory"):
        files.load(spark, root, refs).collect()
    assert files.claimant("x.TXT", {"text": [".txt"]}) == "text"
    with pytest.raises(ValueError):
        files.claimant("x.doc", {"text": [".txt"]})
    assert one(spark, "<p>a &amp; b<script>x()</script> <b>c</b></p>", files.page_text) == "a & b c"
    docs = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    ingest.index_stream(ingest.document_stream(spark, f"{tmp_path}/docs", docs.schema), f"{tmp_path}/out", f"{tmp_path}/ck", 4, 1).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
