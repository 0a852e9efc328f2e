"""PDF text, settings files, and operators of the store, tree and routes on small cases."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import metrics
from quillon.operators import rank, route, store, tree
from quillon.sources import files, pdf


def made_pdf(pages, extra=b"", fonts=b"/F1 9 0 R", more=b""):
    """A small file of pages of content streams, the last of them compressed."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /Resources << /Font << " + fonts + b" >> >> >>"]
    out = b"%PDF-1.4\n1 0 obj" + objects[0] + b"endobj\n2 0 obj" + objects[1] + b"endobj\n9 0 obj<< /Type /Font /Subtype /Type1 >>endobj\n" + more
    for i, content in enumerate(pages):
        last = i == len(pages) - 1
        body = zlib.compress(content) if last else content
        out += b"%d 0 obj<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>endobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj<< /Length %d %s>>\nstream\n" % (11 + 2 * i, len(body), b"/Filter /FlateDecode " if last else b"") + body + b"\nendstream endobj\n"
    return out + extra + b"%%EOF"


def test_pdf_pages():
    one = rb"BT /F1 12 Tf 10 700 Td (Hello \(brave\) w\366rld) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* <414243> Tj ET"
    two = b"BT /F1 9 Tf (last page) Tj ET"
    assert pdf.pdf_text(made_pdf([one, b"", two])) == ["Hello (brave) wörld\nsecond line\nABC", "", "last page"]


def test_pdf_unicode_maps():
    cmap = b"beginbfchar <0001> <0141> endbfchar beginbfrange <0002> <0004> <0061> <0005> <0006> [<00E9> <D83DDE42>] endbfrange"
    more = b"7 0 obj<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>endobj\n8 0 obj<< /Length 1 >>\nstream\n" + cmap + b"\nendstream endobj\n"
    assert pdf.pdf_text(made_pdf([b"BT /F2 12 Tf <000100020003000400050006> Tj ET"], fonts=b"/F1 9 0 R /F2 7 0 R", more=more)) == ["Łabcé🙂"]


@pytest.mark.parametrize("data", [b"plain", b"", made_pdf([b"q 1 0 0 1 0 0 cm /Im1 Do Q"]), made_pdf([b"(x) Tj"], extra=b"trailer << /Encrypt 5 0 R >>")])
def test_pdf_refused(data):
    with pytest.raises(pdf.Unreadable):
        pdf.pdf_text(data)


def test_pdf_nodes(spark):
    docs = spark.createDataFrame([("s1", "/a.pdf", bytearray(made_pdf([b"(one) Tj", b"", b"(three) Tj"])))], "source_id string, path string, content binary")
    got = pdf.pdf_nodes(docs).orderBy("page").collect()
    assert [(r["sources"], r["content"], r["page"]) for r in got] == [(["s1"], "one", 1), (["s1"], "three", 3)] and got[0]["id"] != got[1]["id"]
    assert pdf.pdf_nodes(docs.limit(0)).count() == 0


def test_settings():
    assert files.settings('a = 1\n[b]\nc = "x"', ".toml") == files.settings('{"a": 1, "b": {"c": "x"}}', ".json") == {"a": 1, "b": {"c": "x"}}
    for text, suffix in (("[1]", ".json"), ("a: 1", ".yaml")):
        with pytest.raises(ValueError):
            files.settings(text, suffix)


def test_corpus_profile_knows_what_it_knows(spark):
    schema = "id int, status string, leaves long, tokens long, tokenizer string"
    profile = lambda rows, window=None: store.corpus_profile(spark.createDataFrame(rows, schema), window).first().asDict()
    full = [(1, "active", 2, 10, "t"), (2, "active", 3, 20, "t")]
    assert profile(full, 30) == {"documents": 2, "leaves": 5, "leaf_tokens": 30, "sources_pending": 0, "sources_failed": 0, "base_complete": True, "fits_context": True}
    assert profile(full, 29)["fits_context"] is False and profile(full)["fits_context"] is None
    assert profile([*full, (3, "active", None, 5, "u")])["leaves"] is None and profile([*full, (3, "active", 1, 5, "u")])["leaf_tokens"] is None
    assert profile([*full, (3, "failed", None, None, None)])["base_complete"] is False
    assert profile([(1, "active", 1, 1, "t")][:0])["documents"] == 0 and profile([(3, "indexing", 1, 1, "t")])["leaves"] is None


def test_release_and_catalogue(spark):
    nodes = spark.createDataFrame([("n1", ["1"]), ("n2", ["2"]), ("n3", ["1", "3"]), ("n3", ["2"])], "id string, sources array<string>")
    catalogue = spark.createDataFrame([(i, "active") for i in (1, 2, 3)], "id long, status string")
    found = spark.createDataFrame([(1, "vanished"), (3, "content_changed"), (2, "unchanged")], "id long, change string")
    touched, left = store.release(store.productions(nodes), catalogue, found)
    assert {(r["node_id"], tuple(r["sources"]), r["deleted"]) for r in touched.collect()} == {("n1", (), True), ("n3", ("2",), False)}
    assert sorted(map(tuple, left.collect())) == [(2, "active"), (3, "indexing")]
    put = store.catalogue_put(left, spark.createDataFrame([(3, "active"), (4, "active")], "id long, status string"))
    assert sorted(map(tuple, put.collect())) == [(2, "active"), (3, "active"), (4, "active")]


def test_generations(spark):
    nodes = spark.createDataFrame([("a", ["g1"], ["s1"]), ("b", ["g1"], ["s2"]), ("c", [], ["s1"]), ("d", ["g1", "g0"], ["s3"])], "id string, generations array<string>, sources array<string>")
    carried = store.carry_forward(nodes, "g1", "g2", spark.createDataFrame([("s2",)], "source string"))
    assert {r["id"]: r["generations"] for r in carried.collect()} == {"a": ["g1", "g2"], "b": ["g1"], "c": [], "d": ["g0", "g1", "g2"]}
    assert {r["id"]: r["generations"] for r in store.retract(carried, "g1").collect()} == {"a": ["g2"], "c": [], "d": ["g0", "g2"]}
    made = spark.createDataFrame([("g1", "x", "published", 1), ("g2", "x", "published", 2)], "id string, layer string, status string, published_at int")
    assert {r["id"] for r in store.reclaim(carried, made).collect()} == {"a", "c", "d"}
    assert {tuple(r["generations"]) for r in store.bind(nodes, "z").collect()} == {("g1", "z"), ("z",), ("g0", "g1", "z")}


def test_upsert_of_many_copies(spark):
    rows = [("n", f"text {i}", [f"s{i % 3}"]) for i in range(50)] + [("m", "one", [])]
    got = {r["id"]: r for r in store.upsert(spark.createDataFrame(rows[:0], "id string, content string, sources array<string>"), spark.createDataFrame(rows, "id string, content string, sources array<string>")).collect()}
    assert got["n"]["sources"] == ["s0", "s1", "s2"] and got["m"]["sources"] == []


def test_lease_of_a_killed_writer(tmp_path):
    path = str(tmp_path / "lock")
    killed = store.WriterClaim(path, lease=0.05).__enter__()
    time.sleep(0.2)
    with store.WriterClaim(path, lease=0.05) as own:
        own.renew()
        with pytest.raises(RuntimeError):
            killed.renew()
        killed.__exit__()
        with pytest.raises(RuntimeError), store.WriterClaim(path, lease=60):
            pass
    with store.WriterClaim(path):
        pass


def test_summary_tree_levels(spark):
    leaves = [(s, f"{s}{i:02}", f"text {s}{i}", [1.0, i / 50]) for s in "ab" for i in range(9)]
    embed = lambda text: [1.0, len(text) / 1000]
    df = spark.createDataFrame(leaves, "scope string, node_id string, content string, vector array<double>")
    made = tree.build(df, lambda texts: "|".join(texts), embed, size=3, threshold=0.5).collect()
    for scope in "ab":
        mine = {r["node_id"]: r for r in made if r["scope"] == scope}
        assert [sorted(len(r["parents"]) for r in mine.values() if r["level"] == n) for n in (1, 2)] == [[3, 3, 3], [3]]
        top = next(r for r in mine.values() if r["level"] == 2)
        assert set(top["parents"]) == {r["node_id"] for r in mine.values() if r["level"] == 1}
        assert {x for r in mine.values() if r["level"] == 1 for x in r["parents"]} == {f"{scope}{i:02}" for i in range(9)}
    low = next(r for r in made if r["scope"] == "a" and r["level"] == 1)
    root = next(r for r in made if r["scope"] == "a" and r["level"] == 2)
    joined = spark.createDataFrame([("new", low["node_id"]), ("other", None)], "node_id string, cluster string")
    stored = spark.createDataFrame([(r["node_id"], r["parents"]) for r in made], "node_id string, parents array<string>")
    assert {r["node_id"] for r in tree.outdated(stored, joined).collect()} == {low["node_id"], root["node_id"]}
    with pytest.raises(Exception, match="no vector"):
        tree.build(df.withColumn("vector", F.lit(None).cast("array<double>")), lambda t: "", embed, size=3, threshold=0.5).count()


def test_routes_offered():
    catalogue = [{"name": "plain", "summary": "s"}, {"name": "mute"}, {"name": "graph", "summary": "s", "layers": ["graph"]}, {"name": "judge", "summary": "s", "roles": ["judge"]}, {"name": "whole", "summary": "s", "counts_tokens": True}]
    assert route.offered(catalogue, [], [], False) == (["plain"], {"mute": "no summary", "graph": "not ready: graph", "judge": "no model for: judge", "whole": "tokens are not known"})
    assert route.offered(catalogue, ["graph"], ["judge"], True)[0] == ["plain", "graph", "judge", "whole"]


def test_scores_that_are_not_finite(spark):
    for bad in (float("nan"), float("inf"), -float("inf")):
        hits = spark.createDataFrame([(1, 0, "a", 1, bad, 0)], "query_id int, list_idx int, arm string, node_id int, score double, rank int")
        with pytest.raises(Exception, match="not finite"):
            rank.normalized_scores(hits).collect()


def test_digest_of_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "n int, t string")
    assert metrics.set_digest(a) == metrics.set_digest(a.orderBy(F.desc("n")).select("t", "n")) != metrics.set_digest(a.distinct())
    assert metrics.set_digest(a.limit(0)) != metrics.set_digest(a.limit(0).select("n"))
