import pytest
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.operators import corpus as C
from quillspark.operators import merge as M
from quillspark.operators import ranking as K
from quillspark.operators import retrieval as R
from quillspark.schema import PAPERS


def rows(spark, values, schema="paper_id string, similarity double, pair_score double"):
    return spark.createDataFrame(values, schema)


def labels(df):
    return {r.paper_id: r.focus for r in K.classify(df).collect()}


def test_thresholds(spark):
    got = labels(rows(spark, [("a", 0.0, 0.85), ("b", 0.0, 0.64), ("c", 0.0, 0.10), ("d", 0.0, 0.68), ("e", 0.0, 0.60), ("f", 0.9, None)]))
    assert got == {"a": "primary", "b": "secondary", "c": "off-topic", "d": "primary", "e": "secondary", "f": "off-topic"}


def test_rank_labels(spark):
    got = labels(rows(spark, [(f"{i:03d}", i / 100, None) for i in range(100)]))
    assert sum(v == "primary" for v in got.values()) == 30 and "off-topic" not in got.values()
    got = labels(rows(spark, [(f"{i:03d}", 0.35, None) for i in range(50)]))
    assert sum(v == "primary" for v in got.values()) == 15
    assert "primary" in labels(rows(spark, [(f"{i}", None, None) for i in range(10)])).values()
    assert labels(rows(spark, [])) == {}


def ranks(spark, names):
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "paper_id string, rank int")


@pytest.mark.parametrize("w_vector, w_text, first", [(1.4, 0.8, "B"), (0.8, 1.4, "A")])
def test_fusion_weights(spark, w_vector, w_text, first):
    got = R.fuse(ranks(spark, ["A"]), ranks(spark, ["B"]), w_text, w_vector).orderBy(F.desc("rrf")).collect()
    assert got[0].paper_id == first and {r.origin for r in got} == {"text", "vector"}


def test_fusion_tie(spark):
    a, b = R.fuse(ranks(spark, ["A"]), ranks(spark, ["B"])).collect()
    assert a.rrf == b.rrf


def test_ladder_drops_entities_first(spark):
    df = spark.createDataFrame([(f"{i}", 2020 + i % 3) for i in range(60)], "paper_id string, year int")
    rung, keep = R.ladder(df, F.lit(True), F.col("year") >= 2020, F.lit(False), 50)
    assert rung == 3 and df.where(keep).count() == 60
    assert R.ladder(df, F.lit(False), None, None, 50)[0] == 5
    assert R.ladder(df, F.lit(True), None, None, 50)[0] == 1


def test_bm25_ignores_other_terms(spark):
    df = spark.createDataFrame([("1", "graph nets", "about graphs"), ("2", "tensor", "graph graph"), ("3", "", "")], "paper_id string, title string, abstract string")
    got = {r.paper_id: r.score for r in R.bm25(df, ["graph", "graph"]).collect()}
    assert set(got) == {"1", "2"} and got["1"] > 0


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    day = spark.createDataFrame([("2026-06-30",), ("2026-05-01",), ("2027-01-01",), ("2026",), (None,), ("2026-02-31",)], "d string").select(S.day_of(F.col("d")).alias("d"))
    assert [r[0] for r in day.select(F.round(S.recency(F.col("d"), "2026-07-01"), 4)).collect()] == [0.9667, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert [str(r.d) for r in day.collect()][3:] == ["2024-01-01"] * 3
    assert S.weights("influential")["fame"] == 0.95 and S.weights("recent")["fame"] == 0.84 and S.weights("any", {"fame": 1.0}) == {"fame": 1.0}
    raw = spark.createDataFrame([('{"score": 7}',), ('```json\n{"score": "8"}\n```',), ('{"score": null}',), ("nonsense",), (None,)], "r string")
    assert [r[0] for r in raw.select(S.llm_score(F.col("r"))).collect()] == [70.0, 80.0, 50.0, 50.0, 50.0]


def paper(i, **kw):
    base = dict.fromkeys(PAPERS.names) | {"arxiv_id": i, "title": "t", "abstract": "a", "authors": "[]", "year": 2020, "submitted_date": "2020-01-01", "citation_count": 1, "max_author_citations": 0, "has_embedding": True, "vector": [1.0]}
    return tuple((base | kw)[n] for n in PAPERS.names)


def test_upsert(spark):
    old = spark.createDataFrame([paper("a"), paper("b", venue="V"), paper("c")], PAPERS)
    new = spark.createDataFrame([paper("b", title="new", venue="", citation_count=0, submitted_date="2021-05-05", vector=None), paper("c", title="", abstract=None, authors='["x"]', citation_count=9), paper("d")], PAPERS)
    got = {r.arxiv_id: r for r in M.upsert(old, new).collect()}
    assert {k: r.action for k, r in got.items()} == {"a": "kept", "b": "updated", "c": "updated", "d": "inserted"}
    assert (got["b"].title, got["b"].venue, got["b"].citation_count, got["b"].year, got["b"].has_embedding) == ("new", "V", 1, 2021, False)
    assert (got["c"].title, got["c"].authors, got["c"].citation_count, got["c"].has_embedding) == ("t", '["x"]', 9, True)
    assert not got["d"].has_embedding


def test_writeback_takes_the_last_and_rejects_other_lengths(spark):
    old = spark.createDataFrame([paper("a", has_embedding=False), paper("b", has_embedding=False)], PAPERS)
    new = spark.createDataFrame([("a", 0, [1.0, 1.0]), ("a", 1, [2.0, 2.0]), ("zz", 2, [3.0, 3.0])], "arxiv_id string, position int, vector array<float>")
    got = {r.arxiv_id: (r.has_embedding, r.vector) for r in M.write_vectors(old, new, 2).collect()}
    assert got == {"a": (True, [2.0, 2.0]), "b": (False, [1.0])}
    with pytest.raises(Exception, match="another length"):
        M.write_vectors(old, new, 3).collect()


def test_windows_and_filters(spark):
    assert C.window("Last Week", "2026-07-10") == ("2026-07-03", "2026-07-10")
    assert C.window("All Time", "2026-07-10")[0] == "2000-01-01"
    with pytest.raises(ValueError):
        C.window("Yesterday", "2026-07-10")
    df = spark.createDataFrame([paper("a", title="Video Generation", venue="NeurIPS"), paper("b", title="Other", venue="Nature Physics")], PAPERS)
    view = C.corpus(df)
    assert [r.paper_id for r in C.without_terms(view, ["video generation"]).collect()] == ["b"]
    assert [r.paper_id for r in C.venue_filter(view, "All Conferences").collect()] == ["a"]
    assert C.venue_filter(view, "Nonsense").count() == 0 and C.venue_filter(view, "None").count() == 2
    assert view.where(C.entity_filter([], ["'''"])).count() == 2  # nothing is left of the name
    assert [r.paper_id for r in view.where(C.entity_filter([], ["NeurIPS'; --"])).collect()] == ["a"]
    assert view.where(C.all_of([None, None])).count() == 2


def test_open_or_create(spark, tmp_path):
    path = str(tmp_path / "papers")
    assert C.open_or_create(spark, path).count() == 0
    assert C.open_or_create(spark, path).columns == PAPERS.names


def test_chunks(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "k")
    got = K.chunks(df, ["k"], 64).orderBy("k").collect()
    assert [r.chunk for r in got] == [i // 64 for i in range(1000)]


def test_highlights_keep_papers_without_sentences(spark):
    df = spark.createDataFrame([("1", "We rank proteins by hand. Routing is a protein task. Nothing else matters here."), ("2", "Short."), ("3", None)], "paper_id string, abstract string")
    got = {r.paper_id: r.reason for r in R.highlights(df, ["protein", "routing"]).collect()}
    assert got["1"].startswith("Routing is a protein task....") and got["2"] == got["3"] == "No extractable sentences found in abstract."


def test_pair_scorer_sees_the_whole_title(spark):
    """Only the abstract is cut, so a long title takes nothing from it."""
    made = rows(spark, [("a", 0.5, "t" * 1600, "b" * 1600), ("b", 0.4, "t" * 100, "b" * 1500), ("c", 0.3, "t", None)], "paper_id string, similarity double, title string, abstract string")
    got = R.pair_rerank(made, "x", lambda _, text: F.length(text) / 1000.0).select("paper_id", "pair_score")
    assert {r.paper_id: r.pair_score for r in got.collect()} == {i: pytest.approx(1 / (1 + 2.718281828459045 ** (-n / 1000)), abs=1e-6) for i, n in (("a", 3102), ("b", 1602), ("c", 1))}
