import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.embed import hash_embed, hash_vector, overlap_scorer
from quillspark.plans import export, ingest, training
from quillspark.plans.search import Models, Request, search, stage_of
from quillspark.schema import PAPERS
from quillspark.sources import records
from quillspark.streaming import upsert as stream

SF = "/root/testdata/sf0.001"


def test_search(spark):
    papers = spark.read.parquet(f"{SF}/papers.parquet")
    models = Models(embed_query=lambda s: hash_vector(s, 768), score_pair=overlap_scorer)
    events = list(search(papers, Request("protein routing benchmark", "survey", "All Time", 3), "2026-07-01", models))
    assert [e["type"] for e in events[:-1]] == ["stage"] * (len(events) - 1)
    done = events[-1]
    got = done["papers"].collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) > 0
    assert done["summarise"].count() == min(3, len(got))
    assert not any("survey" in (r["title"] + r["abstract"]).lower() for r in got)


def test_search_without_papers(spark):
    assert list(search(spark.createDataFrame([], PAPERS), Request("x"), "2026-07-01"))[-1]["type"] == "error"
    for bad in ({"top_n": 11}, {"date_range": "Never"}):
        with pytest.raises(ValueError):
            Request("x", **bad)


def test_stage_markers():
    assert [stage_of(m) for m in ("Stage 4 x", "SPECTER2 y", "Stage 0", "else")] == [3, 2, 1, 1]


def test_raw_records(spark):
    raw = [{"paperId": "s", "title": " a\nb ", "externalIds": {"ArXiv": "1.2"}, "authors": [{"name": "X"}, {}], "year": 2020, "venue": "ArXiv", "citationCount": None}, {"paperId": "only", "publicationDate": "2021-02-03"}, {"title": "none"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw] + [("{broken",), (None,)], "raw string")
    got = records.parse_raw(df, "raw").collect()
    assert [(r.arxiv_id, r.title, r.submitted_date, r.venue, r.max_author_citations) for r in got] == [("1.2", "a b", "2020-01-01", None, 0), ("s2:only", "", "2021-02-03", None, 0)]
    assert got[0].authors == ["X", ""] and got[0].pdf_url == "https://arxiv.org/pdf/1.2"
    assert set(PAPERS.names) == set(records.table_row(records.parse_raw(df, "raw")).columns)


def test_atom(spark):
    rows = [("http://arxiv.org/abs/2001.1v2", "t", "s", "2020-01-02T00:00:00Z", ["A"], ["cs.LG", "http://x"], "Accepted at ICLR", None), ("http://arxiv.org/api/errors", "t", "s", None, [], [], None, None), ("http://arxiv.org/abs/hep-ev/99v1", "t", "s", None, [], [], "preprint", "J. X")]
    df = spark.createDataFrame(rows, "id string, title string, summary string, published string, authors array<string>, categories array<string>, comment string, journal_ref string")
    got = records.parse_atom(df, "2026-07-01").collect()
    assert [(r.arxiv_id, r.submitted_date, r.venue, r.fields_of_study) for r in got] == [("2001.1", "2020-01-02", "ICLR", ["Computer Science", "cs.LG"]), ("hep-ev/99", "2026-07-01", "J. X", ["Computer Science"])]


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert records.with_retry(flaky, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        records.with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def pages(query, token):
    """Two pages per query."""
    return [json.dumps({"paperId": f"{query}{token or 0}"})], (1 if token is None else None)


def test_paged_source(spark):
    spark.dataSource.register(records.PagedSource)
    got = spark.read.format("quill_pages").options(queries="a|b", fetch="tests.test_pipeline.pages").load()
    assert sorted((r.query, r.position) for r in got.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_storage():
    with pytest.raises(ValueError, match="BUCKET_NAME"):
        records.storage_options({"BUCKET_ENDPOINT": "x"})
    assert records.storage_options({"BUCKET_ENDPOINT": "e", "BUCKET_NAME": " 'n' ", "BUCKET_KEY_ID": "k", "BUCKET_SECRET": "s"})["path"] == "s3a://n"


def test_stream_state_over_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(u, i * 10 + u) for u in range(5)], "user_id int, event_id int").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = str(tmp_path / "flat")
    spark.read.parquet(*[str(tmp_path / "in" / f"p{i}") for i in range(3)]).repartition(3).write.parquet(source)
    got = {tuple(r) for r in stream.latest_per_key(spark, source, "user_id", "event_id").collect()}
    assert got == {(20 + u, u) for u in range(5)}


def test_ingest_stages(spark, tmp_path):
    source, target = str(tmp_path / "v0"), str(tmp_path / "v1")
    spark.createDataFrame([], PAPERS).write.parquet(source)
    incoming = spark.read.parquet(f"{SF}/papers.parquet").withColumn("o", F.lit(1))
    assert set(ingest.merge_into(spark, incoming, source, target, ["o"])) == {"inserted"}
    assert ingest.embed_pending(spark, target, str(tmp_path / "v2"), hash_embed, 256) == incoming.count()
    assert spark.read.parquet(str(tmp_path / "v2")).where("has_embedding").count() == incoming.count()
    out = ingest.run_stages([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 2)])
    assert out["a"] == 1 and out["c"] == 2 and "failed" in out["b"]


def test_schedule():
    now = dt.datetime(2026, 7, 20, tzinfo=dt.timezone.utc)
    meta = {"last_arxiv_at": "2026-07-19T00:00:00+00:00+00:00", "last_s2_at": "2026-07-01T00:00:00Z"}
    assert ingest.due_sources(meta, now) == ["s2"] and ingest.due_sources({}, now) == ["arxiv", "s2"]
    ran = []
    runners = {n: lambda n=n: ran.append(n) for n in ("arxiv", "s2")}
    assert ingest.schedule("all", meta, now, runners, lambda: ran.append("sync")) == ["s2", "sync"] == ran
    assert ingest.schedule("arxiv", meta, now, runners, lambda: ran.append("sync")) == ["arxiv"]


def test_metadata(spark, tmp_path):
    path = str(tmp_path / "m")
    export.write_meta(spark, path, 3, "t1", arxiv=True)
    assert export.write_meta(spark, path, 4, "t2", s2=True) == {"built_at": "t2", "last_arxiv_at": "t1", "last_s2_at": "t2", "corpus_size": 4, "schema_version": 2}
    (tmp_path / "bad").write_text("{")
    assert export.read_json(spark, str(tmp_path / "bad"), {"x": 1}) == {"x": 1} == export.read_json(spark, str(tmp_path / "none"), {"x": 1})
    export.write_json(spark, str(tmp_path / "w"), {"fame": 0.5, "hype": 0.1, "sniper": 0.2, "utility": 0.2})
    assert export.read_weights(spark, str(tmp_path / "w"))["fame"] == 0.5 and export.read_weights(spark, path)["fame"] == 0.84


def test_training(spark):
    rows = spark.createDataFrame([("TRAIN_1", "a"), ("TEST_1", "b")], "dataset string, paper_id string")
    assert [d.count() for d in training.split(rows)] == [1, 1]
    few = spark.createDataFrame([("a", 1, 0.3), ("b", 10, 0.9)], "paper_id string, actual int, predicted double")
    got = training.precision_at(few, "predicted", "actual").first()
    assert got.precision == pytest.approx(0.1)
