"""Exports: Markdown sections, logs, metadata and weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.sources.shared import read_json, write_json


def markdown(ranked: DataFrame) -> DataFrame:
    """(rank, section): one section of Markdown per ranked row."""
    score = F.when(F.col("too_new"), "Too new to rate").otherwise(F.round("impact").cast("long").cast("string"))
    lines = [F.concat(F.lit("## #"), F.col("rank").cast("string"), F.lit(": "), F.col("title")), F.concat(F.lit("- **Impact score:** "), score), F.concat(F.lit("- **Focus:** "), F.col("focus")), F.concat(F.lit("- **Link:** "), F.col("paper_id")), F.lit(""), F.concat(F.lit("**Abstract:** "), F.col("abstract")), F.lit("---")]
    return ranked.select("rank", F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in lines]).alias("section"))


def write_markdown(ranked: DataFrame, path: str) -> None:
    markdown(ranked).orderBy("rank").select("section").write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_meta(spark: SparkSession, path: str, rows: int, now: str, arxiv: bool = False, s2: bool = False) -> dict:
    """Index metadata; a source's last time is carried forward unless it ran."""
    old = read_json(spark, path, {})
    meta = {"built_at": now, "last_arxiv_at": now if arxiv else old.get("last_arxiv_at"), "last_s2_at": now if s2 else old.get("last_s2_at"), "corpus_size": rows, "schema_version": 2}
    write_json(spark, path, meta)
    return meta


def bootstrap(spark: SparkSession, path: str | None, held: dict, warm: Callable[[], object] | None = None) -> dict:
    """The metadata of a deployment, read once per process into ``held``, and its models warmed up.

    Without a path nothing is read. A failure is not fatal: the next call tries again.
    """
    if path and "meta" not in held:
        meta = read_json(spark, path, {})
        if meta:
            held["meta"] = meta
    if warm and not held.get("warm"):
        try:
            warm()
            held["warm"] = True
        except Exception:  # models load again on first use
            held["warm"] = False
    return held.get("meta", {})


def read_weights(spark: SparkSession, path: str | None) -> dict[str, float]:
    """The learned weights of a folder; the fixed ones where it is missing, unreadable or not four numbers."""
    got = read_json(spark, path, {}) if path else {}
    fit = set(got) == set(V.DEFAULT_WEIGHTS) and all(isinstance(w, (int, float)) for w in got.values())
    return {n: float(w) for n, w in got.items()} if fit else dict(V.DEFAULT_WEIGHTS)


def stale(checked: Column, now: Column, held: Column, offered: Column, every: int = 1800) -> Column:
    """Whether a copy is to be fetched again: the last check lies ``every`` seconds back, or never was, and the stored tag is another."""
    due = checked.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(checked) >= every)
    return due & offered.isNotNull() & ~held.eqNullSafe(offered)


def for_display(ranked: DataFrame) -> DataFrame:
    """Result columns under the names that the user interface reads."""
    return ranked.withColumnsRenamed({"relevance": "rel", "too_new": "tooNew", "arxiv_url": "arxiv", "pdf_url": "pdf"})
