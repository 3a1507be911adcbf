"""Corpus maintenance: ingestion in stages, embedding in committed chunks, and the schedule."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.corpus import pending
from quillspark.operators.merge import backfill_citations, latest, upsert, write_vectors
from quillspark.operators.ranking import chunks
from quillspark.plans.export import write_meta
from quillspark.schema import PAPERS, VECTOR_DIM
from quillspark.sources.records import parse_raw, table_row

CADENCE = {"arxiv": timedelta(days=2), "s2": timedelta(days=15)}


def run_stages(stages: list[tuple[str, Callable[[], int]]]) -> dict[str, int | str]:
    """Result of each stage; one that fails does not stop the others."""
    out: dict[str, int | str] = {}
    for name, stage in stages:
        try:
            out[name] = stage()
        except Exception as e:
            out[name] = f"failed: {e}"
    return out


def merge_into(spark: SparkSession, incoming: DataFrame, source: str, target: str, order: list[str]) -> dict[str, int]:
    """Upsert records, the last of each key, from one version of the table into the next; counts by action."""
    merged = upsert(spark.read.schema(PAPERS).parquet(source), latest(incoming, "arxiv_id", order))
    merged.select(*PAPERS.names, "action").write.mode("overwrite").partitionBy("action").parquet(target)
    return {r["action"]: r["count"] for r in spark.read.parquet(target).groupBy("action").count().collect()}


def embed_in_chunks(table: DataFrame, path: str, embed: Callable, size: int = 2000) -> DataFrame:
    """Embeddings (chunk, arxiv_id, vector) of the rows that lack one, newest first, committed chunk by chunk under a path.

    A chunk is a partition of the folder. A run that was cut short goes on with the chunks that are not
    there yet: the order of the chunks is written down before the first is made, so it stays the same.
    """
    spark = table.sparkSession
    # the plan is written once; a later run finds it and keeps it
    todo = pending(table).select("paper_id", "submitted", F.concat_ws(" ", "title", "abstract").alias("text"))
    numbered = chunks(todo.withColumn("age", -F.unix_date("submitted")), ["age", "paper_id"], size)
    numbered.select("paper_id", "text", F.col("chunk").cast("int").alias("chunk")).write.mode("ignore").partitionBy("chunk").parquet(f"{path}/plan")
    plan = spark.read.schema("paper_id string, text string, chunk int").parquet(f"{path}/plan")
    spark.createDataFrame([], "arxiv_id string, vector array<float>, chunk int").write.mode("ignore").parquet(f"{path}/made/chunk=-1")
    made = spark.read.schema("arxiv_id string, vector array<float>, chunk int").parquet(f"{path}/made")
    done = {r.chunk for r in made.select("chunk").distinct().collect()}
    for c in sorted({r.chunk for r in plan.select("chunk").distinct().collect()} - done):
        part = plan.where(F.col("chunk") == c).select(F.col("paper_id").alias("arxiv_id"), embed(F.col("text")).cast("array<float>").alias("vector"))
        part.write.mode("overwrite").parquet(f"{path}/made/chunk={c}")
    return spark.read.schema("arxiv_id string, vector array<float>, chunk int").parquet(f"{path}/made").where("chunk >= 0")


def embed_pending(spark: SparkSession, source: str, target: str, embed: Callable, dim: int = VECTOR_DIM, size: int = 2000) -> int:
    """Embed the rows that lack an embedding, in committed chunks beside the target, and write the next version with them."""
    table = spark.read.schema(PAPERS).parquet(source)
    made = embed_in_chunks(table, f"{target}-chunks", embed, size)
    write_vectors(table, made.select("arxiv_id", F.col("chunk").alias("position"), "vector"), dim).write.mode("overwrite").parquet(target)
    return made.count()


def scout_analyse_enrich(spark: SparkSession, base: str, raw: DataFrame, embed: Callable, answers: DataFrame, dim: int = VECTOR_DIM) -> dict[str, int | str]:
    """The three stages of ingestion over versions of a table under ``base``: records merged in, rows embedded, author citations filled in.

    ``raw`` holds JSON texts (raw, position). Each stage reads the last version that a stage before it completed.
    """
    done = [f"{base}/v0"]
    spark.createDataFrame([], PAPERS).write.mode("ignore").parquet(done[0])

    def scout() -> int:
        rows = table_row(parse_raw(raw, "raw")).withColumn("o", F.monotonically_increasing_id())
        merge_into(spark, rows, done[-1], f"{base}/v1", ["o"])
        done.append(f"{base}/v1")
        return spark.read.parquet(done[-1]).count()

    def analyse() -> int:
        n = embed_pending(spark, done[-1], f"{base}/v2", embed, dim)
        done.append(f"{base}/v2")
        return n

    def enrich() -> int:
        table = backfill_citations(spark.read.schema(PAPERS).parquet(done[-1]), answers)
        table.select(*PAPERS.names).write.mode("overwrite").parquet(f"{base}/v3")
        done.append(f"{base}/v3")
        return spark.read.parquet(done[-1]).where("max_author_citations > 0").count()

    return run_stages([("scout", scout), ("analyse", analyse), ("enrich", enrich)])


def due_sources(meta: dict, now: datetime) -> list[str]:
    """Sources whose last run lies a cadence back, or that never ran. A doubled offset in a time is read as one."""

    def last(name: str) -> datetime | None:
        text = (meta.get(f"last_{name}_at") or "").replace("Z", "+00:00")
        while text.count("+00:00") > 1:
            text = text.replace("+00:00+00:00", "+00:00")
        return datetime.fromisoformat(text) if text else None

    return [n for n, gap in CADENCE.items() if (t := last(n)) is None or now - t >= gap]


def schedule(mode: str, meta: dict, now: datetime, runners: dict[str, Callable[[], object]], sync: Callable[[], object]) -> list[str]:
    """Run what a mode asks for: one source, a sync, or all that are due followed by a sync. The names that ran."""
    if mode == "sync":
        sync()
        return ["sync"]
    names = due_sources(meta, now) if mode == "all" else [mode]
    for n in names:
        runners[n]()
    if mode == "all" and names:
        sync()
        return [*names, "sync"]
    return names


def record_build(path: str, table: DataFrame, now: str, sources: list[str]) -> dict:
    return write_meta(table.sparkSession, path, table.count(), now, "arxiv" in sources, "s2" in sources)
