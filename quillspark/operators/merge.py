"""Merging records into the corpus table: upsert, backfill, vector write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scores import year_of

COALESCED = ["title", "abstract", "authors", "submitted_date", "venue", "fields_of_study", "pdf_url", "arxiv_url", "source", "doi", "s2_id"]
COUNTED = ["citation_count", "max_author_citations"]


def latest(incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in the given order."""
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def upsert(table: DataFrame, incoming: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The table after merging rows of unique keys, with an ``action``: inserted, updated or kept.

    A new key is inserted without an embedding. Of a known one, texts are replaced unless the new one is
    blank, counts take the larger, the year is read again, and a changed title or abstract drops the
    embedding. Rows whose key is not among the incoming ones are told apart first and never joined further:
    where the incoming keys are few enough for Spark to broadcast them, no row of theirs, vectors
    included, is shuffled; a full join merges the rest.
    """
    keys = incoming.select(key).where(F.col(key).isNotNull()).distinct()
    kept, touched = table.join(keys, key, "left_anti"), table.join(keys, key, "left_semi")
    return merged_rows(touched, incoming, key).unionByName(kept_rows(kept, key))


def blank_of(column: str) -> str:
    """What stands for an unknown text or list."""
    return "[]" if column in ("authors", "fields_of_study") else ""


def kept_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows that nothing is merged into, in the form of merged ones."""
    return rows.select(
        key,
        *[F.coalesce(c, F.lit(blank_of(c))).alias(c) for c in COALESCED],
        *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in COUNTED],
        "year",
        F.coalesce("has_embedding", F.lit(False)).alias("has_embedding"),
        "vector",
        F.lit("kept").alias("action"),
    )


def merged_rows(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    known, fresh = F.col("o._known").isNotNull(), F.col("n._fresh").isNotNull()
    joined = table.withColumn("_known", F.lit(1)).alias("o").join(incoming.select(key, *COALESCED, *COUNTED).withColumn("_fresh", F.lit(1)).alias("n"), key, "full")
    text = {c: F.coalesce(F.when(~F.coalesce(F.col(f"n.{c}"), F.lit("")).isin("", "[]"), F.col(f"n.{c}")), F.col(f"o.{c}"), F.lit(blank_of(c))) for c in COALESCED}
    count = {c: F.greatest(F.coalesce(f"o.{c}", F.lit(0)), F.coalesce(f"n.{c}", F.lit(0))) for c in COUNTED}
    changed = fresh & known & ((text["title"] != F.coalesce("o.title", F.lit(""))) | (text["abstract"] != F.coalesce("o.abstract", F.lit(""))))
    keep = known & ~changed
    year = F.when(fresh, year_of(text["submitted_date"])).otherwise(F.col("o.year"))
    action = F.when(~known, "inserted").when(fresh, "updated").otherwise("kept")
    return joined.select(
        key,
        *[v.alias(c) for c, v in text.items()],
        *[v.alias(c) for c, v in count.items()],
        year.alias("year"),
        F.when(keep, F.coalesce("o.has_embedding", F.lit(False))).otherwise(False).alias("has_embedding"),
        F.when(keep, F.col("o.vector")).alias("vector"),
        action.alias("action"),
    )


def backfill_citations(table: DataFrame, answers: DataFrame) -> DataFrame:
    """The table with author citations filled in by ``s2_id`` from (s2_id, authors array of counts): the largest, where the row has none and it is positive."""
    best = answers.select("s2_id", F.coalesce(F.array_max("counts"), F.lit(0)).alias("most")).where("most > 0").groupBy("s2_id").agg(F.max("most").alias("most"))
    missing = (F.coalesce(F.col("max_author_citations"), F.lit(0)) == 0) & (F.coalesce(F.col("s2_id"), F.lit("")) != "")
    return table.join(best, "s2_id", "left").withColumn("max_author_citations", F.when(missing & F.col("most").isNotNull(), F.col("most")).otherwise(F.coalesce("max_author_citations", F.lit(0)))).drop("most")


def write_vectors(table: DataFrame, vectors: DataFrame, dim: int, key: str = "arxiv_id") -> DataFrame:
    """The table with vectors (key, position, vector) set together with their flag; the last position of a key wins, unknown keys are skipped, other lengths raise."""
    checked = vectors.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit("vector of another length")).cast("array<float>")))
    last = checked.groupBy(key).agg(F.max_by("vector", "position").alias("_v"))
    out = table.join(last, key, "left")
    return out.withColumns({"has_embedding": F.col("_v").isNotNull() | F.coalesce("has_embedding", F.lit(False)), "vector": F.coalesce("_v", "vector")}).drop("_v")


def reset_embeddings(table: DataFrame) -> DataFrame:
    return table.withColumn("has_embedding", F.lit(False))
