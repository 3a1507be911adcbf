"""Sources of bibliographic records: raw JSON, Atom entries, and paged services."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.text import one_line, venue_of
from quillspark.schema import RAW_RECORD


def parse_raw(rows: DataFrame, column: str) -> DataFrame:
    """Records of the bulk interface's JSON texts; unreadable ones and those without any id are dropped.

    Without an arXiv id the key is made from the other one. Missing links are made from the id. A
    missing date is the first day of the year, unknown if the year is, too. ArXiv is no venue.
    """
    r = rows.select(F.from_json(column, RAW_RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    arxiv, s2 = F.nullif("r.externalIds.ArXiv", F.lit("")), F.nullif("r.paperId", F.lit(""))
    key = F.coalesce(arxiv, F.concat(F.lit("s2:"), s2))
    pdf = F.coalesce(F.nullif("r.openAccessPdf.url", F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv), F.lit(""))
    page = F.coalesce(F.nullif("r.url", F.lit("")), F.concat(F.lit("https://arxiv.org/abs/"), arxiv), F.concat(F.lit("https://www.semanticscholar.org/paper/"), s2))
    return r.where(key.isNotNull()).select(
        key.alias("arxiv_id"),
        F.coalesce(s2, F.lit("")).alias("s2_id"),
        one_line(F.col("r.title")).alias("title"),
        one_line(F.col("r.abstract")).alias("abstract"),
        F.coalesce(F.transform("r.authors", lambda a: F.coalesce(a["name"], F.lit(""))), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.nullif("r.publicationDate", F.lit("")), F.concat(F.col("r.year").cast("string"), F.lit("-01-01"))).alias("submitted_date"),
        F.when(~F.lower("r.venue").isin("arxiv", "arxiv.org"), F.col("r.venue")).alias("venue"),
        F.coalesce("r.citationCount", F.lit(0)).alias("citation_count"),
        F.lit(0).alias("max_author_citations"),
        pdf.alias("pdf_url"),
        page.alias("arxiv_url"),
        F.coalesce(F.transform("r.s2FieldsOfStudy", lambda f: F.coalesce(f["category"], F.lit(""))), F.array().cast("array<string>")).alias("fields_of_study"),
    )


def parse_atom(entries: DataFrame, now: str) -> DataFrame:
    """Records of Atom entries (id, title, summary, published, authors, categories, comment, journal_ref).

    The key is what follows ``/abs/`` without its version; longer than 30 characters, with a space or
    with "error" it is none. Tags that are no links follow the field's name.
    """
    key = F.regexp_replace(F.regexp_extract("id", r"/abs/(.+)$", 1), r"v\d+$", "")
    venue = F.coalesce(venue_of(F.col("comment")), F.nullif(F.trim("journal_ref"), F.lit("")))
    return entries.withColumn("key", key).where((F.col("key") != "") & (F.length("key") <= 30) & ~F.col("key").contains(" ") & ~F.col("key").contains("error")).select(
        F.col("key").alias("arxiv_id"),
        one_line(F.col("title")).alias("title"),
        one_line(F.col("summary")).alias("abstract"),
        "authors",
        F.coalesce(F.substring("published", 1, 10), F.lit(now)).alias("submitted_date"),
        venue.alias("venue"),
        F.concat(F.array(F.lit("Computer Science")), F.filter("categories", lambda c: ~c.startswith("http"))).alias("fields_of_study"),
    )


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key in the given order, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def since(rows: DataFrame, cutoff: str) -> tuple[DataFrame, Column]:
    """Rows from a day on, and the expression by which a reader of newest-first pages knows that it may stop."""
    return rows.where(F.col("submitted_date") >= cutoff), F.min("submitted_date") < cutoff


def table_row(records: DataFrame) -> DataFrame:
    """Records as rows of the corpus table: lists as JSON, blanks for nulls, the year read, no embedding."""
    text = ["s2_id", "title", "abstract", "submitted_date", "venue", "pdf_url", "arxiv_url", "source", "doi"]
    have = set(records.columns)
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("Semantic Scholar" if c == "source" else "").alias(c) for c in text]
    return records.select("arxiv_id", *cols, F.to_json("authors").alias("authors"), F.to_json("fields_of_study").alias("fields_of_study"), F.coalesce(F.col("submitted_date").substr(1, 4).try_cast("int"), F.lit(0)).alias("year"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.lit(0).alias("max_author_citations"), F.lit(False).alias("has_embedding"), F.lit(None).cast("array<float>").alias("vector"))


def with_retry(call: Callable[[], object], attempts: int = 4, wait: float = 2.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Result of a call that may fail, retried with doubling waits; the last failure is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(min(longest, wait * 2**i))
    return None


class PagedSource(DataSource):
    """Batch source ``quill_pages`` over a paged service: one partition per query.

    Options: ``queries`` (separated by ``|``) and ``fetch``, the dotted name of a function
    (query, token) -> (list of JSON texts, next token or None) that the executors can import.
    """

    @classmethod
    def name(cls) -> str:
        return "quill_pages"

    def schema(self) -> str:
        return "query string, position int, raw string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries, self.fetch = options["queries"].split("|"), options["fetch"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.fetch.rpartition(".")
        fetch = getattr(importlib.import_module(module), name)
        token, position = None, 0
        while True:
            page, token = with_retry(lambda t=token: fetch(partition.value, t))
            for raw in page:
                yield partition.value, position, raw
                position += 1
            if token is None:
                return


def storage_options(env: dict[str, str]) -> dict[str, str]:
    """Hadoop settings of an S3-compatible bucket from its four values; names those that are missing."""
    names = ["BUCKET_ENDPOINT", "BUCKET_NAME", "BUCKET_KEY_ID", "BUCKET_SECRET"]
    missing = [n for n in names if not env.get(n, "").strip()]
    if missing:
        raise ValueError("missing storage settings: " + ", ".join(missing))
    clean = {n: env[n].strip().strip("'\"") for n in names}
    return {"fs.s3a.endpoint": clean["BUCKET_ENDPOINT"], "fs.s3a.access.key": clean["BUCKET_KEY_ID"], "fs.s3a.secret.key": clean["BUCKET_SECRET"], "fs.s3a.endpoint.region": "auto", "path": f"s3a://{clean['BUCKET_NAME']}"}
