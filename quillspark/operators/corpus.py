"""Scans of the corpus and the predicates on it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.functions.scores import day_of, year_of
from quillspark.functions.text import any_of, holds_any
from quillspark.schema import PAPERS


def corpus(papers: DataFrame) -> DataFrame:
    """The query-side view: lists decoded, blanks null, counts and dates filled; rows without an id are left out."""
    return papers.where("arxiv_id is not null").select(
        F.col("arxiv_id").alias("paper_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.coalesce(F.from_json("authors", "array<string>"), F.array()).alias("authors"),
        F.coalesce("authors", F.lit("[]")).alias("authors_json"),
        F.coalesce("fields_of_study", F.lit("[]")).alias("fields_json"),
        day_of(F.col("submitted_date")).alias("submitted"),
        year_of(F.col("submitted_date")).alias("year"),
        F.nullif("venue", F.lit("")).alias("venue"),
        F.nullif("source", F.lit("")).alias("source"),
        F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
        F.coalesce("max_author_citations", F.lit(0)).alias("max_author_citations"),
        F.coalesce("pdf_url", F.lit("")).alias("pdf_url"),
        F.coalesce("has_embedding", F.lit(False)).alias("has_embedding"),
        "vector",
    )


def open_or_create(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path; an empty one of the fixed schema is written first if there is none."""
    spark.createDataFrame([], PAPERS).write.mode("ignore").parquet(path)  # writes only where nothing is
    return spark.read.schema(PAPERS).parquet(path)


def window(option: str, as_of: str) -> tuple[str, str]:
    """First and last day of a named date window."""
    from datetime import date, timedelta

    end = date.fromisoformat(as_of)
    if option == "All Time":
        return "2000-01-01", as_of
    if option not in V.WINDOW_DAYS:
        raise ValueError(f"unknown date window: {option}")
    return (end - timedelta(days=V.WINDOW_DAYS[option])).isoformat(), as_of


def in_window(start: str, end: str) -> Column:
    """The date window, with the years it implies spelled out so that a table partitioned by year is pruned."""
    return F.col("submitted").between(start, end) & (F.col("year").between(int(start[:4]), int(end[:4])) | (F.col("year") == 0) | F.lit(start <= "2024-01-01" <= end))


def in_category(category: str | None) -> Column:
    return F.lit(True) if category in (None, "All") else F.col("fields_json").contains(category)


def in_subcategories(codes: list[str]) -> Column:
    """The first two words of a code's name, connectors aside, in title or abstract, or the code among the fields; any code will do."""
    out = []
    for code in codes:
        words = [w for w in V.CATEGORIES.get(code, code).split() if w.lower() not in ("and", "or", "of")][:2]
        phrase = " ".join(words)
        out.append(F.col("title").contains(phrase) | F.col("abstract").contains(phrase) | F.col("fields_json").contains(code))
    return any_of(out) if out else F.lit(True)


def scan(papers: DataFrame, start: str, end: str, category: str | None = None, codes: list[str] | None = None, cap: int = V.SCAN_CAP, with_vector: bool = False) -> DataFrame:
    """Papers of a date window, newest first; the cap is the interactive scan's own limit."""
    rows = corpus(papers).where(in_window(start, end) & in_category(category))
    if codes and category != "All":
        rows = rows.where(in_subcategories(codes))
    return (rows if with_vector else rows.drop("vector")).orderBy(F.desc("submitted"), "paper_id").limit(cap)


def names_term(terms: list[str]) -> Column:
    """Whether title or abstract contain one of the terms, letter case aside."""
    return holds_any(F.lower(F.concat_ws(" ", "title", "abstract")), [t.lower() for t in terms])


def without_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    return rows.where(~names_term(terms)) if terms else rows


def venue_filter(rows: DataFrame, kind: str, category: str | None = None, venues: list[str] | None = None) -> DataFrame:
    """All conferences, all journals, or given venues of a category; no kind keeps all, an unknown one nothing."""
    if kind == "None":
        return rows
    low = F.lower(F.coalesce("venue", F.lit("")))
    words = {"All Conferences": V.CONFERENCES, "All Journals": V.JOURNALS}.get(kind, (venues or []) if kind == "Specific Venue" and category in ("Conference", "Journal") else [])
    return rows.where(holds_any(low, [w.lower() for w in words]))


def quality_filter(quality: str) -> Column:
    year, cites = F.col("year"), F.col("citation_count")
    return {"recent": year >= 2023, "influential": cites >= 50, "emerging": (year >= 2023) & (cites < 20), "classic": year <= 2018}.get(quality, F.lit(True))


def year_filter(low: int | None, high: int | None) -> Column:
    return all_of([F.col("year") >= low if low is not None else None, F.col("year") <= high if high is not None else None])


def entity_filter(authors: list[str], venues: list[str]) -> Column:
    """Any of the authors and any of the venues; names are reduced to safe literals and skipped if nothing is left."""
    groups = []
    for column, names in (("authors_json", authors), ("venue", venues)):
        safe = [n for n in map(safe_name, names) if n]
        if safe:
            groups.append(holds_any(F.col(column), safe))
    return all_of(groups)


def safe_name(name: str) -> str:
    """The same reduction of a name as ``like_literal``, for a name known when the query is built."""
    return re.sub(r"[-\s]{2,}", " ", re.sub(r"[^0-9A-Za-z .\-&]", "", name))[:60].strip()


def all_of(parts: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def new_ids(incoming: DataFrame, existing: DataFrame, key: str, existing_key: str | None = None) -> DataFrame:
    return incoming.join(existing.select(F.col(existing_key or key).alias(key)), key, "left_anti")


def known_ids(incoming: DataFrame, existing: DataFrame, key: str, existing_key: str | None = None) -> DataFrame:
    return incoming.join(existing.select(F.col(existing_key or key).alias(key)), key, "left_semi")


def pending(papers: DataFrame) -> DataFrame:
    """Rows still to be embedded, newest first."""
    return corpus(papers).where(~F.col("has_embedding")).orderBy(F.desc("submitted"), "paper_id")
