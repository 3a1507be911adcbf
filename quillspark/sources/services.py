"""Clients of the bulk record service, the Atom feed and citation lookups. How a request is sent is the caller's to name."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.sources.records import with_retry

# Addresses, fields and page sizes of the services.
BULK_URL = "https://api.semanticscholar.org/graph/v1/paper/search/bulk"
BULK_FIELDS = "paperId,externalIds,title,abstract,authors,year,publicationDate,venue,citationCount,openAccessPdf,url,s2FieldsOfStudy"
PAPER_URL = "https://api.semanticscholar.org/graph/v1/paper/"
SEARCH_URL = "https://api.semanticscholar.org/graph/v1/paper/search"
FEED_URL = "http://export.arxiv.org/api/query"
BULK_PAGE, FEED_PAGE, FEED_END, WINDOW = 1000, 1000, 10_000, 90

Transport = Callable[[str, dict, dict], str]


def over_http(url: str, params: dict, headers: dict) -> str:
    """The body of a GET request."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers)
    with urllib.request.urlopen(request, timeout=30) as answer:
        return answer.read().decode("utf-8")


def bulk_request(query: str | None, start: str, token: str | None = None) -> dict:
    """Parameters of one page: the whole field where no query is given, records from a day on."""
    about = {"query": query} if query else {"fieldsOfStudy": "Computer Science"}
    return {"publicationDateOrYear": f"{start}:", "fields": BULK_FIELDS, "limit": BULK_PAGE, **about, **({"token": token} if token else {})}


def bulk_queries() -> list[str | None]:
    """The base sweep and one query per sub-category."""
    return [None, *V.CATEGORIES.values()]


def bulk_page(query: str | None, start: str, token: str | None, transport: Transport = over_http, key: str | None = None) -> tuple[list[str], str | None]:
    """(JSON texts, next token) of one page, repeated on failure."""
    body = json.loads(with_retry(lambda: transport(BULK_URL, bulk_request(query, start, token), {"x-api-key": key} if key else {})))
    return [json.dumps(r) for r in body.get("data") or []], body.get("token") or None


def feed_request(category: str, offset: int) -> dict:
    return {"search_query": f"cat:{category}", "start": offset, "max_results": FEED_PAGE, "sortBy": "submittedDate", "sortOrder": "descending"}


def feed_pages(category: str, cutoff: str, transport: Transport = over_http) -> Iterator[str]:
    """Atom pages of a category, newest first, until the oldest entry of a page lies before the cutoff, a page is empty, or the feed's end."""
    import xml.etree.ElementTree as tree

    for offset in range(0, FEED_END, FEED_PAGE):
        body = with_retry(lambda at=offset: transport(FEED_URL, feed_request(category, at), {}))
        days = [e.text[:10] for e in tree.fromstring(body).iter() if e.tag.endswith("published") and e.text]
        if not days:
            return
        yield body
        if min(days) < cutoff:
            return


ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, comment string, journal_ref string"


def feed_entries(pages: DataFrame, column: str) -> DataFrame:
    """Entries of Atom pages (XML texts) as ``records.parse_atom`` reads them; unreadable pages give none."""
    bare = F.regexp_replace(column, r"<(/?)arxiv:", "<$1")
    feed = F.from_xml(bare, f"struct<entry: array<struct<{ENTRY.replace(' string', ': string').replace(' array', ': array')}>>>", {"rowTag": "feed"})
    e = pages.select(F.explode(feed["entry"]).alias("e"))
    return e.select("e.id", "e.title", "e.summary", "e.published", F.coalesce(F.transform("e.author", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"), F.coalesce(F.transform("e.category", lambda c: c["_term"]), F.array().cast("array<string>")).alias("categories"), "e.comment", "e.journal_ref")


def most_cited(answer: dict | None) -> int | None:
    """The largest positive author count of an answer; None if it tells none."""
    counts = [a.get("citationCount") or 0 for a in (answer or {}).get("authors") or []]
    return max((c for c in counts if c > 0), default=None)


def citation_of(paper_id: str | None, title: str | None, transport: Transport) -> int:
    """Most citations of an author: by id, which may be one of either service, else by the best title hit; 0 if unknown."""

    def ask(url: str, params: dict) -> dict | None:
        try:
            return json.loads(with_retry(lambda: transport(url, params, {}), attempts=3, wait=1.0))
        except Exception:  # no answer is no citation, not a failure of the search
            return None

    if paper_id:
        route = paper_id.removeprefix("s2:") if paper_id.startswith("s2:") else "ARXIV:" + paper_id.split("v")[0]
        found = most_cited(ask(PAPER_URL + route, {"fields": "authors.citationCount"}))
        if found is not None:
            return found
    hits = (ask(SEARCH_URL, {"query": title or "", "limit": 1, "fields": "title,citationCount,authors.citationCount"}) or {}).get("data") or [None]
    return most_cited(hits[0]) or 0


def lookup_citations(rows: DataFrame, transport: Transport, at_once: int = 2) -> DataFrame:
    """The rows with ``max_author_citations`` looked up where the table has none; ``at_once`` tasks ask at a time."""
    known = F.coalesce(F.col("max_author_citations"), F.lit(0)) > 0
    missing = rows.where(~known).select("paper_id", "title").repartition(at_once, "paper_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"paper_id": b.paper_id, "found": [citation_of(i, t, transport) for i, t in zip(b.paper_id, b.title)]})

    found = missing.mapInPandas(run, "paper_id string, found int")
    return rows.join(found, "paper_id", "left").withColumn("max_author_citations", F.coalesce("found", "max_author_citations", F.lit(0))).drop("found")


def completed(rows: DataFrame, prompt: Column, complete: Callable[[str], str], key: str = "paper_id", at_once: int = 5, attempts: int = 3) -> DataFrame:
    """(key, answer) of a language model for each prompt; null where it fails ``attempts`` times. ``at_once`` tasks ask at a time."""
    asked = rows.select(key, prompt.alias("prompt")).repartition(at_once, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for p in b.prompt:
                try:
                    answers.append(with_retry(lambda p=p: complete(p), attempts=attempts, wait=1.0))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({key: b[key], "answer": pd.Series(answers, dtype=object)})

    return asked.mapInPandas(run, f"{key} {asked.schema[key].dataType.simpleString()}, answer string")


def summarised(ranked: DataFrame, complete: Callable[[str], str] | None, top: int) -> DataFrame:
    """Ranked rows with a plain-language ``summary`` of the first ``top``, null for the others and without a model."""
    if complete is None:
        return ranked.withColumn("summary", F.lit(None).cast("string"))
    prompt = F.concat(F.lit("Summarise in plain language.\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit("")))
    made = completed(ranked.where(F.col("rank") <= top), prompt, complete).withColumnRenamed("answer", "summary")
    return ranked.join(made, "paper_id", "left")
