"""Services played back from tables, for runs without a network: pages of the bulk service, and citation answers made of the request."""

from __future__ import annotations

import json

from quillspark.sources import services

PAGE = 400


def bulk_service(folder: str):
    """A transport that answers bulk requests from the records of a folder, ``PAGE`` rows at a time."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/s2_records.parquet", columns=["rec_id", "s2_id", "title", "authors", "year", "publication_date", "venue", "citation_count"]).sort_by("rec_id")

    def send(url: str, params: dict, headers: dict) -> str:
        at = int(params.get("token") or 0)
        rows = table.slice(at, PAGE).to_pylist()
        data = [{"paperId": r["s2_id"], "title": r["title"], "authors": [{"name": a} for a in r["authors"] or []], "year": r["year"], "publicationDate": r["publication_date"], "venue": r["venue"], "citationCount": r["citation_count"]} for r in rows]
        return json.dumps({"data": data, "token": str(at + PAGE) if at + PAGE < table.num_rows else None})

    return send


def bulk_pages(query: str, token: str | None) -> tuple[list[str], str | None]:
    """``fetch`` of the paged source; the query names the folder."""
    return services.bulk_page(None, "2000-01-01", token, bulk_service(query))


def citations(url: str, params: dict, headers: dict) -> str:
    """Answers of the lookup: arXiv ids have as many citations as letters, other ids none, and titles as many as letters."""
    if url.startswith(services.PAPER_URL + "ARXIV:"):
        return json.dumps({"authors": [{"citationCount": None}, {"citationCount": len(url.rpartition(":")[2])}]})
    if url == services.SEARCH_URL and params["query"]:
        return json.dumps({"data": [{"title": params["query"], "authors": [{"citationCount": len(params["query"])}, {}]}]})
    return json.dumps({"data": []} if url == services.SEARCH_URL else {})


def first_line(prompt: str) -> str:
    """A stand-in for a language model: the title of the prompt, in capitals."""
    return prompt.split("\nTitle: ")[1].split("\nAbstract: ")[0].upper()
