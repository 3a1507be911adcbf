"""The search pipeline from a request to a ranked result, as a generator of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.functions import scores as S
from quillspark.functions import text as X
from quillspark.operators import corpus as C
from quillspark.operators import ranking as K
from quillspark.operators import retrieval as R
from quillspark.plans import brief as B
from quillspark.plans import export
from quillspark.schema import VECTOR_DIM
from quillspark.sources import services


@dataclass(frozen=True)
class Request:
    query: str
    exclude: str = ""
    date_range: str = "Last Month"
    top_n: int = 5
    provider: str = "free"
    model: str = ""
    key: str = ""

    def __post_init__(self):
        if self.provider not in V.PROVIDERS:
            raise ValueError(f"unknown provider: {self.provider}")
        if self.date_range not in (*V.WINDOW_DAYS, "All Time"):
            raise ValueError(f"unknown date window: {self.date_range}")
        if not 1 <= self.top_n <= 10:
            raise ValueError("top_n must lie between 1 and 10")


@dataclass(frozen=True)
class Models:
    """What a deployment plugs in; all are optional."""

    embed_query: Callable[[str], list[float]] | None = None
    embed: Callable[[Column], Column] | None = None
    score_pair: Callable[[Column, Column], Column] | None = None
    utility: Callable[[Column], Column] | None = None
    complete: Callable[[str], str] | None = None
    lookup: Callable[[str, dict, dict], str] | None = None
    weights: str | None = None  # folder of the learned weights
    tiers: tuple = ()


def understanding(q: B.Query) -> dict:
    """What a result tells of how its brief was read."""
    f = q.filters
    return {"intent": q.intent, "terms": list(q.keywords), "not_terms": list(f.not_terms), "quality": q.quality, "source": q.source, "window": f.window, "authors": list(f.authors), "venues": list(f.venues), "criteria": [{"name": n, "definition": d, "strength": s} for n, d, s in q.criteria]}


def probe(papers: DataFrame) -> list[float]:
    """Vector of the first usable row by id."""
    row = papers.where(F.col("has_embedding") & (F.size("vector") == VECTOR_DIM)).orderBy("arxiv_id").select("vector").first()
    return [float(x) for x in row["vector"]] if row else [0.0] * VECTOR_DIM


def stages() -> list[tuple[int, str]]:
    """The stages of a search by number."""
    return list(enumerate(V.STAGES))


def health(papers: DataFrame) -> dict:
    """Whether a table can be searched: its rows and those with an embedding."""
    row = papers.agg(F.count("*").alias("papers"), F.count_if("has_embedding").alias("embedded")).first()
    return {"status": "ok" if row.papers else "empty", "papers": row.papers, "embedded": row.embedded}


def stage_of(message: str) -> int:
    """Stage of a progress message by the first marker it holds."""
    return next((n for marker, n in V.STAGE_MARKERS if marker in message), 1)


def candidates(rows: DataFrame, q: B.Query, vector: list[float] | None, models: Models = Models()) -> DataFrame:
    """Retrieval over a pool: filters relaxed as far as needed, both arms fused, reranked by vector and pair."""
    f = q.filters
    k, depth = R.adaptive_k(rows.count())
    dates = C.year_filter(f.year_from, f.year_to) if f.year_from or f.year_to else None
    entities = C.entity_filter(list(f.authors), list(f.venues)) if f.authors or f.venues else None
    rung, keep = R.ladder(rows, C.quality_filter(q.quality), dates, entities, k)
    pool = C.without_terms(rows.where(keep), list(f.not_terms))
    w_vector, w_text = q.weights
    terms = [w for kw in q.keywords for w in kw.split()]
    top = R.hybrid(pool, terms, vector, k if rung == 1 else 1200, depth, w_text, w_vector)
    chosen = pool.join(top, "paper_id")
    reranked = R.rerank(chosen, vector, models.embed) if vector else chosen.withColumn("similarity", F.col("rrf"))
    return R.pair_rerank(reranked, q.statement, models.score_pair)


def search(papers: DataFrame, request: Request, as_of: str, models: Models = Models(), cache: dict | None = None) -> Iterator[dict]:
    """Events: a stage begins and ends, then either done with the result or error with a message."""
    cache = {} if cache is None else cache

    def event(i: int, status: str, detail: str = "") -> dict:
        return {"type": "stage", "index": i, "status": status, "name": V.STAGES[i], "detail": detail}

    yield event(0, "running")
    rows = C.scan(papers, *C.window(request.date_range, as_of), with_vector=True)
    unwanted = [t.strip().lower() for t in request.exclude.replace("\n", ",").replace(";", ",").split(",") if t.strip()]
    rows = C.without_terms(rows, unwanted).persist()  # the scan's cap bounds it; counted and searched several times
    if rows.isEmpty():
        yield {"type": "error", "message": "No papers in this window."}
        return
    yield event(0, "done")
    yield event(1, "running")
    parts = [(V.BRIEF_HEADER + "\n", request.query.strip()), (V.NOT_HEADER + ":\n", request.exclude.strip())]
    text = "\n\n".join(h + t for h, t in parts if t) or V.NO_BRIEF
    key = text.strip().lower()
    q = cache.get(key) or cache.setdefault(key, B.analyse(text, models.tiers, int(as_of[:4])))
    vector = models.embed_query(q.statement) if models.embed_query else None
    found = candidates(rows, q, vector, models)
    yield event(1, "done")
    yield event(4, "running")
    labelled = K.classify(found)
    chosen = K.scoring_set(labelled)
    if chosen.isEmpty():
        yield {"type": "error", "message": "Nothing relevant was found."}
        return
    yield event(4, "done")
    yield event(5, "running")
    if models.lookup:
        chosen = services.lookup_citations(chosen, models.lookup)
    if models.utility:
        score = S.impact(F.col("title"), F.col("max_author_citations"), F.col("submitted"), models.utility(F.col("abstract")), as_of, q.quality, export.read_weights(papers.sparkSession, models.weights))
        rated = chosen.withColumn("impact", score)
    else:
        rated = K.heuristic_impact(chosen)
    reasons = R.highlights(rated, [w for kw in q.keywords for w in kw.split()])
    signals = X.artifact_flags(F.col("abstract"), F.col("pdf_url"))
    final = K.result_row(K.final_rank(rated)).withColumns(signals).withColumn("kind", X.paper_type(F.col("abstract"))).withColumn("why", S.bullets(F.col("max_author_citations"), F.col("submitted"), as_of))
    yield event(5, "done")
    result = final.join(reasons, "paper_id", "left").orderBy("rank")
    told = services.summarised(result, models.complete, request.top_n).orderBy("rank")
    yield {"type": "done", "query": q, "understanding": understanding(q), "window": q.filters.window, "papers": told, "summarise": told.where(F.col("rank") <= request.top_n)}
