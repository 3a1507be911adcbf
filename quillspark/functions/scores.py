"""Dates, vectors and scores as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.functions.text import hype, sniper


def year_of(date: Column) -> Column:
    """First four characters as a year, 0 if they are none."""
    return F.coalesce(date.substr(1, 4).try_cast("int"), F.lit(0))


def day_of(date: Column) -> Column:
    """The date of an ISO text; 2024-01-01 if it has no day, or none that exists."""
    return F.coalesce(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), date.substr(1, 10).try_cast("date")), F.lit("2024-01-01").cast("date"))


def age_days(day: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), day)


def recency(day: Column, as_of: str, days: int = V.RECENCY_DAYS) -> Column:
    """1 for today falling to 0 at ``days``; future days count as today."""
    age = F.greatest(age_days(day, as_of), F.lit(0))
    return F.when(age >= days, 0.0).otherwise(1.0 - age / float(days))


def fame(citations: Column) -> Column:
    return F.when(citations > 0, F.least(F.log(citations + 1) * 8, F.lit(95.0))).otherwise(0.0)


def too_new(citations: Column, day: Column, as_of: str) -> Column:
    """No author citations are known and the paper is at most five days old."""
    return (F.coalesce(citations, F.lit(0)) <= 0) & (age_days(day, as_of) <= V.FRESH_DAYS)


def impact(title: Column, citations: Column, day: Column, utility: Column, as_of: str, quality: str = "any", learned: dict[str, float] | None = None) -> Column:
    """Weighted sum of fame, hype, niche penalty and utility; -1 for papers too new to rate."""
    w = weights(quality, learned)
    total = fame(citations) * w["fame"] + hype(title) * w["hype"] + sniper(title) * w["sniper"] + utility * w["utility"]
    if quality == "recent":
        total = total + recency(day, as_of) * V.RECENCY_BONUS
    return F.when(too_new(citations, day, as_of), -1.0).otherwise(total)


def weights(quality: str = "any", learned: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of a quality if it has its own, else learned ones, else the default."""
    return V.QUALITY_WEIGHTS.get(quality) or learned or V.DEFAULT_WEIGHTS


def bullets(citations: Column, day: Column, as_of: str) -> Column:
    """Explanation of the fame part, without emphasis marks."""
    tier = F.when(citations > 3000, "Distribution: High influence author/lab.").when(citations > 500, "Reach: Established track record.").when(citations > 100, "Momentum: Authors have prior traction.").otherwise("Emerging: Newer authors; relies on merit.")
    return F.when(citations > 0, tier).when(too_new(citations, day, as_of), "Too new for impact score: Citation data unavailable. Ranked by relevance only.").otherwise("Emerging: Unknown authors.")


def llm_score(raw: Column) -> Column:
    """Ten times the score of a JSON answer, fenced or bare; 50 where there is none or it is no number."""
    body = F.trim(F.regexp_replace(raw, r"```(?:json)?", ""))
    return F.coalesce(F.get_json_object(body, "$.score").try_cast("double"), F.lit(5.0)) * 10


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, 0 for vectors of unequal length."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 on null, empty, unequal or zero vectors."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n), F.lit(0.0))


def cosine_to(vectors: Column, query: list[float]) -> Column:
    """Cosine of each vector to one query, 0 on null, unequal or zero vectors.

    For long vectors a batch product in Arrow batches takes a third of the time of the
    element-wise expression, which cannot be compiled.
    """
    q = np.array(query, np.float64)
    size = float(np.sqrt((q * q).sum()))

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        out = np.zeros(len(v))
        ok = pc.fill_null(pc.equal(pc.list_value_length(v), len(q)), False)
        rows, kept = np.flatnonzero(ok.to_numpy(zero_copy_only=False)), v.filter(ok)
        for at in range(0, len(kept), 2000):  # the floats of the batch as they lie, no object per row
            x = kept.slice(at, 2000).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            n = np.sqrt(np.einsum("ij,ij->i", x, x)) * size
            out[rows[at : at + 2000]] = np.nan_to_num(np.where(n > 0, x @ q / np.where(n > 0, n, 1.0), 0.0))
        return pa.array(out)

    return run(vectors)


def month_bounds(as_of: Column, months_ago: int) -> tuple[Column, Column]:
    """First and last day of the month that lies ``months_ago`` before a date."""
    start = F.add_months(F.trunc(as_of, "MM"), -months_ago)
    return start, F.last_day(start)


def repaired_time(c: Column) -> Column:
    """A timestamp text with Z or a doubled offset, as a time in UTC; null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "Z$", "+00:00"), r"(\+00:00)+$", "+00:00"))


def due(last: Column, now: Column, days: int) -> Column:
    """Whether a job that ran last at a time is due again; one that never ran is."""
    return last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= days * 86400)
