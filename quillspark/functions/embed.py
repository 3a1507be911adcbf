"""Deterministic stand-ins for the encoders and scorers that a deployment plugs in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import tokens

DIM = 256


def hash_vector(text: str | None, dim: int = DIM) -> list[float]:
    """Unit vector of hashed word counts; zeros for a text without words."""
    v = np.zeros(dim)
    for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
        h = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        v[h % dim] += 1.0 if h >> 31 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def hash_embed(text: Column) -> Column:
    """Feature-hashing embedder as an Arrow batch function."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(hash_vector)

    return run(text)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of query words in the text, scaled as a raw pair score."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return 4.0 * F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)) - 2.0
