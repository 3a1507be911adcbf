"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        path = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN_DIR[app] = "file://" + path
    return _OWN_DIR[app]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and no executor's loss can undo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a dictionary table (venues, sources) that may be gathered and sent to all tasks.
DICTIONARY_ROWS = 200_000


def dictionary(df: DataFrame) -> list[tuple]:
    """All rows of a dictionary table; an error if it is longer than such a table may be, so that no growing table is broadcast."""
    rows = [tuple(r) for r in df.limit(DICTIONARY_ROWS + 1).collect()]
    if len(rows) > DICTIONARY_ROWS:
        raise ValueError(f"a dictionary table may have {DICTIONARY_ROWS} rows at most")
    return rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` only when the scan has fewer partitions than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(key)) if df.rdd.getNumPartitions() < cores else df


def sampled(df: DataFrame, size: int, *key: str) -> DataFrame:
    """About ``size`` rows, at most, chosen by a hash of the key: the same for the same rows, whatever their partitions.

    The hash thins the rows out where they lie; only what is left is ordered, so no task gathers more than the sample.
    """
    n = df.count()
    if n > size:
        df = df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.02 * size / n)))
    return df.orderBy(F.xxhash64(*key), *key).limit(size)


def fold(s: str) -> str:
    """Lower-cased text without combining marks; stroke letters lose their stroke."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).lower().translate(_STROKES)


# Letters that have no canonical decomposition.
_STROKES = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})


def damerau(a: str, b: str, limit: int) -> int:
    """Restricted Damerau-Levenshtein distance, or ``limit + 1`` when it is larger than ``limit``."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit or len(set(a) ^ set(b)) > 2 * limit:  # an edit changes two letters of the sets at most
        return limit + 1
    prev2, prev = None, list(range(lb + 1))
    for i in range(1, la + 1):
        ca, cur, best = a[i - 1], [i] + [0] * lb, i
        for j in range(1, lb + 1):
            cb = b[j - 1]
            d = prev[j - 1] + (ca != cb)
            if prev[j] + 1 < d:
                d = prev[j] + 1
            if cur[j - 1] + 1 < d:
                d = cur[j - 1] + 1
            if prev2 is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb and prev2[j - 2] + 1 < d:
                d = prev2[j - 2] + 1
            cur[j] = d
            if d < best:
                best = d
        if best > limit:
            return limit + 1
        prev2, prev = prev, cur
    return prev[lb] if prev[lb] <= limit else limit + 1


def deletes(word: str, depth: int) -> set[str]:
    """The word and all strings left after deleting up to ``depth`` of its characters."""
    out = layer = {word}
    for _ in range(depth):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out
