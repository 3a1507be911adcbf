"""Problem 8: fill containers of a fixed capacity by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillspark.llm.common import stage

CAPACITY = 2048


class Pattern(NamedTuple):
    """``times`` containers filled alike: ``uses`` maps a length to its number of items in each."""

    times: int
    uses: dict[int, int]


def fill(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Minimum bin slack over a multiset of lengths, given as length -> count (lengths 1..capacity).

    Each window is opened by the longest length left. A bitset dynamic programme over the other
    lengths (counts split into powers of two, so bit s of the set means "sum s can be reached")
    finds the reachable sum closest to the rest of the capacity; walking the saved sets backwards
    gives the counts used. The pattern found is applied as often as the counts allow, so the number
    of programmes depends on the number of distinct lengths, at most the capacity, and not on the
    number of items.
    """
    left = {k: c for k, c in counts.items() if c > 0}
    out = []
    while left:
        first = max(left)
        room = capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for length in sorted((x for x in left if x <= room), reverse=True):
            can = min(left[length] - (length == first), room // length)
            unit = 1
            while can > 0 and not reach >> room & 1:
                take = min(unit, can)
                steps.append((length, take, reach))
                reach |= (reach << (length * take)) & mask
                can, unit = can - take, unit * 2
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        uses = {first: 1}
        for length, take, old in reversed(steps):
            if not old >> total & 1:
                uses[length] = uses.get(length, 0) + take
                total -= length * take
        times = min(left[k] // u for k, u in uses.items())
        out.append(Pattern(times, uses))
        for k, u in uses.items():
            left[k] -= u * times
            if not left[k]:
                del left[k]
    return out


def pack(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens", rows_per_salt: int = 50_000) -> DataFrame:
    """One row per placed piece: doc_id, piece, n_pieces, n_tokens, container, slack.

    A document of at most ``capacity`` tokens is one piece. A longer one is cut into full
    containers and one remainder, which is packed like any other item. Null or non-positive sizes
    need no place. Equal ids are separate items; an empty table gives no rows.

    Only the histogram of lengths, at most ``capacity`` rows whatever the corpus, reaches the driver.
    Items find their place by their rank among items of equal length; ranks come from counts per
    (length, salt), so a length shared by most of the rows is still ranked by many tasks.
    """
    spark = sizes.sparkSession
    size = F.col(size_col).cast("long")
    docs = sizes.where(size > 0).select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"))
    docs = stage(docs)
    n = docs.count()
    salts = max(1, -(-n // rows_per_salt))
    parts = docs.select("doc_id", (F.col("size") % capacity).alias("rest"), F.floor(F.col("size") / capacity).cast("long").alias("full"))
    items = parts.where("rest > 0").select("doc_id", F.col("full").alias("piece"), (F.col("full") + 1).alias("n_pieces"), F.col("rest").cast("int").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    whole = parts.where("full > 0").withColumn("n_pieces", F.col("full") + (F.col("rest") > 0).cast("long"))
    per_salt = items.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    base = per_salt.select("n_tokens", "salt", (F.sum("n").over(W.Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("base"))
    histogram = {r[0]: r[1] for r in per_salt.groupBy("n_tokens").agg(F.sum("n")).collect()}
    patterns = fill(histogram, capacity)

    # For each length: the rank at which each pattern's share begins, its first container, and items per container.
    shares: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in histogram}
    given, container = dict.fromkeys(histogram, 0), 0
    for p in patterns:
        slack = capacity - sum(k * u for k, u in p.uses.items())
        for k, u in p.uses.items():
            shares[k].append((given[k], container, u, slack))
            given[k] += u * p.times
        container += p.times
    table = {k: np.array(v, dtype=np.int64).T for k, v in shares.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("n_tokens").to_numpy()
            rank = b.column("rank").to_numpy()
            where, slack = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
            for k in np.unique(length):
                at = np.nonzero(length == k)[0]
                start, box, uses, free = table[int(k)]
                i = np.searchsorted(start, rank[at], side="right") - 1
                where[at] = box[i] + (rank[at] - start[i]) // uses[i]
                slack[at] = free[i]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("n_pieces"), b.column("n_tokens"), pa.array(where), pa.array(slack)], names)

    names = ["doc_id", "piece", "n_pieces", "n_tokens", "container", "slack"]
    order = W.Window.partitionBy("n_tokens", "salt").orderBy("doc_id")
    # `base` has at most capacity x salts rows; the join is left to the optimizer, which sees its size.
    ranked = items.withColumn("at", F.row_number().over(order)).join(base, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "n_pieces", "n_tokens", (F.col("base") + F.col("at") - 1).cast("long").alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, piece long, n_pieces long, n_tokens int, container long, slack int")
    # Full pieces are containers of their own, numbered after the packed ones by salt, document and piece.
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    offset = salted.groupBy("salt").agg(F.sum("full").alias("n"))
    offset = offset.select("salt", (F.coalesce(F.sum("n").over(W.Window.orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    running = F.coalesce(F.sum("full").over(W.Window.partitionBy("salt").orderBy("doc_id").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    full = salted.withColumn("run", running).join(offset, "salt")
    full = full.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"), "n_pieces", F.lit(capacity).alias("n_tokens"), (F.col("base") + F.col("run")).alias("start"))
    full = full.select("doc_id", "piece", "n_pieces", "n_tokens", (F.lit(container) + F.col("start") + F.col("piece")).cast("long").alias("container"), F.lit(0).alias("slack"))
    return placed.unionByName(full)
