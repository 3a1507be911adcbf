"""Problem 5: near-duplicate texts by bit-sliced comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import spread, stage

#: Two texts belong together if they share more than this part of their distinct words.
THRESHOLD = 0.65
#: Bands of minimum hashes and hashes of a band: texts that share 0.65 of their words agree in a band with probability 0.984, at 0.7 with 0.9995.
BANDS, ROWS = 128, 8
HASHES = BANDS * ROWS
#: Bits of the fingerprint, one of each of as many minimum hashes.
BITS = 512
#: Fingerprint bits of two texts that share a part J of their words differ with probability (1 - J) / 2. The radius lies
#: eight standard deviations above the mean at the threshold, so it loses no pair that the exact check would keep.
RADIUS = int(BITS * (1 - THRESHOLD) / 2 + 8 * (BITS * 0.175 * 0.825) ** 0.5)
#: Classes of a band beyond which it is tiled; bands are counted over one class of so many, which only decides how the work is cut.
TILE, COUNTED = 2048, 16
_WORD = re.compile(r"\w+")


def word_hashes(text: str | None) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct lower-cased words of a text."""
    found = {xxhash.xxh32_intdigest(w) for w in _WORD.findall(text.lower())} if text else ()
    return np.array(sorted(found), dtype=np.uint32)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_17)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words whose low bits depend on all bits."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes, one row per set; sets must not be empty."""
    a, b = permutations()
    out = np.empty((len(sets), HASHES), np.uint32)
    for i, s in enumerate(sets):
        out[i] = (mixed(s)[:, None] * a[None, :] + b[None, :]).min(axis=0)
    return out


def fingerprints(sig: np.ndarray) -> np.ndarray:
    """One bit of each minimum hash, packed."""
    return np.packbits((mixed(sig[:, :BITS]) & np.uint32(1)).astype(np.uint8), axis=1)


def vertical(bits: np.ndarray) -> np.ndarray:
    """Bit planes of packed fingerprints: plane k holds bit k of all members, 64 members to a word, the first in the lowest bit."""
    n = len(bits)
    out = np.zeros((bits.shape[1] * 8, -(-n // 64)), np.uint64)
    for at in range(0, n, 8192):
        rows = np.unpackbits(bits[at : at + 8192], axis=1).T
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 64)))
        words = np.packbits(np.ascontiguousarray(rows), axis=1, bitorder="little").view(np.uint64)
        out[:, at // 64 : at // 64 + words.shape[1]] = words
    return out


def moved(planes: np.ndarray, s: int, words: np.ndarray) -> np.ndarray:
    """The given words of planes in which each member stands ``s`` places further down; beyond the end are zeros."""
    q, r = divmod(s, 64)
    width = planes.shape[1]

    def take(at: np.ndarray) -> np.ndarray:
        got = planes[:, np.minimum(at, width - 1)]
        got[:, at >= width] = 0
        return got

    low = take(words + q)
    return low if not r else (low >> np.uint64(r)) | (take(words + q + 1) << np.uint64(64 - r))


def add_planes(counters: np.ndarray, planes: np.ndarray) -> None:
    """Add planes to vertical counters (counter j holds bit j of all sums) with carry-save adders, three planes at a time."""
    level, place = planes, 0
    while len(level):
        carries = []
        while len(level) >= 3:  # many full adders at once: three planes of a weight give one of it and one of twice it
            m = len(level) // 3
            p, q, r = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            u = p ^ q
            carries.append((p & q) | (u & r))
            level = np.concatenate([u ^ r, level[3 * m :]])
        for plane in level:
            j, carry = place, plane
            while carry.any():
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
                j += 1
        level, place = np.concatenate(carries) if carries else np.empty((0, planes.shape[1]), np.uint64), place + 1


def close(left: np.ndarray, right, wanted: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """Of the ``wanted`` pairs (a bit each, 64 to a word) those whose fingerprints differ in at most ``radius`` bits.

    ``right(planes, words)`` gives the planes of the partners. One word operation advances 64
    distances; after each 64 planes the words whose pairs all exceed the radius are abandoned.
    """
    out = np.zeros(len(words), np.uint64)
    alive = np.flatnonzero(wanted)
    counters = np.zeros((len(left).bit_length(), len(alive)), np.uint64)
    for k in range(0, len(left), 64):
        if not len(alive):
            return out
        group = slice(k, k + 64)
        add_planes(counters, left[group][:, words[alive]] ^ right(group, words[alive]))
        near = at_most(counters, radius) & wanted[alive]
        stay = near != 0
        alive, counters, near = alive[stay], counters[:, stay], near[stay]
    out[alive] = near
    return out


def flags(mask: np.ndarray) -> np.ndarray:
    """Booleans as bits, 64 to a word."""
    return np.packbits(np.pad(mask, (0, -len(mask) % 64)), bitorder="little").view(np.uint64)


def within(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which rows of two packed fingerprint arrays differ in at most ``radius`` bits."""
    x, y, n = vertical(a), vertical(b), len(a)
    words = np.arange(x.shape[1])
    got = close(x, lambda group, w: y[group][:, w], flags(np.ones(n, bool)), words, radius)
    return np.unpackbits(got.view(np.uint8), bitorder="little")[:n].astype(bool)


def at_most(counters: np.ndarray, radius: int) -> np.ndarray:
    """Bit mask of the vertical counters whose value is at most ``radius``."""
    below, equal = np.zeros(counters.shape[1], np.uint64), np.full(counters.shape[1], 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            below |= equal & ~counters[j]
            equal &= counters[j]
        else:
            equal &= ~counters[j]
    return below | equal


def classes(texts: DataFrame, id_col: str, text_col: str, title_col: str | None = None) -> DataFrame:
    """(id, class, words): class is a hash of the set of distinct words; texts without words have none and are left out.

    The words of a title count with those of its text; a title alone is no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles = b.column(2).to_pylist() if title_col else [None] * b.num_rows
            sets = [word_hashes(f"{t}\n{x}" if t and _WORD.search(x) else x) for x, t in zip(b.column(1).to_pylist(), titles)]
            keep = pa.array([len(s) > 0 for s in sets])
            sets = [s for s in sets if len(s)]
            blobs = [s.tobytes() for s in sets]
            cls = pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), cls, pa.array(blobs, pa.binary())], ["id", "class", "words"])

    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")] + ([F.col(title_col).alias("title")] if title_col else [])
    rows = texts.select(*cols).where("id is not null and text is not null")
    return spread(rows, "id").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, class long, words binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(class, bands, bits): the hash of each band, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sig = signatures([np.frombuffer(w, np.uint32) for w in part.column(1).to_pylist()])
                h = np.zeros((len(sig), BANDS), np.uint64)
                cube = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
                for r in range(ROWS):
                    h = (h ^ cube[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                h ^= np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(h.astype(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                bits = pa.array([x.tobytes() for x in fingerprints(sig)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), keys, bits], ["class", "bands", "bits"])

    return reps.mapInArrow(run, "class long, bands array<long>, bits binary")


def candidate_pairs(signed: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a < b) of classes that share a band and whose fingerprints lie within the radius.

    A band key shared by very many classes is cut into tiles: its members are spread over
    chunks by hash, and each pair of chunks is one group, so no task holds more than two chunks of
    a key. Members of a group are compared in bit planes; only pairs within the radius are emitted.
    """
    counted = COUNTED if tile >= 8 * COUNTED else 1
    keys = signed.select("class", F.explode("bands").alias("band"))
    some = signed.where(F.pmod(F.xxhash64("class"), F.lit(counted)) == 0).select(F.explode("bands").alias("band"))
    hot = stage(some.groupBy("band").agg(F.ceil(F.count("*") * counted / tile).cast("int").alias("parts")).where("parts > 1"))
    alone = keys if hot.isEmpty() else keys.join(hot, "band", "left_anti")
    met = alone.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
    member = met.select(F.col("band").alias("group"), "class", F.lit(0).alias("side"), F.lit(True).alias("same"))
    if not hot.isEmpty():
        chunk = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
        spots = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("chunk")).alias("i"), F.greatest(i, F.col("chunk")).alias("j")))
        tiled = keys.join(hot, "band").withColumn("chunk", chunk).withColumn("spot", F.explode(spots))
        group = F.xxhash64("band", "spot.i", "spot.j").alias("group")
        member = member.unionByName(tiled.select(group, "class", F.col("chunk").alias("side"), (F.col("spot.i") == F.col("spot.j")).alias("same")))
    placed = member.join(signed.select("class", "bits"), "class")
    ordered = placed.repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the radius of each group of a partition sorted by group; groups may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        g = b.column("group").to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if len(g) and (g[:-1] <= g[1:]).all() else 0
        if cut:
            held.append(b.slice(0, cut))
            yield from joined(held)
            held = []
        held.append(b.slice(cut))
    yield from joined(held)


def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the whole groups of some batches.

    The members are stored once in bit planes, the largest groups first. All pairs of members ``s`` places
    apart are then compared at once: the planes against themselves moved by ``s`` places, masked to
    pairs of one group, over the words that still have such pairs.
    """
    table = pa.Table.from_batches(parts) if parts else None
    if table is None or not table.num_rows:
        return
    g = table.column("group").to_numpy()
    _, where, size = np.unique(g, return_inverse=True, return_counts=True)
    order = np.lexsort((g, -size[where]))
    g, size = g[order], size[where][order]
    cls, side, same = (table.column(c).to_numpy()[order] for c in ("class", "side", "same"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(g), BITS // 8)[order]
    planes, found = vertical(bits), []
    for s in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -s, side="left"))  # members of groups of more than s
        i = np.arange(min(n, len(g) - s))
        pair = (g[i] == g[i + s]) & (cls[i] != cls[i + s]) & (same[i] | (side[i] != side[i + s]))
        if not pair.any():
            continue
        wanted = flags(pair)
        words = np.arange(len(wanted))
        got = close(planes, lambda group, w, s=s: moved(planes[group], s, w), wanted, words, RADIUS)
        hit = np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little"))
        found.append(np.stack([np.minimum(cls[hit], cls[hit + s]), np.maximum(cls[hit], cls[hit + s])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def near_classes(texts: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, title_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class) and the pairs (a, b, shared) of classes that share more than ``threshold`` of their words.

    Texts of equal word sets form one class and are compared once. Classes meet where a band of
    minimum hashes agrees, are compared bit-sliced, and the pairs left are checked exactly on their words.
    """
    rows = stage(classes(texts, id_col, text_col, title_col))
    reps = stage(band_rows(rows.groupBy("class").agg(F.first("words").alias("words"))))
    pairs = candidate_pairs(reps)
    words = rows.groupBy("class").agg(F.first("words").alias("words"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                shared.append(both / (len(p) + len(q) - both))
            keep = pa.array([s > threshold for s in shared], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(shared, pa.float64()).filter(keep)], ["a", "b", "shared"])

    full = pairs.join(words.select(F.col("class").alias("a"), F.col("words").alias("x")), "a").join(words.select(F.col("class").alias("b"), F.col("words").alias("y")), "b")
    return rows.select("id", "class"), full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long, shared double")


def class_links(texts: DataFrame, id_col: str = "arxiv_id", text_col: str = "abstract", threshold: float = THRESHOLD, title_col: str = "title") -> DataFrame:
    """(id, class, copies, links) of each row with a text: the smallest id of its class of equal word sets, the rows of the class, and the near classes.

    The compact form of ``near_pairs``, whose size is that of the table however many copies there are. Equal ids are one row.
    """
    member, pairs = near_classes(texts, id_col, text_col, threshold, title_col if title_col in texts.columns else None)
    member = member.distinct()
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    size = member.groupBy("class").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    return member.join(size, "class").join(links, "class", "left").select("id", F.col("first").alias("class"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_pairs(texts: DataFrame, id_col: str = "arxiv_id", text_col: str = "abstract", threshold: float = THRESHOLD, title_col: str = "title") -> DataFrame:
    """All pairs (arxiv_id_a < arxiv_id_b) of rows whose texts are edits of one text.

    A row's text is its title and abstract. Rows with a null id, or with a null, empty or wordless abstract,
    take no part; equal ids are one row; a missing title, or no such column, leaves the abstract. Whole
    texts count, letter case doesn't. Every pair of a class and of two near classes is
    listed, since the result asks for pairs; ``near_classes`` gives the compact form.
    """
    member, pairs = near_classes(texts, id_col, text_col, threshold, title_col if title_col in texts.columns else None)
    member = member.distinct()
    left, right = member.select(F.col("id").alias("p"), F.col("class").alias("a")), member.select(F.col("id").alias("q"), F.col("class").alias("b"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").where("p <> q").select(F.least("p", "q").alias("arxiv_id_a"), F.greatest("p", "q").alias("arxiv_id_b"))
    many = member.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    same = left.join(many.withColumnRenamed("class", "a"), "a").join(right.withColumnRenamed("b", "a"), "a").where("p < q").select(F.col("p").alias("arxiv_id_a"), F.col("q").alias("arxiv_id_b"))
    return across.unionByName(same).distinct()
