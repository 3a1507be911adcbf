"""Problem 7: encode a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_BYTES = 200_000, 64
_NONE = 1 << 62
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Byte-pair encoder whose merge order comes from a segment tree.

    Leaf ``i`` of the tree holds ``rank << 32 | i`` of the pair that starts at live byte position
    ``i``; an inner node holds the smaller child, so the root is the leftmost pair of least rank.
    A merge changes three leaves: the merged one, its swallowed right neighbour, and the left
    neighbour. Each change climbs one path, so a piece of n bytes costs O(n log n) however long.
    """

    def __init__(self, vocabulary: str | bytes):
        """``vocabulary``: the file's path, or its content."""
        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as f:
                vocabulary = f.read()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        self.split = regex.compile(PATTERN).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    def piece(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ranks, n = self.ranks, len(word)
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        width = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                tree[width + i] = r << 32 | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low

        def pair(i: int) -> int:
            mid = after[i]
            if mid >= n:
                return _NONE
            r = ranks.get(word[i : after[mid]])
            return _NONE if r is None else r << 32 | i

        while (top := tree[1]) != _NONE:
            i = top & 0xFFFFFFFF
            gone = after[i]
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
            put(gone, _NONE)
            put(i, pair(i))
            if (left := before[i]) >= 0:
                put(left, pair(left))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text without special tokens; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for w in self.split(text):
            ids = seen.get(w)
            if ids is None:
                ids = tuple(self.piece(w.encode("utf-8")))
                if len(w) <= CACHE_BYTES:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen[w] = ids
            out.extend(ids)
        return out


def encoder(content: bytes) -> Encoder:
    """The encoder of a vocabulary, made once per process."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Encoder(content)
    return _LOADED[name]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, sizes_only: bool = False) -> DataFrame:
    """(doc_id, ids) for every row, or (doc_id, n_tokens) with ``sizes_only``.

    Null and empty texts give an empty list (size 0). Rows are independent: repeated or null ids
    stay repeated, other columns are ignored, an empty table gives no rows. The vocabulary file is read where
    the job is started and sent along (it is of a fixed size), so executors need no copy. The work is a map over the scan; nothing is shuffled unless the scan has fewer partitions than cores.
    """
    with open(vocabulary, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.int32() if sizes_only else pa.list_(pa.int32())
    out = "n_tokens" if sizes_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = (enc.encode(t.as_py()) for t in part.column(1))
                made = pa.array([len(x) for x in ids] if sizes_only else list(ids), kind)
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", out])

    rows = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "doc_id")
    return rows.mapInArrow(run, f"doc_id long, {out} {'int' if sizes_only else 'array<int>'}")
