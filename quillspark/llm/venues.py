"""Problem 6: map freely typed venues to a canonical list."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import damerau, deletes, dictionary, fold

# Words that carry no meaning in a venue's name, wrappers around names, and words of volume or page notes.
FILLERS = frozenset("of on in for the and a an at to s".split())
WRAPPERS = frozenset("proc proceedings procs in appeared presented accepted published".split())
NOTES = frozenset("vol volume no number issue pp pages p ed edition".split())
_TAG = re.compile(r"<[^<>]{1,20}>|\\[a-z]+\{")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ORDINAL = re.compile(r"\d+(st|nd|rd|th)?|[ivx]+")
_NUMBER = re.compile(r"\d")


def words(value: str) -> list[str]:
    """Lower-cased words of a typed value, markup and punctuation removed."""
    s = html.unescape(unicodedata.normalize("NFKC", value))
    s = fold(_TAG.sub(" ", s))
    return [w.replace("'", "").replace("’", "") for w in _WORD.findall(s)]


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` is an abbreviation of ``word``: same first letter, its letters in order."""
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    return True


def edits(n: int) -> int:
    """Edits that a word of n letters may have."""
    return 0 if n < 4 else 1 if n < 5 else 2 if n < 10 else 3


# The rows of letters of a keyboard, neighbours beside each other.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(KEYS) for i, c in enumerate(row)}
_VOWELS = frozenset("aeiouy")


def swap_cost(x: str, y: str) -> float:
    """Cost of typing one letter for another: less for keys side by side, and for vowels, which are confused by ear."""
    p, q = _PLACE.get(x), _PLACE.get(y)
    if p and q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return 0.8
    return 0.85 if x in _VOWELS and y in _VOWELS else 1.0


def weighted_damerau(a: str, b: str) -> float:
    """Restricted Damerau-Levenshtein distance with costs by the kind of slip.

    Letters changed places cost 0.7; a letter typed twice or once too few, 0.7; a neighbouring key 0.8; a vowel for a
    vowel 0.85; anything else 1; a slip in the first letter, which is rarely mistyped, 0.6 more.
    """
    la, lb = len(a), len(b)

    def at(k: int) -> float:
        return 0.6 if k == 0 else 0.0

    d = [[0.0] * (lb + 1) for _ in range(la + 1)]
    for i in range(1, la + 1):
        d[i][0] = d[i - 1][0] + 1.0 + at(i - 1)
    for j in range(1, lb + 1):
        d[0][j] = d[0][j - 1] + 1.0 + at(j - 1)
    for i in range(1, la + 1):
        for j in range(1, lb + 1):
            x, y = a[i - 1], b[j - 1]
            first = at(min(i, j) - 1)
            best = d[i - 1][j - 1] + (0.0 if x == y else swap_cost(x, y) + first)
            best = min(best, d[i - 1][j] + (0.7 if i > 1 and x == a[i - 2] else 1.0) + first * (x != y))
            best = min(best, d[i][j - 1] + (0.7 if j > 1 and y == b[j - 2] else 1.0) + first * (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, d[i - 2][j - 2] + 0.7 + at(min(i, j) - 2))
            d[i][j] = best
    return d[la][lb]


class VenueIndex:
    """Symmetric-delete dictionary over the words of the canonical names.

    Built from the reference list alone, so its size is bound by that list. ``weights`` are the
    reference frequencies that break ties.
    """

    def __init__(self, rows: list[tuple[int, str | None, str | None]], weights: dict[int, int] | None = None):
        self.weights = weights or {}
        self.names: dict[int, tuple[str, ...]] = {}
        self.short: dict[str, int] = {}
        self.exact: dict[tuple[str, ...], int] = {}
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.canonical: dict[int, str] = {}
        for i, name, short in sorted((r for r in rows if r[0] is not None), reverse=True):
            if name and (key := self.content(words(name))):
                self.names[i], self.exact[key], self.canonical[i] = key, i, name
                for w in key:
                    self.by_word[w].add(i)
            if short and short.strip():
                self.short["".join(words(short))] = i
        self.longest = max(map(len, self.by_word), default=0)
        self.near: dict[str, set[str]] = defaultdict(set)
        for w in self.by_word:
            for d in deletes(w, edits(len(w))):
                self.near[d].add(w)
        self.first: dict[str, list[str]] = defaultdict(list)
        for w in self.by_word:
            self.first[w[0]].append(w)
        self.costs: dict[str, dict[str, float]] = {}

    @staticmethod
    def content(ws: list[str]) -> tuple[str, ...]:
        return tuple(w for w in ws if w not in FILLERS)

    def matches(self, token: str) -> dict[str, float]:
        """Reference words that a typed token may stand for, with the cost of reading it so."""
        got = self.costs.get(token)
        if got is not None:
            return got
        got = {}
        if token in self.by_word:
            got[token] = 0.0
        bound = edits(len(token) + 1)
        for d in deletes(token, bound) if bound and len(token) <= self.longest + bound else ():  # a longer one is near none
            for w in self.near.get(d, ()):
                if w not in got:
                    k = damerau(token, w, min(bound, edits(len(w))))
                    if k <= min(bound, edits(len(w))):
                        got[w] = 0.6 * weighted_damerau(token, w)
        for w in self.first.get(token[0], ()):
            if w not in got and shortens(token, w):
                got[w] = 0.25 if w.startswith(token) else 0.35
        if len(token) > 3 and token[-1] == "s":  # the plural of an abbreviation
            for w in self.first.get(token[0], ()):
                if w not in got and shortens(token[:-1], w):
                    got[w] = 0.4
        if len(self.costs) > 100_000:
            self.costs.clear()
        self.costs[token] = got
        return got

    def aligned(self, tokens: list[str], costs: list[dict[str, float]], name: tuple[str, ...]) -> float | None:
        """Least cost of finding all of ``name`` in the tokens, in order or rotated at one place; None if it isn't there.

        A token between matched ones that stands for nothing makes the reading fail: it belongs to another name.
        """
        n, best = len(name), None
        for turn in range(n):
            order = name[turn:] + name[:turn]
            for start in range(len(tokens) - n + 1):
                total = 0.4 * (turn > 0)
                for k in range(n):
                    c = costs[start + k].get(order[k])
                    if c is None:
                        break
                    total += c
                else:
                    rest = [t for t in tokens[:start] if t not in WRAPPERS and not _NUMBER.search(t)]
                    if not rest and (best is None or total < best):
                        best = total
        return best

    def lookup(self, value: str | None) -> int:
        """The venue meant by a typed value, 0 if it means none, for null or blank too."""
        if value is None or not value.strip():
            return 0
        ws = words(value)
        tokens = list(self.content(ws))
        if not tokens:
            return 0
        got = self.exact.get(tuple(tokens))
        if got is not None:
            return got
        glued = [self.split(t) for t in tokens]
        tokens = [x for g in glued for x in g]
        plain = [t for t in tokens if not _NUMBER.search(t) and t not in WRAPPERS and t not in NOTES]
        costs = [self.matches(t) for t in tokens]
        found = []
        hits: dict[int, int] = defaultdict(int)
        for c in costs:
            for i in {i for w in c for i in self.by_word[w]}:
                hits[i] += 1
        for i, k in hits.items():
            if k >= len(self.names[i]):
                cost = self.aligned(tokens, costs, self.names[i])
                if cost is not None:
                    found.append((cost, -self.weights.get(i, 0), i))
        if found:
            found.sort()
            if len(found) > 1 and found[1][0] - found[0][0] < 1e-9 and found[0][0] > 0 and not self.told(tokens, found):
                return 0
            return found[0][2]
        if plain and (i := self.short.get(plain[0])) is not None:  # an acronym, perhaps with a year, number or place
            return i
        return 0

    def told(self, tokens: list[str], found: list[tuple[float, int, int]]) -> bool:
        """Whether reference frequency decides between the equally near readings."""
        tied = [f for f in found if f[0] - found[0][0] < 1e-9]
        return -tied[0][1] >= 20 * max(1, -tied[1][1])

    def split(self, token: str) -> list[str]:
        """A token with digits at its end or start loses them if the rest is an acronym of the list."""
        if not _NUMBER.search(token):
            return [token]
        letters = re.sub(r"\d+", "", token)
        return [letters] if letters in self.short else [token]


def map_venues(records: DataFrame, venue_list: DataFrame, key: str = "record_id", column: str = "venue") -> DataFrame:
    """(record_id, venue_id) for each row whose venue is neither null nor blank; 0 reports a value that means no entry.

    The reference list is a dictionary table and is gathered once (its size is that of the list, not
    of the records); so are the counts of its exact names over all records, one number per entry,
    which break ties. Everything else is one map over the scan with a memo per worker, without a
    shuffle. Ties left by cost go to the entry that is at least twenty times as frequent, otherwise
    the value is reported as unmatched. Repeated rows stay; an empty list maps everything to 0.
    """
    rows = dictionary(venue_list.select(F.col("venue_id").cast("long"), "canonical_name", "short_name"))
    values = records.select(F.col(key).cast("long").alias("record_id"), F.col(column).alias("venue")).where(~blank(F.col("venue")))
    names = {r[1]: r[0] for r in rows if r[1]}
    counts = values.where(F.col("venue").isin(list(names))).groupBy("venue").agg(F.count("*").alias("n")).collect() if names else []
    weights: dict[int, int] = defaultdict(int)
    for r in counts:
        weights[names[r[0]]] += r[1]
    run = mapper(rows, dict(weights))
    return values.mapInArrow(run, "record_id long, venue_id long")


def blank(c: F.Column) -> F.Column:
    """Null, empty, or nothing but white space of any kind."""
    return c.isNull() | ~c.rlike(r"[^\s\x1c-\x1f\x85   -     　]")


def mapper(rows: list[tuple[int, str | None, str | None]], weights: dict[int, int]):
    """Arrow function from (record_id, venue) to (record_id, venue_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = VenueIndex(rows, weights), {}
        for b in batches:
            coded = b.column(1).dictionary_encode()
            ids = []
            for v in coded.dictionary.to_pylist():
                if v not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[v] = index.lookup(v)
                ids.append(memo[v])
            made = pa.array(ids, pa.int64()).take(coded.indices) if ids else pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["record_id", "venue_id"])

    return run
