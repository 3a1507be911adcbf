"""Problem 1: one surviving record of each duplicate group, field by field."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import damerau, dictionary, fold, stage
from quillspark.llm.venues import FILLERS, NOTES, WRAPPERS, mapper, shortens, words

# What stands in a venue field without naming a place of publication.
REMARKS = frozenset(
    "see comments|under review|in review|n a|na|to appear|submitted|unknown|preprint|tba|tbd|none|null|nan|nil|in press|forthcoming|"
    "in preparation|accepted|published|unpublished|working paper|draft|arxiv|arxiv org|arxiv preprint|arxiv e prints|corr|biorxiv|medrxiv|"
    "ssrn|hal|zenodo|researchgate|osf|repository|online|web|website|self published|not available|not published|no venue|other|misc|various|"
    "semantic scholar|s2|to be announced|to be determined|tbc|pending|missing|undefined|test|x|xx|xxx".split("|")
)
# Names under which a source of the list is also known.
SOURCE_ALIASES = {"s2": "semanticscholar", "arxivorg": "arxiv"}
#: Counts from here on are overflow or filler values, not counts.
IMPOSSIBLE = 5_000_000
#: Seconds after which a count's vote is worth half, and the vote of a zero beside that of a positive count.
HALF_LIFE, ZERO = 30 * 86_400, 1e-200
#: A group's distinct values of a field are collected into one row up to this many, and streamed in sorted order beyond.
GROUP_VALUES = 256
#: Votes of a listed name, in those of the heaviest typed value: few values that agree among themselves outvote it.
LISTED = 2.0

Profile = list[dict[str, float]]


def names_place(value: str) -> bool:
    """Whether a venue value may name a place: it has letters and is no remark or repository name."""
    ws = [w for w in words(value) if not w.isdigit()]
    return bool(ws) and " ".join(ws) not in REMARKS and not (ws[0] in ("submitted", "arxiv") and len(ws) < 4)


@lru_cache(200_000)
def unlisted(value: str) -> int:
    """A negative number for the place that a value outside the list names, by the letter its first word of content starts with.

    Cut, abbreviated and misspelt forms of one name keep that letter; two places of one group seldom share it.
    """
    heads = [w[0] for w in words(value) if w not in FILLERS and w not in WRAPPERS and w not in NOTES and not any(c.isdigit() for c in w)]
    return -1 - ord(heads[0]) if heads else -1


@lru_cache(200_000)
def likeness(a: str, b: str) -> float:
    """Similarity of two tokens in 0..1: equal letters, abbreviation, or few edits."""
    if a == b:
        return 1.0
    x, y = fold(a).strip(".,;:\"'()"), fold(b).strip(".,;:\"'()")
    if x == y:
        return 0.95
    if not x or not y:
        return 0.0
    if shortens(x, y) or shortens(y, x):
        return 0.7
    d = damerau(x, y, 3)
    longest = max(len(x), len(y))
    return 0.0 if d > 3 or d > longest // 2 else 0.9 - d / longest


class Alignment:
    """Columns of weighted tokens to which values are aligned one by one."""

    def __init__(self) -> None:
        self.columns: Profile = []
        self.leads: list[tuple[float, str]] = []  # the heaviest token of each column
        self.weight = 0.0

    def add(self, ts: list[str], weight: float) -> None:
        """Align tokens column by column (global alignment on the likeness to the heaviest tokens) and add their votes."""
        n, m = len(self.columns), len(ts)
        if not m:
            return
        heads = [t for _, t in self.leads]
        score = [[0.0] * (m + 1) for _ in range(n + 1)]
        like = [[likeness(h, t) for t in ts] for h in heads]
        for i in range(n - 1, -1, -1):
            row, below = score[i], score[i + 1]
            for j in range(m - 1, -1, -1):
                s = like[i][j]
                row[j] = max(below[j], row[j + 1], below[j + 1] + s - 0.05 if s > 0.3 else 0.0)
        columns, leads, i, j = [], [], 0, 0
        while i < n or j < m:
            if i < n and j < m and like[i][j] > 0.3 and score[i][j] == score[i + 1][j + 1] + like[i][j] - 0.05:
                col, t = self.columns[i], ts[j]
                col[t] = col.get(t, 0.0) + weight
                columns.append(col)
                leads.append(max(self.leads[i], (col[t], t)))
                i, j = i + 1, j + 1
            elif i < n and (j == m or score[i][j] == score[i + 1][j]):
                col = self.columns[i]
                col[""] = col.get("", 0.0) + weight
                columns.append(col)
                leads.append(self.leads[i])
                i += 1
            else:
                columns.append({ts[j]: weight} | ({"": self.weight} if n else {}))
                leads.append((weight, ts[j]))
                j += 1
        self.columns, self.leads, self.weight = columns, leads, self.weight + weight


def shape(token: str) -> float:
    """How well a token is written: capitalised or short lower-case words count in full, notes and numbers not at all, however many values have them."""
    bare = fold(token).strip(".,;:\"'()<>/")
    if not bare or bare in NOTES or bare in WRAPPERS or any(c.isdigit() for c in bare):
        return 0.0
    if not token.replace("-", "").replace("'", "").isalpha():
        return 0.3
    if token[0].isupper() and (len(token) == 1 or token[1:].islower()):
        return 1.0
    return 1.0 if token.islower() and len(token) <= 4 else 0.3


def clipped(token: str, word: str) -> bool:
    """Whether a token abbreviates a word of its column: it ends in a point or lacks two fifths of the letters."""
    t, w = fold(token).strip("."), fold(word)
    return bool(t) and (token.endswith(".") or 5 * len(t) <= 3 * len(w)) and shortens(t, w)


def profile(values: list[tuple[str, float]]) -> Profile:
    """Progressive alignment: the longest and heaviest value opens the profile, the others join by falling weight."""
    out = Alignment()
    for value, weight in sorted(values, key=lambda v: (turn(*v), v[0])):
        out.add(tokens(value), weight)
    return out.columns


def turn(value: str, weight: float) -> float:
    """The place of a value in the alignment, the least first."""
    return -len(value.split()) * weight


def tokens(value: str) -> list[str]:
    """Tokens of a value; one without spaces is parted at underscores and hyphens."""
    ts = value.split()
    return ts if len(ts) > 1 else [t for t in re.split(r"[\s_-]+", value) if t] or ts


def consensus(columns: Profile) -> list[str]:
    """The winning token of each column. Votes of an abbreviation or a misspelling go to the better written token it resembles."""
    out = []
    for col in columns:
        votes: dict[str, float] = {}
        tokens = sorted((t for t in col if t), key=lambda t: (-shape(t), -len(t), t))
        # an abbreviation is shorter than its word and shares its first letter; each list is in the order of the tokens
        words: dict[str, dict[int, list[tuple[int, str]]]] = defaultdict(lambda: defaultdict(list))
        alike: dict[str, str] = {}
        for i, t in enumerate(tokens):
            f = fold(t)
            words[f[:1]][len(f)].append((i, t))
            alike.setdefault(f, t)
        for t in tokens:
            votes[t] = votes.get(t, 0.0) + col[t] * shape(t)
            f = fold(t).strip(".")
            least = len(f) + 1 if t.endswith(".") else -(-5 * len(f) // 3)
            full = [next(((i, u) for i, u in us if u != t and clipped(t, u)), None) for n, us in words[f[:1]].items() if n >= least] if f else []
            same = alike[fold(t)]
            fuller = min(filter(None, full), default=(0, same if shape(same) > shape(t) else None))[1]
            if fuller:
                votes[fuller] = votes.get(fuller, 0.0) + votes.pop(t) + col[t] * 0.5
        best = max(votes, key=lambda t: (votes[t], t))
        if votes[best] >= 0.6 * col.get("", 0.0):
            out.append(best)
    return out


def distance(value: str, agreed: list[str]) -> float:
    """Edit distance over tokens to the consensus; other spacing than single spaces costs a little."""
    ts = value.split()
    prev = [float(j) for j in range(len(agreed) + 1)]
    for i, t in enumerate(ts, 1):
        cur = [float(i)]
        for j, u in enumerate(agreed, 1):
            cur.append(min(prev[j - 1] + (0.0 if t == u else 1.3 - likeness(t, u)), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev[-1] + 0.01 * (value != " ".join(ts))


def source_rank(rows: list[tuple], column: F.Column) -> F.Column:
    """Trust rank of a typed source by its letters and digits, null if the list has no such source."""
    ranks = {re.sub(r"[^a-z0-9]", "", fold(r[0])): r[1] for r in rows if r[0] is not None}
    ranks |= {a: ranks[b] for a, b in SOURCE_ALIASES.items() if b in ranks}
    key = F.regexp_replace(F.lower(column), "[^a-z0-9]", "")
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]) if ranks else F.lit(None).cast("map<string,int>")
    return F.try_element_at(table, key)


def field_survivors(records: DataFrame, source_list: DataFrame, venue_list: DataFrame) -> DataFrame:
    """(arxiv_id, field, record_id) of the surviving venue, citation_count and source of each group of two or more rows.

    Venues are settled in two steps: the place that is backed most recently and by the most trusted
    source, then the token-level consensus of the values that mean this place; places outside the list are told
    apart by their first letters. The other fields hold one token, so all their values share one
    column, whose weighted vote is an aggregate: a source weighs by its trust rank, a count by how recently
    it was fetched, and only if it can be genuine (a listed source that reports counts, or an unlisted one;
    positive; below five million; not the paper's year, the year with a digit, or thousands out of
    proportion); a zero survives only where no positive count does. Null ids form no group. A field without
    a usable value gives no row. Equal values are told apart by the smallest record_id. Extra columns are ignored.

    Shuffles carry values aggregated per id and value; a group of very many values is sorted and
    streamed through the same alignment.
    """
    sources = dictionary(source_list.select("source_name", F.col("trust_rank").cast("int"), "gives_counts"))
    base = records.where(F.col("arxiv_id").isNotNull() & F.col("record_id").isNotNull()).select(
        "arxiv_id",
        F.col("record_id").cast("long").alias("record_id"),
        "venue",
        "source",
        F.col("citation_count").cast("long").alias("cites"),
        F.coalesce(F.unix_timestamp(F.col("fetched_at").cast("timestamp")), F.lit(0)).alias("at"),
        source_rank(sources, F.col("source")).alias("rank"),
        F.coalesce(F.col("submitted_date").substr(1, 4).try_cast("int"), F.lit(0)).alias("dated"),
    )
    return venues(base, venue_list).unionByName(counts(base, sources)).unionByName(trusted(base, sources))


def column_vote(votes: DataFrame) -> DataFrame:
    """(arxiv_id, n, token, first): the consensus of a column that holds one token a value, and the smallest record that holds it.

    ``votes``: arxiv_id, token, weight, n, first. A field of one token is aligned as it stands: all its
    values share one column. Every distinct token votes once with its weight, those of weight 0 not at all;
    of equal votes the larger token wins. The vote is an aggregate, so groups may be of any size.
    """
    voice = F.when(F.col("weight") > 0, F.struct("weight", "token"))
    won = F.max_by(F.when(F.col("weight") > 0, F.struct("token", "first")), voice).alias("won")
    return votes.groupBy("arxiv_id").agg(F.sum("n").alias("n"), won).select("arxiv_id", "n", "won.token", "won.first")


def trusted(base: DataFrame, sources: list[tuple]) -> DataFrame:
    """The source with the most votes: each weighs two to the power of its negative trust rank; the record must hold the listed name."""
    if not sources:
        return base.where("false").select("arxiv_id", F.lit("source").alias("field"), "record_id")
    names = F.create_map(*[F.lit(x) for s in sources for x in (s[1], s[0])])
    exact = F.col("source") == F.try_element_at(names, F.col("rank"))
    votes = base.groupBy("arxiv_id", "rank").agg(F.count("*").alias("n"), F.min(F.when(exact, F.col("record_id"))).alias("first"))
    votes = votes.withColumn("token", F.try_element_at(names, F.col("rank"))).withColumn("weight", F.when(F.col("token").isNotNull(), F.pow(F.lit(2.0), -F.col("rank"))).otherwise(0.0))
    return column_vote(votes).where("n > 1 and first is not null").select("arxiv_id", F.lit("source").alias("field"), F.col("first").alias("record_id"))


def counts(base: DataFrame, sources: list[tuple]) -> DataFrame:
    """The count with the most votes: a count weighs half for every ``HALF_LIFE`` seconds that it was fetched before the latest of its group.

    Counts that cannot be genuine have no vote. One that looks like a year or is a multiple of a thousand has
    one only beside an ordinary count that it does not exceed twentyfold and that is not newer; a zero weighs next to nothing.
    """
    silent = [s[1] for s in sources if s[2] is False] or [-1]
    c, year = F.col("cites"), F.coalesce(F.concat(F.lit("20"), F.regexp_extract("arxiv_id", r"^(\d{2})\d{2}\.", 1)).try_cast("int"), F.col("dated"))
    odd = (c == year) | (c == F.col("dated")) | (F.floor(c / 10) == year) | (F.floor(c / 10) == F.col("dated")) | (c % 1000 == 0)
    can = ~F.coalesce(F.col("rank").isin(silent), F.lit(False)) & (c >= 0) & (c < IMPOSSIBLE)
    kind = F.when(c == 0, "zero").when(odd, "odd").otherwise("plain")
    rows = base.select("arxiv_id", "record_id", "cites", "at", F.when(can, kind).alias("kind"))
    value = rows.groupBy("arxiv_id", "cites", "kind").agg(F.count("*").alias("n"), F.min("record_id").alias("first"), F.max("at").alias("at"))
    # the same count may stand in usable and unusable rows: the smallest record of either holds it
    value = value.groupBy("arxiv_id", "cites").agg(F.sum("n").alias("n"), F.min("first").alias("first"), *[F.max(F.when(F.col("kind") == k, F.col("at"))).alias(k) for k in ("plain", "odd", "zero")])
    group = value.groupBy("arxiv_id").agg(F.max("plain").alias("plain_at"), F.max(F.when(F.col("plain").isNotNull(), F.col("cites"))).alias("most"), F.max(F.greatest("plain", "odd", "zero")).alias("newest"))

    def fresh(k: str) -> Column:
        return F.pow(F.lit(2.0), (F.col(k) - F.col("newest")) / HALF_LIFE)

    fits = (F.col("odd") >= F.col("plain_at")) & F.col("cites").between(F.col("most"), 20 * F.col("most"))
    weight = F.greatest(fresh("plain"), F.when(fits, fresh("odd")), ZERO * fresh("zero"), F.lit(0.0))
    votes = value.join(group, "arxiv_id").select("arxiv_id", F.col("cites").alias("token"), "n", "first", weight.alias("weight"))
    return column_vote(votes).where("n > 1 and first is not null").select("arxiv_id", F.lit("citation_count").alias("field"), F.col("first").alias("record_id"))


def venues(base: DataFrame, venue_list: DataFrame) -> DataFrame:
    listed = dictionary(venue_list.select(F.col("venue_id").cast("long"), "canonical_name", "short_name"))
    canonical = {r[0]: r[1] for r in listed}
    weight = F.sum(F.pow(F.lit(2.0), (F.col("at") - 1_600_000_000) / 63_072_000.0) / (1 + F.coalesce("rank", F.lit(50))))
    typed = base.groupBy("arxiv_id", "venue").agg(F.count("*").alias("n"), F.min("record_id").alias("first"), F.max("at").alias("at"), F.min(F.coalesce("rank", F.lit(99))).alias("rank"), weight.alias("weight"))
    lookup = mapper(listed, {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}

        def place(v: str | None) -> bool:
            if v is None:
                return False
            if v not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[v] = names_place(v)
            return memo[v]

        def pairs() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield pa.RecordBatch.from_arrays([b.column("first"), b.column("venue")], ["record_id", "venue"])

        held: list[pa.RecordBatch] = []
        for ids in lookup(pairs()):
            b = held.pop()
            vid = ids.column(1).fill_null(0).to_pylist()
            named = [i > 0 or place(v) for i, v in zip(vid, b.column("venue").to_pylist())]
            told = [i if i > 0 else unlisted(v) if n else None for i, n, v in zip(vid, named, b.column("venue").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.int64())], [*b.schema.names, "place"])

    schema = "arxiv_id string, venue string, n long, first long, at long, rank int, weight double, place long"
    value = stage(typed.mapInArrow(read, schema))
    per = value.groupBy("arxiv_id", "place").agg(F.sum("n").alias("n"), F.max("at").alias("at"), F.min("rank").alias("rank"), F.count("*").alias("k"))
    w = Window.partitionBy("arxiv_id")
    named = F.col("place").isNotNull()
    wins = (F.col("at") == F.max(F.when(named, F.col("at"))).over(w)).cast("int") + (F.col("rank") == F.min(F.when(named, F.col("rank"))).over(w)).cast("int")
    ranked = per.select("*", F.sum("n").over(w).alias("total"), wins.alias("wins")).where("place is not null and total > 1")
    order = w.orderBy(F.desc("wins"), "rank", F.desc("at"), "place")
    chosen = ranked.withColumn("o", F.row_number().over(order)).where("o = 1").select("arxiv_id", "place", "k")
    rows = value.where(named).select("arxiv_id", "place", "venue", "weight", "first").join(chosen, ["arxiv_id", "place"])
    few = rows.where(F.col("k") <= GROUP_VALUES).groupBy("arxiv_id", "place").agg(F.collect_list(F.struct("venue", "weight", "first")).alias("few"))
    alone = few.where(F.size("few") == 1).select("arxiv_id", F.col("few")[0]["first"].alias("record_id"))
    # the lists are small but costly to align: spread them over all cores, which sizes alone would not
    cores = base.sparkSession.sparkContext.defaultParallelism
    found = few.where(F.size("few") > 1).repartition(2 * cores, "arxiv_id").mapInArrow(nearest(canonical), "arxiv_id string, record_id long")
    big = settle_hot(rows.where(F.col("k") > GROUP_VALUES), canonical)
    return alone.unionByName(found).unionByName(big).select("arxiv_id", F.lit("venue").alias("field"), "record_id")


def plain(value: str) -> str:
    return fold(value).strip()


def uncut(values: Iterable[dict]) -> Iterator[dict]:
    """Of values sorted by ``plain`` text, those not cut off inside a name that another value tells in full; their weight goes to the first that does."""
    held: list[tuple[str, bool, dict]] = []
    for y in values:
        y, u, still = dict(y), plain(y["venue"]), []
        for head, open_end, x in held:
            if not u.startswith(head):  # nor will any later value
                yield x
            elif len(u) > len(head) and (open_end or (head[-1:].isalnum() and u[len(head)].isalnum())):
                y["weight"] += x["weight"]
            else:
                still.append((head, open_end, x))
        v = fold(y["venue"])
        held = [*still, (u, v != v.rstrip() or u.split()[-1:] != [] and u.split()[-1] in FILLERS, y)]
    yield from (x for _, _, x in held)


def whole(few: list[dict]) -> list[dict]:
    """The values without those cut off inside a name that another value of the group tells in full; their weight goes to it."""
    return list(uncut(sorted(few, key=lambda x: (plain(x["venue"]), x["venue"]))))


def nearest(canonical: dict[int, str | None]):
    """Arrow function: from (arxiv_id, place, few) to the record of the existing value closest to the consensus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, recs = b.column(0).to_pylist(), []
            for place, few in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                few = whole(few)
                values = [(x["venue"], x["weight"]) for x in few]
                agreed = consensus(profile(voters(values, canonical.get(place))))
                recs.append(min((distance(x["venue"], agreed), -x["weight"], x["first"]) for x in few)[2])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(recs, pa.int64())], ["arxiv_id", "record_id"])

    return run


def voters(values: list[tuple[str, float]], name: str | None, heaviest: float | None = None) -> list[tuple[str, float]]:
    """The typed values and, for a listed place, its canonical name as one more voter, which weighs ``LISTED`` times as much as the heaviest value.

    The list tells how the name is written, yet values that agree among themselves outvote it.
    """
    top = max((w for _, w in values), default=0.0) if heaviest is None else heaviest
    return values + [(name, LISTED * top)] if name else values


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """((arxiv_id, place), rows) of a partition sorted by both; groups may span batches, and none is held in memory."""
    return groupby((r for b in batches for r in b.to_pylist()), itemgetter("arxiv_id", "place"))


def settle_hot(rows: DataFrame, canonical: dict[int, str | None]) -> DataFrame:
    """The same as ``nearest`` for groups with very many values, which are sorted and streamed instead of collected.

    Sorted by their plain text, cut values stand right before the fuller ones; sorted by their turn,
    they are aligned as ``profile`` does; then every value is measured where it lies.
    """
    keys = ["arxiv_id", "place"]
    kind = "arxiv_id string, place long, venue string, weight double, first long, turn double"
    names = ["arxiv_id", "place", "venue", "weight", "first", "turn"]
    types = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64()))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([plain(v) for v in b.column("venue").to_pylist()], pa.string())], [*b.schema.names, "plain"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (group, place), values in by_group(batches):
            heaviest = 0.0
            for x in uncut(values):
                heaviest = max(heaviest, x["weight"])
                out.append(x | {"turn": turn(x["venue"], x["weight"])})
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out.clear()
            for told in voters([], canonical.get(place), heaviest):  # the canonical name votes, but is no record's value
                out.append({"arxiv_id": group, "place": place, "venue": told[0], "weight": told[1], "first": None, "turn": turn(*told)})
        yield pa.RecordBatch.from_pylist(out, types)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, place), values in by_group(batches):
            made = Alignment()
            for x in values:
                made.add(tokens(x["venue"]), x["weight"])
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([place], pa.int64()), pa.array([consensus(made.columns)], pa.list_(pa.string()))], ["arxiv_id", "place", "agreed"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [distance(v, a) for v, a in zip(b.column("venue").to_pylist(), b.column("agreed").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("arxiv_id"), b.column("weight"), b.column("first"), pa.array(d, pa.float64())], ["arxiv_id", "weight", "first", "d"])

    typed = rows.select("arxiv_id", "place", "venue", "weight", "first").mapInArrow(read, "arxiv_id string, place long, venue string, weight double, first long, plain string")
    kept = typed.repartition(*keys).sortWithinPartitions(*keys, "plain", "venue").drop("plain").mapInArrow(keep, kind)
    voting = kept.repartition(*keys).sortWithinPartitions(*keys, "turn", "venue")
    agreed = voting.mapInArrow(agree, "arxiv_id string, place long, agreed array<string>")
    far = kept.where("first is not null").join(agreed, keys).mapInArrow(measure, "arxiv_id string, weight double, first long, d double")
    return far.groupBy("arxiv_id").agg(F.min(F.struct("d", -F.col("weight"), "first"))["first"].alias("record_id"))
