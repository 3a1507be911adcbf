"""Problem 2: link the spellings that name one person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import damerau, deletes, fold, stage
from quillspark.llm.venues import shortens

# Titles and suffixes around a name, particles of surnames, words that mark an organisation, and words without weight.
TITLES = frozenset("dr prof professor phd md msc bsc jr sr ed eds mr mrs ms dipl ing ii iii iv".split())
PARTICLES = frozenset("van der von de den del della di da du la le al el bin ibn ter ten dos das do zu zur".split())
ORGANISATIONS = frozenset(
    "collaboration consortium laboratory laboratories lab team group working alliance survey center centre institute university project network society committee association initiative experiment observatory foundation department task force council agency company wg wkg grp".split()
)
WEIGHTLESS = frozenset("the for of and et al on in".split())
# Short and familiar forms of given names.
NICKNAMES = {
    a: b.split("|")
    for a, b in (
        x.split(":")
        for x in (
            "matt:matthew matty:matthew jenny:jennifer jen:jennifer dima:dmitry|dimitri mitya:dmitry peggy:margaret maggie:margaret meg:margaret greta:margarete bill:william will:william "
            "billy:william liam:william sam:samuel|samantha tom:thomas tommy:thomas tim:timothy mike:michael|mikael mick:michael liz:elizabeth beth:elizabeth betty:elizabeth lisa:elisabeth "
            "eliza:elizabeth ben:benjamin benny:benjamin bob:robert rob:robert bobby:robert bert:robert paco:francisco pancho:francisco fran:francisco hannes:johannes hans:johannes jo:johannes|josephine "
            "sasha:alexander|alexandra alex:alexander|alexandra sandro:alexander xander:alexander fred:frederick freddy:frederick fritz:friedrich nick:nicholas nico:nicholas klaus:nicholas kate:katherine katie:katherine "
            "kathy:katherine kat:katherine kit:christopher chris:christopher|christine topher:christopher vicky:victoria tori:victoria vika:victoria seb:sebastian bastian:sebastian basti:sebastian gabi:gabriela gaby:gabriela sofi:sofia sonya:sofia "
            "susi:susanne sue:susanne sanne:susanne josie:josephine pepa:josephine theo:theodora|theodore dora:theodora teddy:theodore dan:daniel danny:daniel ed:edgar|edward ned:edward toby:tobias max:maximilian "
            "mag:margaret ted:theodore|edward tony:anthony andy:andrew drew:andrew joe:joseph jim:james jimmy:james jack:john johnny:john dick:richard rick:richard rich:richard charlie:charles chuck:charles "
            "steve:stephen|steven dave:david ron:ronald pete:peter greg:gregory larry:lawrence jeff:jeffrey pat:patricia|patrick abby:abigail becky:rebecca cathy:catherine debbie:deborah ellie:eleanor nell:eleanor "
            "sergey:sergei serge:sergei seryozha:sergei misha:mikhail kolya:nikolai vanya:ivan volodya:vladimir katya:ekaterina tanya:tatiana natasha:natalia pasha:pavel zhenya:evgeny yura:juri pepe:jose "
            "lola:dolores nacho:ignacio lupe:guadalupe memo:guillermo quique:enrique chema:josemaria manolo:manuel"
        ).split(" ")
        if x
    )
}
#: A given name is a misspelling of another if it goes with at most this part of the other's surnames.
RARE = 0.25
#: Spellings of a block up to which all are compared outright; a larger block is searched through an index, to the same result.
BLOCK_NAMES = 2000
#: The same for organisations, whose comparisons cost more.
BLOCK_ORGANISATIONS = 50
_VOWELS = frozenset("aeiouy")
_LETTERS = re.compile(r"[^\W\d_]+")


class Name(NamedTuple):
    """``kind``: p (person), o (organisation), or empty. ``given`` is empty where only initials are told."""

    kind: str
    surname: str = ""
    particle: str = ""
    given: str = ""
    initials: str = ""
    middle: str = ""
    order: str = ""  # "?" where given name and surname may stand the other way round
    tokens: tuple[str, ...] = ()


def repaired(s: str) -> str:
    """Text whose UTF-8 bytes were read as Latin-1 is read again."""
    if "Ã" in s or "Å" in s or "Ä" in s:
        for code in ("cp1252", "latin-1"):
            try:
                return s.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return s


@lru_cache(50_000)
def misspelt_organisation(word: str) -> bool:
    """Whether a folded word is within two edits of a long word that marks an organisation."""
    return len(word) > 5 and any(abs(len(word) - len(o)) <= 2 and len(o) > 6 and damerau(word, o, 2) <= 2 for o in ORGANISATIONS)


@lru_cache(50_000)
def shortened_organisation(word: str) -> bool:
    """Whether a folded word abbreviates one that marks an organisation."""
    return any(shortens(word, o) for o in ORGANISATIONS)


@lru_cache(200_000)
def parse(raw: str) -> Name:
    """Read a typed name. Titles, notes, footnote marks and odd spaces are dropped; surname-first forms are turned."""
    s = repaired(raw)
    if not s.isascii() or not s.isprintable():
        s = unicodedata.normalize("NFC", s)
        s = "".join(" " if unicodedata.category(c)[0] in "ZC" else c for c in s if unicodedata.category(c) != "Cf")
    s = s.replace("_", " ").replace("’", "'").replace("‐", "-").replace("–", "-")
    s = re.sub(r"\bet al\b\.?", " ", s)
    apart = re.sub(r"([a-zß-ž])([A-ZÀ-Þ][a-zß-ž])", r"\1 \2", s)  # words whose space is missing
    words = _LETTERS.findall(apart)
    folded = [fold(w) for w in words]
    near_end = {*folded[-2:], folded[0]} if len(words) > 2 else ()
    shortened = len(words) >= 3 and any(2 <= len(w) <= 7 and w + "." in s and shortened_organisation(fold(w)) for w in words[-2:]) and not any(len(w) == 1 for w in words)
    if not ORGANISATIONS.isdisjoint(folded) or not ORGANISATIONS.isdisjoint(map(fold, _LETTERS.findall(s))) or any(misspelt_organisation(w) for w in near_end) or shortened:
        toks = tuple(w for w in folded if w not in WEIGHTLESS)
        return Name("o", tokens=toks) if toks else Name("")
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    s = re.sub(r"[*†‡§¶#]|\d+", " ", s)
    s = apart_person(s)
    s = re.sub(r"(\w)\.(?=\w)", r"\1. ", s)
    halves = [h.strip() for h in s.split(",")]
    halves = [h for h in halves if re.sub(r"\W", "", h) and not all(fold(w).strip(".") in TITLES for w in re.findall(r"[^\W_]+\.?", h))]
    if not halves:
        return Name("")
    turned = len(halves) > 1

    def pieces(h: str) -> list[str]:
        found = re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+\.?)*\.?(?:-[^\W\d_]\.)*", h)
        return [t for i, t in enumerate(found) if not title(t, i == len(found) - 1 and i > 0)]

    if turned:
        last, first = pieces(halves[0]), pieces(" ".join(halves[1:]))
        if not last or not first:
            last, first = (last or first), []
            turned = False
            toks = last
        else:
            toks = first + last
    else:
        toks = pieces(halves[0])
    if not toks:
        return Name("")
    order = ""
    if not turned:
        bare = [t.strip(".") for t in toks]
        initial = [only_initials(b) for b in bare]
        full = [i for i, f in enumerate(initial) if not f and not (fold(bare[i]) in PARTICLES and not bare[i].isupper())]
        if len(toks) > 1 and full and initial[-1] and not initial[0]:  # Surname I.
            cut = next(i for i, f in enumerate(initial) if f)
            toks = toks[cut:] + toks[:cut]
        elif len(full) >= 2 and bare[full[0]].isupper() and not bare[full[-1]].isupper() and (len(bare[full[0]]) > 3 or fold(bare[full[0]]) in PARTICLES):  # SURNAME Given
            lead = max(i for i in full if all(bare[j].isupper() for j in full if j <= i)) + 1
            toks = toks[lead:] + toks[:lead]
        elif len(full) == 2 and fold(bare[0]) in PARTICLES and bare[0].islower() and full[1] == len(toks) - 1 and full[0] == full[1] - 1:  # van Surname Given
            toks = toks[-1:] + toks[:-1]
        elif len(full) == 2 and len(toks) == 2:
            order = "?"
    # particles before the surname belong to it; in a turned form they precede its last word
    bare = [t.strip(".") for t in toks]
    end = len(bare) - 1
    while end >= 0 and fold(bare[end]) in PARTICLES:
        end -= 1
    if end < 0:
        return Name("")
    start = end
    while start > 0 and fold(bare[start - 1]) in PARTICLES:
        start -= 1
    sur = fold(bare[end]).replace("'", "")
    particle = "".join(fold(b) for b in bare[start:end])
    m = re.match(r"^(al|el)-(.{3,})$", sur)
    if m:
        particle, sur = particle + m.group(1), m.group(2)
    sur = re.sub(r"[^\w]", "", sur)
    front = bare[:start] + bare[end + 1 :]
    given, initials, middle = "", "", ""
    for t in front:
        plain = re.sub(r"[^\w]", "", t)
        if fold(plain) in PARTICLES and plain.islower():
            particle += fold(plain)
            continue
        if only_initials(t):
            if given:
                middle += fold(plain)
            else:
                initials += fold(plain)
        elif not given:
            given = fold(t)
            order = "" if initials else order
        else:
            middle += fold(plain)[0]
    return Name("p", sur, particle, re.sub(r"[^\w-]", "", given), initials, middle, order)


def only_initials(token: str) -> bool:
    """One letter, two capitals, or three capitals without a vowel."""
    t = re.sub(r"[^\w]", "", token)
    return len(t) == 1 or (t.isupper() and (len(t) == 2 or (len(t) == 3 and not _VOWELS & set(fold(t)))))


def apart_person(s: str) -> str:
    """A name written as one word is split before its second capital; one of several words is left alone."""
    return s if re.search(r"[\w.][\s.,]+\w", s.strip()) else re.sub(r"([a-zß-ž])([A-ZÀ-Þ][a-zß-ž])", r"\1 \2", s)


def title(token: str, last: bool) -> bool:
    """Whether a token is a title or suffix; two capitals at the end of a name are initials."""
    t = token.strip(".")
    return fold(t) in TITLES and not (last and len(t) == 2 and t.isupper() and not token.endswith("."))


def start_letters(given: str) -> list[str]:
    """Letters by which a given name may be abbreviated or that a slip of its start leaves first."""
    g = given.replace("-", "")
    out = set(g[:2])
    for full in NICKNAMES.get(g, ()):
        out.add(full[0])
    return sorted(out)


def initial_strings(given: str, middle: str) -> set[str]:
    """All ways to write a given name with middle initials by initials alone."""
    parts = [x for x in given.split("-") if x]
    heads = {parts[0][0], "".join(x[0] for x in parts)} if parts else set()
    heads |= {full[0] for full in NICKNAMES.get(given, ())}
    return heads | {h + middle for h in heads} if middle else heads


#: Costs of pairing words of names: a familiar form, an initial, a misspelling, a word that the other spelling leaves out. A
#: person may differ by one misspelling, or by a familiar form, and by words left out.
FAMILIAR, INITIAL, SLIP, OMITTED, PERSON = 0.3, 0.2, 0.5, 0.1, 0.8


def given_cost(a: str, b: str, ca: int, cb: int) -> float | None:
    """Cost of reading two given names, which go with ``ca`` and ``cb`` surnames, as one; None if they are two.

    A misspelling has few edits, and goes with far fewer surnames than the right form.
    """
    x, y = a.replace("-", ""), b.replace("-", "")
    if x == y:
        return 0.0
    if y in NICKNAMES.get(x, ()) or x in NICKNAMES.get(y, ()):
        return FAMILIAR
    if min(ca, cb) > RARE * max(ca, cb):
        return None
    bound = 1 if min(len(x), len(y)) < 6 else 2
    return SLIP if damerau(x, y, bound) <= bound else None


class Token(NamedTuple):
    """A word of a person's name. ``role``: s (surname with its particle), g (given name), i (initial of it), m (middle initial)."""

    role: str
    text: str
    uses: int = 0
    extra: str = ""


def person_tokens(m: tuple) -> tuple[Token, ...]:
    """The words of a spelling (name, kind, surname, particle, given, initials, middle, ...): surname, given name or initial, middle initial."""
    out = [Token("s", m[2], 0, m[3])]
    if m[4]:
        out.append(Token("g", m[4], m[8]))
        if m[6]:
            out.append(Token("m", m[6][0]))
    elif m[5]:
        out.append(Token("i", m[5]))
    return tuple(out)


def person_cost(x: Token, y: Token) -> float | None:
    """Cost of pairing two words of persons' names, None if they are no partners; an empty word stands for one left out."""
    if not x.role or not y.role:
        return OMITTED if (x.role or y.role) == "m" else None
    if x.role == "s" == y.role:
        if x.extra != y.extra:
            return None
        if x.text == y.text:
            return 0.0
        return SLIP if min(len(x.text), len(y.text)) > 4 and damerau(x.text, y.text, 1) <= 1 else None
    if x.role == "g" == y.role:
        return given_cost(x.text, y.text, x.uses, y.uses)
    if x.role == y.role:
        return 0.0 if x.text == y.text else None
    first, other = (x, y) if x.role == "i" else (y, x)
    if first.role == "i" and other.role == "g":
        return INITIAL if any(first.text.startswith(h) for h in initial_strings(other.text, "")) else None
    return None


def same_person(a: tuple, b: tuple) -> bool:
    """Whether two spellings are one person by the optimal assignment of their words: one slip, a familiar form or an initial at most."""
    x, y = person_tokens(a), person_tokens(b)
    n = max(len(x), len(y))
    cost = assigned(x + (Token("", ""),) * (n - len(x)), y + (Token("", ""),) * (n - len(y)), person_cost)
    return cost is not None and cost < PERSON


@lru_cache(200_000)
def token_cost(x: str, y: str) -> float | None:
    """Cost of pairing two words of organisations, None if they are no partners."""
    if x == y:
        return 0.0
    if shortens(x, y) or shortens(y, x):
        return 0.3
    bound = 1 if min(len(x), len(y)) < 7 else 2
    d = damerau(x, y, bound)
    return 0.5 * d if d <= bound and min(len(x), len(y)) > 3 else None


def assigned(a: tuple, b: tuple, cost=None) -> float | None:
    """Least cost of an optimal one-to-one assignment of two token lists, None if a token finds no partner.

    A word of an organisation pairs with its equal (0), its abbreviation (0.3) or a misspelling of one or two letters
    (0.5 each); ``person_cost`` tells what pairs in names of persons. A dynamic programme over the sets of used
    tokens finds the optimum of short lists, the Hungarian method that of longer ones.
    """
    if cost is None:
        cost = token_cost
        if len(a) == len(b) and sorted(a) == sorted(b):
            return 0.0
        if len(a) != len(b):
            a, b = spelled_out(a, b), spelled_out(b, a)
    if len(a) != len(b):
        return None
    if len(a) > 10:
        return hungarian([[cost(x, y) for y in b] for x in a])

    best: dict[int, float] = {0: 0.0}
    for x in a:
        step: dict[int, float] = {}
        for used, c in best.items():
            for j, y in enumerate(b):
                if not used >> j & 1 and (k := cost(x, y)) is not None and c + k < step.get(used | 1 << j, 1e9):
                    step[used | 1 << j] = c + k
        best = step
    return min(best.values(), default=None)


def hungarian(cost: list[list[float | None]]) -> float | None:
    """Least sum of a one-to-one assignment of rows to columns, None if there is none; takes the cube of their number."""
    n, never = len(cost), 1e6
    u, v, of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j, least, way, used = i, 0, [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while of[j]:
            used[j], row, delta, to = True, of[j], float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    c = cost[row - 1][k - 1]
                    c = (never if c is None else c) - u[row] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            of[j] = of[way[j]]
            j = way[j]
    pairs = [cost[of[k] - 1][k - 1] for k in range(1, n + 1)]
    return None if None in pairs else sum(pairs)


def spelled_out(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """``a`` with a token that is the initials of consecutive tokens of ``b`` replaced by them, or split where it is two of them joined."""
    for i, t in enumerate(a):
        for j in range(len(b)):
            for k in range(j + 2, min(len(b), j + len(t), j + 5) + 1):
                run = b[j:k]
                if t == "".join(w[0] for w in run) or t == "".join(run):
                    return a[:i] + run + a[i + 1 :]
    return a


class OrganisationIndex:
    """Members of a block's groups by their words, so that a name meets only those it could be assigned to."""

    def __init__(self, names: list[tuple[str, ...]]) -> None:
        self.partners: dict[str, set[str]] = defaultdict(set)
        near: dict[str, list[str]] = defaultdict(list)
        for t in {t for ts in names for t in ts}:
            # abbreviations share the first letter, misspellings a string left by as many deletions
            keys = {"^" + t[0]} | (deletes(t, 1 if len(t) < 7 else 2) if len(t) > 3 else set())
            for u in {u for k in keys for u in near[k]} | {t}:
                if token_cost(t, u) is not None:
                    self.partners[t].add(u)
                    self.partners[u].add(t)
            for k in keys:
                near[k].append(t)
        self.word: dict[tuple[int, str], set[int]] = defaultdict(set)
        self.any_word: dict[str, set[int]] = defaultdict(set)
        self.run: dict[str, set[int]] = defaultdict(set)

    @staticmethod
    def runs(ts: tuple[str, ...]) -> set[str]:
        """What ``spelled_out`` may take for two to five consecutive words: their initials, or all of them joined."""
        cuts = [ts[j:k] for j in range(len(ts)) for k in range(j + 2, min(len(ts), j + 5) + 1)]
        return {"".join(c) for c in cuts} | {"".join(w[0] for w in c) for c in cuts}

    def add(self, ts: tuple[str, ...], group: int) -> None:
        for t in ts:
            self.word[len(ts), t].add(group)
            self.any_word[t].add(group)
        for r in self.runs(ts):
            self.run[r].add(group)

    def groups(self, ts: tuple[str, ...]) -> list[int]:
        """Groups with a member of as many words, each with a partner, or one that is spelled out by the name or spells it out."""
        fits: set[int] | None = None
        for t in ts:
            mine = {g for u in self.partners[t] for g in self.word.get((len(ts), u), ())}
            fits = mine if fits is None else fits & mine
            if not fits:
                break
        found = set(fits or ()).union(*[self.run.get(t, ()) for t in ts], *[self.any_word.get(r, ()) for r in self.runs(ts)])
        return sorted(found)


class PersonIndex:
    """Clusters of a block by the slips and familiar forms of their names, so that a cluster meets only those it could be one person with."""

    def __init__(self) -> None:
        self.at: dict[tuple[str, ...], set[int]] = defaultdict(set)

    @staticmethod
    def keys(m: tuple) -> list[tuple[str, ...]]:
        g = m[4].replace("-", "")
        forms = {"=" + n for n in (g, *NICKNAMES.get(g, ()))} | deletes(g, 1 if len(g) < 6 else 2)
        return [("g", m[3], m[2], v) for v in forms] + ([("s", m[3], g, v) for v in deletes(m[2], 1)] if len(m[2]) > 4 else [])

    def add(self, members: list[tuple], cluster: int) -> None:
        for m in {(m[2], m[3], m[4]): m for m in members if m[4]}.values():
            for k in self.keys(m):
                self.at[k].add(cluster)

    def clusters(self, m: tuple) -> list[int]:
        return sorted(set().union(*[self.at.get(k, ()) for k in self.keys(m)]))


def link_block(rows: list[tuple]) -> list[set[str]]:
    """Clusters of the spellings of one block.

    A row is (name, kind, surname, particle, given, initials, middle, tokens, companions, uses). In a block of
    more than ``BLOCK_NAMES`` rows an index leaves out comparisons that could find nothing.
    """
    out = []
    indexed = len(rows) > BLOCK_NAMES
    orgs = sorted((r for r in rows if r[1] == "o"), key=lambda r: (-r[9], r[0]))
    groups: list[list[tuple]] = []
    forms: list[list[tuple[str, ...]]] = []  # the different token lists of each group
    words = OrganisationIndex([tuple(r[7]) for r in orgs]) if indexed or len(orgs) > BLOCK_ORGANISATIONS else None
    for r in orgs:
        mine = tuple(r[7])
        for i in words.groups(mine) if words else range(len(groups)):
            if any((c := assigned(mine, m)) is not None and c <= 1.5 for m in forms[i]):
                break
        else:
            i = len(groups)
            groups.append([])
            forms.append([])
        groups[i].append(r)
        if mine not in forms[i]:
            forms[i].append(mine)
            if words:
                words.add(mine, i)
    out += [{m[0] for m in g} for g in groups]

    people = [r for r in rows if r[1] == "p"]
    full: dict[tuple[str, str, str], list[tuple]] = defaultdict(list)
    for r in people:
        if r[4]:
            full[r[2], r[3], r[4].replace("-", "")].append(r)
    clusters: list[list[tuple]] = []
    for members in full.values():
        middles = {m[6][0] for m in members if m[6]}
        if len(middles) <= 1:
            clusters.append(members)
        else:  # several people of one name: told apart by the middle initial
            clusters += [[m for m in members if m[6][:1] == x] for x in sorted(middles | {""}) if any(m[6][:1] == x for m in members)]
    clusters.sort(key=lambda c: (-sum(m[9] for m in c), c[0][0]))
    kept: dict[int, list[tuple]] = {}
    slips = PersonIndex() if indexed else None
    for n, c in enumerate(clusters):
        fits = [i for i in (slips.clusters(c[0]) if slips else kept) if i in kept and one_person(c, kept[i])]
        if len(fits) > 1:
            near = [i for i in fits if kept[i][0][2] == c[0][2]]
            fits = near if len(near) == 1 else fits
        if len(fits) > 1 and all(kept[i][0][2] == c[0][2] and max(m[8] for m in kept[i] if m[4]) <= RARE * c[0][8] for i in fits):  # misspellings of this one name
            for i in fits[1:]:
                moved = kept.pop(i)
                kept[fits[0]].extend(moved)
                if slips:
                    slips.add(moved, fits[0])
            fits = fits[:1]
        to = fits[0] if len(fits) == 1 else n
        kept.setdefault(to, []).extend(c)
        if slips:
            slips.add(c, to)
    # clusters by surname, particle and the initials they may be written with; "*" stands for a middle initial they lack
    told: dict[tuple[str, str, str], set[int]] = defaultdict(set)
    exact: dict[tuple[str, str], set[int]] = defaultdict(set)
    surnames: set[tuple[str, str]] = set()
    for i, k in kept.items():
        for m in k:
            if m[4]:
                surnames.add((m[2], m[3]))
                for h in initial_strings(m[4], m[6][:1]):
                    told[m[2], m[3], h].add(i)
                    exact[m[2], h].add(i)
                    if not m[6]:
                        told[m[2], m[3], h + "*"].add(i)
    short: dict[tuple[str, str, str], list[tuple]] = defaultdict(list)
    for r in people:
        if not r[4] and r[5]:
            short[r[2], r[3], r[5]].append(r)
    alone = []
    for (sur, particle, ini), members in short.items():
        same = told.get((sur, particle, ini), set()) | told.get((sur, particle, ini[:-1] + "*"), set())
        if len(same) > 1 and len(ini) > 1:
            precise = same & exact.get((sur, ini), set())
            same = precise if len(precise) == 1 else same
        if not same:
            near = [s for s, p in surnames if p == particle and damerau(s, sur, 1) <= 1]
            same = set().union(*[told.get((s, particle, h), ()) for s in near for h in (ini, ini[:-1] + "*")])
        same = {i for i in same if any(same_person(members[0], m) for m in kept[i] if m[4])}
        if len(same) == 1:
            kept[min(same)].extend(members)
        elif not same:
            alone.append(members)
    out += [{m[0] for m in k} for k in (*kept.values(), *alone)]
    return [c for c in out if len(c) > 1]


def one_person(a: list[tuple], b: list[tuple]) -> bool:
    """Whether two clusters of spelled-out names are one person: no middle initials apart, and a form of one assigned to a form of the other."""
    mx, my = {m[6][0] for m in a if m[6]}, {m[6][0] for m in b if m[6]}
    if mx and my and not mx & my:
        return False
    x, forms = a[0], {(m[2], m[3], m[4]): m for m in b if m[4]}
    # a form that differs in both names is none, whatever the assignment would cost
    return any(same_person(x[:6] + ("",) + x[7:], y[:6] + ("",) + y[7:]) for y in forms.values() if x[2] == y[2] or x[4].replace("-", "") == y[4].replace("-", ""))


def spellings(papers: DataFrame, column: str = "authors") -> DataFrame:
    """(name, uses): the distinct elements of the decoded JSON lists and their counts; null, unreadable and empty lists and blank elements give none."""
    names = papers.select(F.explode(F.from_json(column, "array<string>")).alias("name"))
    return names.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.count("*").alias("uses"))


_PARSED = "name string, uses long, kind string, surname string, particle string, given string, initials string, middle string, `order` string, tokens array<string>"


def read_names(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(n) for n in b.column(0).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.string()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array([list(g.tokens) for g in got], pa.list_(pa.string()))], ["name", "uses", "kind", "surname", "particle", "given", "initials", "middle", "order", "tokens"])

    return names.select("name", "uses").mapInArrow(run, _PARSED)


def name_pairs(papers: DataFrame, column: str = "authors") -> DataFrame:
    """(name_a < name_b): all pairs of different spellings that name the same person or organisation.

    Rows: exact strings of the lists, whatever their case or spacing. Names without letters are linked
    to none. A spelling by initials that fits several people stays alone, as does a name that could be
    a misspelling of two others. Result pairs are all pairs of a connected component of the links.

    Spellings meet in blocks of (a string left of the surname by at most one deletion, a letter the
    given name may begin with); of organisations, any of their words takes the surname's
    place. A block is linked as a whole whatever its size, as initials link only where no second
    person fits; a task holds the spellings of one block at a time.
    """
    parsed = stage(read_names(spellings(papers, column)))
    people = parsed.where("kind = 'p'")
    rank = people.where("given <> ''").groupBy(F.regexp_replace("given", "-", "").alias("token")).agg(F.countDistinct("surname").alias("companions"))
    rank = stage(rank)
    as_given = rank.select(F.col("token").alias("g"), F.col("companions").alias("cg"))
    as_surname = rank.select(F.col("token").alias("s"), F.col("companions").alias("cs"))
    told = people.withColumn("g", F.regexp_replace("given", "-", "")).withColumn("s", F.col("surname")).join(as_given, "g", "left").join(as_surname, "s", "left")
    swap = (F.col("order") == "?") & (F.coalesce("cs", F.lit(0)) >= 3) & (F.coalesce("cs", F.lit(0)) > 4 * F.coalesce("cg", F.lit(0)))
    told = told.select("name", "uses", "kind", F.when(swap, F.col("g")).otherwise(F.col("surname")).alias("surname"), "particle", F.when(swap, F.col("surname")).otherwise(F.col("given")).alias("given"), "initials", "middle", "tokens", F.coalesce(F.when(swap, F.col("cs")).otherwise(F.col("cg")), F.lit(0)).alias("companions"))
    orgs = parsed.where("kind = 'o'")
    orgs = orgs.select("name", "uses", "kind", F.lit("").alias("surname"), "particle", "given", "initials", "middle", "tokens", F.lit(0).cast("long").alias("companions"))
    rows = told.unionByName(orgs)
    cols = ["name", "kind", "surname", "particle", "given", "initials", "middle", "tokens", "companions", "uses"]
    schema = "key long, name string, kind string, surname string, particle string, given string, initials string, middle string, tokens array<string>, companions long, uses long"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            d = b.to_pydict()
            take, keys = [], []
            for i, kind in enumerate(d["kind"]):
                if kind == "o":
                    mine = {v for w in d["tokens"][i] for v in deletes(w, 1)}
                else:
                    given, ini = d["given"][i], d["initials"][i]
                    letters = start_letters(given) if given else [ini[0]] if ini else [""]
                    mine = {v + " " + c for v in deletes(d["surname"][i], 1) if len(v) > 1 for c in letters}
                for v in mine:
                    take.append(i)
                    keys.append(digest(kind + v) - (1 << 63))
            pick = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[b.column(c).take(pick) for c in cols]], ["key", *cols])

    keys = rows.select(*cols).mapInArrow(keyed, schema)
    light = keys.select("key", "name")
    size = light.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    placed = light.join(size.select("key"), "key").join(rows.select(*cols), "name")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a partition sorted by key; a block may span batches."""
        held: list[tuple] = []
        now, seen = None, set()

        def emit() -> list[tuple[str, str]]:
            new = []
            if len(held) > 1:
                for c in link_block(held):
                    least = min(c)
                    new += [(least, b) for b in c if b != least]
            return new

        for b in batches:
            out: list[tuple[str, str]] = []
            for row in zip(*[b.column(c).to_pylist() for c in ["key", *cols]]):
                if row[0] != now:
                    out += emit()
                    held.clear()
                    now = row[0]
                held.append(row[1:])
            fresh = [p for p in dict.fromkeys(out) if p not in seen]
            if len(seen) < 1_000_000:
                seen.update(fresh)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh], pa.string()), pa.array([p[1] for p in fresh], pa.string())], ["name_a", "name_b"])
        out = emit()
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.string())], ["name_a", "name_b"])

    links = stage(placed.repartition("key").sortWithinPartitions("key").mapInArrow(sweep, "name_a string, name_b string").distinct())
    member = components(links)
    one, other = member.select("root", F.col("name").alias("name_a")), member.select("root", F.col("name").alias("name_b"))
    return one.join(other, "root").where("name_a < name_b").select("name_a", "name_b")


def components(links: DataFrame) -> DataFrame:
    """(name, root): the smallest name of each connected component of links (name_a, name_b).

    Every name takes the smallest label among its neighbours' until none changes; as blocks emit stars around
    their smallest name, few rounds suffice. Labels stay in tables of the shared folder.
    """
    edges = links.unionByName(links.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b")))
    labels = stage(edges.groupBy(F.col("name_a").alias("name")).agg(F.least("name", F.min("name_b")).alias("root")))
    while True:
        heard = edges.join(labels.select(F.col("name").alias("name_b"), "root"), "name_b").groupBy(F.col("name_a").alias("name")).agg(F.min("root").alias("heard"))
        moved = stage(labels.join(heard, "name").select("name", F.least("root", "heard").alias("root"), (F.col("heard") < F.col("root")).alias("changed")))
        labels = moved.select("name", "root")
        if moved.where("changed").isEmpty():
            return labels
