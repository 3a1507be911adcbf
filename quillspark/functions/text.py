"""Text operators as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed as V


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def holds_any(c: Column, words: list[str]) -> Column:
    """Whether a text contains one of the literals; false for null."""
    return F.coalesce(any_of([c.contains(w) for w in words]), F.lit(False))


def sql_literal(c: Column) -> Column:
    """A text as it may stand in a SQL text: in quotes, its own doubled. Expressions here need none; exports of predicates do."""
    return F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))


def like_literal(c: Column) -> Column:
    """A name reduced to letters, digits, space, point, hyphen and ampersand; runs of hyphens and spaces become a space; 60 characters at most."""
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z .\-&]", ""), r"[-\s]{2,}", " "), 1, 60))


def venue_of(comment: Column) -> Column:
    """First keyword, in binary order, that a comment contains; null for blank comments and for those that deny publication."""
    low = F.lower(comment)
    hit = F.coalesce(*[F.when(low.contains(k.lower()), F.lit(k)) for k in sorted(V.CONFERENCES + V.JOURNALS)])
    return F.when((F.trim(comment) != "") & ~holds_any(low, V.NO_VENUE), hit)


def sentences(c: Column, least: int = 15) -> Column:
    """Sentences of a text: split after ``.!?`` and white space, trimmed, of at least ``least`` characters."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) >= least)


def snippet(top: Column) -> Column:
    """The first 120 characters of one or two sentences, joined by a bar."""
    return F.array_join(F.transform(F.slice(top, 1, 2), lambda s: F.concat(F.substring(s, 1, 120), F.lit("..."))), " | ")


def artifact_flags(abstract: Column, pdf_url: Column) -> dict[str, Column]:
    low, url = F.lower(F.coalesce(abstract, F.lit(""))), F.lower(F.coalesce(pdf_url, F.lit("")))
    one = lambda cond: cond.cast("int")
    return {
        "has_code": low.contains("github.com/") | url.contains("github.com/"),
        "has_dataset": holds_any(low, V.DATASET_PHRASES),
        "reproducibility": one(low.contains("ablation")) + one(low.contains("code available") | low.contains("github.com/")) + one(low.contains("reproducib")),
    }


def paper_type(abstract: Column) -> Column:
    low = F.lower(F.coalesce(abstract, F.lit("")))
    return F.coalesce(*[F.when(holds_any(low, words), F.lit(tag)) for tag, words in V.PAPER_TYPES], F.lit("Other"))


def hype(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(low.contains("benchmark") | low.contains("dataset"), 50).otherwise(0) + F.when(low.contains("survey"), 40).otherwise(0) + F.when(low.contains("llm"), 10).otherwise(0)


def sniper(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(low.contains("benchmark"), 50).otherwise(0) - F.when(holds_any(low, V.NICHE_WORDS), 20).otherwise(0)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))


def brief(wanted: Column, unwanted: Column) -> Column:
    """The two sections of a brief under their headers; a fixed sentence when both are blank."""
    parts = F.concat_ws("\n\n", F.when(F.trim(wanted) != "", F.concat(F.lit(V.BRIEF_HEADER + "\n"), F.trim(wanted))), F.when(F.trim(unwanted) != "", F.concat(F.lit(V.NOT_HEADER + ":\n"), F.trim(unwanted))))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit(V.NO_BRIEF))


def positive_part(c: Column) -> Column:
    """A brief up to its exclusion header."""
    return F.split(c, f"(?i){V.NOT_HEADER}")[0]


def semantic_query(c: Column) -> Column:
    """The clean statement of a brief: no headers, single spaces, at most 512 characters, cut after a sentence where one ends in the second half."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(positive_part(c), rf"(?m)^{V.BRIEF_HEADER}\s*", ""), r"\s+", " "))
    end = F.regexp_instr(F.substring(flat, 201, 312), F.lit(r"[.!?]\s"))
    return F.when(F.length(flat) <= 512, flat).when(end > 0, F.substring(flat, F.lit(1), (F.lit(200) + end).cast("int"))).otherwise(F.substring(flat, 1, 512))


def without_negation(c: Column) -> Column:
    return F.regexp_replace(positive_part(c), V.INLINE_NOT, "")


def not_terms(c: Column) -> Column:
    """Terms a brief rejects: those of its exclusion section, then those of inline phrases; longer than three characters, first ten."""
    section = F.coalesce(F.get(F.split(c, f"(?i){V.NOT_HEADER}", 2), 1), F.lit(""))
    inline = F.regexp_extract_all(positive_part(c), F.lit(V.INLINE_NOT), 1)
    chunks = F.concat(F.array(section), inline)
    raw = F.flatten(F.transform(chunks, lambda x: F.split(x, r"(?i)[,\n;]+|\band\b|\bor\b")))
    clean = F.transform(raw, lambda x: F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")), r"^[-–—:.]+|[-–—:.]+$", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) > 3)), 1, 10)


def clean_secret(c: Column) -> Column:
    """A setting without white space and quotes around it."""
    return F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")


def grounded(value: Column, text: Column) -> Column:
    """Whether a word of three letters or more of a value occurs in a text, letter case aside."""
    ws = F.filter(F.split(F.lower(value), "[^0-9a-z]+"), lambda w: F.length(w) >= 3)
    return F.coalesce(F.exists(ws, lambda w: F.contains(F.lower(text), w)), F.lit(False))


def union_terms(a: Column, b: Column) -> Column:
    """The terms of both lists, each once whatever its case, in order; the first writing stays."""
    both = F.filter(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda t: t.isNotNull())
    return bound(both, lambda all_: bound(F.transform(all_, F.lower), lambda low: F.filter(all_, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)))


def split_terms(c: Column) -> Column:
    """User-typed exclusion terms: split at commas, lines and semicolons, trimmed, lower case."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\n;]+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def authors_of(c: Column) -> Column:
    """Up to five names stated with "by"."""
    found = F.regexp_extract_all(c, F.lit(V.STATED_BY), 1)
    names = F.transform(F.flatten(F.transform(found, lambda m: F.split(m, r"(?i)\s+and\s+|\s*&\s*|,\s*"))), F.trim)
    kept = F.filter(names, lambda n: (F.length(n) >= 2) & ~F.lower(F.split(n, " ")[0]).isin(V.NOT_NAMES))
    return F.slice(F.array_distinct(kept), 1, 5)


def intent(c: Column) -> Column:
    """The first kind of signal in a brief, exclusions aside; a year or a named author makes it specific."""
    text = without_negation(c)
    signal = [F.when(text.rlike(r"(?i)\b(?:" + "|".join(re.escape(w) for w in words) + r")s?\b"), F.lit(name)) for name, words in V.INTENTS]
    return F.coalesce(*signal, F.when(text.rlike(r"\b20\d{2}\b") | (F.size(authors_of(text)) > 0), F.lit("specific")), F.lit("general"))


def quality(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(holds_any(low, words), F.lit(name)) for name, words in V.QUALITIES], F.lit("any"))


def _number(c: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("int")


def year_range(c: Column, this_year: int) -> tuple[Column, Column]:
    """Year bounds a brief states: a range, else last N years, since and before; a bare year bounds nothing."""
    a, b = _number(c, V.YEAR_RANGE), _number(c, V.YEAR_RANGE, 2)
    last = F.lit(this_year) - _number(c, V.LAST_YEARS)
    since, until = _number(c, V.SINCE_YEAR), _number(c, V.UNTIL_YEAR)
    return F.when(a.isNotNull(), F.least(a, b)).otherwise(F.coalesce(last, since)), F.when(a.isNotNull(), F.greatest(a, b)).otherwise(until)


def year_in(c: Column) -> Column:
    """First 19xx or 20xx in any value."""
    return _number(c.cast("string"), rf"({V.YEAR})")


def keywords(c: Column, n: int = V.KEYWORDS) -> Column:
    """The ``n`` weightiest terms of a brief's statement: pairs of neighbouring content words count twice, words within no pair once.

    Equal weights go by first place, pairs before words. Short words and stop words are no content.
    """
    content = lambda w: (F.length(w) > 2) & ~w.isin(V.STOP_WORDS)

    def neighbours(low: Column) -> Column:
        ws = F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, r"^[^a-z]+|[^a-z\-]+$", ""))
        return bound(ws, lambda w: F.filter(F.zip_with(w, F.slice(F.concat(w, F.array(F.lit(""))), F.lit(2), F.size(w)), lambda a, b: F.when(content(a) & content(b), F.concat_ws(" ", a, b))), lambda p: p.isNotNull()))

    def weighed(terms: Column, each: int, kind: int) -> Column:
        return F.transform(F.array_distinct(terms), lambda t: F.struct((-each * F.size(F.filter(terms, lambda u: u == t))).alias("w"), F.lit(kind).alias("k"), F.array_position(terms, t).alias("at"), t.alias("term")))

    def ranked(x: Column) -> Column:
        lone = F.filter(x["runs"], lambda w: content(w) & ~F.exists(x["pairs"], lambda p: p.contains(w)))
        return F.array_sort(F.concat(weighed(x["pairs"], 2, 0), bound(lone, lambda t: weighed(t, 1, 1))))

    both = bound(F.lower(semantic_query(c)), lambda low: F.struct(neighbours(low).alias("pairs"), F.regexp_extract_all(low, F.lit(r"\b([a-z][a-z\-]+)\b"), 1).alias("runs")))
    return F.transform(F.slice(bound(both, ranked), 1, n), lambda x: x["term"])


def letters_match(acronym: Column, phrase: Column) -> Column:
    """Whether the initials of a phrase, of all words or without connectors, spell an acronym."""
    ws = F.filter(F.split(phrase, "[^0-9A-Za-z]+"), lambda w: w != "")
    initials = lambda arr: F.upper(F.array_join(F.transform(arr, lambda w: F.substring(w, 1, 1)), ""))
    return (F.size(ws) > 0) & ((initials(ws) == F.upper(acronym)) | (initials(F.filter(ws, lambda w: ~F.lower(w).isin(V.CONNECTORS))) == F.upper(acronym)))


def acceptable(term: Column) -> Column:
    low = F.lower(F.trim(term))
    return ~low.isin(V.LEAK_TERMS + V.GENERIC_TERMS) & ~term.contains(":") & ~low.startswith("brief")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def window_label(low: Column, high: Column) -> Column:
    """Label of year bounds; null and 0 count as absent."""
    a, b = F.nullif(low, F.lit(0)).cast("string"), F.nullif(high, F.lit(0)).cast("string")
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("–"), b)).when(a.isNotNull(), F.concat(F.lit("from "), a)).when(b.isNotNull(), F.concat(F.lit("up to "), b))


def stage_index(message: Column) -> Column:
    """Stage of a progress message by the first marker it holds, else 1."""
    return F.coalesce(*[F.when(message.contains(m), F.lit(n)) for m, n in V.STAGE_MARKERS], F.lit(1))


def cache_key(c: Column) -> Column:
    return F.md5(F.lower(F.trim(c)))


def fenced_json(c: Column) -> Column:
    """What lies between the first ``[`` and the last ``]``, code fences aside; null if that is no JSON list."""
    inner = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.when(F.get_json_object(inner, "$[*]").isNotNull() | (F.trim(inner) == "[]"), inner)
