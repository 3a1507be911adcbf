"""Queries of the operators that read briefs, and their SQL counterparts. Real briefs are the documents of that kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.functions import scores as S
from quillspark.functions import text as X
from quillspark.plans import brief as B
from quillspark.plans.catalogue import _AUTHORS, _FLAT, _INLINE, _POSITIVE, _STRIPPED, _INTENT_CASE, _ANY, _year_sql, _RANGE, _Y, papers_of, query, table
from quillspark.plans.search import Request, understanding

THIS_YEAR = 2026


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def of_kind_brief(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").where("doc_kind = 'brief' and text is not null").select("doc_id", F.col("text").alias("brief"))


OWN = "b AS (SELECT doc_id, text AS brief FROM documents WHERE doc_kind = 'brief' AND text IS NOT NULL)"
_OK = "length({0}) > 2 AND {0} NOT IN (" + quoted(V.STOP_WORDS) + ")"

KEYWORD_SQL = f"""{OWN}, s AS (SELECT doc_id, {_FLAT} AS flat FROM b), c AS (SELECT doc_id, lower(CASE WHEN length(flat) <= 512 THEN flat WHEN regexp_matches(substr(flat, 201, 312), '[.!?]\\s') THEN substr(flat, 1, 200 + length(regexp_extract(substr(flat, 201, 312), '^(?s)(.*?[.!?])\\s', 1))) ELSE substr(flat, 1, 512) END) AS low FROM s),
w AS (SELECT doc_id, list_transform(regexp_split_to_array(low, '\\s+'), lambda x: regexp_replace(x, '^[^a-z]+|[^a-z\\-]+$', '', 'g')) AS w, regexp_extract_all(low, '\\b([a-z][a-z\\-]+)\\b', 1) AS r FROM c),
p AS (SELECT doc_id, r, list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN {_OK.format('w[i]')} AND {_OK.format('w[i+1]')} THEN w[i] || ' ' || w[i+1] END), lambda x: x IS NOT NULL) AS pairs FROM w),
l AS (SELECT doc_id, pairs, list_filter(r, lambda x: {_OK.format('x')} AND len(list_filter(pairs, lambda q: contains(q, x))) = 0) AS lone FROM p),
t AS (SELECT doc_id, unnest(pairs) AS term, generate_subscripts(pairs, 1) AS pos, 0 AS kind FROM l UNION ALL SELECT doc_id, unnest(lone), generate_subscripts(lone, 1), 1 FROM l),
g AS (SELECT doc_id, term, kind, count(*) * (2 - kind) AS weight, min(pos) AS pos FROM t GROUP BY doc_id, term, kind),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, kind, pos, term) AS place FROM g)"""


@query(f"WITH {KEYWORD_SQL} SELECT doc_id, place, term FROM k WHERE place <= {V.KEYWORDS}")
def brief_keywords(spark, folder):
    rows = of_kind_brief(spark, folder)
    return rows.select("doc_id", F.posexplode(X.keywords(F.col("brief"))).alias("place", "term")).select("doc_id", (F.col("place") + 1).alias("place"), "term")


@query(f"WITH {KEYWORD_SQL} SELECT doc_id, array_to_string(list(term ORDER BY place), '|') AS terms FROM k WHERE place <= 16 AND lower(trim(term)) NOT IN ({quoted(V.LEAK_TERMS + V.GENERIC_TERMS)}) AND NOT contains(term, ':') AND NOT starts_with(lower(trim(term)), 'brief') GROUP BY doc_id")
def keyword_acceptance(spark, folder):
    kept = F.filter(X.keywords(F.col("brief"), 16), X.acceptable)
    return of_kind_brief(spark, folder).select("doc_id", F.array_join(kept, "|").alias("terms")).where("terms <> ''")


@query(
    f"""WITH {OWN}, y AS (SELECT doc_id, brief, {_STRIPPED} AS t, {_year_sql(_RANGE)} AS a, {_year_sql(_RANGE, 2)} AS z, {THIS_YEAR} - {_year_sql('\\b(?:last|past)\\s+([0-9]{1,2})\\s*years?\\b')} AS n,
{_year_sql(f'\\b(?:since|after|from|post-?)\\s*({_Y})\\b')} AS f, {_year_sql(f'\\b(?:before|prior to|up to|until|earlier than|pre-?)\\s*({_Y})\\b')} AS u FROM b)
SELECT doc_id, CASE {_INTENT_CASE} WHEN regexp_matches(t, '\\b20[0-9]{{2}}\\b') OR regexp_matches(t, '{_AUTHORS}') THEN 'specific' ELSE 'general' END AS intent,
CASE {" ".join(f"WHEN {_ANY('lower(brief)', w)} THEN '{q}'" for q, w in V.QUALITIES)} ELSE 'any' END AS quality,
CASE WHEN a IS NOT NULL THEN least(a, z) ELSE coalesce(n, f, -1) END AS low, CASE WHEN a IS NOT NULL THEN greatest(a, z) ELSE coalesce(u, -1) END AS high,
regexp_matches(brief, '{V.TEMPORAL_HINT}') AS timely, regexp_matches(brief, '{V.IMPACT_HINT}') AS weighty FROM y"""
)
def brief_evidence(spark, folder):
    """What briefs state, in bulk: the rules path of the analysis."""
    e = B.read_briefs(of_kind_brief(spark, folder), "brief", THIS_YEAR)
    return e.select("doc_id", "evidence.intent", "evidence.quality", F.coalesce("evidence.low", F.lit(-1)).alias("low"), F.coalesce("evidence.high", F.lit(-1)).alias("high"), "evidence.timely", "evidence.weighty")


@query("SELECT arxiv_id AS paper_id, len(list_filter(string_split_regex(lower(coalesce(venue, '')), '[^0-9a-z]+'), lambda w: length(w) >= 3 AND contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), w))) > 0 AS held FROM papers WHERE arxiv_id IS NOT NULL")
def grounding(spark, folder):
    return papers_of(spark, folder).select("paper_id", X.grounded(F.coalesce("venue", F.lit("")), F.concat_ws(" ", "title", "abstract")).alias("held"))


@query("SELECT arxiv_id AS paper_id, len(list_distinct(list_transform(list_concat(from_json(fields_of_study, '[\"VARCHAR\"]'), ['computer science', 'Robotics', 'ROBOTICS']), lambda x: lower(x)))) AS terms, coalesce(from_json(fields_of_study, '[\"VARCHAR\"]')[1], 'computer science') AS first FROM papers WHERE arxiv_id IS NOT NULL")
def term_union(spark, folder):
    rows = table(spark, folder, "papers").where("arxiv_id is not null")
    both = X.union_terms(F.from_json("fields_of_study", "array<string>"), F.array(F.lit("computer science"), F.lit("Robotics"), F.lit("ROBOTICS")))
    return rows.select(F.col("arxiv_id").alias("paper_id"), F.size(both).cast("long").alias("terms"), both[0].alias("first"))


@query("SELECT s_suppkey, len(list_filter(list_transform(string_split_regex(s_name || ', ' || s_suppkey || ';; A b' || chr(10) || ' ' || s_nationkey, '[,\\n;]+'), lambda x: lower(trim(x))), lambda x: x <> '')) AS n, lower(s_name) || '|' || s_suppkey || '|a b|' || s_nationkey AS terms FROM supplier")
def typed_exclusions(spark, folder):
    typed = F.concat("s_name", F.lit(", "), F.col("s_suppkey").cast("string"), F.lit(";; A b\n "), F.col("s_nationkey").cast("string"))
    return table(spark, folder, "supplier").select("s_suppkey", F.size(X.split_terms(typed)).cast("long").alias("n"), F.array_join(X.split_terms(typed), "|").alias("terms"))


@query("SELECT s_suppkey, s_name AS secret FROM supplier")
def secret_cleanup(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", X.clean_secret(F.concat(F.lit("  \"'"), "s_name", F.lit("'\" "))).alias("secret"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '[{\"id\":' || user_id || '}]' ELSE '-' END AS list FROM events")
def fenced_list(spark, folder):
    fenced = F.concat(F.lit("Here it is:\n```json\n[{\"id\":"), F.col("user_id").cast("string"), F.lit("}]\n```\nDone."))
    raw = F.when(F.col("user_id") % 3 == 0, fenced).when(F.col("user_id") % 3 == 1, F.lit("no list")).otherwise(F.lit("[broken"))
    return table(spark, folder, "events").select("event_id", F.coalesce(X.fenced_json(raw), F.lit("-")).alias("list"))


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6)::DOUBLE AS s FROM part")
def sigmoid(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.round(S.sigmoid((F.col("p_size") - 25) / 10.0), 6).alias("s"))


_INITIALS = "upper(array_to_string(list_transform({0}, lambda x: substr(x, 1, 1)), ''))"


@query("WITH w AS (SELECT venue_id, short_name, list_filter(regexp_split_to_array(canonical_name, '[^0-9A-Za-z]+'), lambda x: x <> '') AS ws FROM venue_list WHERE short_name IS NOT NULL) SELECT venue_id, len(ws) > 0 AND upper(short_name) IN (" + _INITIALS.format("ws") + ", " + _INITIALS.format("list_filter(ws, lambda x: lower(x) NOT IN (" + quoted(V.CONNECTORS) + "))") + ") AS fits FROM w")
def venue_acronyms(spark, folder):
    rows = table(spark, folder, "venue_list").where("short_name is not null")
    return rows.select("venue_id", X.letters_match(F.col("short_name"), F.col("canonical_name")).alias("fits"))


# --- on the driver: the expected rows are stated by hand


def stated(names: str, rows: list[tuple]) -> str:
    """SQL of rows that are known beforehand."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else quoted([x]) for x in r) + ')' for r in rows)}) AS t({names})"


COERCED = [(1, ""), (2, "one"), (3, "a|b"), (4, "7"), (5, "")]


@query(stated("n, items", COERCED))
def list_coercion(spark, folder):
    values = [None, " one ", ["a", " ", "b "], (7,), {}]
    return spark.createDataFrame([(i + 1, "|".join(B._strings(v))) for i, v in enumerate(values)], "n int, items string")


ANSWERS = [
    ("alignment with DPO", {"bm25_keywords": ["DPO", "Differential Privacy Optimization"]}),
    ("diffusion models for text, at NeurIPS. Exclude images", {"intent": "novelty", "quality_modifier": "recent", "semantic_query": "An invented paraphrase", "bm25_keywords": ["machine learning", "novel", "brief: diffusion", "diffusion models", "images of text"], "hard_filters": {"date_range": {"from": 2020}, "authors": ["Nobody"], "venues": "NeurIPS"}}),
    ("a broad overview of graph retrieval from 2015 to 2012 by Ada Lovelace", {"intent": "novelty", "hard_filters": {"authors": ["Lovelace"], "date_range": [1999, None]}}),
    ("influential papers on protein folding since the classic era", {"quality_modifier": "influential", "hard_filters": {"date_range": {"from": "1990s", "to": 2001}}}),
]
SETTLED = [
    (0, "general", "any", "alignment with DPO", "DPO|Direct Preference Optimization|alignment", "-", "-", "-", "-"),
    (1, "novelty", "any", "diffusion models for text, at NeurIPS. Exclude images", "diffusion models|neurips exclude", "images", "-", "NeurIPS", "-"),
    (2, "survey", "any", "a broad overview of graph retrieval from 2015 to 2012 by Ada Lovelace", "broad overview|graph retrieval|ada lovelace", "-", "Lovelace", "-", "2012–2015"),
    (3, "foundational", "influential", "influential papers on protein folding since the classic era", "protein folding|folding since|classic era|influential", "-", "-", "-", "1990–2001"),
]


@query(stated("n, intent, quality, statement, terms, not_terms, authors, venues, years", SETTLED))
def guarded_answers(spark, folder):
    """A model's answers held to what their briefs say."""
    rows = []
    for i, (text, raw) in enumerate(ANSWERS):
        q = B.guarded(B.from_answer(raw, text, "m"), THIS_YEAR)
        u = understanding(q)
        rows.append((i, u["intent"], u["quality"], q.statement, "|".join(u["terms"]), *["|".join(u[k]) or "-" for k in ("not_terms", "authors", "venues")], u["window"] or "-"))
    return spark.createDataFrame(rows, "n int, intent string, quality string, statement string, terms string, not_terms string, authors string, venues string, years string")


ESCALATED = [("rate_limit,ok", "two"), ("infra,infra,ok", "three"), ("parse,ok", "rules"), ("other,ok", "rules"), ("rate_limit,infra,rate_limit", "rules"), ("ok", "one"), ("none", "rules")]


@query(stated("tiers, source", ESCALATED))
def escalation(spark, folder):
    """Which tier's answer is taken: the next one is asked only after a rate limit or a failing service."""

    def tier(kind: str):
        return lambda text: ({"intent": "survey"}, None) if kind == "ok" else (None, kind)

    rows = [(kinds, B.analyse("graph retrieval", [(n, tier(k)) for n, k in zip(("one", "two", "three"), kinds.split(","))] if kinds != "none" else (), THIS_YEAR).source) for kinds, _ in ESCALATED]
    return spark.createDataFrame(rows, "tiers string, source string")


REQUESTS = [("x", "Last Month", 5, "free", 1), ("x", "Never", 5, "free", 0), ("x", "All Time", 11, "free", 0), ("x", "All Time", 0, "groq", 0), ("x", "Last Week", 10, "groq", 1), ("x", "Last Week", 10, "nobody", 0)]


@query(stated("query, date_range, top_n, provider, valid", REQUESTS))
def request_validation(spark, folder):
    def valid(*args) -> int:
        try:
            Request(args[0], "", *args[1:])
            return 1
        except ValueError:
            return 0

    return spark.createDataFrame([(*r[:4], valid(*r[:4])) for r in REQUESTS], "query string, date_range string, top_n int, provider string, valid int")
