"""Queries of the engine's own operators, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.functions import scores as S
from quillspark.functions import text as X
from quillspark.operators import corpus as C
from quillspark.operators import merge as M
from quillspark.operators import ranking as K
from quillspark.operators import retrieval as R
from quillspark.plans import export, training
from quillspark.plans.search import probe
from quillspark.sources import records
from quillspark.streaming import upsert as stream

AS_OF, START, END = "2026-07-01", "2021-01-01", "2025-12-31"
TERMS, UNWANTED = ["protein", "routing", "benchmark"], ["survey", "glacier"]
QUERIES: dict = {}
SQL: dict[str, str] = {}

CORPUS = """
corpus AS (
  SELECT arxiv_id AS paper_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, coalesce(authors, '[]') AS authors_json, coalesce(fields_of_study, '[]') AS fields_json,
    coalesce(CASE WHEN regexp_matches(submitted_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(substr(submitted_date, 1, 10) AS DATE) END, DATE '2024-01-01') AS submitted,
    coalesce(try_cast(substr(submitted_date, 1, 4) AS INTEGER), 0) AS year, nullif(venue, '') AS venue, nullif(source, '') AS source, coalesce(citation_count, 0) AS citation_count,
    coalesce(max_author_citations, 0) AS max_author_citations, coalesce(pdf_url, '') AS pdf_url, coalesce(has_embedding, false) AS has_embedding, vector
  FROM papers WHERE arxiv_id IS NOT NULL)"""
PROBE = "(SELECT vector::DOUBLE[] FROM papers WHERE has_embedding AND len(vector) = 768 ORDER BY arxiv_id LIMIT 1)"
SIMILAR = f"""{CORPUS},
matched AS (SELECT paper_id, title, abstract, submitted, year, citation_count, max_author_citations,
  CASE WHEN has_embedding AND len(vector) = 768 THEN round(list_cosine_similarity(vector::DOUBLE[], {PROBE}), 6) END AS similarity FROM corpus)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def papers_of(spark: SparkSession, folder: str) -> DataFrame:
    return C.corpus(table(spark, folder, "papers"))


def similar(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with the similarity to the probe vector, null where there is no usable vector."""
    papers = table(spark, folder, "papers")
    q = probe(papers)
    usable = F.col("has_embedding") & (F.size("vector") == len(q))
    rows = C.corpus(papers)
    return rows.withColumn("similarity", F.when(usable, F.round(S.cosine_to(F.col("vector"), q), 6))).drop("vector")


# --- scans and filters


@query(f"WITH {CORPUS} SELECT paper_id, title, CAST(submitted AS VARCHAR) AS submitted, year FROM corpus WHERE submitted BETWEEN DATE '{START}' AND DATE '{END}' AND contains(fields_json, 'Computer Science') ORDER BY corpus.submitted DESC, paper_id LIMIT {V.SCAN_CAP}")
def scan_date_window(spark, folder):
    return C.scan(table(spark, folder, "papers"), START, END, "Computer Science").select("paper_id", "title", F.col("submitted").cast("string").alias("submitted"), "year")


@query(f"WITH {CORPUS} SELECT paper_id FROM corpus WHERE (contains(title, 'Robotics') OR contains(abstract, 'Robotics') OR contains(fields_json, 'cs.RO')) OR (contains(title, 'Computer Vision') OR contains(abstract, 'Computer Vision') OR contains(fields_json, 'cs.CV'))")
def filter_subcategory(spark, folder):
    return papers_of(spark, folder).where(C.in_subcategories(["cs.RO", "cs.CV"])).select("paper_id")


_NAMED = "(contains(lower(title || ' ' || abstract), 'survey') OR contains(lower(title || ' ' || abstract), 'glacier'))"


@query(f"WITH {CORPUS} SELECT paper_id FROM corpus WHERE NOT {_NAMED}")
def filter_exclusion_terms(spark, folder):
    return C.without_terms(papers_of(spark, folder), UNWANTED).select("paper_id")


@query(f"WITH {CORPUS} SELECT count(*) FILTER (WHERE {_NAMED}) AS removed, count(*) FILTER (WHERE NOT {_NAMED}) AS kept FROM corpus")
def exclusion_removed_count(spark, folder):
    return papers_of(spark, folder).agg(F.count_if(C.names_term(UNWANTED)).alias("removed"), F.count_if(~C.names_term(UNWANTED)).alias("kept"))


@query(f"WITH {CORPUS} SELECT paper_id, venue FROM corpus WHERE contains(lower(coalesce(venue, '')), 'xeric') OR contains(lower(coalesce(venue, '')), 'letters')")
def filter_venue(spark, folder):
    return C.venue_filter(papers_of(spark, folder), "Specific Venue", "Journal", ["Xeric", "Letters"]).select("paper_id", "venue")


@query(f"WITH {CORPUS} SELECT 'recent' AS quality, paper_id FROM corpus WHERE year >= 2023 UNION ALL SELECT 'influential', paper_id FROM corpus WHERE citation_count >= 50 UNION ALL SELECT 'emerging', paper_id FROM corpus WHERE year >= 2023 AND citation_count < 20 UNION ALL SELECT 'classic', paper_id FROM corpus WHERE year <= 2018")
def filter_quality_modifier(spark, folder):
    kinds = F.array_compact(F.array(*[F.when(C.quality_filter(q), F.lit(q)) for q in ("recent", "influential", "emerging", "classic")]))
    return papers_of(spark, folder).select(F.explode(kinds).alias("quality"), "paper_id")


@query(f"WITH {CORPUS} SELECT paper_id, year, venue FROM corpus WHERE year >= 2019 AND year <= 2025 AND (contains(authors_json, 'Anne') OR contains(authors_json, 'Olaf')) AND (contains(coalesce(venue, ''), 'International') OR contains(coalesce(venue, ''), 'Letters'))")
def filter_entity_year(spark, folder):
    return papers_of(spark, folder).where(C.all_of([C.year_filter(2019, 2025), C.entity_filter(["Anne", "Olaf", "'''"], ["International", "Letters"])])).select("paper_id", "year", "venue")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_semi_join(spark, folder):
    building = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    return C.known_ids(table(spark, folder, "orders").withColumnRenamed("o_custkey", "id"), building, "id", "c_custkey").select("o_orderkey", F.col("id").alias("o_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def new_ids_anti_join(spark, folder):
    return C.new_ids(table(spark, folder, "customer"), table(spark, folder, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(f"WITH {CORPUS} SELECT paper_id, CAST(submitted AS VARCHAR) AS submitted FROM corpus WHERE NOT has_embedding")
def pending_embedding(spark, folder):
    return C.pending(table(spark, folder, "papers")).select("paper_id", F.col("submitted").cast("string").alias("submitted"))


@query("SELECT count(DISTINCT arxiv_id) AS ids, count(*) AS n, count(*) FILTER (WHERE has_embedding) AS embedded, min(submitted_date) AS first_day, max(submitted_date) AS last_day FROM papers WHERE arxiv_id IS NOT NULL")
def corpus_counts(spark, folder):
    rows = table(spark, folder, "papers").where("arxiv_id is not null")
    return rows.agg(F.count_distinct("arxiv_id").alias("ids"), F.count("*").alias("n"), F.count_if("has_embedding").alias("embedded"), F.min("submitted_date").alias("first_day"), F.max("submitted_date").alias("last_day"))


# --- text operators, over texts made from a table


def comments(spark, folder) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Accepted at NeurIPS, ", "Submitted to ICML ", "published in Nature Communications ", "", "oracle methods in NAACL ", "no venue ")])
    return table(spark, folder, "part").select("p_partkey", F.concat(F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name")).alias("comment"))


_COMMENTS = "c AS (SELECT p_partkey, (['Accepted at NeurIPS, ', 'Submitted to ICML ', 'published in Nature Communications ', '', 'oracle methods in NAACL ', 'no venue '])[(p_partkey % 6 + 1)::INT] || p_name AS comment FROM part)"
_VENUE_CASE = " ".join(f"WHEN contains(lower(comment), '{k.lower()}') THEN '{k}'" for k in sorted(V.CONFERENCES + V.JOURNALS))


@query(f"WITH {_COMMENTS} SELECT p_partkey, CASE WHEN trim(comment) = '' OR contains(lower(comment), 'submitted to') OR contains(lower(comment), 'under review') OR contains(lower(comment), 'preprint') THEN NULL {_VENUE_CASE} END AS venue FROM c")
def venue_extraction(spark, folder):
    return comments(spark, folder).select("p_partkey", X.venue_of(F.col("comment")).alias("venue"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 15)"


@query(f"WITH {CORPUS} SELECT paper_id, len({_SENTENCES}) AS n, coalesce(list_sum(list_transform({_SENTENCES}, lambda s: length(s)))::BIGINT, 0) AS chars FROM corpus")
def sentence_split(spark, folder):
    parts = X.sentences(F.col("abstract"))
    return papers_of(spark, folder).select("paper_id", F.size(parts).cast("long").alias("n"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"))


@query(
    f"""WITH {CORPUS}, s AS (SELECT paper_id, unnest({_SENTENCES}) AS sentence, generate_subscripts({_SENTENCES}, 1) AS pos FROM corpus),
r AS (SELECT paper_id, sentence, row_number() OVER (PARTITION BY paper_id ORDER BY len(list_filter(regexp_extract_all(lower(sentence), '[a-z0-9]+'), lambda w: w IN ('protein', 'routing', 'benchmark'))) DESC, pos) AS n FROM s),
t AS (SELECT paper_id, string_agg(substr(sentence, 1, 120) || '...', ' | ' ORDER BY n) AS reason FROM r WHERE n <= 2 GROUP BY paper_id)
SELECT corpus.paper_id, coalesce(reason, 'No extractable sentences found in abstract.') AS reason FROM corpus LEFT JOIN t USING (paper_id)"""
)
def top2_sentences(spark, folder):
    return R.highlights(papers_of(spark, folder), TERMS)


_ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query(f"WITH {CORPUS} SELECT paper_id, contains(lower(abstract), 'github.com/') OR contains(lower(pdf_url), 'github.com/') AS has_code, {_ANY('lower(abstract)', V.DATASET_PHRASES)} AS has_dataset, contains(lower(abstract), 'ablation')::INT + (contains(lower(abstract), 'code available') OR contains(lower(abstract), 'github.com/'))::INT + contains(lower(abstract), 'reproducib')::INT AS reproducibility FROM corpus")
def artifact_flags(spark, folder):
    return papers_of(spark, folder).select("paper_id", *[c.alias(n) for n, c in X.artifact_flags(F.col("abstract"), F.col("pdf_url")).items()])


@query(f"WITH {CORPUS} SELECT paper_id, CASE " + " ".join(f"WHEN {_ANY('lower(abstract)', w)} THEN '{t}'" for t, w in V.PAPER_TYPES) + " ELSE 'Other' END AS kind FROM corpus")
def paper_type_tag(spark, folder):
    return papers_of(spark, folder).select("paper_id", X.paper_type(F.col("abstract")).alias("kind"))


_HYPE = "(CASE WHEN contains(lower(title), 'benchmark') OR contains(lower(title), 'dataset') THEN 50 ELSE 0 END + CASE WHEN contains(lower(title), 'survey') THEN 40 ELSE 0 END + CASE WHEN contains(lower(title), 'llm') THEN 10 ELSE 0 END)"
_SNIPER = f"(CASE WHEN contains(lower(title), 'benchmark') THEN 50 ELSE 0 END - CASE WHEN {_ANY('lower(title)', V.NICHE_WORDS)} THEN 20 ELSE 0 END)"


@query(f"WITH {CORPUS} SELECT paper_id, {_HYPE} AS hype, {_SNIPER} AS sniper FROM corpus")
def title_keyword_scores(spark, folder):
    return papers_of(spark, folder).select("paper_id", X.hype(F.col("title")).alias("hype"), X.sniper(F.col("title")).alias("sniper"))


BRIEFS = [
    "RESEARCH BRIEF:\nA broad overview of {} since {}. Exclude surveys and old reviews.",
    "papers on {} by Geoffrey Hinton and Yann LeCun before {}; no papers on toy data, games",
    "RESEARCH BRIEF:\n{} in the years from {} to 2021\n\nWHAT I AM NOT LOOKING FOR:\nmedical images; robots and drones",
    "renewable {} over the last 7 years, highly cited, published {}",
    "state-of-the-art {} written by Ada Lovelace, excluding benchmarks. pre-{} work",
    "seminal {} methods",
]


def briefs(spark, folder) -> DataFrame:
    year = (F.lit(1995) + F.col("p_size") % 25).cast("string")
    made = [F.concat(*_pieces(b, F.col("p_name"), year)) for b in BRIEFS]
    return table(spark, folder, "part").select("p_partkey", F.element_at(F.array(*made), (F.col("p_partkey") % len(BRIEFS) + 1).cast("int")).alias("brief"))


def _pieces(template: str, *values: Column) -> list[Column]:
    parts, left = [], list(values)
    for i, p in enumerate(template.split("{}")):
        if i:
            parts.append(left.pop(0))
        parts.append(F.lit(p))
    return parts


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_brief(t: str) -> str:
    values, out = ["p_name", "CAST(1995 + p_size % 25 AS VARCHAR)"], []
    for i, p in enumerate(t.split("{}")):
        if i:
            out.append(values.pop(0))
        out.append(_sql_text(p))
    return " || ".join(out)


BRIEF_SQL = "b AS (SELECT p_partkey, ([" + ", ".join(_sql_brief(b) for b in BRIEFS) + f"])[(p_partkey % {len(BRIEFS)} + 1)::INT] AS brief FROM part)"
_POSITIVE = "regexp_replace(brief, '(?is)WHAT I AM NOT LOOKING FOR.*$', '')"
_FLAT = f"trim(regexp_replace(regexp_replace({_POSITIVE}, '(?m)^RESEARCH BRIEF:\\s*', '', 'g'), '\\s+', ' ', 'g'))"
_INLINE = r"\b(?:exclude|excluding|omit|omitting|not including|not interested in|no papers (?:on|about)|nothing (?:on|about))\b[:\s]*([^.\n;]+)"
_STRIPPED = f"regexp_replace({_POSITIVE}, '(?i){_INLINE}', '', 'g')"
_AUTHORS = r"\b(?:authored\s+by|written\s+by|by)\s+((?:[A-Z][A-Za-z.''\-]+)(?:\s+(?:and\s+|&\s+|,\s*)?[A-Z][A-Za-z.''\-]+)*)"


@query(f"WITH {BRIEF_SQL} SELECT p_partkey, {_FLAT} AS statement FROM b")
def semantic_query_clean(spark, folder):
    return briefs(spark, folder).select("p_partkey", X.semantic_query(F.col("brief")).alias("statement"))


@query(f"WITH {BRIEF_SQL} SELECT p_partkey, {_STRIPPED} AS positive FROM b")
def negation_strip(spark, folder):
    return briefs(spark, folder).select("p_partkey", X.without_negation(F.col("brief")).alias("positive"))


@query(
    f"""WITH {BRIEF_SQL}, chunks AS (SELECT p_partkey, list_concat([regexp_extract(brief, '(?is)WHAT I AM NOT LOOKING FOR(.*)$', 1)], regexp_extract_all({_POSITIVE}, '(?i){_INLINE}', 1)) AS c FROM b),
raw AS (SELECT p_partkey, flatten(list_transform(c, lambda x: string_split(regexp_replace(x, '(?i)[,\\n;]+|\\band\\b|\\bor\\b', chr(1), 'g'), chr(1)))) AS r FROM chunks),
clean AS (SELECT p_partkey, list_filter(list_transform(r, lambda x: lower(regexp_replace(trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '^[-–—:.]+|[-–—:.]+$', '', 'g'))), lambda x: length(x) > 3) AS t FROM raw)
SELECT p_partkey, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS terms FROM clean"""
)
def not_terms(spark, folder):
    return briefs(spark, folder).select("p_partkey", F.array_join(X.not_terms(F.col("brief")), "|").alias("terms"))


_INTENT_CASE = " ".join("WHEN regexp_matches(t, '(?i)\\b(?:" + "|".join(words) + f")s?\\b') THEN '{name}'" for name, words in V.INTENTS)


@query(f"WITH {BRIEF_SQL}, s AS (SELECT p_partkey, {_STRIPPED} AS t FROM b) SELECT p_partkey, CASE {_INTENT_CASE} WHEN regexp_matches(t, '\\b20[0-9]{{2}}\\b') OR regexp_matches(t, '{_AUTHORS}') THEN 'specific' ELSE 'general' END AS intent FROM s")
def intent_detect(spark, folder):
    return briefs(spark, folder).select("p_partkey", X.intent(F.col("brief")).alias("intent"))


@query(f"WITH {BRIEF_SQL} SELECT p_partkey, CASE " + " ".join(f"WHEN {_ANY('lower(brief)', w)} THEN '{q}'" for q, w in V.QUALITIES) + " ELSE 'any' END AS quality FROM b")
def quality_detect(spark, folder):
    return briefs(spark, folder).select("p_partkey", X.quality(F.col("brief")).alias("quality"))


@query(f"WITH {BRIEF_SQL} SELECT p_partkey, array_to_string(list_transform(flatten(list_transform(regexp_extract_all(brief, '{_AUTHORS}', 1), lambda m: string_split(regexp_replace(m, '(?i)\\s+and\\s+|\\s*&\\s*|,\\s*', chr(1), 'g'), chr(1)))), lambda n: trim(n)), '|') AS names FROM b")
def author_extract(spark, folder):
    return briefs(spark, folder).select("p_partkey", F.array_join(X.authors_of(F.col("brief")), "|").alias("names"))


def _year_sql(pattern: str, i: int = 1) -> str:
    return f"try_cast(regexp_extract(brief, '(?i){pattern}', {i}) AS INTEGER)"


_Y = "(?:19|20)[0-9]{2}"
_RANGE = f"\\b(?:from|between)?\\s*({_Y})\\s*(?:to|through|until|and|[-–—])\\s*({_Y})\\b"


@query(
    f"""WITH {BRIEF_SQL}, y AS (SELECT p_partkey, {_year_sql(_RANGE)} AS a, {_year_sql(_RANGE, 2)} AS z, 2026 - {_year_sql('\\b(?:last|past)\\s+([0-9]{1,2})\\s*years?\\b')} AS n,
{_year_sql(f'\\b(?:since|after|from|post-?)\\s*({_Y})\\b')} AS f, {_year_sql(f'\\b(?:before|prior to|up to|until|earlier than|pre-?)\\s*({_Y})\\b')} AS t FROM b)
SELECT p_partkey, CASE WHEN a IS NOT NULL THEN least(a, z) ELSE coalesce(n, f, -1) END AS low, CASE WHEN a IS NOT NULL THEN greatest(a, z) ELSE coalesce(t, -1) END AS high FROM y"""
)
def year_range(spark, folder):
    low, high = X.year_range(F.col("brief"), 2026)
    return briefs(spark, folder).select("p_partkey", F.coalesce(low, F.lit(-1)).alias("low"), F.coalesce(high, F.lit(-1)).alias("high"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + ")"


@query(
    f"""WITH {CORPUS}, w AS (SELECT paper_id, regexp_extract_all(lower(title), '[a-z][a-z\\-]+') AS t FROM corpus),
p AS (SELECT unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS term, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i])) AS a, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i + 1])) AS b FROM w)
SELECT term, 2 * count(*) AS weight FROM p WHERE length(a) > 2 AND length(b) > 2 AND a NOT IN {_STOPS} AND b NOT IN {_STOPS} GROUP BY term"""
)
def keyword_bigrams(spark, folder):
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z][a-z\-]+"), 0)
    pairs = papers_of(spark, folder).select(words.alias("t")).select(F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p"))
    good = lambda c: (F.length(c) > 2) & ~c.isin(V.STOP_WORDS)
    return pairs.where(good(F.col("p.a")) & good(F.col("p.b"))).groupBy(F.concat_ws(" ", "p.a", "p.b").alias("term")).agg((2 * F.count("*")).alias("weight"))


_GATE = [("RLHF", "Reinforcement Learning from Human Feedback"), ("RLHF", "reward model"), ("KTO", "Kahneman-Tversky Optimization"), ("MoE", "Mixture of Experts"), ("DPO", "Differentially Private Optimization"), ("SFT", ""), ("PPO", "proximal policy")]


@query(
    "WITH g(acronym, phrase) AS (VALUES " + ", ".join(f"('{a}', '{p}')" for a, p in _GATE) + "), w AS (SELECT acronym, phrase, list_filter(regexp_split_to_array(phrase, '[^0-9A-Za-z]+'), lambda x: x <> '') AS ws FROM g) "
    "SELECT acronym, phrase, len(ws) > 0 AND upper(acronym) IN (upper(array_to_string(list_transform(ws, lambda x: substr(x, 1, 1)), '')), upper(array_to_string(list_transform(list_filter(ws, lambda x: lower(x) NOT IN (" + ", ".join(f"'{c}'" for c in V.CONNECTORS) + ")), lambda x: substr(x, 1, 1)), ''))) AS fits FROM w"
)
def acronym_gate(spark, folder):
    return spark.createDataFrame(_GATE, "acronym string, phrase string").select("acronym", "phrase", X.letters_match(F.col("acronym"), F.col("phrase")).alias("fits"))


@query(f"WITH {CORPUS} SELECT paper_id, md5(lower(trim(title))) AS key FROM corpus")
def cache_key(spark, folder):
    return papers_of(spark, folder).select("paper_id", X.cache_key(F.col("title")).alias("key"))


@query("SELECT arxiv_id AS paper_id, coalesce(try_cast(regexp_extract(submitted_date, '((?:19|20)[0-9]{2})', 1) AS INTEGER), -1) AS named, coalesce(try_cast(substr(submitted_date, 1, 4) AS INTEGER), 0) AS leading FROM papers WHERE arxiv_id IS NOT NULL")
def year_from_text(spark, folder):
    return table(spark, folder, "papers").where("arxiv_id is not null").select(F.col("arxiv_id").alias("paper_id"), F.coalesce(X.year_in(F.col("submitted_date")), F.lit(-1)).alias("named"), S.year_of(F.col("submitted_date")).alias("leading"))


@query("SELECT arxiv_id AS paper_id, trim(substr(regexp_replace(regexp_replace(coalesce(venue, ''), '[^0-9A-Za-z .\\-&]', '', 'g'), '[-\\s]{2,}', ' ', 'g'), 1, 60)) AS literal FROM papers WHERE arxiv_id IS NOT NULL")
def like_literal(spark, folder):
    return table(spark, folder, "papers").where("arxiv_id is not null").select(F.col("arxiv_id").alias("paper_id"), X.like_literal(F.coalesce("venue", F.lit(""))).alias("literal"))


# --- dates and scores


@query(f"WITH {CORPUS} SELECT paper_id, round(CASE WHEN greatest(DATE '{AS_OF}' - submitted, 0) >= 30 THEN 0.0 ELSE 1.0 - greatest(DATE '{AS_OF}' - submitted, 0) / 30.0 END, 6)::DOUBLE AS recency FROM corpus")
def recency_score(spark, folder):
    return papers_of(spark, folder).select("paper_id", F.round(S.recency(F.col("submitted"), AS_OF), 6).alias("recency"))


@query("SELECT o_orderkey, CAST((date_trunc('month', o_orderdate) - INTERVAL 13 MONTH)::DATE AS VARCHAR) AS first_day, CAST(last_day((date_trunc('month', o_orderdate) - INTERVAL 13 MONTH)::DATE) AS VARCHAR) AS last_day FROM orders")
def month_bounds(spark, folder):
    first, last = S.month_bounds(F.col("o_orderdate").cast("date"), 13)
    return table(spark, folder, "orders").select("o_orderkey", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@query("SELECT o_orderkey, epoch(TIMESTAMP '2000-06-01') - epoch(o_orderdate) >= 15 * 86400 AS due FROM orders")
def schedule_due(spark, folder):
    last = S.repaired_time(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00+00:00")))
    return table(spark, folder, "orders").select("o_orderkey", S.due(last, F.try_to_timestamp(F.lit("2000-06-01T00:00:00+00:00")), 15).alias("due"))


_FAME = "CASE WHEN max_author_citations > 0 THEN least(ln(max_author_citations + 1) * 8, 95.0) ELSE 0.0 END"
_NEW = f"(max_author_citations <= 0 AND (DATE '{AS_OF}' - submitted) <= 5)"


@query(f"WITH {CORPUS} SELECT paper_id, round({_FAME}, 6)::DOUBLE AS fame FROM corpus")
def fame_score(spark, folder):
    return papers_of(spark, folder).select("paper_id", F.round(S.fame(F.col("max_author_citations")), 6).alias("fame"))


_RECENT = f"CASE WHEN greatest(DATE '{AS_OF}' - submitted, 0) >= 30 THEN 0.0 ELSE 1.0 - greatest(DATE '{AS_OF}' - submitted, 0) / 30.0 END"


@query(f"WITH {CORPUS} SELECT paper_id, round(CASE WHEN {_NEW} THEN -1.0 ELSE {_FAME} * 0.84 + {_HYPE} * 0.0 + {_SNIPER} * 0.0 + 50.0 * 0.16 + ({_RECENT}) * 15.0 END, 6)::DOUBLE AS recent, round(CASE WHEN {_NEW} THEN -1.0 ELSE {_FAME} * 0.30 + 50.0 * 0.70 END, 6)::DOUBLE AS emerging FROM corpus")
def impact_score(spark, folder):
    args = F.col("title"), F.col("max_author_citations"), F.col("submitted"), F.lit(50.0), AS_OF
    return papers_of(spark, folder).select("paper_id", F.round(S.impact(*args, "recent"), 6).alias("recent"), F.round(S.impact(*args, "emerging"), 6).alias("emerging"))


@query(f"WITH {CORPUS} SELECT paper_id, CASE WHEN max_author_citations > 3000 THEN 'Distribution: High influence author/lab.' WHEN max_author_citations > 500 THEN 'Reach: Established track record.' WHEN max_author_citations > 100 THEN 'Momentum: Authors have prior traction.' WHEN max_author_citations > 0 THEN 'Emerging: Newer authors; relies on merit.' WHEN {_NEW} THEN 'Too new for impact score: Citation data unavailable. Ranked by relevance only.' ELSE 'Emerging: Unknown authors.' END AS why FROM corpus")
def impact_bullets(spark, folder):
    return papers_of(spark, folder).select("paper_id", S.bullets(F.col("max_author_citations"), F.col("submitted"), AS_OF).alias("why"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(replace(props, '\"k\"', '\"score\"'), '$.score') AS DOUBLE), 5.0) * 10 AS utility FROM events")
def llm_score_parse(spark, folder):
    raw = F.concat(F.lit("```json\n"), F.regexp_replace("props", '"k"', '"score"'), F.lit("\n```"))
    return table(spark, folder, "events").select("event_id", S.llm_score(raw).alias("utility"))


@query("SELECT arxiv_id AS paper_id, coalesce(len(from_json(authors, '[\"VARCHAR\"]')), 0) AS n, coalesce(array_to_string(from_json(authors, '[\"VARCHAR\"]'), '; '), '') AS names FROM papers WHERE arxiv_id IS NOT NULL")
def json_list_roundtrip(spark, folder):
    decoded = F.from_json(F.to_json("authors"), "array<string>")
    return papers_of(spark, folder).select("paper_id", F.size(decoded).cast("long").alias("n"), F.array_join(decoded, "; ").alias("names"))


# --- retrieval


def _bm25_sql(source: str = "corpus") -> str:
    fields = [("t", "title"), ("a", "abstract")]
    cols = ", ".join(f"len({p}x) AS {p}l, " + ", ".join(f"len(list_filter({p}x, lambda w: w = '{t}')) AS {p}{i}" for i, t in enumerate(TERMS)) for p, _ in fields)
    stats = ", ".join(f"avg({p}l) AS {p}v, " + ", ".join(f"count(*) FILTER (WHERE {p}{i} > 0) AS {p}d{i}" for i in range(len(TERMS))) for p, _ in fields)
    score = " + ".join(f"ln(1 + (n - {p}d{i} + 0.5) / ({p}d{i} + 0.5)) * {p}{i} * 2.2 / ({p}{i} + 1.2 * (0.25 + 0.75 * {p}l / {p}v))" for p, _ in fields for i in range(len(TERMS)))
    words = ", ".join(f"regexp_extract_all(lower({f}), '[a-z0-9]+') AS {p}x" for p, f in fields)
    return f"words AS (SELECT paper_id, {words} FROM {source}), counted AS (SELECT paper_id, {cols} FROM words), stats AS (SELECT count(*) AS n, {stats} FROM counted), text_arm AS (SELECT * FROM (SELECT paper_id, round(({score})::DOUBLE, 6) AS score FROM counted, stats) WHERE score > 0)"


@query(f"WITH {CORPUS}, {_bm25_sql()} SELECT paper_id, score FROM text_arm ORDER BY score DESC, paper_id LIMIT 50")
def bm25_topk(spark, folder):
    return R.bm25(papers_of(spark, folder), TERMS).orderBy(F.desc("score"), "paper_id").limit(50)


@query(f"WITH {CORPUS}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM corpus) SELECT term, count(DISTINCT paper_id) AS df, count(*) AS cf FROM w GROUP BY term")
def fulltext_index(spark, folder):
    return R.vocabulary(papers_of(spark, folder), "title")


@query(f"WITH {CORPUS} SELECT paper_id, round(list_cosine_similarity(vector::DOUBLE[], {PROBE}), 6) AS score FROM corpus WHERE has_embedding AND len(vector) = 768 ORDER BY score DESC, paper_id LIMIT 20")
def vector_topk(spark, folder):
    papers = table(spark, folder, "papers")
    return R.by_vector(C.corpus(papers), probe(papers)).orderBy(F.desc("score"), "paper_id").limit(20)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20")
def embedding_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in rows.orderBy("vec_id").first()["embedding"]])
    return rows.select("vec_id", F.round(S.cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"WITH {SIMILAR} SELECT paper_id, coalesce(similarity, 0.0)::DOUBLE AS similarity FROM matched ORDER BY coalesce(similarity, 0.0) DESC, matched.similarity IS NULL, paper_id LIMIT {V.KEEP_VECTOR}")
def vector_rerank_with_missing(spark, folder):
    papers = table(spark, folder, "papers")
    return R.rerank(C.corpus(papers), probe(papers)).select("paper_id", "similarity")


def _hybrid_sql(w_text: float, w_vector: float, where: str = "true", depth: str = "500", k: str = "20") -> str:
    return f"""WITH {CORPUS}, pool AS (SELECT * FROM corpus WHERE {where}), size AS (SELECT count(*) AS n, greatest(50, least(1200, floor(0.07 * count(*))))::BIGINT AS k FROM pool), {_bm25_sql('pool')},
tr AS (SELECT paper_id, row_number() OVER (ORDER BY score DESC, paper_id) AS text_rank FROM text_arm QUALIFY text_rank <= {depth}),
va AS (SELECT paper_id, round(list_cosine_similarity(vector::DOUBLE[], {PROBE}), 6) AS score FROM pool WHERE has_embedding AND len(vector) = 768),
vr AS (SELECT paper_id, row_number() OVER (ORDER BY score DESC, paper_id) AS vector_rank FROM va QUALIFY vector_rank <= {depth}),
fused AS (SELECT paper_id, text_rank, vector_rank, round(({w_text} / (45 + coalesce(text_rank, (SELECT count(*) + 1 FROM tr))) + {w_vector} / (45 + coalesce(vector_rank, (SELECT count(*) + 1 FROM vr))))::DOUBLE, 6) AS rrf,
  CASE WHEN text_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both' WHEN text_rank IS NOT NULL THEN 'text' ELSE 'vector' END AS origin FROM tr FULL JOIN vr USING (paper_id)),
best AS (SELECT * FROM fused ORDER BY rrf DESC, paper_id DESC LIMIT {k})"""


_POOL = f"submitted BETWEEN DATE '{START}' AND DATE '{END}' AND NOT {_NAMED}"


def pool(spark, folder) -> DataFrame:
    return C.without_terms(papers_of(spark, folder).where(C.in_window(START, END)), UNWANTED)


@query(_hybrid_sql(1.0, 1.0, _POOL) + " SELECT paper_id, coalesce(text_rank, 0) AS text_rank, coalesce(vector_rank, 0) AS vector_rank, rrf, origin FROM best")
def rrf_fusion(spark, folder):
    """The flagship: a date window without excluded terms, both arms, fused, the best twenty."""
    best = R.hybrid(pool(spark, folder), TERMS, probe(table(spark, folder, "papers")), 20, 500)
    return best.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("text_rank", "vector_rank")})


@query(_hybrid_sql(1.3, 1.0, _POOL) + " SELECT paper_id, rrf, origin FROM best")
def rrf_intent_weighted(spark, folder):
    w_vector, w_text = V.INTENT_WEIGHTS["specific"]
    return R.hybrid(pool(spark, folder), TERMS, probe(table(spark, folder, "papers")), 20, 500, w_text, w_vector).select("paper_id", "rrf", "origin")


@query(_hybrid_sql(1.0, 1.0, _POOL, "(SELECT least(5 * k, 6000) FROM size)", "(SELECT k FROM size)") + " SELECT paper_id, rrf FROM best")
def adaptive_k_cut(spark, folder):
    rows = pool(spark, folder)
    k, depth = R.adaptive_k(rows.count())
    return R.hybrid(rows, TERMS, probe(table(spark, folder, "papers")), k, depth).select("paper_id", "rrf")


@query(
    f"""WITH {SIMILAR}, n AS (SELECT count(*) AS pool, count(*) FILTER (WHERE q AND d AND e) AS qde, count(*) FILTER (WHERE q AND d) AS qd, count(*) FILTER (WHERE q) AS nq FROM (SELECT year >= 2023 AS q, year >= 2025 AS d, contains(title, 'Protein') AS e FROM matched)),
rung AS (SELECT CASE WHEN least(greatest(50, least(1200, floor(0.07 * pool))), qde) >= 50 THEN 1 WHEN least(1200, qde) >= 50 THEN 2 WHEN least(1200, qd) >= 50 THEN 3 WHEN least(1200, nq) >= 50 THEN 4 ELSE 5 END AS rung FROM n)
SELECT paper_id, rung FROM matched, rung WHERE rung = 5 OR (year >= 2023 AND (rung >= 4 OR (year >= 2025 AND (rung = 3 OR contains(title, 'Protein')))))"""
)
def relax_ladder(spark, folder):
    rows = papers_of(spark, folder)
    k, _ = R.adaptive_k(rows.count())
    rung, keep = R.ladder(rows, C.quality_filter("recent"), F.col("year") >= 2025, F.col("title").contains("Protein"), k)
    return rows.where(keep).select("paper_id", F.lit(rung).alias("rung"))


# --- classification and ranking


def scored(spark, folder) -> DataFrame:
    """The rows with a similarity, and a pair score standing in for a scorer."""
    rows = similar(spark, folder).where("similarity is not null")
    return rows.withColumn("pair_score", 0.5 + 0.25 * F.col("similarity"))


_PAIRED = f"{SIMILAR}, paired AS (SELECT *, 0.5::DOUBLE + 0.25::DOUBLE * similarity AS pair_score FROM matched WHERE similarity IS NOT NULL), labelled AS (SELECT *, pair_score AS relevance, CASE WHEN pair_score >= 0.68 THEN 'primary' WHEN pair_score >= 0.60 THEN 'secondary' ELSE 'off-topic' END AS focus FROM paired)"


@query(f"WITH {_PAIRED} SELECT paper_id, focus, relevance FROM labelled")
def threshold_classify(spark, folder):
    return K.classify(scored(spark, folder)).select("paper_id", "focus", "relevance")


_RANKED = f"{SIMILAR}, placed AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, paper_id) AS place, count(*) OVER () AS n FROM matched WHERE similarity IS NOT NULL), labelled AS (SELECT *, similarity AS relevance, CASE WHEN place <= greatest(1, least(n, greatest(10, floor(n * 0.3)))) THEN 'primary' ELSE 'secondary' END AS focus FROM placed)"


@query(f"WITH {_RANKED} SELECT paper_id, focus FROM labelled")
def rank_classify(spark, folder):
    return K.classify(unscored(spark, folder)).select("paper_id", "focus")


def unscored(spark, folder) -> DataFrame:
    return similar(spark, folder).where("similarity is not null").withColumn("pair_score", F.lit(None).cast("double"))


@query(f"WITH {_RANKED} SELECT focus, count(*) AS n FROM labelled GROUP BY focus")
def label_counts(spark, folder):
    return K.classify(unscored(spark, folder)).groupBy("focus").agg(F.count("*").alias("n"))


_MIX = "mixed AS (SELECT *, round(relevance * 0.7 + similarity * 0.3, 6) AS mix FROM labelled), bounds AS (SELECT min(mix) AS low, max(mix) AS high FROM mixed), rated AS (SELECT mixed.*, floor(round(10 + CASE WHEN high > low THEN (mix - low) / (high - low) ELSE 0.5 END * 40, 6))::DOUBLE AS impact FROM mixed, bounds)"


@query(f"WITH {_RANKED}, {_MIX} SELECT paper_id, impact FROM rated")
def heuristic_impact(spark, folder):
    return K.heuristic_impact(K.classify(unscored(spark, folder))).select("paper_id", "impact")


@query(f"WITH {_PAIRED}, counted AS (SELECT *, count(*) FILTER (WHERE focus = 'primary') OVER () AS primaries, row_number() OVER (PARTITION BY focus ORDER BY relevance DESC, similarity DESC, paper_id) AS place FROM labelled) SELECT paper_id, focus FROM counted WHERE focus = 'primary' OR (focus = 'secondary' AND place <= greatest(400 - primaries, 0))")
def scoring_set_topup(spark, folder):
    return K.scoring_set(K.classify(scored(spark, folder)), 400).select("paper_id", "focus")


_FINAL = f"{_PAIRED}, impacts AS (SELECT *, round(CASE WHEN {_NEW} THEN -1.0 ELSE {_FAME} * 0.84 + 50.0 * 0.16 END, 6)::DOUBLE AS impact FROM labelled), final AS (SELECT *, row_number() OVER (ORDER BY CASE focus WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 ELSE 2 END, impact = -1.0, CASE WHEN impact = -1.0 THEN 0 ELSE -impact END, CASE WHEN impact = -1.0 THEN relevance ELSE 0 END DESC, CASE WHEN impact = -1.0 THEN similarity ELSE 0 END DESC, paper_id) AS rank FROM impacts)"


def final(spark, folder) -> DataFrame:
    rated = K.classify(scored(spark, folder)).withColumn("impact", F.round(S.impact(F.col("title"), F.col("max_author_citations"), F.col("submitted"), F.lit(50.0), AS_OF), 6))
    return K.result_row(K.final_rank(rated))


@query(f"WITH {_FINAL} SELECT paper_id, rank, focus, impact, impact = -1.0 AS too_new, greatest(0.0, least(1.0, relevance))::DOUBLE AS relevance, 'cross_encoder' AS basis FROM final")
def grouped_final_rank(spark, folder):
    return final(spark, folder).select("paper_id", "rank", "focus", "impact", "too_new", "relevance", "basis")


@query(f"WITH {_FINAL} SELECT paper_id, rank FROM final WHERE rank BETWEEN 21 AND 30")
def result_page(spark, folder):
    return K.page(final(spark, folder), 3).select("paper_id", "rank")


@query(f"WITH {_FINAL} SELECT rank, '## #' || rank || ': ' || title || chr(10) || '- **Impact score:** ' || CASE WHEN impact = -1.0 THEN 'Too new to rate' ELSE CAST(round(impact)::BIGINT AS VARCHAR) END || chr(10) || '- **Focus:** ' || focus || chr(10) || '- **Link:** ' || paper_id || chr(10) || chr(10) || '**Abstract:** ' || abstract || chr(10) || '---' AS section FROM final WHERE rank <= 50")
def markdown_export(spark, folder):
    return export.markdown(final(spark, folder).where("rank <= 50")).select("rank", "section")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1) / 500))::BIGINT AS chunk FROM lineitem")
def chunk_numbering(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return K.chunks(table(spark, folder, "lineitem").select(*keys), keys, 500).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chunk")


# --- merging and sources


def halves(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A table of two thirds of the papers, and incoming changed rows of another two thirds."""
    papers = table(spark, folder, "papers").where("arxiv_id is not null")
    third = F.length("title") % 3
    incoming = papers.where(third != 0).withColumns({"title": F.when(F.col("year") % 2 == 0, F.concat("title", F.lit(" v2"))).otherwise(""), "citation_count": F.coalesce("citation_count", F.lit(0)) + 5})
    return papers.where(third != 1), incoming


@query(
    """WITH o AS (SELECT * FROM papers WHERE arxiv_id IS NOT NULL AND length(title) % 3 <> 1), n AS (SELECT arxiv_id, CASE WHEN year % 2 = 0 THEN title || ' v2' ELSE '' END AS title, abstract, venue, submitted_date, coalesce(citation_count, 0) + 5 AS citation_count FROM papers WHERE arxiv_id IS NOT NULL AND length(title) % 3 <> 0),
j AS (SELECT coalesce(o.arxiv_id, n.arxiv_id) AS arxiv_id, o.arxiv_id IS NOT NULL AS known, n.arxiv_id IS NOT NULL AS fresh, coalesce(CASE WHEN coalesce(n.title, '') NOT IN ('', '[]') THEN n.title END, o.title, '') AS title, coalesce(o.title, '') AS old_title, coalesce(o.abstract, '') AS old_abstract,
  coalesce(CASE WHEN coalesce(n.abstract, '') NOT IN ('', '[]') THEN n.abstract END, o.abstract, '') AS abstract, greatest(coalesce(o.citation_count, 0), coalesce(n.citation_count, 0)) AS citation_count, coalesce(o.has_embedding, false) AS had FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id)
SELECT arxiv_id, title, citation_count, CASE WHEN known AND NOT (fresh AND (title <> old_title OR abstract <> old_abstract)) THEN had ELSE false END AS has_embedding, CASE WHEN NOT known THEN 'inserted' WHEN fresh THEN 'updated' ELSE 'kept' END AS action FROM j"""
)
def coalescing_upsert(spark, folder):
    old, new = halves(spark, folder)
    return M.upsert(old, new).select("arxiv_id", "title", "citation_count", "has_embedding", "action")


@query("WITH a AS (SELECT s2_id, max(citation_count) AS most FROM s2_records WHERE citation_count > 0 GROUP BY s2_id) SELECT p.arxiv_id, CASE WHEN coalesce(p.max_author_citations, 0) = 0 AND coalesce(p.s2_id, '') <> '' AND most IS NOT NULL THEN most ELSE coalesce(p.max_author_citations, 0) END AS max_author_citations FROM papers p LEFT JOIN a ON p.s2_id = a.s2_id WHERE p.arxiv_id IS NOT NULL")
def author_citation_backfill(spark, folder):
    answers = table(spark, folder, "s2_records").select("s2_id", F.array("citation_count").alias("counts"))
    return M.backfill_citations(table(spark, folder, "papers").where("arxiv_id is not null"), answers).select("arxiv_id", "max_author_citations")


@query("WITH v AS (SELECT arxiv_id, max_by(record_id, record_id) AS last FROM ingest_records WHERE arxiv_id IS NOT NULL GROUP BY arxiv_id) SELECT p.arxiv_id, v.last IS NOT NULL OR coalesce(has_embedding, false) AS has_embedding, CASE WHEN v.last IS NOT NULL THEN v.last ELSE -1 END AS written FROM papers p LEFT JOIN v USING (arxiv_id) WHERE p.arxiv_id IS NOT NULL")
def vector_writeback(spark, folder):
    made = table(spark, folder, "ingest_records").where("arxiv_id is not null").select("arxiv_id", F.col("record_id").alias("position"), F.array_repeat(F.col("record_id").cast("float"), 2).alias("vector"), "record_id")
    rows = table(spark, folder, "papers").where("arxiv_id is not null").withColumn("vector", F.lit(None).cast("array<float>"))
    return M.write_vectors(rows, made, 2).select("arxiv_id", "has_embedding", F.coalesce(F.col("vector")[0].cast("long"), F.lit(-1)).alias("written"))


@query(
    """SELECT 's2:' || s2_id AS arxiv_id, trim(replace(coalesce(title, ''), chr(10), ' ')) AS title, coalesce(array_to_string(authors, '; '), '') AS authors, coalesce(publication_date, CAST(year AS VARCHAR) || '-01-01') AS submitted_date,
CASE WHEN lower(venue) IN ('arxiv', 'arxiv.org') THEN NULL ELSE venue END AS venue, coalesce(citation_count, 0) AS citation_count, 'https://www.semanticscholar.org/paper/' || s2_id AS arxiv_url FROM s2_records WHERE coalesce(s2_id, '') <> ''"""
)
def nested_json_parse(spark, folder):
    rows = table(spark, folder, "s2_records")
    names = F.transform("authors", lambda a: F.struct(F.lit(None).cast("string").alias("authorId"), a.alias("name")))
    raw = rows.select(F.to_json(F.struct(F.col("s2_id").alias("paperId"), "title", names.alias("authors"), "year", F.col("publication_date").alias("publicationDate"), "venue", F.col("citation_count").alias("citationCount"))).alias("raw"))
    parsed = records.parse_raw(raw, "raw")
    return parsed.select("arxiv_id", "title", F.array_join("authors", "; ").alias("authors"), "submitted_date", "venue", "citation_count", "arxiv_url")


@query(
    """SELECT 's2:' || s2_id AS arxiv_id, trim(replace(coalesce(title, ''), chr(10), ' ')) AS title, CAST(to_json(coalesce(authors, [])) AS VARCHAR) AS authors, coalesce(try_cast(substr(coalesce(publication_date, CAST(year AS VARCHAR) || '-01-01'), 1, 4) AS INTEGER), 0) AS year,
coalesce(CASE WHEN lower(venue) IN ('arxiv', 'arxiv.org') THEN NULL ELSE venue END, '') AS venue, 'Semantic Scholar' AS source, coalesce(citation_count, 0) AS citation_count, false AS has_embedding FROM s2_records WHERE coalesce(s2_id, '') <> ''"""
)
def record_to_row(spark, folder):
    rows = table(spark, folder, "s2_records")
    names = F.transform("authors", lambda a: F.struct(F.lit(None).cast("string").alias("authorId"), a.alias("name")))
    raw = rows.select(F.to_json(F.struct(F.col("s2_id").alias("paperId"), "title", names.alias("authors"), "year", F.col("publication_date").alias("publicationDate"), "venue", F.col("citation_count").alias("citationCount"))).alias("raw"))
    return records.table_row(records.parse_raw(raw, "raw")).select("arxiv_id", "title", "authors", "year", "venue", "source", "citation_count", "has_embedding")


_ATOM_CASE = " ".join(f"WHEN contains(lower('Accepted at ' || coalesce(venue, '')), '{k.lower()}') THEN '{k}'" for k in sorted(V.CONFERENCES + V.JOURNALS))


@query(
    f"""SELECT arxiv_id, trim(replace(coalesce(title, ''), chr(10), ' ')) AS title, coalesce(substr(submitted_date, 1, 10), '{AS_OF}') AS submitted_date,
coalesce(CASE WHEN contains(lower(coalesce(venue, '')), 'under review') OR contains(lower(coalesce(venue, '')), 'preprint') OR contains(lower(coalesce(venue, '')), 'submitted to') THEN NULL {_ATOM_CASE} END, '-') AS venue,
array_to_string(list_concat(['Computer Science'], from_json(fields_of_study, '["VARCHAR"]')), ';') AS fields FROM papers WHERE length(arxiv_id) <= 30"""
)
def atom_entries(spark, folder):
    rows = table(spark, folder, "papers").where("arxiv_id is not null")
    entries = rows.select(F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id", F.lit("v2")).alias("id"), "title", F.col("abstract").alias("summary"), F.col("submitted_date").alias("published"), F.from_json("authors", "array<string>").alias("authors"), F.from_json("fields_of_study", "array<string>").alias("categories"), F.concat(F.lit("Accepted at "), F.coalesce("venue", F.lit(""))).alias("comment"), F.lit(None).cast("string").alias("journal_ref"))
    return records.parse_atom(entries, AS_OF).select("arxiv_id", "title", "submitted_date", F.coalesce("venue", F.lit("-")).alias("venue"), F.array_join("fields_of_study", ";").alias("fields"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN 'The user did not provide any research brief.' WHEN p_partkey % 4 = 0 THEN 'WHAT I AM NOT LOOKING FOR:' || chr(10) || p_brand WHEN p_partkey % 3 = 0 THEN 'RESEARCH BRIEF:' || chr(10) || p_name ELSE 'RESEARCH BRIEF:' || chr(10) || p_name || chr(10) || chr(10) || 'WHAT I AM NOT LOOKING FOR:' || chr(10) || p_brand END AS brief FROM part")
def brief_assembly(spark, folder):
    rows = table(spark, folder, "part")
    wanted = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.concat(F.lit("  "), "p_name"))
    unwanted = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat("p_brand", F.lit(" ")))
    return rows.select("p_partkey", X.brief(wanted, unwanted).alias("brief"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 AND p_size % 2 > 0 THEN (2000 + p_size % 3) || '–' || (2010 + p_size % 2) WHEN p_size % 3 > 0 THEN 'from ' || (2000 + p_size % 3) WHEN p_size % 2 > 0 THEN 'up to ' || (2010 + p_size % 2) END, '-') AS label FROM part")
def date_window_label(spark, folder):
    low = F.when(F.col("p_size") % 3 > 0, 2000 + F.col("p_size") % 3).otherwise(0)
    high = F.when(F.col("p_size") % 2 > 0, 2010 + F.col("p_size") % 2)
    return table(spark, folder, "part").select("p_partkey", F.coalesce(X.window_label(low, high), F.lit("-")).alias("label"))


@query("SELECT arxiv_id, false AS has_embedding FROM papers WHERE arxiv_id IS NOT NULL")
def embedding_reset(spark, folder):
    return M.reset_embeddings(table(spark, folder, "papers").where("arxiv_id is not null")).select("arxiv_id", "has_embedding")


@query("SELECT event_type, count(*) AS n, min(stage) AS stage FROM (SELECT event_type, CASE WHEN event_type = 'click' THEN 2 WHEN event_type = 'error' THEN 3 ELSE 1 END AS stage FROM events) GROUP BY event_type")
def stage_markers(spark, folder):
    message = F.when(F.col("event_type") == "click", "RRF done, Stage 2 begins").when(F.col("event_type") == "error", "Cross-Encoder failed").otherwise(F.col("event_type"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(X.stage_index(message)).alias("stage"))


@query(f"WITH {CORPUS}, t AS (SELECT paper_id, citation_count, CASE WHEN year % 2 = 0 THEN 'TRAIN_' ELSE 'TEST_' END || year AS dataset FROM corpus) SELECT dataset, starts_with(dataset, 'TRAIN_') AS training, count(*) AS n, round(sum(ln(1 + greatest(citation_count, 0))), 4)::DOUBLE AS target FROM t GROUP BY dataset")
def train_test_split(spark, folder):
    rows = training.features(papers_of(spark, folder)).withColumn("dataset", F.concat(F.when(F.col("year") % 2 == 0, "TRAIN_").otherwise("TEST_"), F.col("year").cast("string")))
    fit, test = training.split(rows)
    both = fit.withColumn("training", F.lit(True)).unionByName(test.withColumn("training", F.lit(False)))
    return both.groupBy("dataset", "training").agg(F.count("*").alias("n"), F.round(F.sum("target"), 4).alias("target"))


@query("SELECT arxiv_id, min(record_id) AS record_id FROM ingest_records WHERE arxiv_id IS NOT NULL GROUP BY arxiv_id")
def dedupe_keep_first(spark, folder):
    return records.keep_first(table(spark, folder, "ingest_records").where("arxiv_id is not null"), "arxiv_id", ["record_id"]).select("arxiv_id", "record_id")


@query("SELECT max(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def stream_upsert_events(spark, folder):
    return stream.latest_per_key(spark, f"{folder}/events.parquet", "user_id", "event_id")


# --- training and models


@query(
    f"""WITH {CORPUS}, f AS (SELECT paper_id, citation_count, round({_FAME}, 6)::DOUBLE AS predicted FROM corpus), t AS (SELECT quantile_cont(citation_count, 0.8) AS bar FROM f), best AS (SELECT * FROM f ORDER BY predicted DESC, paper_id LIMIT 10)
SELECT round(bar, 6) AS bar, count(*) FILTER (WHERE citation_count >= bar) / 10.0::DOUBLE AS precision FROM best, t GROUP BY bar"""
)
def precision_at_10(spark, folder):
    rows = papers_of(spark, folder).select("paper_id", "citation_count", F.round(S.fame(F.col("max_author_citations")), 6).alias("predicted"))
    return training.precision_at(rows, "predicted", "citation_count")


@query(
    f"""WITH {CORPUS}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(title || chr(10) || chr(10) || abstract), '[a-z0-9]+')) AS w FROM corpus),
h AS (SELECT paper_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w), v AS (SELECT paper_id, h % 256 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
qh AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT unnest(['protein', 'routing', 'benchmark']) AS w)), q AS (SELECT h % 256 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS y FROM qh GROUP BY ALL),
s AS (SELECT paper_id, sum(x * coalesce(y, 0)) / (sqrt(sum(x * x)) * (SELECT sqrt(sum(y * y)) FROM q)) AS s FROM v LEFT JOIN q USING (d) GROUP BY paper_id)
SELECT paper_id, round(coalesce(s, 0), 6)::DOUBLE AS similarity FROM corpus LEFT JOIN s USING (paper_id) ORDER BY round(coalesce(s, 0), 6) DESC, paper_id LIMIT {V.KEEP_VECTOR}"""
)
def hash_embed_rerank(spark, folder):
    from quillspark.functions.embed import hash_embed, hash_vector

    rows = papers_of(spark, folder)
    return R.rerank(rows.withColumn("has_embedding", F.lit(False)), hash_vector("protein routing benchmark"), hash_embed).select("paper_id", "similarity")


@query()
def lsh_ann(spark, folder):
    from quillspark.operators.ann import lsh_neighbours

    return lsh_neighbours(table(spark, folder, "embeddings"), "vec_id", "embedding", 5)


@query()
def ivf_ann(spark, folder):
    from quillspark.operators.ann import ivf_search

    rows = table(spark, folder, "embeddings")
    return ivf_search(rows, "vec_id", "embedding", [float(x) for x in rows.orderBy("vec_id").first()["embedding"]], 20)


@query()
def gbt_feature_importance(spark, folder):
    return training.feature_importance(training.features(papers_of(spark, folder)))


# the queries of briefs, services and pipelines register themselves
from quillspark.plans import catalogue_briefs, catalogue_services  # noqa: E402, F401
