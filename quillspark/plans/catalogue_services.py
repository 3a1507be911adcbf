"""Queries of the sources, services, indexes and pipelines, and their SQL counterparts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as V
from quillspark.functions import text as X
from quillspark.functions.embed import hash_embed, overlap_scorer
from quillspark.operators import ann
from quillspark.operators import corpus as C
from quillspark.operators import ranking as K
from quillspark.operators import retrieval as R
from quillspark.plans import export, ingest, training
from quillspark.plans.catalogue import _FINAL, AS_OF, CORPUS, PROBE, SIMILAR, TERMS, _ATOM_CASE, _bm25_sql, _hybrid_sql, final, halves, papers_of, query, similar, table
from quillspark.plans.catalogue import SQL as CATALOGUE_SQL
from quillspark.plans.catalogue_briefs import stated
from quillspark.plans.brief import Query
from quillspark.plans.search import Models, Request, candidates, health, probe, search, stages
from quillspark.sources import records, replay, services
from quillspark.sources.shared import work_dir
from quillspark.streaming import upsert as stream

# --- sources


@query(CATALOGUE_SQL["record_to_row"])
def bulk_service(spark, folder):
    """Pages of the bulk service, played back, read by the paged source, parsed and turned into rows."""
    spark.dataSource.register(records.PagedSource)
    pages = spark.read.format("quill_pages").options(queries=folder, fetch="quillspark.sources.replay.bulk_pages").load()
    return records.table_row(records.parse_raw(pages, "raw")).select("arxiv_id", "title", "authors", "year", "venue", "source", "citation_count", "has_embedding")


def _xml(c) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;")


@query(
    f"""SELECT arxiv_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, coalesce(substr(submitted_date, 1, 10), '{AS_OF}') AS submitted_date,
coalesce(CASE WHEN contains(lower(coalesce(venue, '')), 'under review') OR contains(lower(coalesce(venue, '')), 'preprint') OR contains(lower(coalesce(venue, '')), 'submitted to') THEN NULL {_ATOM_CASE} END, '-') AS venue,
len(from_json(authors, '["VARCHAR"]')) AS people FROM papers WHERE length(arxiv_id) <= 30 AND length(submitted_date) >= 10 AND len(from_json(authors, '["VARCHAR"]')) > 0"""
)
def atom_feed(spark, folder):
    """Atom XML of one entry each, parsed by the XML reader."""
    rows = table(spark, folder, "papers").where("arxiv_id is not null and length(submitted_date) >= 10")
    people = F.array_join(F.transform(F.from_json("authors", "array<string>"), lambda a: F.concat(F.lit("<author><name>"), _xml(a), F.lit("</name></author>"))), "")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), _xml(c), F.lit(f"</{n}>"))
    entry = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry>'), tag("id", F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id", F.lit("v2"))), tag("title", F.col("title")), tag("published", F.col("submitted_date")), people, F.lit('<category term="cs.LG"/>'), tag("arxiv:comment", F.concat(F.lit("Accepted at "), F.coalesce("venue", F.lit("")))), F.lit("</entry></feed>"))
    got = records.parse_atom(services.feed_entries(rows.select(entry.alias("xml")), "xml"), AS_OF)
    return got.where(F.size("authors") > 0).select("arxiv_id", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "submitted_date", F.coalesce("venue", F.lit("-")).alias("venue"), F.size("authors").cast("long").alias("people"))


@query("SELECT arxiv_id, submitted_date, (SELECT min(submitted_date) < '2023-01-01' FROM papers WHERE submitted_date <> '') AS stop FROM papers WHERE arxiv_id IS NOT NULL AND submitted_date >= '2023-01-01'")
def cutoff_filter(spark, folder):
    """Entries since a day, and whether the page's oldest lets its reader stop."""
    rows = table(spark, folder, "papers").where("submitted_date <> ''")
    kept, stop = records.since(rows, "2023-01-01")
    told = rows.agg(stop.alias("stop"))  # one row
    return kept.where("arxiv_id is not null").select("arxiv_id", "submitted_date").crossJoin(F.broadcast(told))


RETRIES = [(0, "ok", ""), (2, "ok", "2|4"), (4, "failed", "2|4|8"), (9, "failed", "2|4|8")]


@query(stated("failures, result, waits", RETRIES))
def retry_waits(spark, folder):
    out = []
    for n, _, _ in RETRIES:
        left, waits = [n], []

        def call(left=left):
            left[0] -= 1
            if left[0] >= 0:
                raise OSError
            return "ok"

        try:
            result = records.with_retry(call, sleep=waits.append)
        except OSError:
            result = "failed"
        out.append((n, result, "|".join(str(int(w)) for w in waits)))
    return spark.createDataFrame(out, "failures int, result string, waits string")


STORAGE = [("complete", "s3a://papers", "auto"), ("missing BUCKET_KEY_ID, BUCKET_SECRET", "-", "-")]


@query(stated("settings, path, region", STORAGE))
def storage_settings(spark, folder):
    out = []
    for env in ({"BUCKET_ENDPOINT": "e", "BUCKET_NAME": " 'papers' ", "BUCKET_KEY_ID": "k", "BUCKET_SECRET": "s"}, {"BUCKET_ENDPOINT": "e", "BUCKET_NAME": "n", "BUCKET_KEY_ID": " "}):
        try:
            got = records.storage_options(env)
            out.append(("complete", got["path"], got["fs.s3a.endpoint.region"]))
        except ValueError as e:
            out.append((str(e).replace("missing storage settings: ", "missing "), "-", "-"))
    return spark.createDataFrame(out, "settings string, path string, region string")


@query("SELECT arxiv_id AS paper_id, CASE WHEN coalesce(max_author_citations, 0) > 0 THEN max_author_citations WHEN arxiv_id LIKE 's2:%' OR length(split_part(arxiv_id, 'v', 1)) = 0 THEN length(coalesce(title, '')) ELSE length(split_part(arxiv_id, 'v', 1)) END AS max_author_citations FROM papers WHERE arxiv_id IS NOT NULL")
def citation_lookup(spark, folder):
    """Citations by id, then by title, from a service that answers with lengths."""
    return services.lookup_citations(papers_of(spark, folder), replay.citations).select("paper_id", "max_author_citations")


@query(f"WITH {_FINAL} SELECT paper_id, rank, CASE WHEN rank <= 5 THEN upper(title) ELSE '-' END AS summary FROM final WHERE rank <= 30")
def summaries(spark, folder):
    """Plain-language summaries of the first five, joined to the ranked rows; the model repeats the title."""
    ranked = final(spark, folder).where("rank <= 30")
    return services.summarised(ranked, replay.first_line, 5).select("paper_id", "rank", F.coalesce("summary", F.lit("-")).alias("summary"))


# --- sinks, metadata


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def csv_log(spark, folder):
    path = f"{work_dir(spark, 'log')}/log"
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    export.append_log(rows, path)
    export.append_log(rows.where("s_suppkey % 2 = 0"), path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("SELECT count(*) AS corpus_size, 't2' AS built_at, 't1' AS last_arxiv_at, 't2' AS last_s2_at, 2 AS schema_version, 0.84::DOUBLE AS fame, 0.5::DOUBLE AS learned FROM papers")
def metadata_round_trip(spark, folder):
    """Metadata carried forward, weights written and read, unreadable ones replaced by the fixed ones."""
    base, papers = work_dir(spark, "meta"), table(spark, folder, "papers")
    ingest.record_build(f"{base}/meta", papers, "t1", ["arxiv"])
    meta = ingest.record_build(f"{base}/meta", papers, "t2", ["s2"])
    export.write_json(spark, f"{base}/weights", {"fame": 0.5, "hype": 0.1, "sniper": 0.2, "utility": 0.2})
    row = (meta["corpus_size"], meta["built_at"], meta["last_arxiv_at"], meta["last_s2_at"], meta["schema_version"], export.read_weights(spark, f"{base}/meta")["fame"], export.read_weights(spark, f"{base}/weights")["fame"])
    return spark.createDataFrame([row], "corpus_size long, built_at string, last_arxiv_at string, last_s2_at string, schema_version int, fame double, learned double")


@query("SELECT o_orderkey, epoch(TIMESTAMP '2000-06-01') - epoch(o_orderdate) >= 1800 AND o_custkey % 3 <> 0 AND o_orderstatus <> 'F' AS stale FROM orders")
def freshness_check(spark, folder):
    held = F.when(F.col("o_custkey") % 3 == 0, F.lit("tag")).otherwise("old")
    offered = F.when(F.col("o_orderstatus") != "F", F.lit("tag"))
    return table(spark, folder, "orders").select("o_orderkey", export.stale(F.col("o_orderdate").cast("timestamp"), F.lit("2000-06-01").cast("timestamp"), held, offered).alias("stale"))


@query(f'WITH {_FINAL} SELECT paper_id, greatest(0.0, least(1.0, relevance))::DOUBLE AS rel, impact = -1.0 AS "tooNew", pdf_url AS pdf FROM final JOIN (SELECT paper_id, pdf_url FROM corpus) USING (paper_id)')
def display_names(spark, folder):
    return export.for_display(final(spark, folder)).select("paper_id", "rel", "tooNew", "pdf")


# --- scans and pipelines


@query("WITH c AS (SELECT arxiv_id, coalesce(CASE WHEN regexp_matches(submitted_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(substr(submitted_date, 1, 10) AS DATE) END, DATE '2024-01-01') AS d FROM papers WHERE arxiv_id IS NOT NULL), w(name, n) AS (VALUES ('Last 3 Days', 3), ('Last Week', 7), ('Last Month', 30), ('Last 3 Months', 90), ('All Time', 9315)) SELECT name, count(*) FILTER (WHERE d BETWEEN DATE '2025-07-02' - n::INT AND DATE '2025-07-02') AS papers FROM c, w GROUP BY name")
def window_presets(spark, folder):
    rows = papers_of(spark, folder)
    names = [*V.WINDOW_DAYS, "All Time"]
    counts = rows.agg(*[F.count_if(C.in_window(*C.window(n, "2025-07-02"))).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("papers")) for n in names])).alias("x")).select("x.*")


@query(f"WITH {CORPUS} SELECT paper_id, (row_number() OVER (ORDER BY submitted DESC, paper_id) - 1) // 100 AS chunk FROM corpus WHERE NOT has_embedding")
def embedding_chunks(spark, folder):
    """Pending rows, newest first, embedded in committed chunks; the second run finds them all done."""
    path = f"{work_dir(spark, 'embed')}/chunks"
    papers = table(spark, folder, "papers")
    ingest.embed_in_chunks(papers, path, hash_embed, 100)
    return ingest.embed_in_chunks(papers, path, hash_embed, 100).select(F.col("arxiv_id").alias("paper_id"), "chunk")


@query("WITH k AS (SELECT count(DISTINCT s2_id) AS n FROM s2_records WHERE coalesce(s2_id, '') <> ''), a AS (SELECT count(*) AS n FROM (SELECT s2_id FROM s2_records WHERE coalesce(s2_id, '') <> '' GROUP BY s2_id HAVING max(citation_count) > 0)) SELECT 'scout' AS stage, n AS rows FROM k UNION ALL SELECT 'analyse', n FROM k UNION ALL SELECT 'enrich', n FROM a")
def three_stage_ingestion(spark, folder):
    rows = table(spark, folder, "s2_records")
    names = F.transform("authors", lambda a: F.struct(F.lit(None).cast("string").alias("authorId"), a.alias("name")))
    raw = rows.select(F.to_json(F.struct(F.col("s2_id").alias("paperId"), "title", names.alias("authors"), "year")).alias("raw"))
    answers = rows.select("s2_id", F.array("citation_count").alias("counts"))
    got = ingest.scout_analyse_enrich(spark, work_dir(spark, "ingest"), raw, hash_embed, answers, 256)
    return spark.createDataFrame([(s, int(n)) for s, n in got.items()], "stage string, rows long")


@query("WITH o AS (SELECT * FROM papers WHERE arxiv_id IS NOT NULL AND length(title) % 3 <> 1) " + CATALOGUE_SQL["coalescing_upsert"].replace("WITH o AS (SELECT * FROM papers WHERE arxiv_id IS NOT NULL AND length(title) % 3 <> 1)", "").replace("SELECT arxiv_id, title, citation_count, CASE", "SELECT arxiv_id, title, citation_count, CASE").rsplit(", CASE WHEN NOT known", 1)[0] + " FROM j")
def stream_ingest(spark, folder):
    """A stream of records upserted into a bucketed table, twice with new checkpoints: the second run changes nothing."""
    base = work_dir(spark, "feed")
    old, new = halves(spark, folder)
    new.withColumn("seen_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{base}/new")
    old.withColumn("seen_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{base}/old")
    feed = lambda name: spark.readStream.schema(spark.read.parquet(f"{base}/{name}").schema).parquet(f"{base}/{name}")
    spark.read.parquet(f"{base}/old").drop("seen_at").withColumn("bucket", F.pmod(F.xxhash64("arxiv_id"), F.lit(8)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/table")
    for run in ("a", "b"):
        got = stream.ingest(spark, feed("new"), f"{base}/table", f"{base}/check-{run}", buckets=8)
    return got.select("arxiv_id", "title", "citation_count", "has_embedding")


EVENTS = [(0, "stage", 0, "running"), (1, "stage", 0, "done"), (2, "stage", 1, "running"), (3, "stage", 1, "done"), (4, "stage", 4, "running"), (5, "stage", 4, "done"), (6, "stage", 5, "running"), (7, "stage", 5, "done"), (8, "done", -1, "")]


@query(stated("place, kind, stage, status", EVENTS).replace("-1", "-1"))
def progress_events(spark, folder):
    """The events of a search over the whole table, the second time from the cache of briefs."""
    papers, cache = table(spark, folder, "papers"), {}
    got = [list(search(papers, Request("protein routing benchmark", "", "All Time"), AS_OF, Models(score_pair=overlap_scorer), cache)) for _ in range(2)][1]
    return spark.createDataFrame([(i, e["type"], e.get("index", -1), e.get("status", "")) for i, e in enumerate(got)], "place int, kind string, stage int, status string")


@query(
    f"""WITH {CORPUS}, t AS (SELECT paper_id, submitted, CASE WHEN submitted BETWEEN DATE '2025-05-01' AND DATE '2025-05-31' THEN 'TRAIN_2025_05' WHEN submitted BETWEEN DATE '2025-06-01' AND DATE '2025-06-30' THEN 'TRAIN_2025_06' WHEN submitted BETWEEN DATE '2025-07-01' AND DATE '2025-07-31' THEN 'TEST_2025_07' WHEN submitted BETWEEN DATE '2025-08-01' AND DATE '2025-08-31' THEN 'TEST_2025_08' END AS dataset FROM corpus)
SELECT paper_id, dataset FROM t WHERE dataset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY submitted DESC, paper_id) <= 75"""
)
def training_windows(spark, folder):
    return training.windowed(papers_of(spark, folder), training.month_windows(AS_OF)).select("paper_id", "dataset")


# --- indexes and rerankers


@query(CATALOGUE_SQL["bm25_topk"])
def bm25_index_topk(spark, folder):
    """The index written, then searched by its terms' postings alone."""
    path = f"{work_dir(spark, 'index')}/fulltext"
    R.build_index(papers_of(spark, folder), path)
    return R.search_index(spark, path, TERMS).orderBy(F.desc("score"), "paper_id").limit(50)


@query(f"WITH {CORPUS}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(abstract), '[a-z0-9]+')) AS term FROM corpus) SELECT term, count(DISTINCT paper_id) AS df, count(*) AS cf FROM w GROUP BY term")
def fulltext_index_abstract(spark, folder):
    return R.vocabulary(papers_of(spark, folder), "abstract")


@query(f"WITH {CORPUS}, {_bm25_sql()}, top AS (SELECT paper_id, row_number() OVER (ORDER BY score DESC, paper_id) AS text_rank FROM text_arm QUALIFY text_rank <= 40) SELECT paper_id, title, text_rank FROM top JOIN corpus USING (paper_id)")
def hit_lookup(spark, folder):
    """Hits joined back to their records: a short list, far below any limit of broadcasts."""
    rows = papers_of(spark, folder)
    hits = R.ranked(R.bm25(rows, TERMS), 40)
    return rows.select("paper_id", "title").join(F.broadcast(hits), "paper_id").withColumnRenamed("rank", "text_rank")


_WORDS = "list_distinct(regexp_extract_all(lower(title || chr(10) || chr(10) || substr(abstract, 1, 1500)), '[a-z0-9]+'))"


@query(f"WITH {SIMILAR}, raw AS (SELECT paper_id, 4.0::DOUBLE * len(list_intersect({_WORDS}, ['protein', 'routing', 'benchmark'])) / 3 - 2.0 AS raw FROM matched WHERE similarity IS NOT NULL) SELECT paper_id, round(1 / (1 + exp(-raw)), 6)::DOUBLE AS pair_score FROM raw ORDER BY raw DESC, paper_id LIMIT {V.KEEP_PAIR}")
def pair_rerank(spark, folder):
    rows = similar(spark, folder).where("similarity is not null")
    return R.pair_rerank(rows, "protein routing benchmark", overlap_scorer).select("paper_id", "pair_score")


@query("SELECT count(*) AS queries, true AS found FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, folder):
    """Recall of the cell index over all queries whose id is divisible by 100, against brute force: at least 0.9."""
    rows = table(spark, folder, "embeddings")
    path = f"{work_dir(spark, 'cells')}/ivf"
    ann.write_cells(rows, "vec_id", "embedding", path)
    asked = rows.where("vec_id % 100 = 0")
    found, true = ann.search_cells(spark, path, asked, "vec_id", "embedding", 5), ann.brute_force(rows, asked, "vec_id", "embedding", 5)
    hits = true.join(found, ["id", "neighbour"], "left_semi").count()
    return asked.agg(F.count("*").alias("queries"), F.lit(hits >= 0.9 * true.count()).alias("found"))


@query(_hybrid_sql(1.0, 1.0, "true", "(SELECT least(5 * k, 6000) FROM size)", "(SELECT k FROM size)") + f" SELECT paper_id, rrf, round(coalesce(CASE WHEN has_embedding AND len(vector) = 768 THEN list_cosine_similarity(vector::DOUBLE[], {PROBE}) END, 0.0), 6)::DOUBLE AS similarity FROM best JOIN corpus USING (paper_id) ORDER BY 3 DESC, paper_id LIMIT {V.KEEP_PAIR}")
def candidate_pipeline(spark, folder):
    """Retrieval over the whole pool for a query without filters: both arms, fusion, rerank by vector, no pair scorer."""
    papers = table(spark, folder, "papers")
    rows = papers_of(spark, folder)
    return candidates(rows, Query(keywords=("protein routing", "benchmark"), statement="protein routing benchmark"), probe(papers)).select("paper_id", "rrf", "similarity")


@query("SELECT s_suppkey, chr(39) || replace(s_name || chr(39) || 's', chr(39), chr(39) || chr(39)) || chr(39) AS literal FROM supplier")
def sql_literals(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", X.sql_literal(F.concat("s_name", F.lit("'s"))).alias("literal"))


@query("SELECT 'ok' AS status, count(*) AS papers, count(*) FILTER (WHERE has_embedding) AS embedded, 7 AS stages FROM papers")
def service_health(spark, folder):
    h = health(table(spark, folder, "papers"))
    return spark.createDataFrame([(h["status"], h["papers"], h["embedded"], len(stages()))], "status string, papers long, embedded long, stages int")


@query(stated("step, size, warm", [("no path", 0, "no"), ("unreadable, model fails", 0, "no"), ("read", 9, "yes"), ("held", 9, "yes")]))
def startup(spark, folder):
    """Metadata read once, models warmed up once; failures are tried again."""
    base, held, out, calls = work_dir(spark, "start"), {}, [], []

    def warm() -> None:
        calls.append(1)
        if len(calls) == 1:
            raise OSError

    def step(name: str, path: str | None, warm=None) -> None:
        meta = export.bootstrap(spark, path, held, warm)
        out.append((name, meta.get("corpus_size", 0), "yes" if held.get("warm") else "no"))

    step("no path", None)
    step("unreadable, model fails", f"{base}/none", warm)
    export.write_meta(spark, f"{base}/meta", 9, "t1")
    step("read", f"{base}/meta", warm)
    export.write_meta(spark, f"{base}/meta", 10, "t2")
    step("held", f"{base}/meta", warm)
    return spark.createDataFrame(out, "step string, size int, warm string")


RUNS = [("all", "s2|sync"), ("arxiv", "arxiv"), ("sync", "sync")]


@query(stated("mode, ran", RUNS))
def schedule_run(spark, folder):
    """What each mode of the schedule runs when only one source is due."""
    now = datetime(2026, 7, 20, tzinfo=timezone.utc)
    meta = {"last_arxiv_at": "2026-07-19T00:00:00+00:00+00:00", "last_s2_at": "2026-07-01T00:00:00Z"}
    runners = {n: lambda: None for n in ("arxiv", "s2")}
    return spark.createDataFrame([(m, "|".join(ingest.schedule(m, meta, now, runners, lambda: None))) for m, _ in RUNS], "mode string, ran string")


@query("SELECT count(*) AS queries, true AS found FROM embeddings WHERE vec_id % 100 = 0")
def lsh_recall(spark, folder):
    """Recall of the random projections over all queries whose id is divisible by 100, against brute force: at least 0.9."""
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    true = ann.brute_force(rows, asked, "vec_id", "embedding", 5)
    hits = true.join(ann.lsh_neighbours(rows, "vec_id", "embedding", 5), ["id", "neighbour"], "left_semi").count()
    return asked.agg(F.count("*").alias("queries"), F.lit(hits >= 0.9 * true.count()).alias("found"))
