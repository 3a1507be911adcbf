"""Full-text and vector retrieval, fusion, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import fixed as V
from quillspark.functions.scores import cosine_to, sigmoid
from quillspark.functions.text import any_of, sentences, snippet, tokens

K1, B = 1.2, 0.75
FIELDS = ("title", "abstract")


def postings(docs: DataFrame, field: str, id_col: str = "paper_id") -> DataFrame:
    """Positional inverted index of a field: term, id, frequency, positions, length of the document."""
    words = docs.select(id_col, tokens(F.col(field)).alias("t")).select(id_col, F.size("t").alias("length"), F.posexplode("t").alias("pos", "term"))
    return words.groupBy("term", id_col, "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def write_index(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Rebuild the index of all fields under a path, partitioned by field and hash bucket of the term, so that a query reads few files."""
    for i, field in enumerate(FIELDS):
        rows = postings(docs, field).withColumn("field", F.lit(field)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        rows.repartition("bucket").write.mode("overwrite" if i == 0 else "append").partitionBy("field", "bucket").parquet(path)


def index_statistics(docs: DataFrame) -> DataFrame:
    """One row of the collection's statistics: documents and mean lengths of the fields."""
    return docs.agg(F.count("*").alias("n"), *[F.avg(F.size(tokens(F.col(f)))).alias(f"{f}_avg") for f in FIELDS])


def build_index(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """The index of all fields with the statistics that scores need."""
    write_index(docs, f"{path}/postings", buckets)
    index_statistics(docs).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/statistics")


def search_index(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """BM25 scores as ``bm25`` gives them, from the postings of the terms alone: other fields, buckets and terms are never read."""
    stats = spark.read.parquet(f"{path}/statistics").first()
    wanted = list(dict.fromkeys(terms))
    rows = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(wanted) & any_of([F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(stats["buckets"])) for t in wanted]))
    df = rows.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row per field and term
    mean = F.when(F.col("field") == FIELDS[0], F.lit(stats[f"{FIELDS[0]}_avg"])).otherwise(F.lit(stats[f"{FIELDS[1]}_avg"]))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    return rows.join(F.broadcast(df), ["field", "term"]).groupBy("paper_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def vocabulary(docs: DataFrame, field: str) -> DataFrame:
    """Per term: documents and occurrences."""
    return postings(docs, field).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with their BM25 score over title and abstract, rounded to six places; those without any term are left out.

    One pass counts each query term per document, with no exploding and no shuffle but a one-row
    aggregate of the collection's statistics; the score is an expression over both.
    """
    terms = list(dict.fromkeys(terms))
    cols = {}
    for f in FIELDS:
        cols[f"{f}_length"] = F.size(F.col(f"{f}_tokens"))
        for i, t in enumerate(terms):
            cols[f"{f}_{i}"] = occurrences(F.col(f"{f}_tokens"), t)
    counted = docs.select("paper_id", *[tokens(F.col(f)).alias(f"{f}_tokens") for f in FIELDS]).withColumns(cols).drop(*[f"{f}_tokens" for f in FIELDS])
    sums = [F.count("*").alias("n")] + [F.avg(f"{f}_length").alias(f"{f}_avg") for f in FIELDS] + [F.count_if(F.col(f"{f}_{i}") > 0).alias(f"{f}_df_{i}") for f in FIELDS for i in range(len(terms))]
    joined = counted.crossJoin(F.broadcast(counted.agg(*sums)))  # one row
    score: Column = F.lit(0.0)
    for f in FIELDS:
        for i in range(len(terms)):
            tf, df = F.col(f"{f}_{i}"), F.col(f"{f}_df_{i}")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"{f}_length") / F.col(f"{f}_avg")))
    return joined.select("paper_id", F.round(score, 6).alias("score")).where("score > 0")


def by_vector(docs: DataFrame, query: list[float]) -> DataFrame:
    """Exact cosine similarity of the usable vectors to a query vector; the validity filter comes before ranking."""
    return docs.where(F.col("has_embedding") & (F.size("vector") == len(query))).select("paper_id", F.round(cosine_to(F.col("vector"), query), 6).alias("score"))


def ranked(scored: DataFrame, depth: int) -> DataFrame:
    """(paper_id, rank) of the best ``depth``, ties by id. The cut comes first, so one task numbers only that many rows."""
    best = scored.orderBy(F.desc("score"), "paper_id").limit(depth)
    return best.select("paper_id", F.row_number().over(Window.orderBy(F.desc("score"), "paper_id")).alias("rank"))


def fuse(text: DataFrame, vector: DataFrame, w_text: float = 1.0, w_vector: float = 1.0, k: int = V.FUSION_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rank lists; a missing rank counts as one past the end of its list."""
    t, v = text.withColumnRenamed("rank", "text_rank"), vector.withColumnRenamed("rank", "vector_rank")
    both = t.join(v, "paper_id", "full")
    whole = Window.partitionBy()
    last_t, last_v = F.count("text_rank").over(whole) + 1, F.count("vector_rank").over(whole) + 1
    score = w_text / (k + F.coalesce("text_rank", last_t)) + w_vector / (k + F.coalesce("vector_rank", last_v))
    origin = F.when(F.col("text_rank").isNotNull() & F.col("vector_rank").isNotNull(), "both").when(F.col("text_rank").isNotNull(), "text").otherwise("vector")
    return both.select("paper_id", "text_rank", "vector_rank", F.round(score, 6).alias("rrf"), origin.alias("origin"))


def adaptive_k(pool: int) -> tuple[int, int]:
    """Number of candidates for a pool, and the depth to which the arms are searched."""
    k = max(V.MIN_POOL, min(1200, int(0.07 * pool)))
    return k, min(5 * k, 6000)


def hybrid(docs: DataFrame, terms: list[str], query: list[float] | None, k: int, depth: int, w_text: float = 1.0, w_vector: float = 1.0) -> DataFrame:
    """Both arms over a pool, fused; the best ``k`` by fused score, ties by descending id. Without a query vector the vector arm is empty."""
    text = ranked(bm25(docs, terms), depth)
    vector = ranked(by_vector(docs, query), depth) if query else text.where("false")
    return fuse(text, vector, w_text, w_vector).orderBy(F.desc("rrf"), F.desc("paper_id")).limit(k)


def ladder(rows: DataFrame, quality: Column, dates: Column | None, entities: Column | None, k: int) -> tuple[int, Column]:
    """The first rung that leaves at least 50 rows, and its predicate.

    Rungs: all filters at depth k, all filters at 1200, without entities, without dates, and the
    whole pool. One aggregate counts all rungs; the quality filter is dropped last.
    """
    d, e = dates if dates is not None else F.lit(True), entities if entities is not None else F.lit(True)
    n = rows.agg(F.count_if(quality & d & e).alias("qde"), F.count_if(quality & d).alias("qd"), F.count_if(quality).alias("q")).first()
    rungs = [(min(k, n["qde"]), quality & d & e), (min(1200, n["qde"]), quality & d & e)]
    rungs.append((min(1200, n["qd"]) if entities is not None else 0, quality & d))
    rungs.append((min(1200, n["q"]) if dates is not None else 0, quality))
    return next(((i + 1, p) for i, (size, p) in enumerate(rungs) if size >= V.MIN_POOL), (5, F.lit(True)))


def rerank(rows: DataFrame, query: list[float], embed: Callable[[Column], Column] | None = None, keep: int = V.KEEP_VECTOR) -> DataFrame:
    """Best rows by similarity of their stored vector. Rows without a usable one are embedded live if an embedder is given, and are its only rows."""
    usable = F.coalesce(F.col("has_embedding") & (F.size("vector") == len(query)), F.lit(False))
    near = F.round(cosine_to(F.col("vector"), query), 6)
    if embed is None:  # one scan
        found = rows.withColumns({"similarity": F.when(usable, near).otherwise(0.0), "branch": F.when(usable, 0).otherwise(1)})
    else:
        live = F.round(cosine_to(embed(F.concat_ws("\n\n", "title", "abstract")), query), 6)
        found = rows.where(usable).withColumns({"similarity": near, "branch": F.lit(0)}).unionByName(rows.where(~usable).withColumns({"similarity": live, "branch": F.lit(1)}))
    return found.orderBy(F.desc("similarity"), "branch", "paper_id").limit(keep)


def pair_rerank(rows: DataFrame, query: str, score: Callable[[Column, Column], Column] | None, keep: int = V.KEEP_PAIR) -> DataFrame:
    """Best rows by a pair scorer over title and abstract start; the sigmoid goes to a column of its own. Without a scorer the first rows stay, unscored."""
    if score is None:
        return rows.withColumn("pair_score", F.lit(None).cast("double")).orderBy(F.desc("similarity"), "paper_id").limit(keep)
    raw = score(F.lit(query), F.concat_ws("\n\n", "title", F.substring("abstract", 1, V.PAIR_CHARS)))
    return rows.withColumn("raw_score", raw).withColumn("pair_score", F.round(sigmoid(F.col("raw_score")), 6)).orderBy(F.desc("raw_score"), "paper_id").limit(keep).drop("raw_score")


def highlights(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(paper_id, reason): the two sentences of each abstract that name most query terms, earlier ones first on ties; a fixed message without sentences."""
    split = rows.select("paper_id", F.posexplode_outer(sentences(F.col("abstract"))).alias("pos", "sentence"))
    score = sum((occurrences(tokens(F.col("sentence")), t) for t in terms), F.lit(0))
    top = split.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc(score), "pos"))).where("n <= 2")
    packed = top.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]).alias("best"))
    return packed.select("paper_id", F.when(F.size(F.filter("best", lambda s: s.isNotNull())) > 0, snippet(F.col("best"))).otherwise("No extractable sentences found in abstract.").alias("reason"))
