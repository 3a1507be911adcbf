"""Classification, impact and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import fixed as V
from quillspark.sources.shared import materialised


def classify(rows: DataFrame) -> DataFrame:
    """Label by pair score if any row has one, else by rank of similarity.

    Columns read: pair_score, similarity. Added: focus, relevance, basis. A null score counts as 0
    beside scored rows. Thirty per cent, at least ten, of unscored sets are primary, none off-topic.
    """
    whole = Window.partitionBy()
    scored = F.max(F.col("pair_score").isNotNull()).over(whole)
    place = F.row_number().over(Window.orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "paper_id"))
    n = F.count("*").over(whole)
    top = F.greatest(F.lit(1), F.least(n, F.greatest(F.lit(10), F.floor(n * 0.3))))
    score = F.coalesce("pair_score", F.lit(0.0))
    by_score = F.when(score >= V.PRIMARY, "primary").when(score >= V.SECONDARY, "secondary").otherwise("off-topic")
    marked = rows.withColumns({"any_scored": scored, "place": place, "top": top})
    return marked.withColumns({
        "focus": F.when(F.col("any_scored"), by_score).otherwise(F.when(F.col("place") <= F.col("top"), "primary").otherwise("secondary")),
        "relevance": F.when(F.col("any_scored"), score).otherwise(F.coalesce("similarity", F.lit(0.0))),
        "basis": F.when(F.col("any_scored"), "cross_encoder").otherwise("embedding"),
    }).drop("any_scored", "place", "top")


def heuristic_impact(rows: DataFrame) -> DataFrame:
    """10..50 by min-max normalised relevance and similarity, truncated."""
    s = F.coalesce("relevance", F.lit(0.0)) * 0.7 + F.coalesce("similarity", F.lit(0.0)) * 0.3
    whole = Window.partitionBy()
    low, high = F.min("mix").over(whole), F.max("mix").over(whole)
    part = F.when(high > low, (F.col("mix") - low) / (high - low)).otherwise(0.5)
    # rounded before truncation, so that engines that add in another order truncate alike
    return rows.withColumn("mix", F.round(s, 6)).withColumn("impact", F.floor(F.round(10 + part * 40, 6)).cast("double")).drop("mix")


def scoring_set(rows: DataFrame, least: int = V.MIN_SCORED) -> DataFrame:
    """All primary rows, topped up with the best secondary ones to ``least``; the first secondary ones if there are no primary."""
    primary = F.count_if(F.col("focus") == "primary").over(Window.partitionBy())
    place = F.row_number().over(Window.partitionBy("focus").orderBy(F.desc("relevance"), F.desc(F.coalesce("similarity", F.lit(0.0))), "paper_id"))
    marked = rows.withColumns({"primaries": primary, "place": place})
    return marked.where((F.col("focus") == "primary") | ((F.col("focus") == "secondary") & (F.col("place") <= F.greatest(least - F.col("primaries"), F.lit(0))))).drop("primaries", "place")


def order_keys() -> list[Column]:
    """Primary, secondary, others; inside each rated rows by impact, then unrated ones by relevance and similarity; ids last."""
    group = F.when(F.col("focus") == "primary", 0).when(F.col("focus") == "secondary", 1).otherwise(2)
    unrated = F.col("impact") == -1.0
    return [group, unrated.cast("int"), F.when(unrated, 0.0).otherwise(-F.col("impact")), F.desc(F.when(unrated, F.coalesce("relevance", F.lit(0.0))).otherwise(0.0)), F.desc(F.when(unrated, F.coalesce("similarity", F.lit(0.0))).otherwise(0.0)), F.col("paper_id")]


def final_rank(rows: DataFrame) -> DataFrame:
    """Rows with their rank; the candidate set is bounded by the funnel before it."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order_keys())))


def page(ranked: DataFrame, number: int, size: int = 10) -> DataFrame:
    return ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))


def chunks(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """Rows numbered in batches of ``size`` in key order, without gathering them in one task.

    Rows are range-partitioned by key and kept, so that counts and numbers see the same partitions; each
    partition numbers its own rows and adds the counts of those before it.
    """
    placed = materialised(rows.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    local = placed.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*key)))
    return local.join(F.broadcast(before), "part").withColumn("chunk", F.floor((F.col("before") + F.col("i") - 1) / size)).drop("part", "before", "i")


def result_row(rows: DataFrame) -> DataFrame:
    """The public form of a ranked row."""
    focus = F.when(F.col("focus").isin("primary", "secondary", "off-topic"), F.col("focus")).otherwise("off-topic")
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("relevance", "similarity", F.lit(0.0))))
    return rows.withColumns({"too_new": F.col("impact") == -1.0, "focus": focus, "relevance": relevance, "basis": F.when(F.col("basis") == "cross_encoder", F.col("basis")).otherwise("embedding")})
