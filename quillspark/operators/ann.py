"""Approximate nearest neighbours with Spark's own tools."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.scores import cosine, dot, norm


def unit(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    n = norm(F.col(vector_col))
    scaled = F.transform(vector_col, lambda x: x.cast("double") / n)
    return rows.where(n > 0).select(F.col(id_col).alias("id"), scaled.alias("u")).withColumn("v", array_to_vector("u"))


def reach(rows: DataFrame, id_col: str, vector_col: str, k: int, part: float = 0.95) -> float:
    """The Euclidean distance of unit vectors within which most rows have their k neighbours, found on ``TRIALS`` rows."""
    n = rows.count()
    tried = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * min(1.0, TRIALS / max(1, n))))
    last = brute_force(rows, tried, id_col, vector_col, k).groupBy("id").agg(F.min("similarity").alias("s"))
    return last.agg(F.coalesce(F.percentile(F.sqrt(F.greatest(2 - 2 * F.col("s"), F.lit(0.0))), part), F.lit(2.0))).first()[0]


def lsh_neighbours(rows: DataFrame, id_col: str, vector_col: str, k: int, radius: float | None = None) -> DataFrame:
    """(id, neighbour, similarity): pairs within a Euclidean radius of unit vectors, found by random projections; the best k of each.

    Without a radius, it is the one within which most rows have their neighbours.
    """
    radius = radius or reach(rows, id_col, vector_col, k)
    data = unit(rows, id_col, vector_col)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.2, numHashTables=8, seed=7).fit(data)
    near = model.approxSimilarityJoin(data, data, radius, distCol="d").where("datasetA.id <> datasetB.id").select(F.col("datasetA.id").alias("id"), F.col("datasetB.id").alias("neighbour"), F.round(1 - F.col("d") * F.col("d") / 2, 6).alias("similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return near.withColumn("o", F.row_number().over(order)).where(F.col("o") <= k).drop("o")


def ivf_cells(rows: DataFrame, id_col: str, vector_col: str, cells: int = 16) -> tuple[DataFrame, list[list[float]]]:
    """The rows with the cell of their nearest centre, and the centres. Writing them partitioned by cell makes the index."""
    data = unit(rows, id_col, vector_col)
    model = KMeans(k=cells, seed=7, featuresCol="v", predictionCol="cell").fit(data)
    return model.transform(data).select("id", "u", "cell"), [c.tolist() for c in model.clusterCenters()]


def ivf_search(rows: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, cells: int = 16, probes: int = 6) -> DataFrame:
    """(id, similarity): the best k among the cells whose centres lie nearest to the query."""
    indexed, centres = ivf_cells(rows, id_col, vector_col, cells)
    order = sorted(range(len(centres)), key=lambda i: -sum(a * b for a, b in zip(centres[i], query)))
    q = F.array(*[F.lit(float(x)) for x in query])
    return indexed.where(F.col("cell").isin(order[:probes])).select("id", F.round(cosine(F.col("u"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


#: Vectors that the cells are fitted on at most, cells at most, and rows that the number of visits is tried on: bounds of what is broadcast and gathered.
FITTED, CELLS, TRIALS = 20_000, 1024, 200


def write_cells(rows: DataFrame, id_col: str, vector_col: str, path: str, k: int = 5, recall: float = 0.97) -> None:
    """The cell index under a path: unit vectors partitioned by cell, and the centres. Cells follow the rows (their square root, bounded); the fit takes a bounded sample, every row is indexed."""
    data = unit(rows, id_col, vector_col)
    n = data.count()
    cells = max(1, min(CELLS, int(n**0.5)))
    sample = data if n <= FITTED else data.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * FITTED / n))
    model = KMeans(k=cells, seed=7, featuresCol="v", predictionCol="cell").fit(sample)
    model.transform(data).select("id", "u", "cell").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark = rows.sparkSession
    spark.createDataFrame(centres, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    # the cells to visit are the least number that holds nearly all true neighbours of some of the rows
    tried = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * min(1.0, TRIALS / max(1, n))))
    home = spark.read.parquet(f"{path}/cells").select(F.col("id").alias("neighbour"), "cell")
    order = cell_order(spark, path, unit(tried, id_col, vector_col)).select("id", F.posexplode("cells").alias("place", "cell"))
    true = brute_force(rows, tried, id_col, vector_col, k).join(home, "neighbour").join(order, ["id", "cell"])
    probes = true.agg(F.coalesce(F.percentile("place", recall) + 1, F.lit(1.0)).cast("int").alias("probes"))
    probes.write.mode("overwrite").parquet(f"{path}/probes")


def cell_order(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(id, u, cells): all cells for each unit vector, the nearest centre's first."""
    shared = spark.read.parquet(f"{path}/centres").agg(F.collect_list(F.struct("cell", "centre")).alias("centres"))  # one row, bounded by CELLS
    far = F.transform("centres", lambda c: F.struct((-dot(c["centre"], F.col("u"))).alias("d"), c["cell"].alias("cell")))
    return asked.crossJoin(F.broadcast(shared)).select("id", "u", F.transform(F.array_sort(far), lambda x: x["cell"]).alias("cells"))


def search_cells(spark: SparkSession, path: str, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(id, neighbour, similarity) of many queries: each is sent to its nearest cells, as many as the index asks for, and meets only their rows."""
    probes = spark.read.parquet(f"{path}/probes").first().probes
    asked = cell_order(spark, path, unit(queries, id_col, vector_col))
    sent = asked.select("id", F.col("u").alias("q"), F.explode(F.slice("cells", 1, probes)).alias("cell"))
    index = spark.read.parquet(f"{path}/cells").select(F.col("id").alias("neighbour"), "u", "cell")
    met = sent.join(index, "cell").where("id <> neighbour").select("id", "neighbour", F.round(dot(F.col("q"), F.col("u")), 6).alias("similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return met.withColumn("o", F.row_number().over(order)).where(F.col("o") <= k).drop("o")


def brute_force(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """The same by comparing the queries, gathered in blocks, with all rows: the measure of an index."""
    asked = unit(queries, id_col, vector_col).groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("block")).agg(F.collect_list(F.struct("id", "u")).alias("qs"))
    data = unit(rows, id_col, vector_col).select(F.col("id").alias("neighbour"), "u")
    met = data.crossJoin(asked).select("neighbour", "u", F.explode("qs").alias("q")).select(F.col("q.id").alias("id"), "neighbour", F.round(dot(F.col("q.u"), F.col("u")), 6).alias("similarity")).where("id <> neighbour")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return met.withColumn("o", F.row_number().over(order)).where(F.col("o") <= k).drop("o")
