"""Training of the impact weights and their evaluation."""

from __future__ import annotations

from calendar import monthrange

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.scores import fame
from quillspark.functions.text import hype, sniper

FEATURES = ["fame", "hype", "sniper", "utility"]
TRAIN_MONTHS, TEST_MONTHS = (14, 13), (12, 11)
#: Rows of a month that a model is fitted or tested on, at most: the window's own rule.
MONTH_ROWS = 75


def month_windows(as_of: str) -> list[tuple[str, str, str]]:
    """(label, first day, last day) of the training and test months before a day, oldest first."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    out = []
    for kind, back in [("TRAIN", n) for n in TRAIN_MONTHS] + [("TEST", n) for n in TEST_MONTHS]:
        y, m = divmod(12 * year + month - 1 - back, 12)
        out.append((f"{kind}_{y}_{m + 1:02d}", f"{y}-{m + 1:02d}-01", f"{y}-{m + 1:02d}-{monthrange(y, m + 1)[1]}"))
    return out


def windowed(papers: DataFrame, windows: list[tuple[str, str, str]], most: int = MONTH_ROWS) -> DataFrame:
    """Papers of the windows with their label as ``dataset``: of each, the ``most`` newest with a known citation count."""
    label = F.coalesce(*[F.when(F.col("submitted").between(a, b), F.lit(n)) for n, a, b in windows])
    rows = papers.withColumn("dataset", label).where("dataset is not null and citation_count is not null")
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("submitted"), "paper_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def features(papers: DataFrame) -> DataFrame:
    """The four features and log citations; utility is 50 where no model rates it."""
    cols = {"fame": fame(F.col("max_author_citations")), "hype": hype(F.col("title")).cast("double"), "sniper": sniper(F.col("title")).cast("double"), "utility": F.lit(50.0), "target": F.log1p(F.greatest(F.col("citation_count"), F.lit(0)))}
    return papers.select("paper_id", "citation_count", "year", *[c.alias(n) for n, c in cols.items()])


def feature_importance(rows: DataFrame, trees: int = 100, depth: int = 3) -> DataFrame:
    """(feature, weight) of gradient-boosted trees on log citations."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select("x", "target")
    model = GBTRegressor(featuresCol="x", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42).fit(data)
    return rows.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(FEATURES, model.featureImportances.toArray())], "feature string, weight double")


def precision_at(rows: DataFrame, predicted: str, actual: str, k: int = 10, quantile: float = 0.8) -> DataFrame:
    """(bar, precision): hits among the k best predicted, divided by k; a hit reaches the quantile of the actual values."""
    bar = rows.agg(F.percentile(actual, quantile).alias("bar"))
    best = rows.orderBy(F.desc(predicted), "paper_id").limit(k)
    return best.crossJoin(F.broadcast(bar)).groupBy(F.round("bar", 6).alias("bar")).agg((F.count_if(F.col(actual) >= F.col("bar")) / float(k)).alias("precision"))


def split(rows: DataFrame, label: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the prefix of their label."""
    return rows.where(F.col(label).startswith("TRAIN_")), rows.where(F.col(label).startswith("TEST_"))
