"""Statistics of scores and binary classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bce, decide, ratio


def score_stats(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """count, min, max, mean of the scores; NaN for a table without rows (when ``by`` is empty)."""
    nan = F.lit(float("nan"))
    cols = [F.coalesce(f(score), nan).alias(f"{name}_score") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.groupBy(*by).agg(F.count(score).alias("n"), *cols) if by else df.agg(F.count(score).alias("n"), *cols)


def histogram(df: DataFrame, bins: int = 50, by: list[str] = (), score: str = "score", total: float | None = None, normalise: bool = False) -> DataFrame:
    """Bins of equal width on [0, 1], the last one closed; other scores are left out; empty bins are listed.
    normalise: shares of ``total`` (default: all rows, those left out included)."""
    by = list(by)
    own = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*by, F.when(F.col(score).between(0.0, 1.0), own).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = counts.withColumn("__all", F.sum("n").over(per))
    axis = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    frame = counts.groupBy(*by).agg(F.max("__all").alias("__all"), F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"))
    out = frame.withColumn("bin", axis).withColumn("n", F.coalesce(F.try_element_at("m", "bin"), F.lit(0).cast("long")))
    out = out.withColumn("low", F.col("bin") / F.lit(float(bins)))
    if normalise:
        out = out.withColumn("share", ratio(F.col("n"), F.lit(total) if total else F.col("__all")))
    return out.drop("m", "__all")


def label_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def _counts(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    y, p = F.col("label") == 1, decide(F.col("score"), threshold) == 1
    return df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def confusion(df: DataFrame, by: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """The four cells (label, predicted, n); always all four for every group."""
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"), F.col(c).alias("n")) for a, b, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return _counts(df, list(by), threshold).select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def binary_metrics(df: DataFrame, by: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1; an empty denominator gives 0."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return _counts(df, list(by), threshold).select(
        *by, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def class_report(df: DataFrame, by: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1, support of both classes and their macro and weighted averages."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    row = lambda name, t, p, n: F.struct(F.lit(name).alias("class"), ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"), (t + n).alias("support"))
    both = _counts(df, list(by), threshold).select(*by, row("0", tn, fn, fp).alias("a"), row("1", tp, fp, fn).alias("b"))
    names = ("precision", "recall", "f1")
    support = F.col("a.support") + F.col("b.support")
    macro = F.struct(F.lit("macro avg").alias("class"), *[((F.col(f"a.{m}") + F.col(f"b.{m}")) / 2).alias(m) for m in names], support.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("class"), *[ratio(F.col(f"a.{m}") * F.col("a.support") + F.col(f"b.{m}") * F.col("b.support"), support).alias(m) for m in names], support.alias("support"))
    return both.select(*by, F.explode(F.array("a", "b", macro, weighted)).alias("r")).select(*by, "r.*")


def _score_range(score) -> Column:
    """A number that never falls as the score rises: 256 ranges for each power of two, null first, NaN last. A range of
    32-bit scores holds 32,768 distinct ones at most."""
    x = score.cast("double")
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(1e308))) * 256) + 400_000
    sign = F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0))
    return F.when(x.isNull(), F.lit(-1 << 40)).when(F.isnan(x), F.lit(1 << 40)).otherwise(sign)


def _running(df: DataFrame, by: list[str], down: bool = False) -> DataFrame:
    """Labels counted per distinct score (p, q), the counts up to and with each score in the order of scores (tp, fp),
    and those of the group (np, nq). Distinct scores may be as many as rows: running counts are taken within ranges
    of scores, and only the ranges' sums meet in one task of a group."""
    counts = df.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    ranged = counts.withColumn("__r", _score_range(F.col("score")) * (-1 if down else 1))
    sums = ranged.groupBy(*by, "__r").agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    group, zero = Window.partitionBy(*(by or [F.lit(1)])), F.lit(0).cast("long")
    before = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__bp": F.coalesce(F.sum("__p").over(before), zero), "__bq": F.coalesce(F.sum("__q").over(before), zero), "np": F.sum("__p").over(group), "nq": F.sum("__q").over(group)})
    own = Window.partitionBy(*by, "__r").orderBy(F.desc("score") if down else F.asc("score")).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({"tp": F.sum("p").over(own), "fp": F.sum("q").over(own)})
    match = F.col("a.__r") == F.col("b.__r")
    for c in by:
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = inside.alias("a").join(sums.drop("__p", "__q").alias("b"), match)
    return out.select(*[F.col(f"a.{c}").alias(c) for c in by], "score", "p", "q", (F.col("tp") + F.col("__bp")).alias("tp"), (F.col("fp") + F.col("__bq")).alias("fp"), "np", "nq")


def auc(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count half; null where a class is absent. Negatives below each score
    come from a running sum over distinct scores."""
    by = list(by)
    won = F.sum(F.col("p") * (F.col("fp") - F.col("q") / F.lit(2.0)))
    return _running(df, by).groupBy(*by).agg(F.try_divide(won, F.max("np").cast("double") * F.max("nq").cast("double")).alias("auc"))


def roc_points(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score, and the origin at threshold infinity."""
    by = list(by)
    zero = F.lit(0).cast("long")
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("q"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"))
    point = F.struct("threshold", "tp", "fp")
    marked = _running(df, by, down=True).withColumn("threshold", F.col("score").cast("double"))
    counts = marked.withColumn("points", F.when(first, F.array(origin, point)).otherwise(F.array(point))).select(*by, F.explode("points").alias("x"), "np", "nq").select(*by, "x.*", "np", "nq")
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return counts.select(*by, "threshold", "tp", "fp", rate("tp", "np").alias("tpr"), rate("fp", "nq").alias("fpr"))


class EpochMetrics:
    """Metrics of epochs that arrive in parts: ``update`` appends the part's counts to a table at path, ``compute`` adds
    them up, ``reset`` forgets all. What is kept of a part is one row per distinct score, batch sums beside."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def update(self, part: DataFrame, epoch: int, split: str) -> None:
        """part: scored rows (label, score) of one or more batches, and ``batch`` if the loss is to be per batch."""
        batch = F.col("batch").cast("string") if "batch" in part.columns else F.lit("0")
        kept = part.groupBy(batch.alias("batch"), "label", "score").agg(F.count(F.lit(1)).alias("n"))
        kept.select(F.lit(epoch).alias("epoch"), F.lit(split).alias("split"), "batch", "label", "score", "n").write.mode("append").parquet(self.path)

    def _state(self) -> DataFrame:
        """The counts of epochs since their last reset."""
        rows = self.spark.read.schema("epoch int, split string, batch string, label int, score double, n long").parquet(self.path)
        return rows.where("n > 0")

    def compute(self) -> DataFrame:
        """(epoch, split, loss: mean of the batches' means, auroc, acc, recall)."""
        by = ["epoch", "split"]
        rows = self._state().withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("row", "n")
        loss = bce_loss(rows, "batch", by).select(*by, "loss")
        metrics = binary_metrics(rows, by).select(*by, F.col("accuracy").alias("acc"), "recall")
        return loss.join(auc(rows, by).withColumnRenamed("auc", "auroc"), by).join(metrics, by).select(*by, "loss", "auroc", "acc", "recall")

    def reset(self) -> None:
        """Forgets all parts."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def throughput(n: int, seconds: float) -> float:
    """Rows a second, of a time of a millionth at least."""
    return n / max(seconds, 1e-6)


def bce_loss(df: DataFrame, batch: str, by: list[str] = ()) -> DataFrame:
    """loss: the mean of the batches' means (a short last batch weighs as much as any); row_loss: the mean of rows."""
    by = list(by)
    per = df.groupBy(*by, batch).agg(F.avg(bce(F.col("score"), F.col("label"))).alias("m"), F.count(F.lit(1)).alias("c"))
    return per.groupBy(*by).agg(F.avg("m").alias("loss"), (F.sum(F.col("m") * F.col("c")) / F.sum("c")).alias("row_loss"), F.count(F.lit(1)).alias("batches"))


def best_epochs(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Of an epoch table (epoch, auroc, loss): the epoch of the best auroc, of the least loss, and the last;
    of equals the earliest."""
    return df.agg(
        F.max_by(epoch, F.struct("auroc", -F.col(epoch))).alias("best_auroc_epoch"), F.max("auroc").alias("best_auroc"),
        F.min_by(epoch, F.struct("loss", epoch)).alias("best_loss_epoch"), F.min("loss").alias("best_loss"), F.max(epoch).alias("last_epoch"),
    )
