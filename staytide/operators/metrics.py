"""Multiclass evaluation from counts of (truth, prediction)."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows per (truth, prediction), with zero for pairs of occurring classes
    that do not occur. The classes, not the rows, bound what is paired."""
    found = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = found.select(F.explode(F.array("truth", "predicted")).alias("c")).where("c is not null").agg(F.collect_set("c").alias("all"))
    zero = classes.select("all", F.explode("all").alias("truth")).select(
        "truth", F.explode("all").alias("predicted"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(zero).groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def confusion_normalized(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    row = F.sum("n").over(Window.partitionBy("truth"))
    return confusion(df, truth, predicted).withColumn("share", F.coalesce(F.try_divide(F.col("n"), row), F.lit(0.0)))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, predicted count, support and total per class of the truth.

    Works on the confusion counts, so everything after the first aggregate has
    at most classes x classes rows.
    """
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("guessed"), F.lit(0).cast("long").alias("tp"))))
    counts = confusion(df, truth, predicted).select(sides.alias("s")).select("s.*")
    per_label = counts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "tp")])
    total = F.sum("support").over(Window.partitionBy(F.lit(0)))
    return per_label.withColumn("total", total).where(F.col("support") > 0)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with micro, macro,
    weighted and per-sample averages. Ratios without a denominator are 0."""
    scored = _per_class(df, truth, predicted).select(
        F.col("label").cast("string").alias("label"), "tp", "guessed", "support",
        _ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))
    shares = ["precision", "recall", "f1"]
    sums = scored.agg(
        *[F.sum(c).alias(c) for c in ("tp", "guessed", "support")],
        *[F.avg(c).alias(f"macro_{c}") for c in shares],
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in shares])
    micro_p, micro_r = _ratio(F.col("tp"), F.col("guessed")), _ratio(F.col("tp"), F.col("support"))
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), p.alias("precision"),
                                          r.alias("recall"), f.alias("f1"), "support")
    averages = sums.select(F.explode(F.array(
        line("micro avg", micro_p, micro_r, _ratio(2 * micro_p * micro_r, micro_p + micro_r)),
        *[line(f"{kind} avg", *[F.col(f"{kind}_{c}") for c in shares])
          for kind in ("macro", "weighted")],
        # Each row has one class, so per sample all three ratios are 1 for a hit and 0 for a miss.
        line("samples avg", micro_r, micro_r, micro_r))).alias("a")).select("a.*")
    return scored.select("label", *shares, "support").unionByName(averages)


def _macro_area() -> Column:
    fp = F.col("guessed") - F.col("tp")
    negatives = F.col("total") - F.col("support")
    return F.avg((F.col("tp") / F.col("support") + F.try_divide(negatives - fp, negatives)) / 2)


def macro_auc_hard(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean over classes of the area under the curve of a 0/1 prediction,
    which is (true positive rate + true negative rate) / 2."""
    return _per_class(df, truth, predicted).agg(_macro_area().alias("macro_auc"))


def metrics_row(df: DataFrame, truth: str, predicted: str, **names: object) -> DataFrame:
    """Accuracy, macro area and row count of one evaluation as one row, from
    one pass over the predictions; ``names`` become leading columns."""
    row = _per_class(df, truth, predicted).agg(
        (F.sum("tp") / F.max("total")).alias("accuracy"), _macro_area().alias("macro_auc"),
        F.max("total").alias("n"))
    return row.select(*[F.lit(v).alias(k) for k, v in names.items()], "*")


def roc_auc(df: DataFrame, label: str, score: str, buckets: int = 1000) -> DataFrame:
    """Area under the curve of a score for a 0/1 label, ties counted half.

    Rows are reduced to counts per distinct score first. The running number of
    negatives below a score is then taken per bucket of scores plus the total
    of lower buckets. Bucket borders are score quantiles (a list of at most
    ``buckets`` numbers); they only balance the work, any borders give the
    exact area.
    """
    counts = checkpointed(  # read for the borders and for the area
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
             F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")))
    borders = sorted(set(counts.approxQuantile(
        "score", [i / buckets for i in range(1, buckets)], 1 / buckets)))
    splits = [float("-inf"), *borders, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="score", outputCol="_bucket",
                          handleInvalid="keep").transform(counts) if borders else counts.withColumn(
        "_bucket", F.lit(0.0))
    lower = bucketed.groupBy("_bucket").agg(F.sum("neg").alias("_neg"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lower.select("_bucket", F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = (bucketed.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
              .join(F.broadcast(offsets), "_bucket"))
    wins = F.col("pos").cast("double") * (F.col("_below") + F.col("_in") + F.col("neg") / 2)
    return placed.agg(F.try_divide(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg"))
                      .alias("roc_auc"))
