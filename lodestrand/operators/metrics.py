"""Regression and classification metrics per group, and model comparison statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import joined, medians, with_average_rank, with_running_sums


def regression_metrics(df: DataFrame, by: Sequence[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """rmse, mae, median absolute error, r2, Pearson and Spearman; null where undefined. Rows with a null or NaN side do
    not take part. Spearman is Pearson of average ranks."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(y) & ~F.isnan(p))
    rows = with_average_rank(with_average_rank(rows.select(*by, y, p), y, "__ry", by), p, "__rp", by)
    e = F.col(y) - F.col(p)

    def corr(a: str, b: str):
        var = F.sqrt((F.avg(F.col(a) * F.col(a)) - F.avg(a) * F.avg(a)) * (F.avg(F.col(b) * F.col(b)) - F.avg(b) * F.avg(b)))
        return F.when((F.count("*") > 1) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b), var))

    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.min(y) < F.max(y), 1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"),
        corr(y, p).alias("pearson"), corr("__ry", "__rp").alias("spearman"),
    )
    middle = medians(rows.withColumn("__ae", F.abs(e)), "__ae", "median_ae", by)
    return joined(out, middle, by).select(*by, "n", "rmse", "mae", "median_ae", "r2", "pearson", "spearman")


def classification_metrics(df: DataFrame, by: Sequence[str], y: str, score: str, threshold: float = 0.5, undefined: float | None = 0.0) -> DataFrame:
    """Confusion counts and rates at a threshold; f1 and mcc are `undefined` (0, or null) where nothing divides."""
    hit = F.col(score) >= threshold
    pos = F.col(y) == 1
    c = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn")
    )
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    recall, spec, precision = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fp)
    other = F.lit(undefined).cast("double")
    return c.select(
        *by, "tp", "tn", "fp", "fn", F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.coalesce((recall + spec) / 2, recall, spec).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), other).alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), other).alias("mcc"),
    )


def curve(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """ROC and precision-recall points, one per different score, from the highest down.

    Scores are counted first, and summed up by ranges of the score, so no task sorts a group's scores."""
    pts = _points(df, by, y, score)
    tp, fp = F.col("run_p"), F.col("run_n")
    return pts.select(*by, F.col(score).alias("threshold"), "p", "n", F.try_divide(tp, "all_p").alias("tpr"), F.try_divide(fp, "all_n").alias("fpr"), F.try_divide(tp, tp + fp).alias("precision"))


def _points(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    counts = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    return with_running_sums(counts, score, ["p", "n"], by)


def ranking_quality(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """ROC-AUC with ties counted half, average precision, and the trapezoid area of the precision-recall points from
    precision 1 on; null where one class is absent."""
    # The point before a row is the sums without the row.
    tp, fp, tp0, fp0 = F.col("run_p"), F.col("run_n"), F.col("run_p") - F.col("p"), F.col("run_n") - F.col("n")
    pts = _points(df, by, y, score).select(
        *by, "p", "n", F.try_divide(tp, "all_p").alias("tpr"), F.try_divide(fp, "all_n").alias("fpr"), F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp0, "all_p").alias("tpr0"), F.try_divide(fp0, "all_n").alias("fpr0"), F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0)).alias("pr0"),
    )
    both = (F.sum("p") > 0) & (F.sum("n") > 0)
    return pts.groupBy(*by).agg(
        F.when(both, F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2)).alias("roc_auc"),
        F.when(both, F.sum((F.col("tpr") - F.col("tpr0")) * F.col("precision"))).alias("average_precision"),
        F.when(both, F.sum((F.col("tpr") - F.col("tpr0")) * (F.col("precision") + F.col("pr0")) / 2)).alias("pr_auc"),
    )


def stepwise_areas(df: DataFrame, by: Sequence[str], y: str, score: str, order: Sequence[str]) -> DataFrame:
    """Areas under the ROC and precision-recall points of single rows, from the highest score down, ties in `order` and not
    grouped; the precision-recall points start at precision 1. For comparison with results that were made so; null where
    a class is absent. The window runs over a group's rows."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    w = W.partitionBy(*by).orderBy(F.desc(score), *order).rowsBetween(W.unboundedPreceding, 0)
    tp, n = F.sum(y).over(w), F.count("*").over(w)
    x = rows.select(*by, F.col(y).alias("__y"), tp.alias("__tp"), n.alias("__n"))
    before = F.when(F.col("__n") == 1, 1.0).otherwise((F.col("__tp") - F.col("__y")) / (F.col("__n") - 1))
    pos, neg = F.sum("__y"), F.count("*") - F.sum("__y")
    # A negative moves right by 1 / negatives at the height of the positives so far; a positive moves by 1 / positives.
    return x.groupBy(*by).agg(
        F.when((pos > 0) & (neg > 0), F.sum(F.when(F.col("__y") == 0, F.col("__tp")).otherwise(0)) / (pos * neg).cast("double")).alias("roc_auc"),
        F.when(pos > 0, F.sum(F.when(F.col("__y") == 1, (F.col("__tp") / F.col("__n") + before) / 2).otherwise(0.0)) / pos).alias("pr_auc"),
    )


def paired_t(folds: DataFrame, keys: Sequence[str], model: str, metric: str) -> DataFrame:
    """All model pairs over the folds they share: differences, t and degrees of freedom; null t where they never differ."""
    a = folds.select(*keys, F.col(model).alias("model_a"), F.col(metric).alias("x"))
    b = folds.select(*keys, F.col(model).alias("model_b"), F.col(metric).alias("z"))
    d = a.join(b, list(keys)).where("model_a < model_b AND x IS NOT NULL AND z IS NOT NULL").withColumn("d", F.col("x") - F.col("z"))
    s = d.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd")).where("n >= 2")
    return s.withColumn("t", F.try_divide("mean_difference", F.col("sd") / F.sqrt("n"))).withColumn("df", F.col("n") - 1)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the regularized incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1.0 - x, 1e-300)))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1.0) / (a + b + 2.0) else 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if a == a and a is not None and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")
