"""Composition of result tables: deduplicated joins, membership flags, preferred sources, value lists, metric views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per non-null key, with the columns of the row that comes first by `order`, nulls last. By aggregation, so a key
    with most of the rows is reduced before the shuffle."""
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}__null"), F.col(c))])
    whole = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return whole.groupBy(*keys).agg(F.min_by(F.struct(*columns), place).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in columns])


def join_first(base: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str], Sequence[str], Sequence[str]]], prefix: Sequence[str] | None = None) -> DataFrame:
    """`base` left-joined with the first row of each side (table, keys, order, columns); no join multiplies rows. With `prefix`
    the columns of side i are named prefix[i] + name, so that sides cannot collide."""
    for i, (df, keys, order, columns) in enumerate(sides):
        p = prefix[i] if prefix else ""
        side = first_rows(df, keys, order, columns).select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(p + c) for c in columns])
        base = base.join(side, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left").drop(*[f"__k_{k}" for k in keys])
    return base


def with_membership(df: DataFrame, column: str, reference: DataFrame, of: str, out: str) -> DataFrame:
    """`df` with whether its value of `column` is among the values of `of` in the reference; false for null."""
    known = reference.select(F.col(of).alias("__m")).where("__m IS NOT NULL").distinct().withColumn("__in", F.lit(True))
    return df.join(known, F.col(column) == F.col("__m"), "left").withColumn(out, F.coalesce("__in", F.lit(False))).drop("__m", "__in")


def preferred(choices: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(value, source name) of the first of the columns that is known, in order of preference; both null where none is."""
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c, _ in choices]
    value = F.coalesce(*[F.when(k, F.col(c)) for k, (c, _) in zip(known, choices, strict=True)])
    return value, F.coalesce(*[F.when(k, F.lit(name)) for k, (_, name) in zip(known, choices, strict=True)])


def value_list(rows: DataFrame, by: Sequence[str], column: str, out: str, k: int = 5) -> DataFrame:
    """Per group the k most frequent values as `value:count; ...`, ties by value. Values are counted before they are gathered,
    and a group limit leaves k of them."""
    from .windows import top_per_group

    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    best = top_per_group(counts, by, [F.col("n").desc(), F.col(column)], k)
    text = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", F.col(column), F.col("n").cast("string")).alias("t")))), lambda x: x["t"])
    return best.groupBy(*by).agg(F.array_join(text, "; ").alias(out))


def metric_view(summary: DataFrame, metric: str, keys: Sequence[str], lower_is_better: bool) -> DataFrame:
    """The rows whose metric is known, as `plot_metric`, with their place for display, the best first, ties by `keys`."""
    from pyspark.sql import Window as W

    x = summary.withColumn("plot_metric", F.col(metric)).where("plot_metric IS NOT NULL AND NOT isnan(plot_metric)")
    order = F.col("plot_metric").asc() if lower_is_better else F.col("plot_metric").desc()
    return x.withColumn("place", F.row_number().over(W.orderBy(order, *keys)))


def endpoints(pairs: DataFrame, sides: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """The distinct ends of pairs: each side's columns under common names."""
    return reduce(DataFrame.unionByName, [pairs.select(*[F.col(c).alias(n) for c, n in zip(side, names, strict=True)]) for side in sides]).distinct()


def union_of_annotations(frames: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct rows of several annotation tables in one set of columns, null where a table lacks one, with the table's name."""
    parts = [df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns], F.lit(name).alias("annotation_source")).distinct() for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
