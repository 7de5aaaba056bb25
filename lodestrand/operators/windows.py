"""Ranking and normalization with explicit ties and nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_rank(order: Sequence[Column], by: Sequence[str] = ()) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def value_bucket(v: Column) -> Column:
    """An order-preserving range number of a double: 256 ranges between one power of two and the next. Null for null; NaN last."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    size = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(2200 * 256)).otherwise((e + 1100) * 256 + F.floor(a / F.pow(F.lit(2.0), e.cast("double")) * 256) - 256)
    return F.when(v.isNull(), None).when(F.isnan(v), 2300 * 256).when(v < 0, -size).otherwise(size).cast("int")


def _ranged(df: DataFrame, value: str, by: Sequence[str], descending: bool) -> tuple[DataFrame, list[str]]:
    """`df` with the value's range, the number of the group's values in ranges before it, and of all of them. A group's values
    are counted by range first, so that what is sorted together is one range of one group, not the group."""
    x = df.withColumn("__b", value_bucket(F.col(value).cast("double")) * (-1 if descending else 1))
    part = [*by, "__b"]
    counts = x.where(F.col(value).isNotNull()).groupBy(*part).agg(F.count("*").alias("__in"))
    whole = W.partitionBy(*by)
    before = F.sum("__in").over(whole.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__in")
    offsets = counts.select(*[F.col(c).alias(f"__r_{c}") for c in part], before.alias("__before"), F.sum("__in").over(whole).alias("__n"))
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by] + [F.col("__b") == F.col("__r___b")]
    return x.join(offsets, on, "left").drop(*[f"__r_{c}" for c in part]), part


def with_average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = False, n: str | None = None) -> DataFrame:
    """`df` with the average rank of ties among a group's non-null values, and, if asked for, their number `n`; null for null."""
    x, part = _ranged(df, value, by, descending)
    v = F.col(value)
    w = W.partitionBy(*part).orderBy(v.desc() if descending else v.asc())
    ties = F.count("*").over(W.partitionBy(*part, v))
    x = x.withColumn(out, F.when(v.isNotNull(), F.col("__before") + F.rank().over(w) + (ties - 1) / 2.0))
    return (x.withColumn(n, F.col("__n")) if n else x).drop("__b", "__before", "__n")


def with_rank_normalized(df: DataFrame, value: str, out: str, by: Sequence[str] = (), larger_is_better: bool = True, strict_parity: bool = False) -> DataFrame:
    """`df` with average ranks scaled to [0, 1], the best at 1; null stays null and a single value gives 1.

    With `strict_parity` the best value gets 0, as the original code does against its own description."""
    x = with_average_rank(df, value, "__rank", by, descending=larger_is_better == strict_parity, n="__many")
    scaled = F.when(F.col("__many") == 1, F.lit(1.0)).otherwise((F.col("__rank") - 1) / F.greatest(F.col("__many") - 1, F.lit(1)))
    return x.withColumn(out, F.when(F.col(value).isNotNull(), scaled)).drop("__rank", "__many")


def with_place(df: DataFrame, value: str, ties: Sequence[Column], out: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """`df` with the place 1..n among a group's non-null values, ties in the given order, and their number `n`; null for null."""
    x, part = _ranged(df, value, by, False)
    inside = F.row_number().over(W.partitionBy(*part).orderBy(F.col(value).asc(), *ties))
    return x.withColumns({out: F.when(F.col(value).isNotNull(), F.col("__before") + inside), n: F.col("__n")}).drop("__b", "__before", "__n")


def medians(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, out): each group's exact median of the non-null values, by places counted in ranges, so that no task holds the values
    of a group. Groups without a value do not come out."""
    x = with_place(df.select(*by, value), value, [], "__i", "__many", by)
    middle = x.where((F.col("__i") * 2 >= F.col("__many")) & (F.col("__i") * 2 <= F.col("__many") + 2))
    return middle.groupBy(*by).agg(F.avg(value).alias(out))


def joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """A left join on group keys, null keys being equal; one-row tables where there are none."""
    if not by:
        return left.join(right, F.lit(True), "left")
    side = right.select(*[F.col(c).alias(f"__g_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by]
    return left.join(side, on, "left").drop(*[f"__g_{c}" for c in by])


def with_running_sums(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`df`, one row for each value of a group, with `run_` + name: the sum from the highest value down to the row's, and `all_` + name. Sums
    are taken by ranges of the value first, so that what is sorted together is one range of one group."""
    x = df.withColumn("__b", -value_bucket(F.col(value).cast("double")))
    part = [*by, "__b"]
    totals = x.groupBy(*part).agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    whole = W.partitionBy(*by)
    upto = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    totals = totals.select(*part, *[(F.sum(f"__t_{c}").over(upto) - F.col(f"__t_{c}")).alias(f"__before_{c}") for c in sums], *[F.sum(f"__t_{c}").over(whole).alias(f"all_{c}") for c in sums])
    inside = W.partitionBy(*part).orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    x = joined(x, totals, part)
    return x.withColumns({f"run_{c}": F.col(f"__before_{c}") + F.sum(c).over(inside) for c in sums}).drop("__b", *[f"__before_{c}" for c in sums])


def quantile_bin(place: Column, n: Column, bins: int = 5) -> Column:
    """Bin 0..bins-1 of a place 1..n, with edges at linear quantiles of the places (not equal to ntile)."""
    q = F.least(F.lit(bins), n)
    return F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.ceil(q * (place - 1) / (n - 1)) - 1, F.lit(0))).cast("int")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", row_rank(order, by)).where(F.col("rank") <= k)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order; null keys are a key."""
    return df.withColumn("__k", row_rank(order, by)).where("__k = 1").drop("__k")


def first_non_null(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, each column's first non-null value in the given order, from whichever row has it."""
    return df.groupBy(*by).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
