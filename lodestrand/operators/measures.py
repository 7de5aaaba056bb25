"""Aggregation of repeated measurements, panel selection and overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known(c: str | Column) -> Column:
    """The number, or null where it is null or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def round_half_away(c: Column, digits: int) -> Column:
    """Rounded to `digits`, from the scaled binary value; a decimal rounding would decide halves by the shortest decimal text."""
    scale = F.lit(float(10**digits))
    return F.when(F.isnan(c), c).otherwise(F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale)


def aggregate_duplicates(df: DataFrame, keys: Sequence[str], ki: str, pki: str, distinct: dict[str, str] | None = None, hot_rows: int = 5_000_000) -> DataFrame:
    """Per key: records, exact medians, spread (null for one record), distinct counts, and whether it was repeated. Null keys are keys.

    One exchange by key serves all of it (see `_by_key`). Keys with more than `hot_rows` rows, which would make one task of
    each, are told apart by a count with partial aggregation and take the way of `_by_ranges`; where there are none, adaptive
    execution drops that branch. The result does not depend on the way."""
    columns = dict.fromkeys([*keys, ki, pki, *(distinct or {}).values()])
    rows = df.select(*columns)
    many = df.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") > hot_rows).select(*[F.col(k).alias(f"__h_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]
    usual, hot = rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")
    return _by_key(usual, keys, ki, pki, distinct or {}).unionByName(_by_ranges(hot, keys, ki, pki, distinct or {}))


def _by_key(rows: DataFrame, keys: Sequence[str], ki: str, pki: str, distinct: dict[str, str]) -> DataFrame:
    """Windows behind one exchange mark the middle values and each first different value, and the aggregation behind them needs no
    exchange. Sorts spill, so a key's rows need not fit into memory, as an exact percentile's would."""
    w = W.partitionBy(*keys)
    for v in dict.fromkeys((ki, pki)):
        n, i = F.count(v).over(w), F.row_number().over(w.orderBy(F.col(v).asc_nulls_last()))
        rows = rows.withColumns({f"__n_{v}": n, f"__i_{v}": i})
    for v in dict.fromkeys(distinct.values()):
        before = F.lag(v).over(w.orderBy(F.col(v).asc_nulls_first()))
        rows = rows.withColumn(f"__new_{v}", F.when(F.col(v).isNotNull() & ~F.col(v).eqNullSafe(before), 1))
    middle = lambda v: F.avg(F.when((F.col(f"__i_{v}") * 2 >= F.col(f"__n_{v}")) & (F.col(f"__i_{v}") * 2 <= F.col(f"__n_{v}") + 2) & F.col(v).isNotNull(), F.col(v)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_records"), middle(ki).alias("median_ki"), middle(pki).alias("median_pki"), F.stddev_samp(pki).alias("std_pki"),
        *[F.count(f"__new_{c}").alias(a) for a, c in distinct.items()],
    ).withColumn("is_duplicate", F.col("n_records") > 1)


def _by_ranges(rows: DataFrame, keys: Sequence[str], ki: str, pki: str, distinct: dict[str, str]) -> DataFrame:
    """The same by partial aggregation: medians by ranges of the values, different values counted before they are shuffled by key."""
    from .windows import joined, medians

    out = rows.groupBy(*keys).agg(F.count("*").alias("n_records"), F.stddev_samp(pki).alias("std_pki"))
    for v, name in ((ki, "median_ki"), (pki, "median_pki")):
        out = joined(out, medians(rows, v, name, keys), keys)
    for name, c in distinct.items():
        out = joined(out, rows.where(F.col(c).isNotNull()).select(*keys, c).distinct().groupBy(*keys).agg(F.count("*").alias(name)), keys).withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(*keys, "n_records", "median_ki", "median_pki", "std_pki", *distinct, (F.col("n_records") > 1).alias("is_duplicate"))


def target_summary(fact: DataFrame, target: str, compound: str, value: str, support: str) -> DataFrame:
    from .windows import joined, medians

    out = fact.groupBy(target).agg(
        F.count("*").alias("n_records"), F.count_distinct(compound).alias("n_compounds"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.sum(support).alias("support"),
    )
    return joined(out, medians(fact, value, "median", [target]), [target]).select(target, "n_records", "n_compounds", "median", "std", "support")


def panel(summary: DataFrame, min_records: int, min_compounds: int) -> DataFrame:
    """The summary with the failed thresholds as sorted reasons, and whether the target is kept."""
    failed = F.array_compact(F.array(
        F.when(F.col("n_compounds") < min_compounds, F.lit("too_few_compounds")), F.when(F.col("n_records") < min_records, F.lit("too_few_records")),
    ))
    return summary.withColumn("reasons", F.array_join(failed, ";")).withColumn("kept", F.size(failed) == 0)


def with_min_targets(fact: DataFrame, compound: str, target: str, least: int) -> DataFrame:
    """Rows of the compounds that have at least `least` targets."""
    wide = fact.groupBy(compound).agg(F.count_distinct(target).alias("__n")).where(F.col("__n") >= least).select(compound)
    return fact.join(wide, compound, "left_semi")


def density(fact: DataFrame, row: str, column: str) -> DataFrame:
    """Observed cells over all cells of the sparse matrix."""
    a = fact.agg(F.count_distinct(row).alias("n_rows"), F.count_distinct(column).alias("n_columns"), F.count_distinct(row, column).alias("observed"))
    return a.withColumn("density", F.try_divide("observed", F.col("n_rows") * F.col("n_columns")))


def matrix(fact: DataFrame, row: str, column: str, value: str, columns: Sequence, prefix: str = "t") -> DataFrame:
    """Long to wide with given columns, so that no pass over the data is needed to find them."""
    wide = fact.groupBy(row).pivot(column, list(columns)).agg(F.first(value, ignorenulls=True))
    return wide.select(row, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])


def overlap(fact: DataFrame, item: str, group: str) -> DataFrame:
    """For every pair of groups: shared items, Jaccard and overlap coefficient; 0 where nothing divides.

    The self-join is on the item; pairs are counted with partial aggregation, so only group pairs are shuffled twice."""
    cells = fact.select(item, group).distinct()
    a, b = cells.withColumnRenamed(group, "a"), cells.withColumnRenamed(group, "b")
    pairs = a.join(b, item).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = cells.groupBy(group).agg(F.count("*").alias("n"))
    both = pairs.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return both.select(
        "a", "b", "shared", F.coalesce(F.try_divide("shared", F.col("na") + F.col("nb") - F.col("shared")), F.lit(0.0)).alias("jaccard"),
        F.coalesce(F.try_divide("shared", F.least("na", "nb")), F.lit(0.0)).alias("coefficient"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, min, max, mean, median, population spread."""
    from .windows import joined, medians

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), known(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    whole = df.agg(*[F.struct(F.count(known(c)).alias("n"), F.min(known(c)).alias("min"), F.max(known(c)).alias("max"), F.avg(known(c)).alias("mean"), F.stddev_pop(known(c)).alias("std")).alias(f"s{i}") for i, c in enumerate(columns)])
    out = whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)])).alias("x")).select("x.column_name", "x.s.*")
    return joined(out, medians(long, "v", "median", ["column_name"]), ["column_name"]).select("column_name", "n", "min", "max", "mean", "median", "std")


def value_counts(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def summarize(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """n, mean, std, standard error, min, max and median of each metric; the standard error is null below two values."""
    parts = []
    for m in metrics:
        std, n = F.stddev_samp(m), F.count(m)
        parts += [n.alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"), std.alias(f"{m}_std"), F.when(n > 1, std / F.sqrt(n)).alias(f"{m}_sem"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.median(m).alias(f"{m}_median")]
    return df.groupBy(*groups).agg(F.count("*").alias("n_rows"), *parts)


def first_present(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, each column's first non-blank value in the given order."""
    place = F.struct(*order)
    pick = [F.min_by(F.col(c), F.when(F.trim(F.col(c)) != "", place)).alias(c) for c in columns]
    return df.groupBy(key).agg(*pick)
