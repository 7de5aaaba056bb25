"""Consensus, applicability, and shortlists with quotas and diversity caps."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def family_summary(scores: DataFrame, keys: Sequence[str], family: str, value: str) -> DataFrame:
    return scores.groupBy(*keys, family).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.when(F.count("*") > 1, F.stddev_pop(value)).otherwise(0.0).alias("std"), F.count(value).alias("n_models"),
    )


def consensus(summary: DataFrame, keys: Sequence[str], family: str, families: Sequence[str]) -> DataFrame:
    """One row per key: each family's mean and spread, and mean, median, spread, range and number over the families."""
    wide = summary.groupBy(*keys).pivot(family, list(families)).agg(F.first("mean").alias("mean"), F.first("std").alias("within"), F.max("max").alias("best"), F.first("n_models").alias("n"))
    v = F.array_compact(F.array(*[F.col(f"{f}_mean") for f in families]))
    n = F.size("__v")
    mean = F.try_divide(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x), n)
    s = F.array_sort("__v")
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    spread = F.sqrt(F.try_divide(F.aggregate(F.transform("__v", lambda x: (x - F.col("cross_mean")) * (x - F.col("cross_mean"))), F.lit(0.0), lambda a, x: a + x), n))
    out = wide.withColumn("__v", v).withColumn("cross_mean", mean)
    return out.withColumns({
        "cross_median": F.when(n > 0, median), "cross_std": F.coalesce(spread, F.lit(0.0)), "disagreement": F.array_max("__v") - F.array_min("__v"), "families_with_support": n,
        **{f"{f}_within": F.coalesce(F.col(f"{f}_within"), F.lit(0.0)) for f in families},
    }).drop("__v")


def applicability(items: DataFrame, reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """Range violations and root mean square distance (in the reference's spreads, from its medians) of each item.

    The reference is one row of statistics, whatever its size, and joins as a broadcast of that one row."""
    from .windows import joined, medians

    stats = reference.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop))])
    for c in features:
        stats = joined(stats, medians(reference, c, f"md_{c}"), [])
    x = items.crossJoin(F.broadcast(stats))
    out_of = sum((F.coalesce((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}")), F.lit(False)).cast("int") for c in features), F.lit(0))
    z = [F.when(F.col(f"sd_{c}") > 0, (F.col(c) - F.col(f"md_{c}")) / F.col(f"sd_{c}")) for c in features]
    zs = F.array_compact(F.array(*z))
    rms = F.sqrt(F.try_divide(F.aggregate(zs, F.lit(0.0), lambda a, v: a + v * v), F.size(zs)))
    return x.withColumns({"range_violations": out_of, "distance": rms}).drop(*[f"{n}_{c}" for c in features for n in ("lo", "hi", "md", "sd")])


def capped(candidates: DataFrame, bucket: str, order: Sequence[str], exact: str, generic: str, exact_cap: int, generic_cap: int) -> DataFrame:
    """Greedy selection inside each bucket: in order, a row is kept unless its exact group already holds `exact_cap` kept
    rows or its generic group `generic_cap`. Which row counts depends on what was kept before, so this is sequential in a
    bucket. A group that is full stays full, so of the rows with one exact and one generic group the kept ones come first: only as many
    of them as the lesser cap can count, and a group limit leaves the others out before the shuffle. A task holds the
    keys and order of what is left of one bucket: a few rows for each different scaffold, however crowded one is."""
    fields = [bucket, *order, exact, generic]
    schema = candidates.select(*fields).schema
    first = F.row_number().over(W.partitionBy(bucket, exact, generic).orderBy(*order))
    candidates = candidates.select(*fields).withColumn("__first", first).where(F.col("__first") <= min(exact_cap, generic_cap)).drop("__first")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="mergesort", ignore_index=True)
        seen_e: dict = {}
        seen_g: dict = {}
        kept = []
        for i, (e, g) in enumerate(zip(pdf[exact], pdf[generic], strict=True)):
            if seen_e.get(e, 0) < exact_cap and seen_g.get(g, 0) < generic_cap:
                seen_e[e] = seen_e.get(e, 0) + 1
                seen_g[g] = seen_g.get(g, 0) + 1
                kept.append(i)
        return pdf.iloc[kept]

    return candidates.select(*fields).groupBy(bucket).applyInPandas(keep, schema)


def one_bucket(entries: DataFrame, entity: str, bucket: str, priority: str) -> DataFrame:
    """Each entity in its bucket of the least priority number, with all its buckets and whether it had several."""
    g = entries.groupBy(entity).agg(F.min_by(bucket, priority).alias(bucket), F.min(priority).alias(priority), F.array_join(F.array_sort(F.collect_set(bucket)), ";").alias("all_buckets"), F.count_distinct(bucket).alias("n_buckets"))
    return g.withColumn("was_in_several", F.col("n_buckets") > 1)


def subtotals(rows: DataFrame, bucket: str, counts: Sequence[str]) -> DataFrame:
    """Rows and distinct values per bucket and over all."""
    r = rows.rollup(bucket).agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in counts])
    return r.withColumn(bucket, F.coalesce(F.col(bucket), F.lit("all")))


def weighted(parts: dict[str, float]) -> Column:
    """Weighted sum, null parts counting as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))


def best_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")
