"""Policies and checks that stop a run, and small quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measures import known


def endpoint_policy(df: DataFrame, column: str, policy: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Rows by the policy for mixed endpoints: `proceed` keeps all, `error` raises where there are several, `filter` keeps
    the allowed ones and raises where nothing is left."""
    if policy == "proceed":
        return df
    if policy == "error":
        kinds = [r[0] for r in df.select(F.coalesce(column, F.lit("<missing>"))).distinct().limit(20).collect()]
        if len(kinds) > 1:
            raise ValueError(f"several endpoints: {', '.join(sorted(kinds))}")
        return df
    if policy != "filter":
        raise ValueError(f"unknown policy {policy}")
    kept = df.where(F.col(column).isin(*allowed))
    if kept.isEmpty():
        raise ValueError("no row has an allowed endpoint")
    return kept


def reference_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, and of each column the known values, different values, least, largest and mean."""
    stats = [F.struct(F.lit(c).alias("column_name"), F.count(known(c)).alias("n"), F.count_distinct(known(c)).alias("n_different"), F.min(known(c)).alias("least"), F.max(known(c)).alias("most"), F.avg(known(c)).alias("mean")) for c in columns]
    return df.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).select(F.explode(F.array(*[f"s{i}" for i in range(len(stats))])).alias("s")).select("s.*")


def column_check(df: DataFrame, expected: Sequence[str], critical: Sequence[str]) -> list[tuple[str, str]]:
    """(column, severity) of the expected columns that are absent; raises where a critical one is."""
    gone = [c for c in expected if c not in df.columns]
    if bad := [c for c in gone if c in critical]:
        raise ValueError(f"critical columns are missing: {', '.join(bad)}")
    return [(c, "warning") for c in gone]


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one different value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def binary_codes(df: DataFrame, column: str) -> DataFrame:
    """The two different texts of a column as 0 and 1, in sorted order; raises unless there are two at most."""
    kinds = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(3).collect())
    if len(kinds) > 2:
        raise ValueError(f"{column} has more than two values")
    code = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)]) if kinds else None
    return df.withColumn(f"{column}_code", code[F.col(column)] if code is not None else F.lit(None).cast("int"))
