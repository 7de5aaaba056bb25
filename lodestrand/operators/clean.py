"""Reason cascades, duplicates with provenance, alias resolution and key normalization."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null where none does."""
    c = F
    out = None
    for name, holds in rules:
        out = c.when(holds, name) if out is None else out.when(holds, name)
    return out


def all_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, sorted and joined by `;`."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in rules])))), ";")


def collapse_within(df: DataFrame, keys: Sequence[str], order: str, item: str) -> DataFrame:
    """The first row per key, with the group's size, its other ids and all ids joined in order."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("i")))).alias("__all"))
    ids = F.transform("__all", lambda x: x["i"])
    return g.select(*keys, "n_rows", F.col("__all")[0]["i"].alias("kept"), F.array_join(ids, "|").alias("all_ids"), F.array_join(F.slice(ids, 2, F.size(ids)), "|").alias("collapsed"))


def cross_source(df: DataFrame, key: str, source: str, item: str) -> DataFrame:
    """Rows with their key's number of rows and sources, a flag for several sources, and whether it is the first of them."""
    g = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(source).alias("n_sources"), F.min(item).alias("first_item"))
    return df.join(g, key).select(key, source, item, "n_rows", "n_sources", (F.col("n_sources") > 1).alias("across"), (F.col(item) == F.col("first_item")).alias("is_first"))


def resolve_aliases(columns: Iterable[str], aliases: dict[str, Sequence[str]], required: Iterable[str] = ()) -> dict[str, str]:
    """Canonical name -> the first of its aliases that is present, without case; missing required ones raise."""
    there = {c.lower(): c for c in columns}
    found = {k: next(there[a.lower()] for a in (k, *names) if a.lower() in there) for k, names in aliases.items() if any(a.lower() in there for a in (k, *names))}
    if gone := [r for r in required if r not in found]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return found


def canonical(df: DataFrame, aliases: dict[str, Sequence[str]], required: Iterable[str] = (), types: dict[str, str] | None = None) -> DataFrame:
    """Columns under their canonical names, absent ones null, text trimmed, numbers tried."""
    found, out = resolve_aliases(df.columns, aliases, required), []
    for name in aliases:
        kind = (types or {}).get(name, "string")
        c = F.col(f"`{found[name]}`") if name in found else F.lit(None)
        out.append((F.trim(c.cast("string")) if kind == "string" else F.nullif(c.cast("string").try_cast(kind), F.lit("NaN").try_cast(kind)) if kind == "double" else c.cast("string").try_cast(kind)).alias(name))
    return df.select(*out)


def unique_names(names: Iterable[str]) -> list[str]:
    """Trimmed names; blank ones are `unnamed_column`, repeated ones get `__dup_N`."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = (n or "").strip() or "unnamed_column"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__dup_{seen[n] - 1}")
    return out


def merge_key(c: Column) -> Column:
    """Keys as text: `12.0` and `12` are equal; blanks trimmed; null stays."""
    t = F.trim(c.cast("string"))
    return F.when(t.try_cast("double").isNotNull(), F.regexp_replace(t, "\\.0+$", "")).otherwise(t)


def coalesce_suffixes(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`name_x`, `name`, `name_y` become `name`, the first non-null in that order."""
    for n in names:
        parts = [c for c in (f"{n}_x", n, f"{n}_y") if c in df.columns]
        if parts:
            df = df.withColumn("__v", F.coalesce(*[F.col(c) for c in parts])).drop(*parts).withColumnRenamed("__v", n)
    return df


def fallback_join(rows: DataFrame, notes: DataFrame, keys: Sequence[Sequence[str]], value: str) -> DataFrame:
    """`rows` with `value` from `notes` by the first of several keys that finds one, and which key that was.

    Each key's notes are made unique first, so no join multiplies rows."""
    parts = []
    for i, k in enumerate(keys):
        side = notes.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(f"__{i}_{c}") for c in k]).agg(F.min(value).alias(f"__v{i}"))
        on = [F.col(c) == F.col(f"__{i}_{c}") for c in k]
        rows = rows.join(side, on, "left").drop(*[f"__{i}_{c}" for c in k])
        parts.append(i)
    found = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), F.lit("+".join(keys[i]))) for i in parts])
    return rows.withColumns({value: F.coalesce(*[F.col(f"__v{i}") for i in parts]), "found_by": found}).drop(*[f"__v{i}" for i in parts])


def first_present_column(df: DataFrame, candidates: Sequence[str], default=None) -> Column:
    """The first of the columns that the table has, whole, its nulls included; the default where it has none."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(default))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Columns filled with a default where they are null or absent."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def ordered_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The listed columns that the table has, in this order and once each, then the others by name."""
    head = [c for c in dict.fromkeys(first) if c in df.columns]
    return df.select(*head, *sorted(c for c in df.columns if c not in head))


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a missing key part, and keys held by more than one row."""
    blank = None
    for k in keys:
        c = F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
        blank = c if blank is None else blank | c
    g = df.withColumn("__blank", blank).groupBy("__blank", *keys).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("__blank"), F.col("n"))), F.lit(0)).alias("n_missing"), F.count_if((~F.col("__blank")) & (F.col("n") > 1)).alias("n_repeated_keys"))


def scope_of_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
