"""Problem 5: related records, and splits that keep them together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, present
from ..session import Workspace
from .components import with_component


def compound_groups(compounds: DataFrame, workspace: Workspace) -> DataFrame:
    """(id, component) of every compound: linked by scaffold, by structure and, where a compound was delivered more
    than once, by its id. Rows with a null id do not take part; missing scaffolds and structures link nothing."""
    rows = compounds.select(
        F.col("screening_compound_id").alias("id"),
        present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("a"),
        present(F.col("standardized_smiles")).alias("b"),
    ).where("id IS NOT NULL").distinct()
    keys = {"scaffold": F.col("a"), "structure": F.col("b"), "id": F.col("id")}
    return workspace.cut(with_component(rows, keys, workspace).select("id", "component").distinct(), "members")


def related_pairs(compounds: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """(anchor_id, member_id): the least id of each related set of two or more, with each other id of the set. Repeated
    rows count once; an empty table gives no rows. A set with a third of all compounds is joined by its one anchor, and
    adaptive execution splits its rows."""
    ws = workspace or Workspace(compounds.sparkSession, "related")
    members = compound_groups(compounds, ws)
    anchors = members.groupBy("component").agg(F.min("id").alias("anchor_id"), F.max("id").alias("last")).where("anchor_id <> last")
    return (
        members.join(anchors.drop("last"), "component")
        .where("id <> anchor_id")
        .select("anchor_id", F.col("id").alias("member_id"))
    )


def assign_splits(
    spark: SparkSession, groups: DataFrame, shares: dict[str, float], large: float = 0.001, buckets: int = 4096, seed: int = 5
) -> DataFrame:
    """(component, split_label) for `groups` (component, n): whole components, shares by their summed n.

    Components with at least `large` of all records - fewer than 1 / `large` of them - are placed on the driver, largest
    first, each where most is still missing. The rest are ordered by a hash of their name into `buckets` ranges; the
    ranges' sums are taken to the driver, and the cut points between the splits fall inside a range, at a component.
    The range a cut falls in is ordered by one window over its few components; the others need no order at all.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    names = list(shares)
    want = {k: total * v / sum(shares.values()) for k, v in shares.items()}
    big = groups.where(F.col("n") >= max(1.0, large * total)).orderBy(F.desc("n"), "component").collect() if total else []
    have = dict.fromkeys(names, 0)
    placed = []
    for r in big:
        to = max(names, key=lambda k: (want[k] - have[k], -names.index(k)))
        have[to] += r["n"]
        placed.append((r["component"], to))
    small = groups.where(F.col("n") < max(1.0, large * total)).withColumn("h", F.xxhash64(F.lit(seed), "component"))
    small = small.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sums = dict(small.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    rest = {k: max(0.0, want[k] - have[k]) for k in names}
    left, need = sum(sums.values()), sum(rest.values())
    ends, at = [], 0.0
    for k in names:
        at += rest[k] * (left / need if need else 0)
        ends.append(at)
    ends[-1] = math.inf
    starts, at = [], 0
    for b in range(buckets):
        starts.append((b, at, at + sums.get(b, 0)))
        at += sums.get(b, 0)
    whole, torn = [], []
    for b, lo, hi in starts:
        if hi > lo:
            inside = [k for k, e in zip(names, ends, strict=True) if e > lo]
            (whole if ends[names.index(inside[0])] >= hi else torn).append((b, lo, inside[0]))
    plan = spark.createDataFrame([(b, float(lo), k, i == 0) for i, part in enumerate((whole, torn)) for b, lo, k in part], "bucket int, lo double, k string, is_whole boolean")
    placed_small = small.join(F.broadcast(plan), "bucket")
    run = F.sum("n").over(W.partitionBy("bucket").orderBy("h", "component")) + F.col("lo") - F.col("n") / 2
    cut: Column = F.lit(names[-1])
    for k, e in reversed(list(zip(names, ends, strict=True))[:-1]):
        cut = F.when(run <= e, k).otherwise(cut)
    parts = [
        placed_small.where("is_whole").select("component", F.col("k").alias("split_label")),
        placed_small.where("NOT is_whole").select("component", cut.alias("split_label")),
        spark.createDataFrame(placed, groups.select("component").schema.add("split_label", "string")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scaffold_split(compounds: DataFrame, shares: dict[str, float] | None = None, workspace: Workspace | None = None) -> DataFrame:
    """(screening_compound_id, split_strategy, split_label): one row per compound, no related set in two splits."""
    shares = shares or {"train": 0.8, "valid": 0.1, "test": 0.1}
    spark = compounds.sparkSession
    ws = workspace or Workspace(spark, "split")
    members = compound_groups(compounds, ws)
    groups = ws.cut(members.groupBy("component").agg(F.count("*").alias("n")), "groups")
    labels = assign_splits(spark, groups, shares)
    return members.join(labels, "component").select(F.col("id").alias("screening_compound_id"), F.lit("scaffold").alias("split_strategy"), "split_label")


def split_errors(compounds: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, workspace: Workspace | None = None) -> DataFrame:
    """One row: compounds, those with a label, compounds with two rows, related sets under several labels, and whether each
    share is within the largest set's share of what was asked for."""
    shares = shares or {"train": 0.8, "valid": 0.1, "test": 0.1}
    ws = workspace or Workspace(compounds.sparkSession, "errors")
    members = compound_groups(compounds, ws)
    x = members.join(labels.select(F.col("screening_compound_id").alias("id"), "split_label"), "id", "left")
    sets = x.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("split_label").alias("labels"), F.count_distinct("id").alias("ids"), F.count("split_label").alias("labelled"), F.min("split_label").alias("label"))
    total, largest = F.sum("n"), F.max("n")
    near = [F.abs(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) / total - v) <= largest / total for k, v in shares.items()]
    return sets.agg(
        F.sum("ids").alias("n_compounds"), F.sum("labelled").alias("n_labelled"), F.sum(F.col("n") - F.col("ids")).alias("n_twice"), F.count_if(F.col("labels") > 1).alias("n_torn"),
        (near[0] & near[1] & near[2]).alias("near_shares"),
    )
