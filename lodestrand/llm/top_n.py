"""Problem 1: the N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import present
from ..session import Workspace


def top_n_per_group(
    df: DataFrame, group: str, item: str, score: str, tie: str, n: int = 5, depth: int = 4, workspace: Workspace | None = None
) -> DataFrame:
    """The `n` best items of each group, one row per (group, item), as columns `group_key`, `item`, `score`, `tie`, `rank`.

    Groups are compared and returned without outer blanks and in upper case. Order: score descending, tie descending
    with nulls last (NaN above all numbers), item ascending by bytes with nulls first. An item counts once, with its
    best row. Rows with a missing group, or a null or NaN score, do not take part; an empty table gives no rows. Other
    columns of `df` are not read, so their names may be anything.

    A row_number window filtered at `n * depth` is planned with group limits before and after the shuffle, so that the
    shuffle carries at most that many rows of a group from each task. Repeats of an item use up places of that window;
    a group whose window is full with fewer than `n` items is answered by a second pass over all its rows, which
    collapses repeats by a partial aggregation before the same ranking. Either way the result is exact.
    """
    spark = df.sparkSession
    ws = workspace or Workspace(spark, "top-n")
    rows = df.select(
        F.upper(present(F.col(f"`{group}`"))).alias("group_key"),
        F.col(f"`{item}`").alias("item"),
        F.col(f"`{score}`").cast("double").alias("score"),
        F.col(f"`{tie}`").cast("double").alias("tie"),
    ).where("group_key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    order = [F.col("score").desc(), F.col("tie").desc_nulls_last(), F.col("item").asc()]
    by_group, places = W.partitionBy("group_key"), n * depth
    head = ws.cut(
        rows.withColumn("place", F.row_number().over(by_group.orderBy(*order)))
        .where(F.col("place") <= places)
        .withColumn("copy", F.row_number().over(W.partitionBy("group_key", "item").orderBy("place")))
        .withColumn("items", F.sum(F.when(F.col("copy") == 1, 1)).over(by_group))
        .withColumn("filled", F.max("place").over(by_group) >= places),
        "head",
    )

    def ranked(x: DataFrame) -> DataFrame:
        return (
            x.withColumn("rank", F.row_number().over(by_group.orderBy(*order)))
            .where(F.col("rank") <= n)
            .select("group_key", "item", "score", "tie", "rank")
        )

    short = head.where(F.col("filled") & (F.col("items") < n)).select("group_key").distinct()
    result = ranked(head.where((~F.col("filled") | (F.col("items") >= n)) & (F.col("copy") == 1)))
    if short.isEmpty():
        return result
    best = (
        rows.join(short, "group_key", "left_semi")
        .groupBy("group_key", "item")
        .agg(F.max(F.struct("score", "tie")).alias("best"))
        .select("group_key", "item", "best.score", "best.tie")
    )
    return result.unionByName(ranked(best))
