"""Connected components of records that share key values, by random-mate contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace


def contract(edges: DataFrame, workspace: Workspace, seed: int = 17, max_rounds: int = 400) -> DataFrame | None:
    """Component roots of the graph with `edges` (columns u, v): (vertex, root) of every vertex that is not its own
    root, or None where there are no edges.

    Each round every vertex draws a coin from a hash of seed, round and name, so that a task that runs again draws the
    same. A vertex with tails that has a neighbour with heads is merged into the least such neighbour; edges are
    renamed, loops and repeats fall away. Half of the lone edges vanish each round, so rounds grow with the logarithm
    of the number of edges. Each vertex is merged once, which leaves a forest no deeper than the rounds; its labels are
    unwound by pointer doubling. A hub's edges are aggregated before each shuffle and never gathered.
    """

    def heads(c: Column, r: int) -> Column:
        return F.xxhash64(F.lit(seed * 1_000_003 + r), c) % 2 == 0

    live = workspace.cut(edges.where("u <> v").distinct(), "edges-0")
    merged: list[DataFrame] = []
    r = 0
    while not live.isEmpty():
        if (r := r + 1) > max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mates = workspace.cut(
            both.where(~heads(F.col("u"), r) & heads(F.col("v"), r)).groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("parent")),
            f"mates-{r}",
        )
        merged.append(mates)
        to = [mates.select(F.col("vertex").alias(x), F.col("parent").alias(f"p{x}")) for x in "uv"]
        live = workspace.cut(
            live.join(to[0], "u", "left").join(to[1], "v", "left")
            .select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
            .where("u <> v")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .distinct(),
            f"edges-{r}",
        )
        workspace.drop(f"edges-{r - 1}")
    if not merged:
        return None
    forest = reduce(DataFrame.unionByName, merged)
    depth = 1
    while depth < len(merged):
        up = forest.select(F.col("vertex").alias("parent"), F.col("parent").alias("above"))
        forest = workspace.cut(forest.join(up, "parent", "left").select("vertex", F.coalesce("above", "parent").alias("parent")), f"forest-{depth}")
        depth *= 2
    return forest.withColumnRenamed("parent", "root")


def with_component(df: DataFrame, keys: dict[str, Column], workspace: Workspace, out: str = "component", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df`, without the columns `drop`, with the component of each row, a long: rows are linked where they have an equal, non-null value of one of
    `keys`, directly or through other rows. A row with no key at all gets null. `df` and a digest of each key (`__k0`,
    `__k1`, ...) are written once and read from there.

    Keys are compared by 64-bit digests; a second digest shows two keys with the same one, and another seed is taken then.
    Only key values that meet more than one name become edges: a value's least and greatest name are taken by partial
    aggregation, so the values that hold most of the rows cost no more than others.
    """
    for seed in range(5):
        digest = lambda i, c, n, seed=seed: F.when(c.isNotNull(), F.xxhash64(F.lit(n * 100 + seed * 10 + i), c))
        marks = {f"__k{i}": digest(i, c, 0) for i, c in enumerate(keys.values())} | {f"__c{i}": digest(i, c, 1) for i, c in enumerate(keys.values())}
        rows = workspace.cut(df.withColumns(marks).drop(*drop), f"keyed-{seed}")
        name = F.coalesce(*[F.col(f"__k{i}") for i in range(len(keys))])
        edges, twice = [], []
        for i in range(len(keys)):
            k = f"__k{i}"
            held = rows.select(k, F.col(f"__c{i}").alias("c"), name.alias("__name")).where(F.col(k).isNotNull())
            met = held.groupBy(k).agg(F.min("__name").alias("u"), F.max("__name").alias("most"), F.min("c").alias("c0"), F.max("c").alias("c1"))
            if i:
                met = workspace.cut(met.where("u <> most OR c0 <> c1"), f"met-{seed}-{i}")
                edges.append(held.select(k, "__name").join(met.select(k, "u"), k).select("u", F.col("__name").alias("v")))
            twice.append(met.where("c0 <> c1").select(k))
        if reduce(DataFrame.unionByName, [x.toDF("k") for x in twice]).isEmpty():
            break
    else:
        raise RuntimeError("keys with equal digests under five seeds")
    rows = rows.drop(*[f"__c{i}" for i in range(len(keys))]).withColumn("__name", name)
    roots = contract(reduce(DataFrame.unionByName, edges), workspace) if edges else None
    if roots is None:
        return rows.withColumnRenamed("__name", out)
    return rows.join(roots.select(F.col("vertex").alias("__name"), F.col("root").alias("__root")), "__name", "left").withColumn(out, F.coalesce("__root", "__name")).drop("__name", "__root")
