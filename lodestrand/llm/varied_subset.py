"""Problem 3: a varied subset of given size, by a cluster-feature tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, present
from ..session import Workspace

DIM = 24


def scaffold_vectors(scaffolds: list[str | None], rare: np.ndarray, dim: int = DIM, weight: float = 0.35) -> np.ndarray:
    """Unit vectors of hashed character trigrams and, as the last coordinate, the rarity mark. Missing scaffolds share the
    zero vector, so that they are one group."""
    import xxhash

    out = np.zeros((len(scaffolds), dim + 1))
    for i, s in enumerate(scaffolds):
        if s:
            padded = f"  {s} "
            for j in range(len(padded) - 2):
                h = xxhash.xxh64_intdigest(padded[j : j + 3])
                out[i, h % dim] += 1 if h >> 63 else -1
            out[i, :dim] /= np.linalg.norm(out[i, :dim]) or 1.0
    out[:, dim] = weight * rare
    return out


class _Node:
    """Cluster features (mass, linear sum, squared sum) of a node's entries; `kids` of inner nodes, names of nothing else."""

    __slots__ = ("n", "ls", "ss", "size", "kids")

    def __init__(self, room: int, dim: int, leaf: bool):
        self.n, self.ls, self.ss = np.zeros(room), np.zeros((room, dim)), np.zeros(room)
        self.size, self.kids = 0, None if leaf else []

    def put(self, n: float, ls: np.ndarray, ss: float, kid: _Node | None = None) -> None:
        i = self.size
        self.n[i], self.ls[i], self.ss[i] = n, ls, ss
        if self.kids is not None:
            self.kids.append(kid)
        self.size += 1

    def nearest(self, centre: np.ndarray) -> int:
        m = self.size
        return int(np.argmin(((self.ls[:m] / self.n[:m, None] - centre) ** 2).sum(1)))

    def total(self) -> tuple[float, np.ndarray, float]:
        m = self.size
        return float(self.n[:m].sum()), self.ls[:m].sum(0), float(self.ss[:m].sum())


class FeatureTree:
    """A height-balanced cluster-feature tree of at most `limit` leaf entries.

    A point goes down from the root to the child with the nearest centre, adding itself to the features on its way, and
    is absorbed by the nearest leaf entry where that one's radius stays within the threshold; else it becomes an entry. A
    node with more than `branching` entries is split at its two farthest ones, up to the root. When the leaves hold more than
    `limit` entries, the tree is built again from them with a larger threshold.
    """

    def __init__(self, limit: int, branching: int = 24, threshold: float = 1e-9):
        self.limit, self.branching, self.threshold = limit, branching, threshold
        self.root, self.held = None, 0

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        if self.root is None:
            self.root = _Node(self.branching + 1, len(ls), True)
        centre, path, node = ls / n, [], self.root
        while node.kids is not None:
            i = node.nearest(centre)
            path.append((node, i))
            node = node.kids[i]
        absorbed = False
        if node.size:
            i = node.nearest(centre)
            n1, l1, s1 = node.n[i] + n, node.ls[i] + ls, node.ss[i] + ss
            if absorbed := max(0.0, s1 / n1 - float(l1 @ l1) / n1**2) <= self.threshold**2:
                node.n[i], node.ls[i], node.ss[i] = n1, l1, s1
        if not absorbed:
            node.put(n, ls, ss)
            self.held += 1
        for parent, i in path:
            parent.n[i] += n
            parent.ls[i] += ls
            parent.ss[i] += ss
        while node.size > self.branching:
            left, right = self._split(node)
            parent, i = path.pop() if path else (None, 0)
            if parent is None:
                self.root = parent = _Node(self.branching + 1, len(ls), False)
                parent.put(*left.total(), left)
            else:
                parent.n[i], parent.ls[i], parent.ss[i] = left.total()
                parent.kids[i] = left
            parent.put(*right.total(), right)
            node = parent
        if self.held > self.limit:
            self._rebuild()

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        m = node.size
        c = node.ls[:m] / node.n[:m, None]
        d = ((c[:, None] - c[None]) ** 2).sum(2)
        i, j = np.unravel_index(int(np.argmax(d)), d.shape)
        to_left = d[i] <= d[j]
        to_left[i], to_left[j] = True, False
        parts = tuple(_Node(self.branching + 1, node.ls.shape[1], node.kids is None) for _ in range(2))
        for e in range(m):
            parts[0 if to_left[e] else 1].put(node.n[e], node.ls[e], node.ss[e], node.kids[e] if node.kids is not None else None)
        return parts

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mass, linear sum, squared sum) of the leaf entries."""
        out, open_ = [], [self.root] if self.root is not None else []
        while open_:
            node = open_.pop()
            if node.kids is None:
                out.append((node.n[: node.size], node.ls[: node.size], node.ss[: node.size]))
            else:
                open_ += reversed(node.kids)
        if not out:
            return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _rebuild(self) -> None:
        n, ls, ss = self.entries()
        c = ls / n[:, None]
        sample = c[:: max(1, len(c) // 256)]
        d = np.sqrt(np.maximum(0, (sample**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * sample @ c.T))
        d[d < 1e-6] = np.inf
        wider = max(self.threshold * 1.5, float(np.quantile(d.min(1), 0.5)) * 0.75)
        self.__init__(self.limit, self.branching, wider if np.isfinite(wider) else self.threshold * 1.5)
        for x in zip(n, ls, ss, strict=True):
            self.add(float(x[0]), x[1], float(x[2]))


def ward(n: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Group numbers 0..k-1 of the entries by Ward linkage, merged by nearest-neighbour chains and cut at k groups."""
    m = len(n)
    if k >= m:
        return np.arange(m)
    size, c, alive = n.astype(float).copy(), centres.astype(float).copy(), np.ones(m, bool)
    merges, chain = [], []
    sq = (c**2).sum(1)
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            d = (sq + sq[a] - 2 * c @ c[a]) * (size * size[a] / (size + size[a]))
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((max(0.0, float(d[b])), a, b))
        c[a] = (size[a] * c[a] + size[b] * c[b]) / (size[a] + size[b])
        sq[a] = float(c[a] @ c[a])
        size[a] += size[b]
        alive[b] = False
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for _, a, b in sorted(merges, key=lambda x: x[0])[: m - k]:
        parent[root(a)] = root(b)
    _, out = np.unique([root(i) for i in range(m)], return_inverse=True)
    return out


def varied_subset(shortlist: DataFrame, k: int, entries: int = 2000, coarse: int = 256, rows_per_task: int = 100_000, workspace: Workspace | None = None) -> DataFrame:
    """`k` records that cover the variety of scaffolds: (entity_id, murcko_scaffold, rare, group_size), group_size being
    the rows its group stands for; all records where there are no more than `k`.

    Rows are summed up per scaffold first, so a scaffold held by a third of all rows is one point and weighs no more than
    another. A scaffold is rare if most of its flags say so; without flags, if it is held once. Missing scaffolds are one
    group. Each partition builds a cluster-feature tree of at most `entries` leaf entries; over shuffles they are merged by further
    trees, sixteen to a task, to one, whose entries are joined by Ward linkage into at most `coarse` groups on the driver. In
    each of these another tree over the partitions' entries is cut by Ward linkage at the group's share of `k` (one group where `k` is
    at most `coarse`). Each of the k centres gives the scaffold nearest to it, a rare one first among equals, with its
    best-scored record (ties to the lesser entity_id). Centres that no scaffold is nearest to are made up for by the
    scaffolds farthest from their centres. With fewer scaffolds than k, further records of the same scaffolds fill up, one each
    in turn.
    """
    spark = shortlist.sparkSession
    ws = workspace or Workspace(spark, "varied")
    rows = ws.cut(
        shortlist.select(
            "entity_id", present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("scaffold"), F.col("rare_scaffold_flag").cast("double").alias("flag"),
            F.when(~F.isnan(F.col("final_strategic_score").cast("double")), F.col("final_strategic_score").cast("double")).alias("score"),
        ).where("entity_id IS NOT NULL"),
        "rows",
    )
    points = ws.cut(
        rows.groupBy("scaffold").agg(F.count("*").alias("n"), F.avg("flag").alias("flag"))
        .select("scaffold", "n", F.coalesce((F.col("flag") >= 0.5).cast("double"), (F.col("n") == 1).cast("double")).alias("rare"))
        .withColumn("rare", F.when(F.col("scaffold").isNull(), F.lit(0.0)).otherwise(F.col("rare"))),
        "points",
    )
    total = points.count()
    if not total or k <= 0:
        return rows.select("entity_id", F.col("scaffold").alias("murcko_scaffold"), F.lit(0.0).alias("rare"), F.lit(0).cast("long").alias("group_size")).limit(0)
    wanted = min(k, total)
    limit = max(entries, 8 * min(wanted, coarse))
    shape = "n double, ls array<double>, ss double"

    def vectors(pdf: pd.DataFrame) -> np.ndarray:
        return scaffold_vectors(pdf["scaffold"].tolist(), pdf["rare"].to_numpy())

    def entry_frame(tree: FeatureTree) -> pd.DataFrame:
        n, ls, ss = tree.entries()
        return pd.DataFrame({"n": n, "ls": list(ls), "ss": ss})

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(limit)
        for pdf in batches:
            for x in vectors(pdf):
                tree.add(1.0, x, float(x @ x))
        yield entry_frame(tree)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(limit)
        for pdf in batches:
            for n, ls, ss in zip(pdf["n"], pdf["ls"], pdf["ss"], strict=True):
                tree.add(float(n), np.asarray(ls, dtype=float), float(ss))
        yield entry_frame(tree)

    parts = max(1, -(-total // rows_per_task))
    leaves = ws.cut(points.repartition(parts, "scaffold").mapInPandas(summarise, shape), "leaves")
    summary = leaves
    while parts > 1:
        parts = -(-parts // 16)
        summary = summary.repartition(parts).mapInPandas(merge, shape)
    top = summary.toPandas()
    mass, hearts = _centres(top, min(wanted, coarse))
    shared = spark.sparkContext.broadcast(hearts)

    def nearest(v: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.maximum(0, (v**2).sum(1)[:, None] + (h**2).sum(1)[None] - 2 * v @ h.T)
        return d.argmin(1), d.min(1)

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(group=nearest(np.stack(pdf["ls"].to_numpy()) / pdf["n"].to_numpy()[:, None], shared.value)[0])

    sizes = leaves.mapInPandas(grouped, shape + ", group int")
    sizes = ws.cut(sizes, "grouped")
    held = dict(sizes.groupBy("group").agg(F.sum("n")).collect())
    names = sorted(held)
    quota = dict(zip(names, _shares(np.array([int(round(held[g])) for g in names]), wanted).tolist(), strict=True))

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = quota[int(key[0])]
        tree = FeatureTree(max(entries, 8 * q))
        for n, ls, ss in zip(pdf["n"], pdf["ls"], pdf["ss"], strict=True):
            tree.add(float(n), np.asarray(ls, dtype=float), float(ss))
        _, c = _centres(entry_frame(tree), q)
        return pd.DataFrame({"group": int(key[0]), "centre": np.arange(len(c)), "v": list(c)})

    centres = ws.cut(sizes.where(F.col("group").isin([g for g in names if quota[g]])).groupBy("group").applyInPandas(cut, "group int, centre int, v array<double>"), "centres")

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value[[g for g in names if quota[g]]]
        for pdf in batches:
            v = vectors(pdf)
            yield pdf.assign(v=list(v), group=np.array([g for g in names if quota[g]])[nearest(v, h)[0]])

    # A group's points are spread over as many tasks as its size asks for; its centres go to each and come first there.
    salts = {g: max(1, -(-int(held[g]) // rows_per_task)) for g in names}
    of = F.create_map(*[F.lit(x) for g in names for x in (g, salts[g])])
    located_points = points.mapInPandas(located, "scaffold string, n long, rare double, v array<double>, group int").withColumn("salt", F.pmod(F.xxhash64("scaffold"), of[F.col("group")]).cast("int"))
    to_all = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), of[F.col("group")] - 1)))
    both = to_all.select("group", "salt", "centre", "v", F.lit(None).cast("string").alias("scaffold"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("rare")).unionByName(
        located_points.select("group", "salt", F.lit(None).cast("int").alias("centre"), "v", "scaffold", "n", "rare")
    )
    both = both.repartition(max(1, -(-4 * total // rows_per_task)), "group", "salt").sortWithinPartitions(F.col("centre").isNull())

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine: dict[int, list] = {}
        for pdf in batches:
            is_centre = pdf["centre"].notna()
            for g, c, v in pdf.loc[is_centre, ["group", "centre", "v"]].itertuples(index=False):
                mine.setdefault(int(g), []).append((int(c), v))
            for g, part in pdf[~is_centre].groupby("group"):
                ids, h = [c for c, _ in mine[int(g)]], np.stack([v for _, v in mine[int(g)]])
                at, d = nearest(np.stack(part["v"].to_numpy()), h)
                yield pd.DataFrame({"scaffold": part["scaffold"], "n": part["n"], "rare": part["rare"], "group": int(g), "centre": np.array(ids)[at], "distance": np.round(d, 9)})

    matched = ws.cut(both.mapInPandas(match, "scaffold string, n long, rare double, group int, centre int, distance double"), "matched")
    best = F.struct("distance", (-F.col("rare")).alias("not_rare"), F.coalesce("scaffold", F.lit("")).alias("s"))
    first = matched.groupBy("group", "centre").agg(F.min_by(F.struct("scaffold", "rare"), best).alias("p"), F.sum("n").alias("group_size")).select("p.scaffold", "p.rare", "group_size")
    first = ws.cut(first, "first")
    lacking = wanted - first.count()
    if lacking > 0:
        rest = matched.join(first.select(F.coalesce("scaffold", F.lit("")).alias("s")), F.coalesce("scaffold", F.lit("")) == F.col("s"), "left_anti")
        more = rest.orderBy(F.desc("distance"), "scaffold").limit(lacking).select("scaffold", "rare", F.col("n").alias("group_size"))
        first = ws.cut(first.unionByName(more), "chosen")
    best = rows.join(first, rows["scaffold"].eqNullSafe(first["scaffold"])).select("entity_id", rows["scaffold"].alias("murcko_scaffold"), "rare", "group_size", "score")
    if k <= wanted:
        leader = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "entity_id")
        return best.groupBy("murcko_scaffold", "rare", "group_size").agg(F.min(leader).alias("l")).select("l.entity_id", "murcko_scaffold", "rare", "group_size")
    turn = best.withColumn("turn", F.row_number().over(W.partitionBy("murcko_scaffold").orderBy(F.col("score").desc_nulls_last(), "entity_id")))
    return turn.where(F.col("turn") <= k).orderBy("turn", F.col("rare").desc(), "murcko_scaffold", "entity_id").limit(k).select("entity_id", "murcko_scaffold", "rare", "group_size")


def _centres(entries: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mass, centre) of the at most k groups that Ward linkage makes of leaf entries."""
    n, c = entries["n"].to_numpy(), np.stack(entries["ls"].to_numpy()) / entries["n"].to_numpy()[:, None]
    group = ward(n, c, k)
    mass = np.bincount(group, n)
    return mass, np.stack([np.average(c[group == g], axis=0, weights=n[group == g]) for g in range(len(mass))])


def _shares(sizes: np.ndarray, k: int) -> np.ndarray:
    """k places in proportion to sizes, none above its size and, where k allows, none at 0; largest remainders first."""
    base = np.minimum(sizes, 1) if k >= len(sizes) else np.zeros(len(sizes), int)
    ideal = sizes / sizes.sum() * k
    out = np.maximum(base, np.minimum(sizes, np.floor(ideal).astype(int)))
    while out.sum() < k:
        out[int(np.argmax(np.where(out < sizes, ideal - out, -np.inf)))] += 1
    while out.sum() > k:
        out[int(np.argmax(np.where(out > base, out - ideal, -np.inf)))] -= 1
    return out
