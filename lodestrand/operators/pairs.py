"""Comparisons inside a group: pairs, leave-one-out references, similar pairs and cliffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def member_pairs(fact: DataFrame, group: str, member: str, values: Sequence[str], both_ways: bool = False) -> DataFrame:
    """Pairs of a group's members, a < b, with each side's values; `both_ways` adds every pair with its sides exchanged.

    An equi-join on the group with the order as a residual; the exchanged rows come from an explode, not a second join."""
    side = lambda s: fact.select(group, F.col(member).alias(f"{member}_{s}"), *[F.col(v).alias(f"{v}_{s}") for v in values])
    p = side("a").join(side("b"), group).where(F.col(f"{member}_a") < F.col(f"{member}_b"))
    if not both_ways:
        return p
    fields = [member, *values]
    ways = F.array(*[F.struct(*[F.col(f"{c}_{x}").alias(f"{c}_{o}") for c in fields for x, o in ((s, "a"), (t, "b"))]) for s, t in (("a", "b"), ("b", "a"))])
    return p.select(group, F.explode(ways).alias("w")).select(group, "w.*")


def leave_one_out(fact: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Each member against the group's other members: their count, median, mean, maximum and second largest value, and the
    group's own mean and population spread. Mean and maximum follow from windows; the median from sorted arrays of the
    group, whose size is bounded by the number of members (targets) and not by the rows."""
    w = W.partitionBy(group)
    all_ = F.sort_array(F.collect_list(value).over(w))
    at = F.array_position(F.col("__all"), F.col(value))
    n = F.size("__all")
    rest = F.concat(F.slice("__all", 1, at.cast("int") - 1), F.slice("__all", at.cast("int") + 1, F.greatest(n - at.cast("int"), F.lit(0))))
    m = F.size("__rest")
    mid = lambda i: F.get("__rest", i)
    median = (mid(F.floor((m - 1) / 2).cast("int")) + mid(F.floor(m / 2).cast("int"))) / 2
    return (
        fact.withColumns({"__all": all_, "group_mean": F.avg(value).over(w), "group_std": F.stddev_pop(value).over(w)})
        .withColumn("__rest", rest).where(m > 0)
        .select(
            group, member, value, m.alias("n_others"), median.alias("others_median"), (F.aggregate("__rest", F.lit(0.0), lambda a, x: a + x) / m).alias("others_mean"),
            mid(m - 1).alias("others_max"), mid(m - 2).alias("others_second"), "group_mean", "group_std",
        )
    )


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of 64-bit words."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    ones = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.bit_count(x))
    return F.coalesce(F.try_divide(common.cast("double"), ones(a) + ones(b) - common), F.lit(0.0))


def sign_bits(vector: Column) -> Column:
    """The signs of a vector of any length as 64-bit words, entry i in bit i % 64 of word i // 64."""
    zero = F.lit(0).cast("long")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)
    bits = F.transform(vector, lambda x, i: F.when(x > 0, one(i)).otherwise(zero))
    word = lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), zero, lambda s, x: s.bitwiseOR(x))
    return F.when(F.size(vector) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")), word)).when(vector.isNotNull(), F.array(zero))


def set_bits(bits: Column) -> Column:
    """Numbers of the bits that are set in an array of 64-bit words."""
    word = lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftright", w, j).bitwiseAND(F.lit(1).cast("long")) == 1), lambda j: j + k * 64)
    return F.flatten(F.transform(bits, word))


def _by_prefix(items: DataFrame, group: str, bits: str, least: float, names: tuple[str, ...]) -> DataFrame:
    """Items with the first of their bits, the rarest first, that any partner must share one of: of n bits, n - ceil(least n) + 1.
    Only the counts of the bits, as many as the fingerprint is wide, come to the driver."""
    x = items.withColumn("__set", set_bits(F.col(bits)))
    counts = x.select(F.explode("__set").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    rank = {r["t"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["t"])))}
    table = F.array(*[F.lit(rank.get(t, len(rank))) for t in range(max(rank, default=0) + 1)])
    ranked = F.array_sort(F.transform("__set", lambda t: F.get(table, t)))
    n = F.size("__set")
    return x.withColumn("__prefix", F.slice(ranked, 1, F.greatest(n - F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int") + 1, F.lit(0)))).select(*names, "__prefix")


def similar_pairs(items: DataFrame, group: str, item: str, bits: str, least: float, most_pairs: int | None = None, value: str | None = None, least_difference: float = 0.0, prefix: bool = False) -> DataFrame:
    """Pairs of a group with a Tanimoto similarity of `least` or more. With `value`, its absolute difference must be
    `least_difference` or more too, and comes out as `difference`: activity cliffs. Groups with more than `most_pairs` pairs are left out
    before the join when that is asked for (a guard that the caller sets, not a default). With `prefix` the join is on rare bits that
    similar items must share, which is exact too, and spares most pairs where fingerprints are sparse and `least` is high."""
    if most_pairs is not None:
        n = F.count("*").over(W.partitionBy(group))
        items = items.withColumn("__n", n).where(F.col("__n") * (F.col("__n") - 1) / 2 <= most_pairs).drop("__n")
    # Tanimoto is at most the smaller number of bits over the larger one.
    ones = F.aggregate(F.col(bits), F.lit(0), lambda s, x: s + F.bit_count(x))
    x = items.withColumn("__ones", ones)
    a = x.select(group, F.col(item).alias("item_1"), F.col(bits).alias("b1"), F.col("__ones").alias("o1"), *([F.col(value).alias("v1")] if value else []))
    b = x.select(group, F.col(item).alias("item_2"), F.col(bits).alias("b2"), F.col("__ones").alias("o2"), *([F.col(value).alias("v2")] if value else []))
    close = (F.col("item_1") < F.col("item_2")) & (F.least("o1", "o2") >= F.lit(least) * F.greatest("o1", "o2"))
    if prefix and least > 0:
        a, b = (_by_prefix(s, group, f"b{i}", least, tuple(s.columns)).withColumnRenamed("__prefix", f"p{i}").withColumn("t", F.explode(f"p{i}")) for i, s in ((1, a), (2, b)))
        # A pair that shares several of them is taken at the first.
        p = a.join(b, [group, "t"]).where(close & (F.array_min(F.array_intersect("p1", "p2")) == F.col("t")))
    else:
        p = a.join(b, group).where(close)
    if value:
        p = p.withColumn("difference", F.abs(F.col("v1") - F.col("v2"))).where((F.col("difference") >= least_difference) & ~F.isnan("difference"))
    return p.withColumn("similarity", tanimoto(F.col("b1"), F.col("b2"))).where(F.col("similarity") >= least).select(group, "item_1", "item_2", "similarity", *(["difference"] if value else []))


def pair_flags(pairs: DataFrame, group: str) -> DataFrame:
    """Per (group, item) of either side: number of pairs, partners and the largest similarity."""
    ends = F.explode(F.array(F.struct(F.col("item_1").alias("item"), F.col("item_2").alias("partner")), F.struct(F.col("item_2").alias("item"), F.col("item_1").alias("partner"))))
    e = pairs.select(group, "similarity", ends.alias("e"))
    return e.groupBy(group, F.col("e.item").alias("item")).agg(F.count("*").alias("n_pairs"), F.count_distinct("e.partner").alias("n_partners"), F.max("similarity").alias("most_similar"))
