"""Whole sign words, and cliffs by similarity and difference."""

from pyspark.sql import functions as F

from lodestrand.operators import pairs


def test_sign_bits_of_long_vectors(spark):
    v = [1.0 if i in (0, 62, 63, 64, 129) else -1.0 for i in range(130)]
    df = spark.createDataFrame([(1, v), (2, v[:64]), (3, [])], "i int, v array<double>")
    got = {r["i"]: [x % 2**64 for x in r["b"]] for r in df.select("i", pairs.sign_bits(F.col("v")).alias("b")).collect()}
    assert got == {1: [1 | 1 << 62 | 1 << 63, 1, 2], 2: [1 | 1 << 62 | 1 << 63], 3: [0]}


def test_cliffs_need_the_difference(spark):
    x = spark.createDataFrame([("a", 1, [7], 5.0), ("a", 2, [7], 6.0), ("a", 3, [7], 5.5), ("a", 4, [7], None), ("b", 5, [7], 9.0)], "g string, i int, b array<long>, v double")
    got = pairs.similar_pairs(x, "g", "i", "b", 0.8, value="v", least_difference=1.0)
    assert [(r["item_1"], r["item_2"], r["difference"]) for r in got.collect()] == [(1, 2, 1.0)]
    assert sorted(r["item"] for r in pairs.pair_flags(got, "g").collect()) == [1, 2]
