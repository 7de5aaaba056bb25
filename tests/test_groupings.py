"""Regression metrics over several groupings: the same as by copies of the rows, without shuffling the copies."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import groupings, metrics

BY, EACH = ["k", "l"], {"one": "g", "two": "h", "again": "k"}


def plain(df):
    """Rows in the order of their groups; numbers that are equal but for the order of sums compare equal."""
    return sorted(([pytest.approx(x, rel=1e-9, abs=1e-12) if isinstance(x, float) else x for x in r] for r in df.collect()), key=lambda r: str(r[:4]))


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(3)
    v = lambda: rng.choice([None, float("nan"), rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), 7.0, 7.0, -0.0, 0.0])
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice(["x", None, f"z{rng.randrange(40)}"]), rng.randrange(3), v(), v()) for _ in range(3000)]
    return spark.createDataFrame(rows, "k string, l int, g string, h int, observed double, predicted double")


@pytest.fixture(scope="module")
def by_copies(measured):
    rows = metrics.regression_metrics(groupings.long_form(measured, BY, EACH, "observed", "predicted"), [*BY, "group_type", "group_value"]).collect()
    return sorted(map(list, rows), key=lambda r: str(r[:4]))


# As it is; few ranges, and values with more rows than are held in memory; more groups than may be counted.
@pytest.mark.parametrize("how", [{}, {"ranges": 4, "held": 5}, {"most": 10}])
def test_as_by_copies(measured, by_copies, how):
    assert plain(groupings.regression_metrics_each(measured, BY, EACH, **how)) == by_copies


def test_of_nothing(measured):
    assert groupings.regression_metrics_each(measured.limit(0), BY, EACH).count() == 0


def shuffled(spark, run):
    """Records that the stages of a run wrote to shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def test_a_row_is_not_shuffled_for_each_grouping(spark):
    n, names = 100_000, ("a", "b", "c", "d", "e")
    df = spark.range(n).select((F.col("id") % 2).alias("k"), *[(F.hash("id", F.lit(i)) % 2).alias(c) for i, c in enumerate(names)], F.rand(1).alias("observed"), F.rand(2).alias("predicted"))
    assert shuffled(spark, lambda: groupings.regression_metrics_each(df, ["k"], dict(zip(names, names, strict=True))).collect()) < 5 * n
    assert shuffled(spark, lambda: metrics.regression_metrics(groupings.long_form(df, ["k"], dict(zip(names, names, strict=True)), "observed", "predicted"), ["k", "group_type", "group_value"]).collect()) > 10 * n
