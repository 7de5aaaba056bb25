"""The queries with SQL against it, over whole tables."""

import pytest

from lodestrand.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, spark, duck, same):
    same(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_splits_keep_sets_together(spark):
    labels = {r[0]: r[2] for r in queries.QUERIES["p5_scaffold_split"](spark, DATA).collect()}
    n = len(labels)
    assert all(labels[a] == labels[b] for a, b in queries.QUERIES["p5_found"](spark, DATA).collect())
    shares = {k: sum(v == k for v in labels.values()) / n for k in ("train", "valid", "test")}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["valid"] - 0.1) < 0.02
