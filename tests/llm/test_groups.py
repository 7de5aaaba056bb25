"""Top N, components, splits and survivors: nulls, ties, repeats, empty tables, clashing names, brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import components, group_split, survivors, top_n
from lodestrand.session import Workspace

TOP = "g string, i string, s double, t double, rank int, item string, score string"


def top(spark, data, n=2, **kw):
    rows = [(*r, 7, "x", "y") for r in data]
    df = spark.createDataFrame(rows, TOP)
    return [tuple(r)[:2] for r in top_n.top_n_per_group(df, "g", "i", "s", "t", n, **kw).orderBy("group_key", "rank").select("group_key", "item").collect()]


def test_top_ties_and_nulls(spark):
    data = [(" a", "x", 1.0, None), ("A\t", "y", 1.0, 2.0), ("a", "z", 1.0, 2.0), (None, "q", 9.0, 1.0), ("nan", "q", None, 1.0), ("", "q", 9.0, 1.0), ("b", "w", float("nan"), 1.0), ("b", None, 1.0, 1.0)]
    assert top(spark, data) == [("A", "y"), ("A", "z"), ("B", None)]
    assert top(spark, []) == []


def test_top_with_repeats_fills_up(spark):
    data = [("a", "x", 9.0, 1.0)] * 50 + [("a", "y", 5.0, 1.0), ("a", "x", 3.0, 2.0), ("a", "z", 4.0, None)]
    assert top(spark, data, 3, depth=2) == [("A", "x"), ("A", "y"), ("A", "z")]


def test_top_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), f"i{rng.randrange(30)}", float(rng.randrange(6)), rng.choice([None, 1.0, 2.0])) for _ in range(600)]
    best = {}
    for g, i, s, t in data:
        k = (-s, -(t if t is not None else -1), i)
        best[g, i] = min(best.get((g, i), k), k)
    want = []
    for g in "abc":
        want += [(g.upper(), i) for _, i in sorted((k, i) for (h, i), k in best.items() if h == g)[:4]]
    assert top(spark, data, 4, depth=1) == want and top(spark, data, 4, depth=9) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(120)}", f"v{rng.randrange(120)}") for _ in range(90)] + [("hub", f"s{i}") for i in range(80)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    roots = dict(components.contract(spark.createDataFrame(edges, "u string, v string"), Workspace(spark, "t"), seed).collect())
    got = defaultdict(set)
    want = defaultdict(set)
    for x in parent:
        want[find(x)].add(x)
        if x in roots or any(x in e and e[0] != e[1] for e in edges):
            got[roots.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_nothing(spark):
    assert components.contract(spark.createDataFrame([("a", "a")], "u string, v string"), Workspace(spark, "t")) is None


ENV = "screening_compound_id string, murcko_scaffold string, standardized_smiles string, component string, id string"


def test_related_pairs(spark):
    data = [("1", "S", "a"), ("2", " S ", "b"), ("3", None, "b\t"), ("4", "NO_SCAFFOLD", "c"), ("5", "nan", ""), ("6", "", "  "), ("7", "T", "c"), ("7", "T", "c"), (None, "S", "z"), ("8", "Q", "q"), ("8", "R", "r"), ("9", "R", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], ENV)
    got = sorted(tuple(r) for r in group_split.related_pairs(df).collect())
    assert got == [("1", "2"), ("1", "3"), ("4", "7"), ("8", "9")]
    assert group_split.related_pairs(df.limit(0)).count() == 0
    assert group_split.scaffold_split(df.limit(0)).count() == 0
    labels = {r[0]: r[2] for r in group_split.scaffold_split(df).collect()}
    assert set(labels) == set("123456789") and labels["1"] == labels["2"] == labels["3"] and labels["8"] == labels["9"]


def test_shares_with_a_hot_group(spark):
    g = spark.createDataFrame([("hot", 3000)] + [(f"g{i}", 1 + i % 4) for i in range(3000)], "component string, n long")
    got = group_split.assign_splits(spark, g, {"train": 0.8, "valid": 0.1, "test": 0.1})
    assert got.count() == 3001 == got.select("component").distinct().count()
    n = dict(g.join(got, "component").groupBy("split_label").agg(F.sum("n")).collect())
    total = sum(n.values())
    assert abs(n["train"] / total - 0.8) < 0.005 and abs(n["valid"] / total - 0.1) < 0.005


def test_branch_and_bound_is_the_best_choice():
    rng = random.Random(5)
    ok = lambda a, b: a is None or b is None or a == b
    for _ in range(200):
        c = [[(rng.randrange(5), rng.choice([None, True, False])) for _ in range(rng.randrange(1, 4))] for _ in range(3)]
        every = [[i, j, k] for i in range(len(c[0])) for j in range(len(c[1])) for k in range(len(c[2])) if ok(c[0][i][1], c[1][j][1]) and ok(c[0][i][1], c[2][k][1]) and ok(c[1][j][1], c[2][k][1])]
        trust = lambda x: [c[b][i][0] for b, i in enumerate(x)]
        got = survivors.branch_and_bound(c, ok)
        assert (got is None) == (not every) and (got is None or trust(got) == max(map(trust, every)))
    assert survivors.branch_and_bound([[], [(1, None)]], ok) is None


REC = "record_id long, compound_id string, standardized_smiles string, target_chembl_id string, median_ki_nM double, pKi double, pKi_std double, n_source_records long, n_unique_assays long, is_duplicate_measurement boolean, curation_source string, curated_at timestamp, loaded_at timestamp, target string, component string, best string"


def records(spark, rows):
    return spark.createDataFrame([(i, c, s, t, 10.0, p, None, ns, na, ns and ns > 1, "src", None, None, "x", "y", "z") for i, c, s, t, p, ns, na in rows], REC)


def test_best_supported(spark):
    nan = float("nan")
    df = records(spark, [
        (1, "C1", "s1", "T", 5.0, 3, 2), (2, " c1", "s9", "t ", 6.0, 2, 1), (3, "C9", "s9", "T", 6.0, None, None),  # 1 wins over a chain of three
        (4, "C2", "s2", "T", nan, 3, 3), (5, "C2", None, "T", 5.0, 1, 1),  # the best has no potency
        (6, "C3", "s3", "T", 5.0, 3, 1), (7, "C3", "s3", "T", 5.0, 2, 2),  # no record is best in both
        (8, "C4", "s4", "T", 5.0, 2, 2), (9, "C4", "s4", "T", 5.0, 2, 1),  # a tie
        (10, "C5", "s5", "T", 5.0, 9, 9),  # alone
        (11, "nan", "", "T", 5.0, 9, 9), (12, None, None, "T", 5.0, 8, 8), (13, "C6", "s6", None, 5.0, 9, 9),  # no group
        (14, "C1", "s1", "U", 5.0, 1, None), (15, "C1", "s1", "U", 5.0, None, 1),  # null is lowest, but not best in both
    ])
    assert sorted(r[0] for r in survivors.best_supported(df).collect()) == [1]
    assert survivors.best_supported(df.limit(0)).count() == 0
    chosen = {r["n_records"]: r for r in survivors.surviving_records(df).where("target = 'T'").collect()}
    assert chosen[3]["measurement_record"] == 1 and chosen[3]["is_duplicate_measurement"] is True
    assert survivors.surviving_records(df.limit(0)).count() == 0


def test_a_group_with_most_of_the_rows(spark):
    rows = [(i, "HOT", f"s{i % 7}", "T", 5.0, 2, 2) for i in range(3000)] + [(9001, "HOT", "s1", "T", 5.0, 5, 5)] + [(10_000 + i, f"C{i}", f"q{i}", "T", 5.0, 1, 1) for i in range(500)]
    assert [r[0] for r in survivors.best_supported(records(spark, rows)).collect()] == [9001]
