"""Operators on small literal tables: nulls, NaN, ties, empty tables, single rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import features, text
from lodestrand.operators import clean, labels, measures, metrics, models, pairs, quality, shortlist, splits, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_text(spark):
    df = spark.createDataFrame([(" a ",), ("\t",), (None,), ("NaN",), ("　x",), ("No_Scaffold ",)], "s string")
    assert [r[0] for r in df.select(text.present(F.col("s"), text.PLACEHOLDERS)).collect()] == ["a", None, None, None, "x", None]
    assert [r[0] for r in df.select(text.key(F.col("s"))).collect()] == ["A", None, None, None, "X", None]


def test_rank_normalize(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 20.0), ("a", None), ("b", 1.0)], "g string, v double")
    got = {(g, v): n for g, v, n in rows(windows.with_rank_normalized(df, "v", "n", ["g"]).distinct())}
    assert got[("a", 10.0)] == 0 and got[("a", 20.0)] == 0.75 and got[("a", None)] is None and got[("b", 1.0)] == 1.0
    parity = {v: n for _, v, n in rows(windows.with_rank_normalized(df.where("g = 'a'"), "v", "n", ["g"], strict_parity=True).distinct())}
    assert parity[10.0] == 1.0 and parity[20.0] == 0.25


@pytest.mark.parametrize("n", [1, 2, 6, 7, 8, 11, 13])
def test_quantile_bin(spark, n):
    import pandas as pd

    df = spark.range(1, n + 1).withColumn("b", windows.quantile_bin(windows.row_rank([F.col("id")]), F.lit(n)))
    want = [0] if n == 1 else pd.qcut(pd.Series(range(1, n + 1)), min(5, n), labels=False).tolist()
    assert [r["b"] for r in df.orderBy("id").collect()] == want


def test_first_choices(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 7, None), (None, 1, 3, 3)], "g string, o int, x int, y int")
    assert sorted(rows(windows.first_non_null(df, ["g"], ["o"], ["x", "y"])), key=str) == sorted([("a", 7, 5), (None, 3, 3)], key=str)
    assert len(rows(windows.keep_first(df, ["g"], [F.col("o")]))) == 2


def test_measures_of_nothing(spark):
    empty = spark.createDataFrame([], "c string, t string, ki double, pki double, a string")
    assert rows(measures.aggregate_duplicates(empty, ["c", "t"], "ki", "pki", {"n": "a"})) == []
    assert rows(measures.density(empty, "c", "t"))[0][3] is None
    assert rows(measures.overlap(empty, "c", "t")) == []
    assert rows(measures.describe(empty, ["ki"])) == [("ki", 0, None, None, None, None, None)]


def test_nan_is_unknown(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("a", None)], "g string, v double")
    assert rows(measures.describe(df, ["v"])) == [("v", 1, 2.0, 2.0, 2.0, 2.0, 0.0)]


def test_regression_metrics(spark):
    data = [("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 4.0, 3.0), ("a", None, 3.0), ("one", 1.0, 2.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0)]
    got = {r["g"]: r for r in metrics.regression_metrics(spark.createDataFrame(data, "g string, observed double, predicted double"), ["g"]).collect()}
    assert got["a"]["n"] == 3 and math.isclose(got["a"]["mae"], 0.5) and math.isclose(got["a"]["spearman"], 1.0)
    assert math.isclose(got["a"]["r2"], 1 - 1.25 / (14 / 3))
    assert got["one"]["r2"] is None and got["one"]["pearson"] is None and got["flat"]["r2"] is None and got["flat"]["spearman"] is None


def test_classification(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.8), ("x", 1, 0.8), ("x", 0, 0.1), ("none", 0, 0.2)], "g string, y int, s double")
    c = {r["g"]: r for r in metrics.classification_metrics(df, ["g"], "y", "s").collect()}
    assert (c["x"]["tp"], c["x"]["fp"], c["x"]["tn"], c["x"]["fn"]) == (2, 1, 1, 0) and c["none"]["f1"] == 0.0
    assert metrics.classification_metrics(df.where("g = 'none'"), ["g"], "y", "s", undefined=None).first()["mcc"] is None
    q = {r["g"]: r for r in metrics.ranking_quality(df, ["g"], "y", "s").collect()}
    assert math.isclose(q["x"]["roc_auc"], 0.875) and q["none"]["roc_auc"] is None


def test_t_distribution():
    assert math.isclose(metrics.t_two_sided(2.776445, 4), 0.05, abs_tol=1e-6)
    assert math.isclose(metrics.t_two_sided(1.0, 1), 0.5, abs_tol=1e-9)
    assert metrics.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_labels(spark):
    df = spark.createDataFrame([(5.0,), (4.3,), (4.0,), (None,)], "v double")
    assert [r[0] for r in df.select(labels.binary_label(F.col("v"), 4.5, 4.2)).collect()] == [1, None, 0, None]
    assert [r[0] for r in df.select(labels.binary_label(F.col("v"), 4.5, 4.2, "assign")).collect()] == [1, 0, 0, None]


def test_pairs(spark):
    f = spark.createDataFrame([("c", 1, 5.0), ("c", 2, 6.0), ("c", 3, 9.0), ("d", 1, 4.0)], "g string, m int, v double")
    assert len(rows(pairs.member_pairs(f, "g", "m", ["v"]))) == 3 and len(rows(pairs.member_pairs(f, "g", "m", ["v"], both_ways=True))) == 6
    loo = {r["m"]: r for r in pairs.leave_one_out(f, "g", "m", "v").collect()}
    assert set(loo) == {1, 2, 3} and loo[1]["others_median"] == 7.5 and loo[3]["others_max"] == 6.0 and loo[3]["others_second"] == 5.0


def test_similar_pairs(spark):
    x = spark.createDataFrame([("a", 1, [7]), ("a", 2, [3]), ("a", 3, [8]), ("b", 4, [7]), ("a", 5, [0])], "g string, i int, b array<long>")
    assert rows(pairs.similar_pairs(x, "g", "i", "b", 0.5).select("item_1", "item_2")) == [(1, 2)]
    assert rows(pairs.similar_pairs(x, "g", "i", "b", 0.5, most_pairs=2)) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20, 1000])
def test_fraction_counts(n):
    for tr, va in ((0.7, 0.15), (0.9, 0.1), (0.5, 0.5), (0.1, 0.1)):
        a, b, c = splits.fraction_counts(n, tr, va)
        assert a + b + c == n and min(a, b, c) >= 0
        assert n < 3 or min(a, b, c) >= 1


def test_splits(spark):
    df = spark.range(103).withColumn("g", F.col("id") % 7)
    s = splits.random_split(df, "id")
    assert sorted(r["place"] for r in s.collect()) == list(range(1, 104))
    k = splits.k_folds(df, "id", 5)
    assert k.where("split_label = 'test'").groupBy("id").count().where("count <> 1").count() == 0
    sizes = {r[0]: r[1] for r in k.where("split_label = 'test'").groupBy("fold_id").count().collect()}
    assert sorted(sizes.values()) == [20, 20, 21, 21, 21]
    assert splits.leakage(splits.group_split(df, "id", "g").withColumnRenamed("group_key", "h"), "h").count() == 0
    with pytest.raises(ValueError):
        splits.group_split(df.where("g < 2"), "id", "g")


def test_clean(spark):
    assert clean.unique_names([" a", "a", "", None, "a"]) == ["a", "a__dup_1", "unnamed_column", "unnamed_column__dup_1", "a__dup_2"]
    df = spark.createDataFrame([("12.0", " x ", "nan")], "Key string, Name string, v string")
    got = clean.canonical(df, {"id": ["key"], "name": ["title"], "value": ["v"], "gone": ["g"]}, ["id"], {"value": "double"}).first()
    assert tuple(got) == ("12.0", "x", None, None)
    with pytest.raises(ValueError):
        clean.resolve_aliases(df.columns, {"q": ["z"]}, ["q"])
    keys = spark.createDataFrame([("12.0",), ("12",), (" 7 ",), ("a.0",), (None,)], "k string")
    assert [r[0] for r in keys.select(clean.merge_key(F.col("k"))).collect()] == ["12", "12", "7", "a.0", None]
    j = spark.createDataFrame([(None, 1, 2), (3, None, None)], "v_x int, v int, v_y int")
    assert sorted(r[0] for r in clean.coalesce_suffixes(j, ["v"]).collect()) == [1, 3]


def test_capped_is_greedy(spark):
    rng = random.Random(3)
    data = [(b, i, f"e{rng.randrange(6)}", f"g{rng.randrange(3)}") for b in "xy" for i in range(60)]
    got = set(rows(shortlist.capped(spark.createDataFrame(data, "b string, i int, e string, g string"), "b", ["i"], "e", "g", 2, 3)))
    want, seen = set(), {}
    for b, i, e, g in sorted(data):
        if seen.get((b, "e", e), 0) < 2 and seen.get((b, "g", g), 0) < 3:
            want.add((b, i, e, g))
            for k in ((b, "e", e), (b, "g", g)):
                seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_applicability(spark):
    ref = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    items = spark.createDataFrame([(1, 4.0, 5.0), (2, None, None)], "id int, a double, b double")
    got = {r["id"]: r for r in shortlist.applicability(items, ref, ["a", "b"]).collect()}
    assert got[1]["range_violations"] == 1 and got[1]["distance"] == 2.0 and got[2]["range_violations"] == 0 and got[2]["distance"] is None


def test_features(spark):
    df = spark.createDataFrame([("CCO",), ("CCO",), ("c1ccccc1[",), ("",), (None,)], "s string")
    got = {r["smiles"]: r for r in features.featurize(df, "s").collect()}
    assert got["CCO"]["ok"] and got["CCO"]["heavy_atoms"] == 3 and got["CCO"]["hetero"] == 1
    assert got["c1ccccc1["]["reason"] == "unbalanced" and got[""]["reason"] == "empty" and len(got) == 3


def test_ridge_per_group(spark):
    data = [("a", float(x), 2.0 * x + 1) for x in range(30)] + [("b", 1.0, 1.0)]
    got = models.ridge_per_group(spark.createDataFrame(data, "g string, x double, y double").repartition(3), "g", ["x"], "y", penalty=0.0).collect()
    assert len(got) == 1 and got[0]["weights"][0] == pytest.approx(2.0) and got[0]["intercept"] == pytest.approx(1.0)


def test_pipeline_and_batches(spark):
    df = spark.createDataFrame([(float(i), None if i % 5 == 0 else float(i % 3), "k" if i % 2 else "m", float(i) * 2) for i in range(40)], "a double, b double, c string, y double")
    fitted = models.fit_model(df, models.preprocessing(["a", "b"], ["c"]), models.regressors()["ridge"], "y")
    assert fitted.transform(df).where("prediction IS NOT NULL").count() == 40
    from pyspark import cloudpickle

    class Doubler:
        def predict(self, x):
            return x[:, 0] * 2

    got = models.predict_batches(df, cloudpickle.dumps(Doubler()), ["a", "b"], ["a", "c"])
    assert got.where("reason = 'missing_feature' AND score IS NULL").count() == 8 and got.where("score = 2 * a").count() == 32


def test_policies(spark):
    df = spark.createDataFrame([("Ki", 1), ("IC50", 2), (None, 3)], "t string, v int")
    assert quality.endpoint_policy(df, "t", "proceed").count() == 3 and quality.endpoint_policy(df, "t", "filter", ["Ki"]).count() == 1
    for policy, allowed in (("error", ()), ("filter", ["EC50"]), ("other", ())):
        with pytest.raises(ValueError):
            quality.endpoint_policy(df, "t", policy, allowed)
    assert quality.column_check(df, ["t", "w"], ["t"]) == [("w", "warning")]
    with pytest.raises(ValueError):
        quality.column_check(df, ["t", "w"], ["w"])
    assert {r["t"]: r["t_code"] for r in quality.binary_codes(df, "t").collect()} == {"IC50": 0, "Ki": 1, None: None}


def test_medians_of_repeated_measurements(spark):
    import statistics

    rng = random.Random(3)
    rows = [(g, rng.choice([None, *map(float, range(9))]), float(rng.randrange(5)), rng.choice(["a", "b", None])) for g in range(30) for _ in range(rng.randrange(1, 9))]
    got = {r["g"]: r for r in measures.aggregate_duplicates(spark.createDataFrame(rows, "g int, k double, p double, s string"), ["g"], "k", "p", {"n_s": "s"}).collect()}
    for g, r in got.items():
        mine = [x for x in rows if x[0] == g]
        k = [x[1] for x in mine if x[1] is not None]
        assert r["median_ki"] == (statistics.median(k) if k else None) and r["median_pki"] == statistics.median(x[2] for x in mine)
        assert r["n_s"] == len({x[3] for x in mine} - {None}) and r["n_records"] == len(mine)
    same = lambda rs: sorted(((r["g"], r["n_records"], r["median_ki"], r["median_pki"], r["n_s"], r["is_duplicate"], r["std_pki"] and round(r["std_pki"], 9)) for r in rs), key=str)
    for hot in (0, 4):
        assert same(measures.aggregate_duplicates(spark.createDataFrame(rows, "g int, k double, p double, s string"), ["g"], "k", "p", {"n_s": "s"}, hot_rows=hot).collect()) == same(got.values())


def test_value_ranges_keep_the_order(spark):
    rng = random.Random(5)
    vals = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, float("inf"), float("-inf"), 1e-300, -1e300, 4.999999999999999, 8.0, 7.999999999999999, *(rng.choice([1, -1]) * 10 ** rng.uniform(-12, 12) for _ in range(400))]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select("v", windows.value_bucket(F.col("v")).alias("b")).collect()
    order = sorted(got, key=lambda r: r["v"])
    assert all(x["b"] <= y["b"] for x, y in zip(order, order[1:])) and len({r["b"] for r in got}) > 200


def test_ranks_against_sorting(spark):
    rng = random.Random(6)
    data = [(g, rng.choice([None, *(x / 4 for x in range(-8, 30))]), i) for i, g in enumerate(rng.choices(["a", "b", None], k=400))]
    df = spark.createDataFrame(data, "g string, v double, i int")
    x = windows.with_place(windows.with_average_rank(df, "v", "r", ["g"]), "v", [F.col("i")], "p", "n", ["g"])
    for row in x.collect():
        mine = sorted((v, i) for g, v, i in data if g == row["g"] and v is not None)
        same = [k + 1 for k, (v, _) in enumerate(mine) if v == row["v"]]
        assert row["n"] == (len(mine) if same else None)
        assert (row["r"], row["p"]) == ((sum(same) / len(same), mine.index((row["v"], row["i"])) + 1) if same else (None, None))


def test_stepwise_areas(spark):
    rng = random.Random(7)
    data = [(g, rng.randrange(2), rng.choice([0.1, 0.4, 0.4, 0.9]), i) for i, g in enumerate("ab" * 40)] + [("c", 1, 0.5, 99)]
    got = {r["g"]: r for r in metrics.stepwise_areas(spark.createDataFrame(data, "g string, y int, s double, i int"), ["g"], "y", "s", ["i"]).collect()}
    for g in "ab":
        mine = [y for _, y, _, _ in sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[3]))]
        pos, neg, tp, roc, pr, last = sum(mine), len(mine) - sum(mine), 0, 0.0, 0.0, 1.0
        for n, y in enumerate(mine, 1):
            tp += y
            roc += 0 if y else tp / pos / neg
            pr += (tp / n + last) / 2 / pos if y else 0
            last = tp / n
        assert math.isclose(got[g]["roc_auc"], roc) and math.isclose(got[g]["pr_auc"], pr)
    assert got["c"]["roc_auc"] is None and got["c"]["pr_auc"] == 1.0


def test_models_that_cannot_be_loaded(spark):
    from pyspark import cloudpickle

    class Doubler:
        def predict(self, x):
            return x[:, 0] * 2

    good, failed = models.load_models({"double": cloudpickle.dumps(Doubler()), "broken": b"no pickle", "none": cloudpickle.dumps(3)})
    assert list(good) == ["double"] and sorted(failed) == ["broken", "none"] and "predict" in failed["none"]
    df = spark.createDataFrame([(1, 2.0), (2, None)], "i int, a double")
    got = models.predict_with_all(df, {"x": good["double"], "y": good["double"]}, ["a"], ["i"]).collect()
    assert sorted((r["model_name"], r["i"], r["score"], r["reason"]) for r in got if r["i"] == 1) == [("x", 1, 4.0, None), ("y", 1, 4.0, None)]


def test_structures_one_by_one(spark):
    from lodestrand.functions import chemistry

    def make():
        return lambda s: {"reason": None, "heavy_atom_count": len(s), "standardized_smiles": s.upper()} if s != "x" else 1 / 0

    got = {r["s"]: r for r in chemistry.per_structure(spark.createDataFrame([("a",), ("a",), ("x",), (None,), ("",)], "s string"), "s", make, chemistry.STANDARD).collect()}
    assert set(got) == {"a", "x", ""} and got["a"]["standardized_smiles"] == "A" and got["x"]["reason"] == "error:ZeroDivisionError" and got[""]["heavy_atom_count"] == 0
    assert [x.split()[0] for x in chemistry._fields(chemistry.GRAPH)] == ["atoms", "bonds", "n_atoms", "n_bonds", "reason"]


def test_family_rules_and_flags(spark):
    df = spark.createDataFrame([("p38-alpha",), ("DNA-PK",), ("Aurora/A",), ("xyz",), (None,)], "n string")
    got = [tuple(r) for r in df.select(labels.first_rule(labels.normalized_name(F.col("n"))).alias("r")).select("r.family", "r.provenance").collect()]
    assert got == [("CMGC", "name_match:P38"), ("PIKK", "name_match:DNA PK"), ("CAMK", "name_match:AUR"), ("Unclassified", "name_match:unclassified"), ("Unclassified", "name_match:unclassified")]
    f = spark.createDataFrame([(" Yes ",), ("0.5",), ("0",), ("no",), ("maybe",), (None,)], "f string")
    assert [tuple(r) for r in f.select(labels.truthy(F.col("f")), labels.strict_boolean(F.col("f"))).collect()] == [(True, True), (True, None), (False, False), (False, False), (False, None), (False, None)]
    x = spark.createDataFrame([(1, None, 3)], "b int, a int, c int")
    assert clean.ordered_columns(x, ["c", "z", "c"]).columns == ["c", "a", "b"]
    assert clean.with_defaults(x, {"a": 7, "d": "q"}).first().asDict() == {"b": 1, "a": 7, "c": 3, "d": "q"}
    assert x.select(clean.first_present_column(x, ["z", "a", "b"]).alias("v")).first()["v"] is None


def test_similar_pairs_by_prefix(spark):
    rng = random.Random(9)
    base = [sorted(rng.sample(range(256), 30)) for _ in range(12)]
    sets = [set(b) ^ set(rng.sample(range(256), rng.randrange(0, 6))) for b in base for _ in range(6)] + [set(), {1}, {1}]
    word = lambda x: x - 2**64 if x >= 2**63 else x
    rows = [("g" if i % 7 else "h", i, [word(sum(1 << b % 64 for b in s if b // 64 == w)) for w in range(4)]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "g string, i int, b array<long>")
    for least in (0.5, 0.8, 1.0):
        a, b = (sorted((r["item_1"], r["item_2"], round(r["similarity"], 9)) for r in pairs.similar_pairs(df, "g", "i", "b", least, prefix=p).collect()) for p in (False, True))
        want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (i % 7 == 0) == (j % 7 == 0) and len(sets[i] & sets[j]) >= least * max(1, len(sets[i] | sets[j]))]
        assert a == b and [x[:2] for x in a] == want
    assert pairs.similar_pairs(df.limit(0), "g", "i", "b", 0.8, prefix=True).count() == 0


def test_caps_against_one_pass(spark):
    rng = random.Random(10)
    rows = [(rng.choice("xy"), i, rng.choice("abc"), rng.choice("pq")) for i in range(300)]
    got = {(r["k"], r["o"]) for r in shortlist.capped(spark.createDataFrame(rows, "k string, o int, e string, g string"), "k", ["o"], "e", "g", 3, 5).collect()}
    want, seen = set(), {}
    for k, o, e, g in rows:
        if seen.get((k, "e", e), 0) < 3 and seen.get((k, "g", g), 0) < 5:
            want.add((k, o))
            for key in ((k, "e", e), (k, "g", g)):
                seen[key] = seen.get(key, 0) + 1
    assert got == want


def test_medians_and_running_sums_by_ranges(spark):
    import statistics

    rng = random.Random(12)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *(x / 8 for x in range(-20, 40))]), rng.randrange(5)) for _ in range(500)] + [("empty", None, 1)]
    df = spark.createDataFrame(data, "g string, v double, n int")
    got = {r["g"]: r["m"] for r in windows.medians(df, "v", "m", ["g"]).collect()}
    assert got == {g: statistics.median(v for h, v, _ in data if h == g and v is not None) for g in ("a", "b", None)}
    assert windows.medians(df, "v", "m").collect()[0]["m"] == statistics.median(v for _, v, _ in data if v is not None)
    one = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.sum("n").alias("n"))
    for r in windows.with_running_sums(one, "v", ["n"], ["g"]).collect():
        mine = [(v, n) for g, v, n in data if g == r["g"] and v is not None]
        assert r["run_n"] == sum(n for v, n in mine if v >= r["v"]) and r["all_n"] == sum(n for _, n in mine)
