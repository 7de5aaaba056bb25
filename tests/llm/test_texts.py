"""Overlaps, packing, leaks, abuse scores and varied subsets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import abuse, leaks, overlap, packing, varied_subset
from lodestrand.session import Workspace


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        op = rng.randrange(3)
        if op == 0:
            s[i] = rng.choice("CNOSF")
        elif op == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("CNOSF"))
    return "".join(s)


SPLIT = "task_name string, split_strategy string, split_id string, fold_id string, row_uid string, split_label string, compound_id string, standardized_smiles string, source_environment string, place string, label string, record string, id string"


def split_rows(spark, rows):
    return spark.createDataFrame([("t", " Scaffold", "h", "f", u, lab, c, s, None, "a", "b", "c", "d") for u, lab, c, s in rows], SPLIT)


def test_overlap_cases(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("CNOSFclnos()=123[]@+") for _ in range(100)).replace(".", "C")
    near, far = edited(rng, base, 4), edited(rng, base, 30)
    rows = [
        ("a", "train", "X1", base), ("b", " Validation", "x1 ", None), ("c", "TEST", None, base + ".Cl"), ("d", "test", "nan", near), ("e", "valid", "", far),
        ("f", "excluded", "X1", base), ("g", None, "X1", base), ("h", "train", None, None), ("i", "test", None, ""), ("j", "test", "Q", " " + base[:50] + " " + base[50:]), ("j", "test", "Q", base), (None, "test", "X1", base),
    ]
    df = split_rows(spark, rows)
    assert sorted(tuple(r) for r in overlap.cross_split_pairs(df).collect()) == [("a", x) for x in "bcdj"]
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0
    report = overlap.overlap_report(df).collect()
    assert [(r["n_rows"], r["n_overlapping"]) for r in sorted(report, key=lambda r: r["label"])] == [(5, 4), (2, 1)]


def test_a_family_is_one_class(spark):
    rng = random.Random(21)
    base = "".join(rng.choice("CNOSFclnos()=123[]@+") for _ in range(100))
    family = sorted({edited(rng, base, 3) for _ in range(40)})
    rows = [(f"r{i}", "train" if i % 2 else "test", None, s) for i, s in enumerate(family)] + [("x", "train", None, "zzz"), ("y", "test", None, "zzz"), ("z", "test", None, None)]
    got = {r["structure"]: r for r in overlap.structure_classes(split_rows(spark, rows)).collect()}
    assert set(got) == {*family, "zzz"} and {got[s]["class_structure"] for s in family} == {family[0]}
    assert all(got[s]["n_links"] == 20 for s in family) and (got["zzz"]["n_links"], got["zzz"]["n_rows"], got["zzz"]["class_structure"]) == (0, 2, "zzz")
    assert overlap.structure_classes(split_rows(spark, rows).limit(0)).count() == 0


def test_overlap_report(spark):
    base = "".join(random.Random(3).choice("CNOSFclnos()=123[]@+") for _ in range(100))
    half = base[:50] + "q" * 50
    rows = [("a", "train", "X1", base), ("b", "test", None, base), ("c", "test", "x1", half), ("d", "test", "X1", None), ("e", "test", "Y", "zzz")]
    (got,) = overlap.overlap_report(split_rows(spark, rows)).collect()
    assert (got["n_rows"], got["n_overlapping"]) == (4, 3) and 1.3 / 3 < got["mean_overlap"] < 1.55 / 3
    assert overlap.overlap_report(split_rows(spark, rows).limit(0)).count() == 0


def test_chunks_are_found_wherever_they_stand():
    a = "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    text, start, length, digest = overlap.content_chunks(pa.array([a, "zz" + a, "", "q", "ü" + a]))
    of = [set(digest[text == i]) for i in range(5)]
    assert len(of[0] & of[1]) >= len(of[0]) - 1 and len(of[0] & of[4]) >= len(of[0]) - 1 and set(text) == {0, 1, 3, 4}
    assert [int(length[text == i].sum()) for i in range(5)] == [80, 82, 0, 1, 81] and start[0] == 0
    names = {d: a[s : s + n] for d, s, n, i in zip(digest, start, length, text, strict=True) if i == 0}
    assert len(set(names.values())) == len(names)


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        h = np.zeros(65, np.int64)
        for n in rng.integers(1, 65, 7):
            h[n] += rng.integers(1, 9)
        lengths = np.flatnonzero(h)
        cost = lambda ends: sum(h[n] * 64 / (64 // min(e for e in ends if e >= n)) for n in lengths)
        got = packing.bucket_bounds(h, 64, 3)
        from itertools import combinations

        best = min(cost([*c, int(lengths[-1])]) for k in range(3) for c in combinations(lengths[:-1].tolist(), k))
        assert len(got) <= 3 and cost(got) == pytest.approx(best)
    assert packing.bucket_bounds(np.zeros(65, np.int64), 64, 3) == []


def fill(histogram, bounds, capacity):
    kinds = packing.plan_containers(histogram, bounds, capacity)
    containers = sum({k: t for k, _, t, _, _ in kinds}.values())
    assert all(sum(n * e for k, _, _, n, e in kinds if k == kind) <= capacity for kind in {k[0] for k in kinds})
    placed = np.zeros_like(histogram)
    for _, _, times, n, each in kinds:
        placed[n] += times * each
    assert (placed == histogram).all()
    return float((histogram * np.arange(len(histogram))).sum() / (containers * capacity))


def test_bucket_bounds_matter():
    rng = np.random.default_rng(4)
    for shape in (rng.lognormal(5.5, 1.0, 20_000), rng.uniform(1, 2048, 20_000), rng.normal(900, 300, 20_000)):
        h = np.bincount(np.clip(shape, 1, 2048).astype(int), minlength=2049)
        best = fill(h, packing.bucket_bounds(h, 2048, 16), 2048)
        one, other = fill(h, [2048], 2048), fill(h, [1400, 2048], 2048)
        assert best > one + 0.01 and best > other + 0.001
    # Inside a bucket no item of another bucket is taken as long as its own fit.
    h = np.zeros(101, np.int64)
    h[[60, 40, 30, 10]] = [2, 2, 2, 3]
    assert packing.plan_containers(h, [40, 60, 100], 100)[:2] == [(0, 1, 2, 60, 1), (0, 1, 2, 40, 1)]


def test_packing_is_whole_and_exact(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["kinase", "assay", "the", "Ki", "of", "7.3"]) for _ in range(rng.randrange(1, 120)))) for i in range(400)] + [(1000, "word " * 700), (1001, None), (1002, ""), (3, "same id again"), (3, "same id again")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, bucket int, part int")
    got = packing.pack(df, capacity=256, chunk_rows=100).collect()
    used = {}
    for r in got:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        assert 0 < r["n_tokens"] <= 256
    assert max(used.values()) <= 256
    counts = packing.token_counts(df).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    mine = {}
    for r in got:
        mine[r["doc_id"]] = mine.get(r["doc_id"], 0) + r["n_tokens"]
    assert mine == {d: n for d, n in counts if n}
    assert len(used) <= 1.03 * sum(used.values()) / 256 + 1
    long_parts = sorted((r["part"], r["first_token"]) for r in got if r["doc_id"] == 1000)
    assert [p for p, _ in long_parts] == list(range(len(long_parts))) and all(a == 256 * p for p, a in long_parts)
    assert packing.pack(df.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["Größe", "naïve", "x_1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "a a a a a a a a a a a a a a")]
    docs = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            src = items[rng.randrange(25)][1].split()
            k = rng.randrange(0, max(1, len(src) - 11))
            w[5:5] = src[k : k + rng.randrange(9, 16)]
        docs.append((i, rng.choice([" ", ", ", "_", "\n"]).join(w).upper()))
    docs += [(900, None), (901, ""), (902, "A a-a_a a.a a a a a a a a a"), (903, "a " * 11)]
    words = lambda t: __import__("re").findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(words(t)[i : i + 12]) for i in range(len(words(t)) - 11)}
    want = sorted((d, i) for d, x in docs for i, y in items if grams(x) & grams(y))
    df, it = spark.createDataFrame([(*d, 0) for d in docs + docs[:5]], "doc_id long, text string, pos int"), spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 1):
        index = leaks.LeakIndex(df.select("doc_id", "text"), it, Workspace(spark, "t"), broadcast_terms=most)
        got = sorted((r["doc_id"], r["item_id"]) for r in index.matches().collect())
        assert sorted(set(got)) == want
    assert leaks.LeakIndex(df.select("doc_id", "text").limit(0), it, Workspace(spark, "t")).matches().count() == 0
    assert leaks.LeakIndex(df.select("doc_id", "text"), it.limit(0), Workspace(spark, "t")).matches().count() == 0


def test_abuse_symbols():
    a, _, _ = abuse.encode(["d1$gu$t1ng"])
    b, _, _ = abuse.encode(["DISGUSTING"])
    assert a.tolist() == b.tolist()
    c, _, _ = abuse.encode(["hоrny"])  # a Cyrillic letter inside
    assert c.tolist() == abuse.encode(["horny"])[0].tolist()
    assert abuse.passages("you p a r a s i t e go") == ["you parasite go"] and abuse.passages(None) == [] and abuse.passages("  ") == []
    long = "x" * 950
    assert len("".join(p[:40] for p in abuse.passages(long))) >= 900


def test_kernel_is_the_inner_product():
    texts = ["abcdef", "abxcdef", "zzz", "qwertyabcd"]
    dense = np.zeros((4, abuse.FEATURES), np.float32)
    t, f, v = abuse._feature_rows(texts)
    dense[t, f] = v
    assert np.allclose(abuse._kernel(texts, abuse._feature_rows(texts), 4), dense @ dense.T, atol=1e-4)
    assert (dense @ dense.T)[0, 1] > 0 and (dense @ dense.T)[0, 2] == 0


def test_abuse_on_held_out_labels(spark):
    rng = random.Random(9)
    bad = ["you are a {} idiot and nobody likes you", "go away you {} moron", "shut up {} fool"]
    good = ["the {} assay was run at pH 7", "kill the {} process before you start", "the {} pump is a piece of junk", "we measured {} wells again"]
    fill = ["stupid", "useless", "lazy", "slow", "second", "blue", "broken", "first"]
    docs, labels = [], []
    for i in range(400):
        s = [rng.choice(good).format(rng.choice(fill)) for _ in range(6)]
        y = int(i % 4 == 0)
        if y:
            s[3] = rng.choice(bad).format(rng.choice(fill)).replace("idiot", rng.choice(["idiot", "1d1ot", "i d i o t", "id-iot"]))
        docs.append((i, ". ".join(s) + ".", "src" if i % 2 else None, "x"))
        if i < 250:
            labels.append((i, "r", None if i % 50 == 7 else y))
    docs += [(1000, None, "src", "x"), (1001, "", "src", "x")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, source string, score string"), spark.createDataFrame(labels, "doc_id long, rater string, abusive int")
    scored = {r["doc_id"]: r for r in abuse.score_documents(d, lab).collect()}
    assert len(scored) == 402 and not scored[1000]["abusive"] and scored[1001]["score"] == -10
    truth = {i: i % 4 == 0 for i in range(250, 400)}
    assert sum(scored[i]["abusive"] == y for i, y in truth.items()) >= 145
    assert abuse.score_documents(d, lab.limit(0)).where("abusive").count() == 0
    assert abuse.score_documents(d.limit(0), lab).count() == 0


SHORT = "entity_id string, murcko_scaffold string, rare_scaffold_flag int, final_strategic_score double, scaffold string, n int"


def test_varied_subset(spark):
    data = [(f"e{i}", "HOT" if i < 60 else f"C{i}N" * 3, 0 if i < 60 else 1, float(i % 7) if i % 5 else None, "q", 1) for i in range(100)]
    data += [("m1", None, None, None, "q", 1), ("m2", " nan", 0, 1.0, "q", 1), ("m3", "", 0, float("nan"), "q", 1), (None, "Z", 1, 1.0, "q", 1)]
    df = spark.createDataFrame(data, SHORT)
    got = varied_subset.varied_subset(df, 20).collect()
    assert len(got) == 20 == len({r["entity_id"] for r in got}) and len({r["murcko_scaffold"] for r in got}) == 20
    every = varied_subset.varied_subset(df, 60).collect()
    assert len(every) == 60 == len({r["entity_id"] for r in every}) and len({r["murcko_scaffold"] for r in every}) == 42
    assert varied_subset.varied_subset(df, 500).count() == 103
    assert varied_subset.varied_subset(df.limit(0), 5).count() == 0 and varied_subset.varied_subset(df, 0).count() == 0


def test_varied_subset_in_two_levels(spark):
    rng = random.Random(2)
    data = [(f"e{i}", "".join(rng.choice("CNOcn1()") for _ in range(20)), 0, 1.0, "q", 1) for i in range(1500)]
    got = varied_subset.varied_subset(spark.createDataFrame(data, SHORT).repartition(5), 300, entries=200).collect()
    assert len(got) == 300 == len({r["murcko_scaffold"] for r in got})


def test_feature_tree_is_balanced_and_whole():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (3000, 6))
    tree = varied_subset.FeatureTree(300, branching=8)
    for v in x:
        tree.add(1.0, v, float(v @ v))
    n, ls, ss = tree.entries()
    assert len(n) <= 300 and n.sum() == 3000 and np.allclose(ls.sum(0), x.sum(0)) and np.isclose(ss.sum(), (x**2).sum())

    def depths(node, at=0):
        assert 0 < node.size <= 8
        if node.kids is None:
            return {at}
        for i, kid in enumerate(node.kids):
            assert np.isclose(node.n[i], kid.total()[0]) and np.allclose(node.ls[i], kid.total()[1])
        return set().union(*(depths(kid, at + 1) for kid in node.kids))

    assert len(depths(tree.root)) == 1 and depths(tree.root) != {0}


def test_subset_covers_more_than_chance(spark):
    rng = random.Random(8)
    parts = ["c1ccccc1", "C(=O)N", "c1ccncc1", "CC(C)", "OCC", "S(=O)(=O)", "NC", "F"]
    crowded = ["".join(rng.choice(parts[:2]) for _ in range(9)) for _ in range(800)]
    other = ["".join(rng.choice(parts) for _ in range(9)) for _ in range(100)] + ["P" * i + "Br" * (9 - i) + "I" for i in range(9)]
    names = sorted({*crowded, *other})
    df = spark.createDataFrame([(f"e{i}", s, int(s in other), 1.0, "q", 1) for i, s in enumerate(names)], SHORT)
    v = varied_subset.scaffold_vectors(names, np.array([float(s in other) for s in names]))
    far = lambda chosen: ((v[:, None] - v[chosen][None]) ** 2).sum(2).min(1)
    got = varied_subset.varied_subset(df, 40, rows_per_task=100).collect()
    mine = far([names.index(r["murcko_scaffold"]) for r in got])
    chance = [far(rng.sample(range(len(names)), 40)) for _ in range(30)]
    assert len(got) == 40 and mine.mean() < np.mean([c.mean() for c in chance]) and mine.max() < np.mean([c.max() for c in chance])
    share = sum(s in other for s in names) / len(names)
    assert sum(r["rare"] for r in got) > 40 * share


def test_ward_finds_clusters():
    rng = np.random.default_rng(0)
    c = np.concatenate([rng.normal(m, 0.05, (20, 2)) for m in ((0, 0), (3, 0), (0, 3))])
    lab = varied_subset.ward(np.ones(60), c, 3)
    assert len(set(lab)) == 3 and all(len(set(lab[i : i + 20])) == 1 for i in (0, 20, 40))
