"""Near pairs are all found, whatever holds their runs."""

import random

from test_texts import distance, edited

from lodestrand.llm import near
from lodestrand.session import Workspace

LETTERS = "CNOSFclnos()=123[]@+"


def found_and_true(spark, texts, **sizes):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, record string")
    rows = near.near_records(df, Workspace(spark, "near"), **sizes).collect()
    assert all(r["distance"] == distance(texts[r["id_a"]], texts[r["id_b"]]) for r in rows[:200])
    got = sorted((r["id_a"], r["id_b"]) for r in rows)
    size = [*map(len, texts)]
    true = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if abs(size[i] - size[j]) * 10 <= max(size[i], size[j]) and distance(texts[i], texts[j]) * 10 <= max(size[i], size[j])]
    return got, true


def test_pairs_at_the_full_tenth(spark):
    rng = random.Random(11)
    texts = set()
    for _ in range(40):
        base = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60, 150)))
        # Also edits at even distances, which leave no equal run of 12.
        spread = list(base)
        for i in range(len(base) // 10):
            spread[5 + i * 10] = "#"
        texts |= {base, "".join(spread), *(edited(rng, base, len(base) // 10) for _ in range(3))}
    got, true = found_and_true(spark, sorted(texts))
    assert got == true and len(true) >= 120


def test_a_crowded_family(spark):
    rng = random.Random(12)
    base = "".join(rng.choice(LETTERS) for _ in range(60))
    texts = sorted({base, *(edited(rng, base, 3) for _ in range(80))})
    got, true = found_and_true(spark, texts)
    assert got == true and len(true) >= 1000
    # In many tasks, with salted digests, by a sample of a third.
    assert found_and_true(spark, texts, postings=100, sample=25) == (true, true)


def test_texts_of_any_kind(spark):
    rng = random.Random(14)
    long = "".join(rng.choice(LETTERS) for _ in range(900))
    uneven = "".join(rng.choice("aä€𝄞") for _ in range(60))
    texts = sorted({long, edited(rng, long, 80), edited(rng, long, 89), uneven, edited(rng, uneven, 5), "C" * 300, "C" * 290, "C" * 200, "C", "CC", "CN"})
    got, true = found_and_true(spark, texts)
    assert got == true and len(true) >= 4
    df = spark.createDataFrame([(1, None), (2, "")], "id long, record string")
    assert near.near_records(df, Workspace(spark, "near")).count() == 0


def test_roles(spark):
    base = "".join(random.Random(15).choice(LETTERS) for _ in range(100))
    rows = [(1, base, 1, 0), (2, base + "C", 0, 1), (3, base + "N", 2, 1), (4, base + "O", 0, 2), (5, base + "S", 0, 0), (6, base + "F", 0, -(2**63))]
    df = spark.createDataFrame(rows, "id long, record string, train long, other long")
    assert sorted((r["id_a"], r["id_b"]) for r in near.near_records(df, Workspace(spark, "near")).collect()) == [(1, 2), (1, 3), (3, 4)]


def test_short_structures_and_ends(spark):
    rng = random.Random(13)
    texts = set()
    for n in range(9, 45):
        base = "".join(rng.choice(LETTERS) for _ in range(n))
        mid = n // 2
        texts |= {base, base[:mid] + "#" + base[mid + 1 :], base[:mid] + "#" + base[mid:], base[:-1] + "#", base[1:]}
    got, true = found_and_true(spark, sorted(texts))
    assert got == true and len(true) >= 100
