"""Hamming joins, components, keepers."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import similarity
from tarnwell.operators.near import near_bits

H = "id long, h long"


@pytest.mark.parametrize("distance", [1, 3, 10, 18])
def test_pairs_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    rows = [(i, rng.getrandbits(63)) for i in range(60)]
    for i in range(60, 120):
        h = rng.choice(rows)[1]
        for _ in range(rng.randrange(distance + 2)):
            h ^= 1 << rng.randrange(63)
        rows.append((i, h))
    df = spark.createDataFrame([*rows, (999, None)], H)
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items() if x < y and bin(x ^ y).count("1") <= distance}
    got = [(r["a"], r["b"]) for r in similarity.hamming_pairs(df, "id", "h", distance).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r["a"], r["b"]) for r in similarity.copies(df, "id", "h").collect()} == {(first[h], i) for i, h in rows if first[h] != i}
    assert similarity.hamming_pairs(df.where("false"), "id", "h", distance).count() == 0


def test_components_bridge_and_dismissals(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 5), (10, 11)], "a long, b long")
    got = {r["id"]: r["component"] for r in similarity.components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10}
    barred = spark.createDataFrame([(5, 4), (3, 1)], "image_id_a long, image_id_b long")
    left = similarity.without_dismissed(pairs, barred)
    assert {r["id"] for r in similarity.components(left).collect()} == {1, 2, 3, 9, 10, 11}
    assert similarity.components(pairs.where("false")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert similarity.components(chain).select("component").distinct().count() == 1


def test_keepers_keep_their_promise(spark):
    rng = random.Random(5)
    items, labels = [], []
    for i in range(60):
        items.append((i, rng.getrandbits(6), rng.randrange(3) or None, 2, rng.randrange(2)))
        labels.append((i, i % 3))
    df = spark.createDataFrame(items, "id long, h long, width int, height int, size long")
    got = similarity.keeper_groups(df, spark.createDataFrame(labels, "id long, component long"), 2).collect()
    by = {i: (h, (w or 0) * hh, s) for i, h, w, hh, s in items}
    want = set()
    for c in range(3):  # the same, one component at a time
        left = [i for i, _ in labels if i % 3 == c]
        while left:
            keeper = max(left, key=lambda i: (by[i][1], by[i][2], -i))
            taken = [i for i in left if bin(by[i][0] ^ by[keeper][0]).count("1") <= 2]
            if len(taken) > 1:
                want |= {(c, keeper, i) for i in taken}
            left = [i for i in left if i not in taken]
    assert {(r["component"], r["keeper"], r["id"]) for r in got} == want
    groups = spark.createDataFrame([tuple(r) for r in got], "component long, keeper long, id long, similarity double")
    assert similarity.ranked_groups(groups, 3).count() == 3


def test_selection_pairs(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 4)], "g long, m long")
    assert {tuple(r) for r in similarity.all_pairs(df, "g", "m").collect()} == {(3, 4), (3, 5), (4, 5)}
    assert similarity.choose_bands(10**6, 3) == 4 or similarity.choose_bands(10**6, 3) >= 2
    assert df.select(F.lit(1)).count() == 3


def brute_near(hashes, distance):
    known = sorted(set(hashes))
    return {(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance}


@pytest.mark.parametrize(("distance", "crowded"), [(1, 3), (3, 12), (4, 400)])
def test_near_bits_refines_crowds_to_any_depth(spark, distance, crowded):
    rng = random.Random(distance)
    flat = [sum(rng.getrandbits(1) << b for b in rng.sample(range(64), 5)) for _ in range(90)]  # nearly all bits alike
    low = [rng.getrandbits(7) for _ in range(60)]  # crowded until hardly a bit is left
    far = [rng.getrandbits(64) for _ in range(40)]
    far += [h ^ (1 << rng.randrange(64)) for h in far[:10]]
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in flat + low + far]
    df = spark.createDataFrame([*rows, (None,)], "h long")
    got = [tuple(r) for r in near_bits(df, "h", distance, crowded=crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near([r[0] for r in rows], distance)
    assert near_bits(df.where("false"), "h", distance).count() == 0


def test_probed_crowds_are_met_in_parts(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(10),) for _ in range(120)] + [(rng.getrandbits(63),) for _ in range(30)]
    classes = spark.createDataFrame(rows, "h long").distinct()
    got = [tuple(r) for r in similarity.probed_pairs(classes, 8, crowded=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near([r[0] for r in rows], 8)


def test_probes_are_bounded():
    for rows in (10, 10**6, 10**9, 10**12):
        for distance in (1, 3, 10, 18, 32):
            assert similarity._probes(similarity.choose_bands(rows, distance), distance) <= similarity.MOST_PROBES or distance > 24


def test_many_keepers_of_one_component_take_few_rounds(spark, monkeypatch):
    rng = random.Random(6)
    order = list(range(60))
    rng.shuffle(order)
    items = [(i, (1 << i) - 1, order[i] + 1, 1, 1) for i in range(60)]  # a chain: neighbours differ in one bit
    df = spark.createDataFrame(items, "id long, h long, width int, height int, size long")
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "id long, component long")
    tables = []
    real = similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, name: tables.append(name) or real(df, name))
    got = {(r["keeper"], r["id"]) for r in similarity.keeper_groups(df, labels, 1).collect()}
    left, want = set(range(60)), set()
    while left:
        keeper = max(left, key=lambda i: order[i])
        taken = {i for i in left if abs(i - keeper) <= 1}
        want |= {(keeper, i) for i in taken} if len(taken) > 1 else set()
        left -= taken
    assert got == want and tables.count("settled") < 8


def test_members_of_the_largest_groups_in_order(spark):
    groups = spark.createDataFrame([(1, 1, 1, 100.0), (1, 1, 2, 90.6), (1, 1, 3, 90.6), (5, 5, 5, 100.0), (5, 5, 6, 99.0)], "component long, keeper long, id long, similarity double")
    items = spark.createDataFrame([(1, "k"), (2, "b"), (3, "a"), (5, "x"), (6, "y")], "id long, filename string")
    marks = spark.createDataFrame([(2, "discard", 0.0)], "image_id long, mark string, created_at double")
    rows = similarity.group_members(groups, items, marks, 1).orderBy("place").collect()
    assert [(r["id"], r["mark"], r["n"], r["least"]) for r in rows] == [(1, None, 3, 90.6), (3, None, 3, 90.6), (2, "discard", 3, 90.6)]
