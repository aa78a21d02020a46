"""Groups of matching hashes against brute force."""

import random
from collections import defaultdict

import pytest

from tarnwell.llm import components as C


def brute(items, barred, distance=3):
    parent = {i: i for i, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (a, g) in enumerate(items):
        for b, h in items[x + 1 :]:
            if bin((g ^ h) & (2**64 - 1)).count("1") <= distance and (min(a, b), max(a, b)) not in barred:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    groups = defaultdict(list)
    for i in parent:
        groups[find(i)].append(i)
    return {(min(m), i) for m in groups.values() if len(m) > 1 for i in m}


@pytest.mark.parametrize("seed,share", [(0, 0.3), (1, 0.8), (2, 0.97), (3, 1.0)])
def test_groups_with_exceptions(spark, seed, share):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) - 2**63 for _ in range(12)]
    items = []
    for i in range(90):
        h = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 0, 0, 2])):
            h ^= 1 << rng.randrange(60)
        items.append((i, h))
    near = [(a, b) for a, g in items for b, h in items if a < b and bin((g ^ h) & (2**64 - 1)).count("1") <= 3]
    barred = {p for p in near if rng.random() < share}
    got = C.groups(spark.createDataFrame([*items, (500, None), (None, 5)], "id long, h long"), spark.createDataFrame(sorted(barred) or [(0, 0)], "id_a long, id_b long"))
    assert {tuple(r) for r in got.collect()} == brute(items, barred)


def test_copies_are_one_group_and_dismissals_count(spark):
    items = spark.createDataFrame([(i, 5) for i in range(300)] + [(1000, 7 << 40), (1001, (7 << 40) + 8)], "id long, h long")
    none = spark.createDataFrame([], "id_a long, id_b long")
    assert {r["group_id"] for r in C.groups(items, none).collect()} == {0, 1000}
    pair = C.excepted_pairs(spark.createDataFrame([(1001, 1000), (1000, 1001), (3, 3), (None, 1)], "a long, b long"), "a", "b")
    assert [tuple(r) for r in pair.collect()] == [(1000, 1001)]
    assert {r["group_id"] for r in C.groups(items, pair).collect()} == {0}
    assert C.groups(items.where("false"), none).count() == 0


@pytest.mark.parametrize("crowded", [20, 10_000])
def test_near_bits(spark, crowded):
    rng = random.Random(7)
    values = {rng.getrandbits(12) << 3 for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)}
    values |= {v ^ 7 for v in list(values)[:20]}
    df = spark.createDataFrame([(v, 1) for v in [*values, *values]] + [(None, 1)], "bits long, choice int")
    want = {(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 3}
    got = [tuple(r) for r in C.near_bits(df, "bits", crowded=crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_connected(spark):
    rng = random.Random(9)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(900, 900 - i) for i in range(40)] + [(None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert {r["vertex"]: r["component"] for r in C.connected(df, "a", "b").collect()} == {x: find(x) for x in parent}
    assert C.connected(df.where("false"), "a", "b").count() == 0


def test_heavy_clusters_are_joined_where_they_are(spark):
    links = [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["vertex"]: r["component"] for r in C.connected(df, "a", "b", heavy=10).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100, 102: 100}
