"""Survivors against a plain ranking."""

import random

import pytest

from tarnwell.llm.survivors import survivors

SCHEMA = "g string, id long, t int, at double, width long, height long, size long, trust string, mask int, records int"


def test_equal_to_ranking(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        value = lambda: rng.choice([None, None, 1, 2, 3])
        rows.append((rng.choice(["hot", "hot", *"abcdefgh", None]), i, rng.choice([None, 1, 2, 3]), rng.choice([None, float("nan"), 1.0, 2.0]), value(), value(), value(), "x", 1, 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["g"]: tuple(r)[1:6] for r in survivors(df, "g", "id", "t", "at", ["width", "height", "size"]).select("g", "keeper_id", "width", "height", "size", "records").collect()}
    want = {}
    for g in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == g]
        late = lambda x: float("-inf") if x is None or x != x else x
        own.sort(key=lambda r: (-(r[2] if r[2] is not None else -9), -late(r[3]), r[1]))
        first = lambda k: next((r[k] for r in own if r[k] is not None), None)
        keeper = max(own, key=lambda r: sum(v is not None for v in r[4:7]))
        if len(own) > 1:
            want[g] = (keeper[1], first(4), first(5), first(6), len(own))
    assert got == want
    assert survivors(df.where("false"), "g", "id", "t", "at", ["width"]).count() == 0


def test_skyline_counts_undominated(spark):
    rows = [("g", 1, 5, 1.0, 1, None, None), ("g", 2, 4, 2.0, 1, None, None), ("g", 3, 4, 1.0, 1, None, None), ("g", 4, 1, 0.5, 1, 1, 1)]
    df = spark.createDataFrame(rows, "g string, id long, t int, at double, width long, height long, size long")
    row = survivors(df, "g", "id", "t", "at", ["width", "height", "size"]).head()
    assert (row["keeper_id"], row["skyline"], row["width"], row["size"]) == (4, 3, 1, 1)


def test_layers_fill_what_the_skyline_lacks(spark):
    rows = [
        ("g", 1, 5, 2.0, 7, 8, None),  # dominates all: most trusted and latest, and no record has more than two fields
        ("g", 2, 4, 1.0, 1, None, 30),  # second layer: fills the size
        ("g", 3, 3, 0.5, None, 2, 40),  # third layer
        ("one", 9, 1, 1.0, 1, 1, 1),
        ("h", 4, 5, 2.0, None, None, None), ("h", 5, 4, 1.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "g string, id long, t int, at double, width long, height long, size long")
    fields = ["width", "height", "size"]
    got = {r["g"]: r for r in survivors(df, "g", "id", "t", "at", fields, complete="number").collect()}
    g = got["g"]
    assert (g["keeper_id"], g["width"], g["height"], g["size"], g["skyline"], g["layers"]) == (1, 7, 8, 30, 1, 3)
    assert (got["h"]["keeper_id"], got["h"]["size"], got["h"]["records"]) == (4, None, 2) and "one" not in got
    sets = survivors(df.where("g = 'g'"), "g", "id", "t", "at", fields).head()
    assert (sets["keeper_id"], sets["size"], sets["skyline"], sets["layers"]) == (1, 30, 3, 1)


def layers_by_hand(rows, complete):
    """Pareto layers by definition, over all records of one group: (id, trust, at, values)."""
    left, layers = list(rows), []
    full = lambda s, r: all(a is not None or b is None for a, b in zip(s[3], r[3])) if complete == "fields" else sum(a is not None for a in s[3]) >= sum(b is not None for b in r[3])
    later = lambda s, r: (s[2], -s[0]) > (r[2], -r[0])
    while left:
        best = [r for r in left if not any(s is not r and full(s, r) and s[1] >= r[1] and later(s, r) for s in left)]
        layers.append(best)
        left = [r for r in left if r not in best]
    return layers


@pytest.mark.parametrize("complete", ["fields", "number"])
def test_layers_against_definition(spark, complete):
    rng = random.Random(9)
    rows = [(f"g{i % 12}", i, rng.randrange(1, 4), float(rng.randrange(4)), *(rng.choice([None, None, rng.randrange(1, 99)]) for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, id long, t int, at double, width long, height long, size long")
    for r in survivors(df, "g", "id", "t", "at", ["width", "height", "size"], complete).collect():
        layers = layers_by_hand([(x[1], x[2], x[3], x[4:]) for x in rows if x[0] == r["g"]], complete)
        rank = lambda x: (x[1], x[2], -x[0])
        keeper = max(layers[0], key=lambda x: (sum(v is not None for v in x[3]), rank(x)))
        want = []
        for i in range(3):
            offers = next(([x for x in layer if x[3][i] is not None] for layer in layers if any(x[3][i] is not None for x in layer)), [])
            want.append(max(offers, key=rank)[3][i] if offers else None)
        assert (r["keeper_id"], r["width"], r["height"], r["size"]) == (keeper[0], *want)
