"""Replies brought to shape, against the same in Python; search and summaries."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.operators import reporting, semantic


def python_coerce(data, classes):
    """The agreed shape of a reply, value by value."""

    def whole(v):
        try:
            return int(float(v))
        except (TypeError, ValueError, OverflowError):
            return 0

    def texts(v):
        v = [v] if isinstance(v, str) else v
        return [t for x in v if (t := (x if isinstance(x, str) else json.dumps(x)).strip())] if isinstance(v, list) else []

    out = {}
    for c in classes:
        out[f"{c}_count"], out[f"{c}_kinds"] = whole(data.get(f"{c}_count")), texts(data.get(f"{c}_kinds"))
    plain = lambda v: v.strip() if isinstance(v, str) else ""
    return out | {"activities": texts(data.get("activities")), "environment": plain(data.get("environment")), "is_main_subject": bool(data.get("is_main_subject")),
                  "quality": max(0, min(10, whole(data.get("quality")))), "notes": plain(data.get("notes"))}


def coerced(spark, texts, classes=("cat",)):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, json string")
    return {r["id"]: {k: v for k, v in r.asDict().items() if k != "id"} for r in semantic.coerced_replies(df, "id", "json", classes).collect()}


DATA = [
    {}, {"cat_count": "3", "cat_kinds": "tabby", "quality": 42}, {"cat_count": 2.9, "cat_kinds": [" a\t", "", "b"], "is_main_subject": "false"}, {"cat_count": None, "activities": None, "quality": -3},
    {"cat_count": True, "is_main_subject": 0, "environment": "  beach "}, {"is_main_subject": [], "notes": "x"}, {"is_main_subject": {"a": 1}, "cat_kinds": 5}, {"is_main_subject": "", "quality": "7.9"}, {"cat_count": "many"},
]


def test_coerce(spark):
    got = coerced(spark, [json.dumps(d) for d in DATA])
    assert [got[i] for i in range(len(DATA))] == [python_coerce(d, ["cat"]) for d in DATA]


def test_salvage(spark):
    texts = ['Sure: {"quality": 3} bye', "no", None, "", "[1]", '"x"', "{bad} {", '```json\n{"quality": 4}\n```', '{"quality": 5}', "null"]
    assert {i: r["quality"] for i, r in coerced(spark, texts).items()} == {0: 3, 7: 4, 8: 5}
    assert coerced(spark, []) == {}


value = st.one_of(st.none(), st.booleans(), st.integers(-20, 20), st.text("ab 1", max_size=4), st.lists(st.text("ab ", max_size=3), max_size=3))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from(["cat_count", "cat_kinds", "activities", "is_main_subject", "quality"]), value), min_size=1, max_size=12))
def test_coerce_anything(spark, data):
    got = coerced(spark, [json.dumps(d) for d in data])
    assert [got[i] for i in range(len(data))] == [python_coerce(d, ["cat"]) for d in data]


@pytest.mark.parametrize("said,want", [("present", "present"), (" YES ", "present"), ("no", "absent"), ("false", "absent"), ("none", "absent"), ("maybe", "unsure"), ("", "unsure"), (None, "unsure"), ("dunno", "unsure"), (True, "present")])
def test_verdicts(spark, said, want):
    text = json.dumps({"cat_verdict": said, "cat_confidence": "1.7"})
    got = spark.createDataFrame([(text,)], "t string").select(semantic.parse_verdicts(F.col("t"), ["cat", "dog"]).alias("v")).head()["v"]
    assert [tuple(v) for v in got] == [("cat", want, 1.0), ("dog", "unsure", 0.0)]
    one = spark.createDataFrame([(text, "cat"), (text, "dog"), (None, "cat"), ("prose", "cat")], "t string, c string")
    each = one.select(semantic.verdict_on(F.col("t"), F.col("c")).alias("v")).collect()
    assert [tuple(r["v"]) for r in each] == [("cat", want, 1.0), ("dog", "unsure", 0.0), ("cat", "unsure", 0.0), ("cat", "unsure", 0.0)]


def test_broken_verdicts(spark):
    got = spark.createDataFrame([("oops",), (None,)], "t string").select(semantic.parse_verdicts(F.col("t"), ["cat"]).alias("v")).collect()
    assert [[tuple(v) for v in r["v"]] for r in got] == [[("cat", "unsure", 0.0)]] * 2


def test_schemas():
    assert semantic.reply_schema(["cat"])["required"][:2] == ["cat_count", "cat_kinds"]
    assert semantic.verdict_schema(["cat"])["properties"]["cat_verdict"]["enum"] == ["present", "absent", "unsure"]
    assert semantic.reply_type(["cat"]).names[:2] == ["cat_count", "cat_kinds"]


def test_search_and_highlights(spark):
    images = spark.createDataFrame([(1, "a", "cat", 0), (2, "b", "dog", 1), (3, "c", None, 0)], "id long, path string, category string, missing int")
    texts = [(1, '{"cat_kinds": ["x", "y"], "activities": ["run"], "dog_kinds": []}'), (2, '{"notes": "RUN"}'), (3, r"a\b 100%~ RUN")]
    meta = spark.createDataFrame(texts, "image_id long, json string")
    ids = lambda term: [r["id"] for r in reporting.search(meta, images, term, 10).collect()]
    assert ids("run") == [1, 3] and ids("Run") == [1, 3] and ids("\\") == [3] and ids("~") == [3] and ids("100_~") == [3] and ids("zzz") == []
    rows = meta.select("image_id", semantic.highlights(meta, "json", ["dog", "cat"]).alias("h")).collect()
    assert [r["h"] for r in sorted(rows, key=lambda r: r["image_id"])] == [["cat: x, y", "run"], [], []]
