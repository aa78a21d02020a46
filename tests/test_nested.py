"""Nested replies to flat tables."""

import json
import time

import pytest

from tarnwell.functions.json_scan import _decode_deep, objects
from tarnwell.operators.nested import REPLY, Shredder, columns_of, shred, supertype, typed_table, variant_tables, variants

FRAME = {"at": 0.0, "subjects": [{"class": " Cat ", "kinds": ["tabby", {"name": " long coat ", "score": 0.5, "traits": ["wet"]}, {"name": " "}, None]}, None, {"count": 2}]}
NODES = [("frame", 0, -1, -1, ""), ("subject", 0, 0, -1, "cat"), ("kind", 0, 0, 0, "tabby"), ("kind", 0, 0, 1, "long coat"), ("subject", 0, 2, -1, "")]
PLAIN = json.dumps({"frames": [FRAME]})


def nodes(text):
    return [(n["node_type"], *n["positions"], n["node_name"]) for n in Shredder(REPLY).nodes([text]).to_pylist()[0]]


@pytest.mark.parametrize("text", [
    PLAIN, json.dumps({"frames": FRAME}), json.dumps({"FRAMES": [FRAME], "quality": 3}), "﻿" + PLAIN, "```json\n" + PLAIN + "\n```", "I see {this}: " + PLAIN + " -- end",
    json.dumps({"data": {"reply": {"frames": [FRAME]}}}), json.dumps({"quality": "high", "result": {"frames": [FRAME]}}), json.dumps({"response": PLAIN}), json.dumps(PLAIN), json.dumps({"message": {"content": "Sure. " + PLAIN}}),
    json.dumps([{"x": 1}, {"frames": [FRAME]}]), '{"a": NaN, "result": ' + PLAIN + "}", '{"result": ' + PLAIN,
])
def test_wrappings(text):
    assert nodes(text) == NODES


@pytest.mark.parametrize("text", [
    None, "", "  ", "I cannot see", "null", "[]", "{", PLAIN[:-1], PLAIN.replace('"', "'"), json.dumps({"frames": None}), json.dumps({"quality": 1}), json.dumps({"frames": "none", "x": 1}),
    PLAIN.replace("0.5", "NaN"), json.dumps({"frames": [None, 3, "x"]}), "[" * 5000 + "]" * 5000, '{"a":' * 3000,
])
def test_nothing(text):
    assert nodes(text) == []


def test_positions_and_oddities():
    text = json.dumps({"frames": [None, {"subjects": {"class": 5, "kinds": {"name": "x"}}}, {}]})
    assert nodes(text) == [("frame", 1, -1, -1, ""), ("subject", 1, 0, -1, ""), ("kind", 1, 0, 0, "x"), ("frame", 2, -1, -1, "")]


def test_any_depth_of_wrappers():
    for depth in (60, 64, 1_000, 30_000):
        assert nodes('{"x":[' * depth + PLAIN + "]}" * depth) == NODES, depth
    text = PLAIN
    for _ in range(12):
        text = json.dumps({"reply": text})
    assert nodes(text) == NODES


def test_broken_replies_take_linear_time():
    began = time.perf_counter()
    assert nodes('{"frames": [' + ", ".join(json.dumps({"at": i, "subjects": [{"class": "cat", "note": "{"}]}) for i in range(40_000))) == []
    assert nodes('{"a":' * 400_000) == [] == nodes('{"frames":[' * 200_000)
    assert nodes('{"x": "{", ' * 100_000) == []
    assert time.perf_counter() - began < 30


def test_objects_in_text():
    assert list(objects('a {"x": 1} b {"y": {"z": 2}} {"cut": {"whole": 3}, "n":')) == [{"x": 1}, {"y": {"z": 2}}, {"whole": 3}]
    assert list(objects('{"a": NaN, "b": [{"c": 1}, {"d": Infinity, "e": {"f": {}}}]}')) == [{"c": 1}, {"f": {}}]
    assert list(objects('{"NaN": "Infinity"}')) == [{"NaN": "Infinity"}]
    assert list(objects('{"a": "unclosed {"b": 1}')) == [{"b": 1}]
    assert list(objects('{"a": 1,} {"b": 01} {"c": "\t"} {"d": ' + "9" * 5000 + "}"))[0]["d"] == float("inf")


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\"y"], "b": {}, "c": [], "d": {"e": [[], {}]}}  rest', '[]', '{ }', '"x"', "[1,[2,[3]]]"])
def test_deep_decoder_reads_what_the_usual_one_reads(text):
    assert _decode_deep(text, 0) == json.JSONDecoder().raw_decode(text)


@pytest.mark.parametrize("text", ['{"a": 1,}', "[1,]", '{"a" 1}', "{a: 1}", "[1 2]", "[NaN]", "[01]", '["\n"]', "[", "{", '{"a":', "", "]"])
def test_deep_decoder_refuses(text):
    with pytest.raises(json.JSONDecodeError):
        _decode_deep(text, 0)


def test_variants_and_their_tables(spark):
    other = json.dumps({"frames": {"at": "1.5", "subjects": [{"class": "dog", "count": 2, "box": {"x1": 1, "y1": 2.5}, "kinds": None}, {"class": "dog", "count": "two"}]}})
    df = spark.createDataFrame([(1, PLAIN, 9), (2, None, 9), (1, PLAIN, 9), (3, "prose", 9), (4, other, 9)], "image_id long, json string, count long")
    found = shred(df, "json", ["image_id"])
    assert supertype(found).count() == 2 * len(NODES) + 3
    counts = {(r["node_type"], r["variant"]): r["n"] for r in variants(found).collect()}
    assert counts == {
        ("frame", "{at: number, subjects: object*}"): 2, ("frame", "{at: text, subjects: object*}"): 1, ("subject", "{class: text, kinds: object|text*}"): 2, ("subject", "{count: number}"): 2,
        ("subject", "{box.x1: number, box.y1: number, class: text, count: number}"): 1, ("subject", "{class: text, count: text}"): 1, ("kind", "text"): 2, ("kind", "{name: text, score: number, traits: text*}"): 2,
    }
    tables = variant_tables(found)
    assert {k: t.count() for k, t in tables.items()} == counts
    kinds = tables["kind", "{name: text, score: number, traits: text*}"].head()
    assert (kinds["frame_no"], kinds["subject_no"], kinds["kind_no"], kinds["node_name"], kinds["score"], kinds["traits"]) == (0, 0, 1, "long coat", 0.5, ["wet"])
    boxed = typed_table(found, "subject", "{box.x1: number, box.y1: number, class: text, count: number}").head()
    assert (boxed["image_id"], boxed["count"], boxed["box_x1"], boxed["box_y1"]) == (4, 2.0, 1.0, 2.5)
    assert columns_of("{at: number, x: list}") == {"at": "double", "x": "string"} and columns_of("text") == {} == columns_of("{}")
    assert {r["node_type"] for r in supertype(found).collect()} == {"frame", "subject", "kind"}


def test_edges(spark):
    df = spark.createDataFrame([(1, PLAIN, 9)], "image_id long, json string, variant long")
    assert shred(df, "json", ["variant"]).columns[0] == "variant_"
    assert shred(df.where("false"), "json", ["image_id"]).count() == 0
