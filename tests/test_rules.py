"""The condition language and rule sets."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarnwell.errors import RuleError
from tarnwell.operators import evidence
from tarnwell.plans import conditions
from tarnwell.plans.rules import Rule, RuleSet, parse_ruleset, starter
from tarnwell.plans.conditions import Band, Kind, Node, parse


@pytest.mark.parametrize(
    "node",
    [
        {}, {"clas": "cat"}, 3, None, {"class": ""}, {"class": "cat", "min_count": 0}, {"class": "cat", "min_count": True}, {"class": "cat", "extra": 1},
        {"class": "cat", "min_confidence": 1.5}, {"class": "cat", "min_confidence": 0.3, "min_review_confidence": 0.4}, {"class": "cat", "ollama_review": 1},
        {"all_of": []}, {"any_of": "cat"}, {"none_of": ["cat"], "x": 1}, {"any_detection": True, "ollama_review": True}, {"not": {"all_of": []}},
    ],
)
def test_bad_conditions(node):
    with pytest.raises(RuleError):
        parse(node)


def test_round_trip_and_words():
    node = {"all_of": ["cat", {"class": "dog", "min_count": 2, "min_confidence": 0.5}, {"not": {"any_of": ["bus", "car"]}}, {"none_of": [{"any_detection": True, "min_count": 3}]}]}
    tree = parse(node)
    assert parse(tree.to_json()) == tree
    assert tree.describe() == "cat and 2 or more dog (sure from 0.50) and all but [either bus or car] and none of 3 or more boxes of any class"
    assert parse({"always": False}).to_json() == {"always": True}
    assert parse("  CAT ").cls == "cat"


def test_bands_field_by_field():
    rules = parse_ruleset({"rules": [
        {"name": "a", "when": "cat"},
        {"name": "b", "when": {"class": "cat", "min_review_confidence": 0.1}, "enabled": False},
        {"name": "c", "when": {"class": "cat", "min_confidence": 0.8, "min_review_confidence": 0.2, "ollama_review": False}},
    ]})
    assert rules.bands() == {"cat": Band(0.8, 0.1, False)}
    assert not rules.needs_second_opinion() and rules.confidence_floor() == 0.1


def test_doubt_rule_is_once_and_last():
    rules = parse_ruleset({"rules": [{"name": "in-doubt", "when": "cat", "action": "copy"}, {"name": "x", "when": "cat"}]})
    assert rules.names == ["x", "in-doubt"] and rules.doubt.when == Node("in_doubt") and rules.doubt.folder == "_Review"
    assert parse_ruleset({"rules": []}).doubt.action == "move"


def test_validation():
    known = ["copy", "move", "delete", "ignore"]
    starter(["cat"]).validate(known, ["Cat", "dog"])
    for bad in (
        {"name": "x", "when": "cat", "action": "fly"},
        {"name": "in-doubt", "when": "cat", "action": "delete"},
        {"name": "x", "when": {"class": "cat", "min_confidence": 0.2}},
        {"name": "x", "when": "unicorn"},
    ):
        with pytest.raises(RuleError):
            parse_ruleset({"rules": [bad]}).validate(known, ["cat"])
    with pytest.raises(RuleError):
        parse_ruleset({"rules": [{"name": "x", "when": "cat"}, {"name": "x", "when": "dog"}]})
    with pytest.raises(RuleError):
        parse_ruleset({"rules": [{"name": "none", "when": {"always": True}}]}).detector_classes()
    for bad in ({"name": "", "when": "cat"}, {"name": "x"}, {"name": "x", "when": "cat", "folder": " "}, {"name": "x", "when": "cat", "to": 1}, []):
        with pytest.raises(RuleError):
            parse_ruleset({"rules": [bad]})


def test_all_problems_are_told_at_once():
    with pytest.raises(RuleError) as e:
        parse({"class": "", "min_count": 0, "colour": 1})
    assert all(x in str(e.value) for x in ("class", "min_count", "colour"))
    rules = parse_ruleset({"rules": [{"name": "x", "when": "unicorn", "action": "fly"}, {"name": "in-doubt", "when": "cat", "action": "delete"}]})
    assert len(rules.problems(["copy", "move", "delete", "ignore"], ["cat"])) == 3 and starter(["cat"]).problems(["copy", "move", "ignore"]) == []


def test_starter_order_and_folders():
    rules = starter(["dog", "cat", "video"])
    assert rules.names == ["cat-dog", "cat", "dog", "video", "none", "in-doubt"]
    assert rules.rules[0].target_folder == "Cat-Dog" and Rule("aB cD-eF", Node("always")).target_folder == "Ab cd-Ef"
    assert rules.moved("dog", -5).names[0] == "dog" and rules.moved("cat-dog", 99).names[-2] == "cat-dog"
    with pytest.raises(RuleError):
        rules.moved("in-doubt", -1)


def test_new_kind_of_condition(spark):
    from pyspark.sql import functions as F

    kind = Kind(lambda n: Node("even"), lambda n: {"even": True}, lambda n, counted: counted((None, 0.0)) % 2 == 0, lambda n: "even", lambda n: (None, 0.0))
    conditions.register_condition("even", kind)
    try:
        rules = parse_ruleset({"rules": [{"name": "pairs", "when": {"even": True}}]})
        boxes = spark.createDataFrame([(1, "cat", 0.1), (1, "dog", 0.2), (2, "cat", 0.1)], "image_id long, class string, confidence double")
        images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
        got = {r["image_id"]: r["category"] for r in evidence.decide(images, boxes, rules).select("image_id", F.col("category")).collect()}
        assert got == {1: "pairs", 2: "none", 3: "pairs"}
    finally:
        del conditions.KINDS["even"]


# A tiny evaluator in Python to hold the compiled columns against.
def matches(node: Node, boxes) -> bool:
    count = lambda cls, t: sum(1 for c, x in boxes if (cls is None or c == cls) and x >= t)
    kids = [matches(c, boxes) for c in node.children]
    return {
        "class": lambda: count(node.cls, node.threshold) >= node.min_count, "any_detection": lambda: count(None, node.threshold) >= node.min_count,
        "all_of": lambda: all(kids), "any_of": lambda: any(kids), "none_of": lambda: not any(kids), "not": lambda: not kids[0],
        "always": lambda: True, "in_doubt": lambda: False,
    }[node.kind]()


leaf = st.one_of(
    st.builds(lambda c, n, t: {"class": c, "min_count": n} | ({} if t is None else {"min_confidence": t, "min_review_confidence": 0.0}), st.sampled_from("abc"), st.integers(1, 2), st.sampled_from([None, 0.3, 0.5])),
    st.builds(lambda n, t: {"any_detection": True, "min_count": n} | ({} if t is None else {"min_confidence": t}), st.integers(1, 3), st.sampled_from([None, 0.2])),
    st.just({"always": True}),
)
tree = st.recursive(leaf, lambda x: st.one_of(st.builds(lambda k, c: {k: c}, st.sampled_from(["all_of", "any_of", "none_of"]), st.lists(x, min_size=1, max_size=3)), st.builds(lambda c: {"not": c}, x)), max_leaves=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(nodes=st.lists(tree, min_size=1, max_size=4), boxes=st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abc"), st.sampled_from([0.1, 0.3, 0.4, 0.65, 0.9])), max_size=15))
def test_compiled_rules_equal_evaluator(spark, nodes, boxes):
    rules = RuleSet(tuple(Rule(f"r{i}", parse(n)) for i, n in enumerate(nodes)))
    df = spark.createDataFrame([(i, c, x) for i, c, x in boxes], "image_id long, class string, confidence double")
    images = spark.createDataFrame([(i,) for i in range(6)], "image_id long")
    got = {r["image_id"]: (r["category"], r["needs_review"]) for r in evidence.decide(images, df, rules).collect()}
    bands = rules.bands()
    for i in range(6):
        own = [(c, x) for j, c, x in boxes if j == i]
        name = next((r.name for r in rules.ordinary if matches(r.when, own)), "none")
        tops = {c: max(x for d, x in own if d == c) for c, _ in own}
        doubt = any((b := bands.get(c, Band())).review_confidence <= x < b.confidence for c, x in tops.items())
        assert got[i] == (name, doubt)
