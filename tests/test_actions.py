"""Plans of actions."""

from pyspark.sql import functions as F

from tarnwell.plans import actions
from tarnwell.plans.rules import parse_ruleset
from tarnwell.schema import DONE
from test_scan_state import images

PLACE = actions.Place("/out", "/trash", ("/l/sub", "/l"))


def rules(doubt="ignore"):
    return parse_ruleset({"rules": [
        {"name": "cat", "when": "cat"}, {"name": "big-dog", "when": "dog", "action": "move"}, {"name": "junk", "when": "owl", "action": "delete"},
        {"name": "none", "when": {"always": True}, "action": "ignore"}, {"name": "in-doubt", "when": {"in_doubt": True}, "action": doubt, "folder": "Review"},
    ]})


def plan(spark, rule_set, *rows):
    got = actions.plan_actions(images(spark, *[{"detect_state": DONE} | r for r in rows]), rule_set, PLACE)
    return sorted(tuple(r) for r in got.select("image_id", "seq", "action", "target").collect())


def test_kinds(spark):
    rows = [{"category": "cat"}, {"category": "big-dog"}, {"category": "junk", "path": "/l/sub/x/3.jpg"}, {"category": "none"}, {"category": "gone"}, {"category": None}, {"category": "cat", "missing": 1},
            {"category": "big-dog", "path": "/out/Big-Dog/8.jpg"}, {"category": "junk", "path": "/elsewhere/9.jpg"}]
    assert plan(spark, rules(), *rows) == [(1, 1, "copy", "/out/Cat/1.jpg"), (2, 1, "move", "/out/Big-Dog/2.jpg"), (3, 1, "delete", "/trash/x/3.jpg"), (9, 1, "delete", "/trash/9.jpg")]


def test_doubt(spark):
    rows = [{"category": "big-dog", "needs_review": 1}, {"category": "none", "needs_review": 1}, {"category": "cat"}]
    assert plan(spark, rules(), *rows) == [(1, 1, "move", "/out/Big-Dog/1.jpg"), (3, 1, "copy", "/out/Cat/3.jpg")]
    assert plan(spark, rules("copy"), *rows) == [(1, 0, "copy", "/out/Review/1.jpg"), (1, 1, "move", "/out/Big-Dog/1.jpg"), (2, 0, "copy", "/out/Review/2.jpg"), (3, 1, "copy", "/out/Cat/3.jpg")]
    assert plan(spark, rules("move"), *rows) == [(1, 0, "move", "/out/Review/1.jpg"), (2, 0, "move", "/out/Review/2.jpg"), (3, 1, "copy", "/out/Cat/3.jpg")]


def test_names(spark):
    names = ["a.jpg", "a.jpg", "a_2.jpg", "a_2_3.jpg", ".env", ".env", "b", "b", "x.tar.gz", "x.tar.gz"]
    rows = [{"category": "cat", "filename": n, "path": f"/l/{i}/{n}"} for i, n in enumerate(names)]
    taken, want = set(), []
    for i, n in enumerate(names, 1):  # one after the other
        import os

        stem, suffix = os.path.splitext(n)
        name = n if n not in taken else f"{stem}_{i}{suffix}"
        taken.add(name)
        want.append("/out/Cat/" + name)
    assert [t for *_, t in plan(spark, rules(), *rows)] == want


def test_links(spark):
    rows = images(spark, {"category": "cat", "detect_state": DONE}, {"category": "cat", "detect_state": DONE}, {"category": "big-dog", "detect_state": DONE})
    steps = actions.plan_actions(rows, rules(), PLACE)
    links = spark.createDataFrame([("/out/Cat/1.jpg", 1), ("/out/Cat/2.jpg", 9), ("/out/old.jpg", 1)], "link_path string, image_id long")
    assert {r["link_path"] for r in actions.stale_links(links, steps).collect()} == {"/out/Cat/2.jpg", "/out/old.jpg"}
    assert [r["link_path"] for r in actions.existing_links(links, steps).collect()] == ["/out/Cat/1.jpg"]
    assert {r["action"]: r["n"] for r in actions.dry_run(steps).collect()} == {"copy": 2, "move": 1}
    present = spark.createDataFrame([("/l/1.jpg",), ("/l/3.jpg",), ("/out/Cat/1.jpg",)], "path string")
    got = {r["image_id"]: r["outcome"] for r in actions.outcomes(steps, links, present).collect()}
    assert got == {1: "existing", 2: "skipped", 3: "done"}
    assert tuple(actions.verify(links, rows, present).head()) == (1, 2, 1)
    assert actions.links_of_root(links, rows, "/l").count() == 2 and actions.links_of_root(links, rows, "/m").count() == 0
    made = spark.createDataFrame([("/out/Cat/2.jpg", 2)], "link_path string, image_id long")
    assert {tuple(r) for r in actions.record_links(links, made).collect()} == {("/out/Cat/1.jpg", 1), ("/out/Cat/2.jpg", 2), ("/out/old.jpg", 1)}


def test_new_kind_of_action(spark):
    actions.register_action(actions.Action("frame", lambda place, folder: F.concat(F.lit("/wall/"), folder)))
    try:
        own = parse_ruleset({"rules": [{"name": "cat", "when": "cat", "action": "frame"}]})
        assert plan(spark, own, {"category": "cat"}) == [(1, 1, "frame", "/wall/Cat/1.jpg")]
    finally:
        del actions.ACTIONS["frame"]
