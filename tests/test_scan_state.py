"""Scans and the states of stages."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import reporting, scan, state
from tarnwell.schema import DONE, ERROR, PENDING, RUNNING, SKIPPED, TABLES

FILES = "path string, size long, mtime double"


def images(spark, *rows):
    """Rows of an index given as dicts."""
    base = {f.name: None for f in TABLES["images"].fields} | {"needs_review": 0, "detect_state": 0, "adjudicate_state": 0, "analyze_state": 0, "missing": 0, "deleted": 0}
    full = [base | {"id": i, "path": f"/l/{i}.jpg", "filename": f"{i}.jpg", "root": "/l"} | r for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[f.name] for f in TABLES["images"].fields) for r in full], TABLES["images"])


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_diff(spark):
    walk = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, 5.0), ("e", None, None), ("n", 1, 1.0)], FILES)
    index = spark.createDataFrame([("a", 1, 1.0000001), ("b", 1, 1.0), ("c", 1, 4.0), ("d", 1, 1.0), ("e", None, 0.0)], FILES)
    got = {r["path"]: r["status"] for r in scan.snapshot_diff(walk, index).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "missing", "e": "unchanged", "n": "added"}
    assert {r["status"]: r["n"] for r in scan.scan_tally(scan.snapshot_diff(walk, index.where("false"))).collect()} == {"added": 5}


def test_upsert(spark):
    old = images(spark, {"category": "cat", "needs_review": 1, "detect_state": DONE, "adjudicate_state": DONE, "analyze_state": DONE, "deleted": 1, "size": 1, "first_seen": 5.0}, {"category": "dog"})
    row = "path string, filename string, root string, hash string, phash string, size long, mtime double, width int, height int, format string, taken_at string"
    new = spark.createDataFrame([("/l/1.jpg", "x", "x", "h", "p", 9, 2.0, 1, 1, "JPEG", None), ("/l/z.jpg", "z.jpg", "/l", "h2", None, 3, 2.0, 1, 1, "JPEG", None), ("/l/y.jpg", "y.jpg", "/l", "h3", None, 3, 2.0, 1, 1, "JPEG", None)], row)
    got = by_id(scan.upsert(old, new, 100.0), "path", "size", "category", "adjudicate_state", "detect_state", "first_seen", "deleted", "filename")
    assert got == {
        1: ("/l/1.jpg", 9, None, DONE, PENDING, 5.0, 0, "1.jpg"), 2: ("/l/2.jpg", None, "dog", PENDING, PENDING, 100.0, 0, "2.jpg"),
        3: ("/l/y.jpg", 3, None, PENDING, PENDING, 100.0, 0, "y.jpg"), 4: ("/l/z.jpg", 3, None, PENDING, PENDING, 100.0, 0, "z.jpg"),
    }
    many = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("path"))
    numbers = scan.numbered(many.repartition(7), "path", 10).orderBy("path").collect()
    assert [r["id"] for r in numbers] == list(range(10, 1010))
    assert scan.numbered(many.where("false"), "path", 1).count() == 0


def test_missing_present_purge(spark):
    rows = images(spark, {}, {"root": "/m"}, {"deleted": 1})
    gone = scan.flag_missing(rows, "/l")
    assert by_id(gone, "missing") == {1: 1, 2: 0, 3: 1}
    back = scan.touch_present(gone, spark.createDataFrame([("/l/3.jpg",), ("/l/3.jpg",)], "path string"))
    assert by_id(back, "missing", "deleted") == {1: (1, 0), 2: (0, 0), 3: (0, 0)}
    boxes = spark.createDataFrame([(1, 1), (2, 3)], "id long, image_id long")
    pairs = spark.createDataFrame([(1, 2, 0.0), (2, 3, 0.0)], TABLES["dupe_dismissals"])
    left = scan.purge({"images": back, "detections": boxes, "dupe_dismissals": pairs}, F.col("missing") == 1)
    assert {n: t.count() for n, t in left.items()} == {"images": 2, "detections": 1, "dupe_dismissals": 1}
    assert scan.without_stale(boxes, back.where("id = 1")).count() == 1 == scan.stale_rows(boxes, back.where("id = 1")).count()
    assert [r[0] for r in scan.unconfigured_roots(rows, spark.createDataFrame([("/l",)], "root string")).collect()] == ["/m"]


def test_claims_and_recovery(spark):
    rows = images(spark, {"detect_state": DONE}, {}, {"missing": 1}, {"deleted": 1}, {}, {"detect_state": DONE, "needs_review": 1}, {"detect_state": DONE, "adjudicate_state": DONE, "action": "copy"}, {"detect_state": DONE, "adjudicate_state": RUNNING, "action": "copy"})
    assert [r["id"] for r in state.claim(rows, "detect", 2).collect()] == [2, 4]
    assert [r["id"] for r in state.claim(rows, "adjudicate", 9).collect()] == [6]
    assert [r["id"] for r in state.claim(rows, "analyze", 9).collect()] == [7]
    running = state.mark_running(rows, "detect", state.claim(rows, "detect", 2))
    assert by_id(running, "detect_state")[2] == RUNNING and reporting.in_flight(running, "detect")
    assert by_id(state.reset_running(running, "detect"), "detect_state") == by_id(rows, "detect_state")
    assert state.claim(rows.where("false"), "detect", 2).count() == 0


def test_queues(spark):
    d = {"detect_state": DONE}
    rows = images(spark, d | {"adjudicate_state": SKIPPED, "needs_review": 1, "action": "ignore"}, d | {"adjudicate_state": PENDING}, d | {"adjudicate_state": DONE, "needs_review": 1, "action": "copy"}, d | {"adjudicate_state": SKIPPED, "needs_review": 1, "missing": 1})
    assert by_id(state.sync_queues(rows), "adjudicate_state", "analyze_state") == {1: (PENDING, PENDING), 2: (SKIPPED, SKIPPED), 3: (DONE, PENDING), 4: (SKIPPED, SKIPPED)}


def test_results_errors_resets(spark):
    rows = images(spark, {"error": "x"}, {}, {"detect_state": ERROR, "analyze_state": ERROR, "error": "y"})
    decisions = spark.createDataFrame([(1, "cat", "copy", True), (2, "none", "ignore", False)], "image_id long, category string, action string, needs_review boolean")
    done = state.finish_detect(rows, decisions, 9.0)
    assert by_id(done, "detect_state", "adjudicate_state", "category", "needs_review", "error")[1] == (DONE, PENDING, "cat", 1, None)
    assert by_id(done, "adjudicate_state")[2] == SKIPPED and by_id(done, "detect_state")[3] == ERROR
    again = state.finish_adjudicate(done, decisions.where("image_id = 1").withColumn("needs_review", F.lit(False)), 10.0)
    assert by_id(again, "adjudicate_state", "needs_review")[1] == (DONE, 0)
    assert by_id(state.set_decisions(again, decisions, 11.0), "needs_review")[1] == 1
    assert by_id(state.finish_analyze(again, rows.where("id = 2"), 1.0), "analyze_state") == {1: 0, 2: DONE, 3: ERROR}
    failed = state.fail(rows, "detect", spark.createDataFrame([(2, "e" * 600)], "id long, message string"), 1.0)
    assert by_id(failed, "detect_state")[2] == ERROR and len(by_id(failed, "error")[2]) == 500
    assert state.retry_count(failed).head()[0] == 3
    assert by_id(state.retry_errors(failed), "detect_state", "error") == {1: (0, "x"), 2: (0, None), 3: (0, None)}
    assert by_id(state.retry_errors(failed, "analyze"), "detect_state", "analyze_state")[3] == (ERROR, PENDING)
    assert by_id(state.reset_stage(done, "detect"), "detect_state", "category", "adjudicate_state")[1] == (0, None, 0)
    assert by_id(state.reset_stage(done, "analyze"), "category", "analyze_state")[1] == ("cat", 0)


def test_moves_marks_dismissals(spark):
    rows = images(spark, {}, {})
    moved = state.relocate(rows, spark.createDataFrame([(1, "/out/Cat/n.jpg")], "id long, path string"), 1.0)
    assert by_id(moved, "path", "filename", "root")[1] == ("/out/Cat/n.jpg", "n.jpg", "/out/Cat") and by_id(moved, "path")[2] == "/l/2.jpg"
    assert by_id(state.mark_deleted(rows, rows.where("id = 2").select("id"), 1.0), "deleted") == {1: 0, 2: 1}
    none = spark.createDataFrame([], TABLES["dupe_dismissals"])
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "image_id_a long, image_id_b long")
    once = state.dismiss(none, pairs, 5.0)
    assert [tuple(r) for r in state.dismiss(once, pairs, 9.0).collect()] == [(1, 2, 5.0)]
    ids = spark.createDataFrame([(1,), (1,), (2,)], "image_id long")
    marks = state.set_marks(spark.createDataFrame([], TABLES["dupe_marks"]), ids, "keep", 1.0)
    assert marks.count() == 2 and state.set_marks(marks, ids.where("image_id = 1"), None, 2.0).count() == 1
    with pytest.raises(ValueError):
        state.set_marks(marks, ids, "maybe", 1.0)
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "image_id long, c string")
    fresh = spark.createDataFrame([(1, "z"), (1, "y")], "image_id long, c string")
    assert sorted(tuple(r) for r in state.replace_for_images(stored, fresh, fresh).collect()) == [(1, "y"), (1, "z"), (2, "b")]
    seen = spark.createDataFrame([(1,), (2,)], "image_id long")  # 2 was looked at again and shows nothing
    assert sorted(tuple(r) for r in state.replace_for_images(stored, fresh, seen).collect()) == [(1, "y"), (1, "z")]


def test_resets_log_and_budget(spark):
    rows = images(spark, {"detect_state": DONE, "category": "cat", "analyze_state": DONE})
    one = spark.createDataFrame([(1, 1)], "id long, image_id long")
    tables = {"images": rows, "detections": one, "adjudications": one, "metadata": one}
    count = lambda t: {n: d.count() for n, d in t.items()}
    assert count(state.reset(tables, "analyze")) == {"images": 1, "detections": 1, "adjudications": 1, "metadata": 0}
    everything = state.reset(tables)
    assert count(everything) == {"images": 1, "detections": 0, "adjudications": 0, "metadata": 0}
    assert by_id(everything["images"], "detect_state", "category", "analyze_state")[1] == (PENDING, None, PENDING)
    assert count(state.rebuilt(tables, "6", "7"))["images"] == 0 and count(state.rebuilt(tables, "7", "7"))["images"] == 1
    log = spark.createDataFrame([(4, 1, "move", "/x", 1.0)], TABLES["action_log"])
    more = spark.createDataFrame([(2, "delete", "/b"), (1, "move", "/a")], "image_id long, action string, detail string")
    assert by_id(state.append_log(log, more, 2.0), "image_id", "created_at") == {4: (1, 1.0), 5: (1, 2.0), 6: (2, 2.0)}
    assert [state.batch_size(16, b) for b in (None, 40, 5, 0, -1)] == [16, 16, 5, 0, 0]
