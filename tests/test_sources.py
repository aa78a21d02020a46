"""Listing files, settings, exports, providers and stages."""

import csv
import glob
import hashlib
import json
import os
import shutil
import struct

import pytest
from pyspark.sql import functions as F

from tarnwell.errors import RuleError
from tarnwell.operators import evidence, export, semantic
from tarnwell.plans import actions
from tarnwell.plans.rules import starter
from tarnwell.sources import effects, files, headers, providers, settings
from tarnwell.streaming import stages
from tarnwell.schema import DONE, ERROR, SKIPPED, TABLES
from test_scan_state import images


@pytest.fixture
def library(tmp_path):
    for name in ("a.jpg", "b.JPG", "sub/c.png", "sub/d.mp4", "_e.webp", "notes.txt", ".hidden/x.jpg", "output/y.jpg", "skip/z.jpg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    return str(tmp_path)


def test_walk_and_hash(spark, library):
    rows = files.list_files(spark, [library], excluded_paths=frozenset([library + "/skip"])).collect()
    assert sorted(os.path.relpath(r["path"], library) for r in rows) == ["_e.webp", "a.jpg", "b.JPG", "sub/c.png", "sub/d.mp4"]
    assert {r["root"] for r in rows} == {library} and all(r["size"] > 0 and r["mtime"] > 0 for r in rows)
    found = files.content_hashes(files.binary_files(spark, library)).collect()
    names = {os.path.basename(r["path"]): r["hash"] for r in found}
    assert set(names) == {"a.jpg", "b.JPG", "c.png", "d.mp4", "z.jpg"} and names["a.jpg"] == hashlib.sha256(b"a.jpg").hexdigest()
    assert files.list_files(spark, [library + "/none"]).count() == 0


def test_settings(tmp_path):
    rules = starter(["cat", "dog"])
    path = str(tmp_path / "x" / "rules.json")
    settings.save_rules(path, rules)
    assert settings.load_rules(path) == rules
    settings.write_atomically(path, "{")
    with pytest.raises(RuleError):
        settings.load_rules(path)
    env = settings.parse_env("# c\nexport A=1\nB='x y' \nC=z # note\nbad\n=3\nD=\n")
    assert env == {"A": "1", "B": "x y", "C": "z", "D": ""}
    s = settings.Settings({"A": " ", "L": "b, c"}, {"A": "7", "S": "JPG,.png", "F": "yes"})
    assert (s.number("A", 1), s.listed("L"), s.suffixes("S", ""), s.flag("F", False), s.flag("G", True), s.text("H", "d"), s.source("A"), s.source("H")) == (7, ["b", "c"], {".jpg", ".png"}, True, True, "d", "environment", "default")
    assert [settings.resolve_tag(*x) for x in (("m", ["m"]), ("m", ["m:latest", "mm"]), ("m", ["ma", "m:z", "m:8b"]), ("x:7b", ["x:8b", "xy:7b"]))] == ["m", "m:latest", "m:8b", "x:8b"]
    with pytest.raises(LookupError):
        settings.resolve_tag("llava", ["llava-llama3:8b"])


def test_exports(spark, tmp_path):
    rows = images(spark, {"category": "cat"}, {"category": "dog"}, {"missing": 1})
    boxes = spark.createDataFrame([(1, 1, "cat", 0.125), (2, 1, "dog", 0.9), (3, 1, "cow", 0.9)], "id long, image_id long, class string, confidence double")
    meta = spark.createDataFrame([(1, '{"a": "x, \\"y\\""}'), (2, "prose")], "image_id long, json string")
    records = export.records(rows, boxes, meta)
    export.write_json(records, str(tmp_path / "j"))
    got = sorted((json.loads(line) for f in glob.glob(str(tmp_path / "j/*.json")) for line in open(f)), key=lambda r: r["id"])
    assert [d["class"] for d in got[0]["detections"]] == ["dog", "cow", "cat"] and got[0]["metadata"] == {"a": 'x, "y"'} and got[1]["detections"] == []
    export.write_csv(records, str(tmp_path / "c"))
    lines = [r for f in glob.glob(str(tmp_path / "c/*.csv")) for r in csv.DictReader(open(f))]
    one = next(r for r in lines if r["id"] == "1")
    assert list(one) == export.CSV_COLUMNS and one["detections"] == "dog:0.90;cow:0.90;cat:0.12" and one["metadata"] == '{"a": "x, \\"y\\""}'
    assert export.records(rows, boxes, meta, "dog").count() == 1


def broken():
    """A class that workers get by value, as they can't import tests."""

    class Broken:
        model = "m"

        def detect(self, paths):
            raise OSError("no model")

    return Broken


def test_provider_failures_stay_with_their_rows(spark):
    rows = images(spark, {}, {"path": "/l/broken.jpg"})
    got = {r["id"]: r for r in providers.detect(rows, providers.FakeDetector).collect()}
    assert got[1]["error"] is None and got[2]["boxes"] is None and got[2]["error"] == "unreadable image"
    assert {r["error"] for r in providers.detect(rows, broken()).collect()} == {"no model"}
    hints = rows.select("id", "path", F.lit("cat (90%)").alias("hint"))
    assert json.loads(providers.describe(hints, providers.FakeDescriber).head()["reply"])["environment"] == "cat (90%)"


def agreeing():
    class Yes:
        model = "yes"

        def describe(self, path, hint):
            return json.dumps({f"{c}_{k}": v for c in hint.split(",") for k, v in (("verdict", "yes"), ("confidence", 0.9))})

    return Yes


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    rules = starter(["cat", "dog", "video"])
    rows = [{"path": f"/l/{i}{'.mp4' if i % 7 == 0 else '.jpg'}"} for i in range(1, 40)] + [{"path": "/l/broken.jpg"}, {"path": "/l/broken.mp4"}, {"missing": 1}]
    table = images(spark, *rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table.repartition(5).write.parquet(source)
    stages.run_detect(spark, source, out, rules, providers.FakeDetector, files_per_batch=2)
    decided = stages.read_results(spark, out, "decisions")
    boxes, batch, errors = stages.detected_batch(table, rules, providers.FakeDetector)
    key = lambda df: sorted(tuple(r) for r in df.select("image_id", "category", "action", "needs_review", "skip_analyze").collect())
    assert key(decided) == key(batch) and decided.count() == 40 and [r["id"] for r in errors.collect()] == [40]
    assert decided.where("skip_analyze").count() == 1 and stages.read_results(spark, out, "boxes").count() == boxes.count()
    before = decided.count()
    stages.run_detect(spark, source, out, rules, providers.FakeDetector, files_per_batch=2)
    assert stages.read_results(spark, out, "decisions").count() == before
    stages.run_adjudicate(spark, out, rules, agreeing())
    asked = evidence.uncertain_classes(stages.read_results(spark, out, "boxes"), rules)
    verdicts = stages.read_results(spark, out, "verdicts")
    assert {(r["image_id"], r["class"]) for r in verdicts.collect()} == {(r["image_id"], c) for r in asked.collect() for c in r["classes"]}
    assert not [r for r in stages.read_results(spark, out, "rechecked").join(asked, "image_id").collect() if r["category"] == "none" and set(r["classes"]) & {"cat", "dog"}]


def detected(spark, tmp_path, rules, count=40):
    """A folder in which detection has run over images of the paths /l/1.jpg, /l/2.jpg ..., every seventh a video."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    images(spark, *[{"path": f"/l/{i}{'.mp4' if i % 7 == 0 else '.jpg'}"} for i in range(1, count)]).repartition(5).write.parquet(source)
    stages.run_detect(spark, source, out, rules, providers.FakeDetector, files_per_batch=2)
    return out


def looking():
    """Agrees, but only where it is given the path of one of the images."""

    class Looks:
        model = "looks"

        def describe(self, path, hint):
            if not path.startswith("/l/"):
                raise OSError(path)
            number = int(path[3:-4])
            return json.dumps({f"{c}_{k}": v for c in hint.split(",") for k, v in (("verdict", "yes"), ("confidence", number / 1000))})

    return Looks


def test_second_opinion_is_given_the_path(spark, tmp_path):
    rules = starter(["cat", "dog", "video"])
    out = detected(spark, tmp_path, rules)
    stages.run_adjudicate(spark, out, rules, looking())
    asked = evidence.uncertain_classes(stages.read_results(spark, out, "boxes"), rules)
    want = {(r["image_id"], c, r["image_id"] / 1000) for r in asked.collect() for c in r["classes"]}
    got = {(r["image_id"], r["class"], r["verdict_confidence"]) for r in stages.read_results(spark, out, "verdicts").collect()}
    assert want and got == want


def test_second_opinion_does_not_depend_on_files(spark, tmp_path):
    """An image's boxes in many files, read one at a time, lead to what one recheck of all boxes says."""
    rules = starter(["cat", "dog", "video"])
    out = detected(spark, tmp_path, rules)
    for folder in glob.glob(f"{out}/boxes/batch=*"):
        rows = spark.read.parquet(folder).collect()
        spark.createDataFrame(rows, spark.read.parquet(folder).schema).repartition(7, "class", "confidence").write.parquet(folder + ".spread")
        shutil.rmtree(folder)
        os.rename(folder + ".spread", folder)
    stages.run_adjudicate(spark, out, rules, looking(), files_per_batch=1)
    boxes = stages.read_results(spark, out, "boxes").drop("batch").withColumn("id", F.monotonically_increasing_id())
    asked, verdicts = evidence.uncertain_classes(boxes, rules), stages.read_results(spark, out, "verdicts").drop("batch")
    key = lambda df: sorted(tuple(r) for r in df.select("image_id", "category", "action", "needs_review").collect())
    want = key(evidence.recheck(asked.select("image_id"), boxes, verdicts, rules))
    assert want and key(stages.read_results(spark, out, "rechecked").join(asked, "image_id", "left_semi")) == want
    assert verdicts.count() == verdicts.select("image_id", "class").distinct().count() > 0


def failing():
    """Agrees on images of even numbers and fails on others."""

    class Fails:
        model = "fails"

        def describe(self, path, hint):
            if int(path[3:-4]) % 2:
                raise OSError("no answer")
            return json.dumps({f"{c}_verdict": "yes" for c in hint.split(",")})

    return Fails


def test_failed_second_opinions_are_recorded(spark, tmp_path):
    rules = starter(["cat", "dog", "video"])
    out = detected(spark, tmp_path, rules)
    stages.run_adjudicate(spark, out, rules, failing())
    asked = {r["image_id"] for r in evidence.uncertain_classes(stages.read_results(spark, out, "boxes"), rules).collect()}
    odd = {i for i in asked if i % 2}
    assert odd and asked - odd
    assert {(r["id"], r["message"]) for r in stages.read_results(spark, out, "adjudicate_errors").collect()} == {(i, "no answer") for i in odd}
    assert {r["image_id"] for r in stages.read_results(spark, out, "rechecked").collect()} == asked - odd
    assert {r["image_id"] for r in stages.read_results(spark, out, "verdicts").collect()} == asked - odd


def describing():
    """Repeats path and hint; has prose for /l/3.jpg and fails on /l/6.jpg."""

    class Describes:
        model = "describes"

        def describe(self, path, hint):
            if path == "/l/6.jpg":
                raise OSError("no answer")
            return "a cat" if path == "/l/3.jpg" else json.dumps({"environment": hint, "notes": path, "cat_count": "2"})

    return Describes


def test_images_are_described(spark, tmp_path):
    rules = starter(["cat", "dog", "video"])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [{"path": f"/l/{i}{'.mp4' if i % 7 == 0 else '.jpg'}"} for i in range(1, 40)] + [{"path": "/l/broken.mp4"}, *[{"path": f"/l/{i}.jpg", "deleted": 1} for i in range(41, 60)]]
    images(spark, *rows).repartition(5).write.parquet(source)
    stages.run_detect(spark, source, out, rules, providers.FakeDetector, files_per_batch=2)
    first = {r["image_id"]: r for r in stages.read_results(spark, out, "decisions").collect()}
    doubtful = {i for i, r in first.items() if r["needs_review"]}

    def told():
        return sorted(r["image_id"] for r in stages.read_results(spark, out, "metadata").collect()), sorted(r["id"] for r in stages.read_results(spark, out, "analyze_errors").collect())

    wanted = lambda decided: {i for i, r in decided.items() if i < 40 and r["action"] != "ignore"}
    stages.run_analyze(spark, out, rules, describing(), files_per_batch=1)
    described, failed = told()
    assert sorted(described + failed) == sorted(wanted(first) - doubtful)
    stages.run_adjudicate(spark, out, rules, failing())
    last = first | {r["image_id"]: r for r in stages.read_results(spark, out, "rechecked").collect()}
    assert wanted(last) - wanted(first)  # rescued from ignore
    for _ in range(2):  # a restart adds nothing
        stages.run_analyze(spark, out, rules, describing(), files_per_batch=1)
        described, failed = told()
        assert sorted(described + failed) == sorted(wanted(last)) and set(failed) == wanted(last) & {3, 6} and failed
    hints = {r["image_id"]: r["hint"] for r in evidence.hints(stages.read_results(spark, out, "boxes").withColumnRenamed("seq", "id"), rules).collect()}
    for r in stages.read_results(spark, out, "metadata").collect():
        reply = json.loads(r["json"])
        assert (reply["notes"], reply["environment"], reply["cat_count"], r["model"]) == (rows[r["image_id"] - 1]["path"], hints.get(r["image_id"], ""), 2, "describes")
        assert not [k for k in reply if k.startswith("video")] and reply["dog_kinds"] == []


def test_runs_stop(spark):
    done, stopper = [], stages.Stopper()
    assert stages.run_all([lambda: done.append(1), lambda: 1 / 0, lambda: done.append(3)], stopper) == ["ZeroDivisionError: division by zero"] and done == [1, 3]
    with pytest.raises(ZeroDivisionError):
        stages.run_all([lambda: 1 / 0], stopper)
    assert stopper.stopped and stages.run_all([lambda: done.append(9)], stopper) == [] and 9 not in done


def filming():
    """Sees two cats in the second frame of a video; can't read broken ones."""

    class Films:
        model = "films"

        def detect(self, paths):
            return [[box("Dog", 0.9), box("dog", 0.1)] for _ in paths]

        def frames(self, path):
            return None if "broken" in path else [[box("cat", 0.95)], [box("cat", 0.5), box("Cat", 0.6), box("dog", 0.4)], []]

    def box(cls, confidence):
        return {"class": cls, "confidence": confidence, "x1": 0.126, "y1": 0.0, "x2": 9.0, "y2": 9.0}

    return Films


def test_frames_of_videos_are_merged(spark):
    rows = images(spark, {"path": "/l/a.jpg"}, {"path": "/l/b.mp4"}, {"path": "/l/broken.mp4"}).withColumn("is_video", F.col("path").endswith("mp4"))
    got = {r["id"]: r for r in providers.detect(rows, filming(), floor=0.3).collect()}
    seen = lambda i: [(b["class"], b["confidence"], b["x1"]) for b in got[i]["boxes"]]
    assert seen(1) == [("dog", 0.9, 0.13)] and seen(2) == [("cat", 0.5, 0.13), ("cat", 0.6, 0.13), ("dog", 0.4, 0.13)]
    assert got[3]["boxes"] is None and got[3]["error"] == "no readable frame"
    frames = [(1, n, b["class"].lower(), b["confidence"]) for n, f in enumerate(filming()().frames("x")) for b in f]
    merged = evidence.merge_frames(spark.createDataFrame(frames, "file_id long, frame int, class string, confidence double"))
    assert sorted((r["class"], r["confidence"]) for r in merged.collect()) == sorted((b["class"].lower(), b["confidence"]) for b in providers.merged_frames(filming()().frames("x")))


def test_stages_together_and_their_results_in_the_index(spark, tmp_path):
    rules = starter(["cat", "dog", "video"])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [{"path": f"/l/{i}{'.mp4' if i % 7 == 0 else '.jpg'}"} for i in range(1, 24)] + [{"path": "/l/broken.jpg"}, {"path": "/l/broken.mp4"}]
    table = images(spark, *rows)
    table.repartition(3).write.parquet(source)
    stopper = stages.Stopper()
    steps = [
        lambda: stages.run_detect(spark, source, out, rules, providers.FakeDetector, stopper, files_per_batch=1),
        lambda: stages.run_adjudicate(spark, out, rules, failing(), stopper),
        lambda: stages.run_analyze(spark, out, rules, describing(), stopper),
    ]
    assert stages.run_together(steps, stopper, pause=0.1) == []
    old = spark.createDataFrame([(7, 1, "cow", 0.5), (9, 24, "cow", 0.9)], "id long, image_id long, class string, confidence double")
    columns = "id long, image_id long, class string, confidence double, x1 double, y1 double, x2 double, y2 double, model string, created_at double"
    boxes = old.unionByName(spark.createDataFrame([], columns), allowMissingColumns=True)
    tables = {"images": table, "detections": boxes, "adjudications": spark.createDataFrame([], TABLES["adjudications"]), "metadata": spark.createDataFrame([], TABLES["metadata"])}
    after = stages.settle(spark, out, tables, 9.0)
    rows = {r["id"]: r for r in after["images"].collect()}
    first = {r["image_id"]: r for r in stages.read_results(spark, out, "decisions").collect()}
    asked = {r["image_id"] for r in evidence.uncertain_classes(stages.read_results(spark, out, "boxes"), rules).collect()}
    assert rows[24]["detect_state"] == ERROR and rows[24]["error"] == "unreadable image" and all(rows[i]["detect_state"] == DONE for i in first)
    assert {i for i in asked if rows[i]["adjudicate_state"] == DONE} == {i for i in asked if i % 2 == 0}
    assert {i for i in asked if rows[i]["adjudicate_state"] == ERROR} == {i for i in asked if i % 2} and any(i % 2 for i in asked)
    assert all(rows[i]["category"] == first[i]["category"] for i in first if i not in asked) and rows[25]["analyze_state"] == SKIPPED
    known = {r["image_id"]: r["class"] for r in after["detections"].where("class = 'cow'").collect()}
    assert known == {24: "cow"}  # 1 was looked at again, 24 couldn't be
    assert after["detections"].count() == after["detections"].select("id").distinct().count() == stages.read_results(spark, out, "boxes").count() + 1
    described = {r["image_id"] for r in after["metadata"].collect()}
    assert described and all(rows[i]["analyze_state"] == DONE for i in described)
    tally = {(r["stage"], r["kind"]): r["n"] for r in stages.stage_tally(spark, out).groupBy("stage", "kind").agg(F.sum("n").alias("n")).collect()}
    assert tally["detect", "category"] == len(first) and tally["detect", "error"] == 1 and tally["adjudicate", "error"] == sum(i % 2 for i in asked) and tally["analyze", "described"] == len(described)


def test_failures_of_stages_that_run_together(spark):
    done, stopper = [], stages.Stopper()
    assert stages.run_together([lambda: done.append(1), lambda: 1 / 0, lambda: done.append(3)], stopper, 0.01) == ["ZeroDivisionError: division by zero"] and {1, 3} <= set(done)
    with pytest.raises(ZeroDivisionError):
        stages.run_together([lambda: 1 / 0, lambda: done.append(2)], stopper, 0.01)
    assert stopper.stopped


def test_prompts_and_requests():
    prompt = semantic.description_prompt(["cat", "dog"], "cat (90%)")
    assert "cat or dog" in prompt and "cat (90%)" in prompt and "dog_kinds" in prompt and "detector" not in semantic.description_prompt(["cat"])
    asked = semantic.verdict_prompt(["cat"])
    assert "cat" in asked and all(v in asked for v in ("present", "absent", "unsure"))
    made = semantic.request("m", asked, semantic.verdict_schema(["cat"]), "AAAA")
    assert made["options"]["temperature"] == 0 and made["messages"][0]["images"] == ["AAAA"] and made["format"]["required"] == ["cat_verdict", "cat_confidence"]


def test_models_behind_a_chat_interface(spark, tmp_path):
    import http.server
    import threading

    asked = []

    class Chat(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            self.send_response(200 if body["messages"][0]["images"] == ["YQ=="] else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": '{"cat_verdict": "yes", "cat_confidence": 0.7}'}}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        (tmp_path / "a.jpg").write_text("a")
        (tmp_path / "b.jpg").write_text("b")
        rows = spark.createDataFrame([(1, str(tmp_path / "a.jpg"), "cat,dog"), (2, str(tmp_path / "b.jpg"), "cat"), (3, str(tmp_path / "none"), "cat")], "id long, path string, hint string")
        got = {r["id"]: r for r in providers.describe(rows, lambda: providers.judge(url, "m:1")).collect()}
        assert got[1]["reply"] and got[1]["error"] is None and got[1]["model"] == "m:1" and all(got[i]["reply"] is None and got[i]["error"] for i in (2, 3))
        assert providers.analyst(url, "m", ["cat"]).describe(str(tmp_path / "a.jpg"), "cat (90%)")
        assert asked[0][0] == "/api/chat" and "cat (90%)" in asked[-1][1]["messages"][0]["content"] and "cat_kinds" in asked[-1][1]["format"]["properties"]
    finally:
        server.shutdown()


def test_one_array_of_records(spark, tmp_path):
    rows = images(spark, {"category": "cat"}, {"category": "dog"}, {"missing": 1})
    boxes = spark.createDataFrame([(1, 2, "cat", 0.5)], "id long, image_id long, class string, confidence double")
    meta = spark.createDataFrame([(1, '{"a": 1}'), (2, "prose")], "image_id long, json string")
    path = str(tmp_path / "x.json")
    assert export.write_json_array(export.records(rows, boxes, meta), path) == 2
    first, second = json.load(open(path))
    assert (first["id"], first["metadata"], first["detections"], second["metadata"], second["detections"][0]["class"]) == (1, {"a": 1}, [], None, "cat")
    assert export.write_json_array(export.records(rows.where("false"), boxes, meta), path) == 0 and json.load(open(path)) == []


STEP = "image_id long, seq int, action string, source string, target string"


def test_carrying_out_a_plan(spark, library):
    out = library + "/made"
    steps = [(1, 0, "copy", library + "/a.jpg", out + "/Review/a.jpg"), (1, 1, "move", library + "/a.jpg", out + "/Cat/a.jpg"), (2, 1, "move", library + "/b.JPG", out + "/Cat/taken.jpg"), (3, 1, "copy", library + "/none.jpg", out + "/x.jpg")]
    os.makedirs(out + "/Cat")
    open(out + "/Cat/taken.jpg", "w").close()
    assert effects.why_not_writable(out) is None and effects.why_not_writable(library + "/a.jpg/x")
    plan = spark.createDataFrame(steps, STEP)
    with pytest.raises(effects.NotWritable):
        effects.execute(plan, [library + "/a.jpg/x"])
    results = effects.execute(plan, [out])
    results.write.parquet(out + "/.results")
    results = spark.read.parquet(out + "/.results")
    got = {(r["image_id"], r["action"]): (r["target"], r["outcome"]) for r in results.collect()}
    assert got == {(1, "copy"): (out + "/Review/a.jpg", "created"), (1, "move"): (out + "/Cat/a.jpg", "done"), (2, "move"): (out + "/Cat/taken_2.jpg", "done"), (3, "copy"): (out + "/x.jpg", "skipped")}
    assert os.path.exists(out + "/Cat/a.jpg") and os.path.exists(out + "/Review/a.jpg") and not os.path.exists(library + "/a.jpg")
    assert os.path.getsize(out + "/Cat/taken.jpg") == 0
    table = images(spark, {"path": library + "/a.jpg"}, {"path": library + "/b.JPG"}, {"path": library + "/none.jpg"})
    after = {r["id"]: r for r in effects.settle(table, results, 9.0).collect()}
    assert (after[1]["path"], after[1]["root"], after[1]["updated_at"]) == (out + "/Cat/a.jpg", out + "/Cat", 9.0) and after[2]["filename"] == "taken_2.jpg" and after[3]["path"].endswith("none.jpg")
    assert sorted(tuple(r) for r in effects.log_entries(results).collect()) == [(1, "move", out + "/Cat/a.jpg"), (2, "move", out + "/Cat/taken_2.jpg")]
    tally = {(r["outcome"], r["action"]): r["n"] for r in actions.apply_tally(results).collect()}
    assert tally == {("created", "copy"): 1, ("done", "move"): 2, ("skipped", "copy"): 1}
    assert effects.remove_file(out + "/Review/a.jpg") and not effects.remove_file(out + "/Review/a.jpg") and effects.drop_empty_folders(out) == 1
    stale = spark.createDataFrame([(out + "/Cat/taken.jpg",), (out + "/gone",)], "link_path string")
    assert {r["outcome"] for r in effects.remove_links(stale).collect()} == {"pruned"} and not os.path.exists(out + "/Cat/taken.jpg")
    assert effects.empty_tree(out)[0] >= 2 and os.listdir(out) == []


def test_an_action_only_does_what_it_says(spark, library):
    """A registered action doesn't touch the original unless its own effect does, and one without effect is refused."""
    plan = spark.createDataFrame([(1, 1, "frame", library + "/a.jpg", library + "/made/a.txt")], STEP)
    actions.register_action(actions.Action("frame", lambda place, folder: folder))
    try:
        with pytest.raises(ValueError, match="frame"):
            effects.execute(plan, [library])
        effects.register_effect("frame", writing())
        assert [tuple(r)[4:] for r in effects.execute(plan, [library]).collect()] == [(library + "/made/a.txt", "done")]
        assert os.path.exists(library + "/a.jpg") and open(library + "/made/a.txt").read() == "1"
    finally:
        del actions.ACTIONS["frame"]
        effects.EFFECTS.pop("frame", None)


def writing():
    def write(image_id, source, target):
        import os

        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w") as file:
            file.write(str(image_id))
        return target

    return write


def test_moves_never_overwrite(tmp_path):
    def made(name):
        (tmp_path / name).write_text(name)
        return str(tmp_path / name)

    target = str(tmp_path / "t" / "x.jpg")
    places = [effects.move_file(made(f"s{i}"), target, 7) for i in range(4)]
    assert [os.path.basename(p) for p in places] == ["x.jpg", "x_7.jpg", "x_7_2.jpg", "x_7_3.jpg"]
    assert [open(p).read() for p in places] == ["s0", "s1", "s2", "s3"]
    source = made("again")
    os.link(source, str(tmp_path / "t" / "y.jpg"))  # a task that was stopped between its two steps
    assert effects.move_file(source, str(tmp_path / "t" / "y.jpg"), 1) == str(tmp_path / "t" / "y.jpg") and not os.path.exists(source)
    other = made("other")
    assert effects._claim_elsewhere(other, str(tmp_path / "z")) and not effects._claim_elsewhere(other, str(tmp_path / "z")) and open(tmp_path / "z").read() == "other"


def test_discarding_what_is_marked(spark, library):
    table = images(spark, {"path": library + "/a.jpg"}, {"path": library + "/sub/c.png"}, {"path": library + "/lost.jpg"})
    marks = spark.createDataFrame([(1, "keep", 0.0), (2, "discard", 0.0), (3, "discard", 0.0)], "image_id long, mark string, created_at double")
    plan = effects.discard(table, marks, library + "/_Duplicates", (library,))
    effects.execute(plan, [library + "/_Duplicates"]).write.parquet(library + "/.r")
    results = spark.read.parquet(library + "/.r")
    after, left = effects.after_discard(table, marks, results, 5.0)
    assert {r["id"]: r["deleted"] for r in after.collect()} == {1: 0, 2: 1, 3: 1} and [r["image_id"] for r in left.collect()] == [1]
    assert os.path.exists(library + "/_Duplicates/sub/c.png") and os.path.exists(library + "/a.jpg")


def jpeg(width, height, date=None):
    parts = [b"\xff\xd8"]
    if date:
        entry = struct.pack("<HHII", 0x9003, 2, len(date) + 1, 44)
        tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0) + struct.pack("<H", 1) + entry + struct.pack("<I", 0)
        body = b"Exif\0\0" + tiff + date.encode() + b"\0"
        parts.append(b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body)
    parts.append(b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\0\0\0\xff\xd9")
    return b"".join(parts)


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 64, 48, 8, 2, 0, 0, 0) + b"\0\0\0\0" + struct.pack(">I4s", 0, b"IEND")
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (63).to_bytes(3, "little") + (47).to_bytes(3, "little")
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 64, 0) + struct.pack("<HHII", 257, 4, 1, 48) + b"\0\0\0\0"
    cases = {
        "PNG": png, "GIF": b"GIF89a" + struct.pack("<HH", 64, 48), "BMP": b"BM" + b"\0" * 16 + struct.pack("<ii", 64, -48), "WEBP": webp, "TIFF": tiff, "JPEG": jpeg(64, 48),
    }
    assert {k: headers.header(v) for k, v in cases.items()} == {k: (64, 48, k, None) for k in cases}
    assert headers.header(jpeg(640, 480, "2020:01:02 03:04:05")) == (640, 480, "JPEG", "2020:01:02 03:04:05")
    assert {headers.header(x) for x in (b"", b"text", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", jpeg(1, 1)[:9], b"II*\0\xff\xff\xff\xff")} == {headers.UNKNOWN}


def test_rows_of_a_scan(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(20, 10, "2020:01:02 03:04:05"))
    (tmp_path / "b.png").write_bytes(b"no picture")
    listed = files.list_files(spark, [str(tmp_path)])
    rows = {r["filename"]: r for r in files.file_rows(listed, bright()).collect()}
    a, b = rows["a.jpg"], rows["b.png"]
    assert (a["width"], a["height"], a["format"], a["taken_at"], a["phash"], a["error"]) == (20, 10, "JPEG", "2020:01:02 03:04:05", "0" * 16, None)
    assert a["hash"] == hashlib.sha256(jpeg(20, 10, "2020:01:02 03:04:05")).hexdigest()
    assert (b["width"], b["format"], b["phash"], b["hash"]) == (None, None, None, hashlib.sha256(b"no picture").hexdigest())
    os.remove(tmp_path / "b.png")
    assert {r["filename"] for r in files.file_rows(listed).where("error is not null").collect()} in ({"b.png"}, set())


def bright():
    return lambda path: list(range(72)) if path.endswith(".jpg") else 1 / 0


def test_listing_of_links_and_of_what_cannot_be_read(spark, tmp_path):
    root, other = tmp_path / "lib", tmp_path / "other"
    (root / "deep" / "er").mkdir(parents=True)
    other.mkdir()
    (root / "deep" / "er" / "a.jpg").write_text("a")
    (other / "b.jpg").write_text("b")
    os.symlink(other, root / "link")
    os.symlink(other, root / "folder.jpg")
    os.symlink(other / "b.jpg", root / "l.jpg")
    os.symlink(root, root / "deep" / "loop")
    os.symlink(tmp_path / "nowhere", root / "dead.jpg")
    names = lambda df: sorted(os.path.relpath(r["path"], root) for r in df.collect())
    assert names(files.list_files(spark, [str(root)])) == ["deep/er/a.jpg"]
    followed = names(files.list_files(spark, [str(root)], follow_links=True))
    assert "deep/er/a.jpg" in followed and "l.jpg" in followed and sum(f.endswith("b.jpg") for f in followed) == 1 and len(followed) == 3
    errors = files.list_files(spark, [str(root / "none")], with_errors=True).collect()
    assert len(errors) == 1 and errors[0]["error"]


def test_weights_classes_and_overlay(tmp_path):
    (tmp_path / "m.pt").write_text("")
    assert settings.find_weights("x/m.pt", [str(tmp_path)]) == str(tmp_path / "m.pt") and settings.find_weights("no.pt", []) == "no.pt"
    assert settings.class_ids({0: "Cat", 1: "dog", 2: "bus"}, ["CAT", "bus"]) == [0, 2]
    for wanted in ([], ["cow"]):
        with pytest.raises(ValueError):
            settings.class_ids({0: "cat"}, wanted)
    path = str(tmp_path / "o.json")
    assert settings.save_overlay(path, {"A": "1", "B": "2"}) == {"A": "1", "B": "2"} and settings.save_overlay(path, {"A": None, "C": "3"}) == {"B": "2", "C": "3"}
