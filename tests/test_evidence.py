"""Second opinions, frames, videos and hints."""

from tarnwell.operators import evidence
from tarnwell.plans.rules import parse_ruleset
from pyspark.sql import functions as F

RULES = parse_ruleset({"rules": [{"name": "cats", "when": "cat"}, {"name": "dogs", "when": {"class": "dog", "ollama_review": False}}]})
BOXES = "id long, image_id long, class string, confidence double"
VERDICTS = "image_id long, class string, verdict string, verdict_confidence double"


def after(spark, boxes, verdicts):
    got = evidence.adjudicated(spark.createDataFrame(boxes, BOXES), spark.createDataFrame(verdicts, VERDICTS), RULES)
    return sorted((r["id"], r["confidence"]) for r in got.collect())


def test_verdicts(spark):
    boxes = [(1, 1, "cat", 0.9), (2, 1, "cat", 0.5), (3, 1, "cat", 0.5), (4, 1, "dog", 0.4), (5, 2, "cat", 0.2), (6, 2, "dog", 0.7)]
    assert after(spark, boxes, []) == [(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.4), (5, 0.2), (6, 0.7)]
    said = [(1, "cat", "present", 0.3), (1, "dog", "absent", 1.0), (2, "cat", "present", 0.8), (2, "dog", "absent", 1.0)]
    assert after(spark, boxes, said) == [(1, 0.9), (2, 0.65), (3, 0.5), (5, 0.8), (6, 0.7)]
    assert after(spark, boxes, [(1, "cat", "unsure", 1.0)]) == after(spark, boxes, [])
    assert after(spark, [], said) == []


def test_uncertain_and_decisions(spark):
    boxes = spark.createDataFrame([(1, 1, "cat", 0.5), (2, 1, "dog", 0.5), (3, 2, "cat", 0.5), (4, 2, "cat", 0.7), (5, 3, "owl", 0.35)], BOXES)
    assert {r["image_id"]: r["classes"] for r in evidence.uncertain_classes(boxes, RULES).collect()} == {1: ["cat"], 3: ["owl"]}
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "image_id long")
    got = {r["image_id"]: tuple(r)[1:] for r in evidence.decide(images, boxes, RULES).collect()}
    assert got == {1: ("none", "ignore", True), 2: ("cats", "copy", False), 3: ("none", "ignore", True), 4: ("none", "ignore", False)}
    nulls = spark.createDataFrame([(1, None, "cat", 0.9), (2, 1, None, 0.9), (3, 1, "cat", None)], BOXES)
    assert {r["category"] for r in evidence.decide(images, nulls, RULES).collect()} == {"none"}


def test_frames(spark):
    rows = [(1, 0, "cat", 0.9), (1, 1, "cat", 0.5), (1, 1, "cat", 0.4), (1, 2, "cat", 0.5), (1, 2, "cat", 0.1), (1, 2, "dog", 0.3), (2, 5, "cat", 0.1)]
    frames = spark.createDataFrame(rows, "file_id long, frame long, class string, confidence double")
    got = sorted((r["file_id"], r["class"], r["frame"], r["confidence"]) for r in evidence.merge_frames(frames).collect())
    assert got == [(1, "cat", 1, 0.4), (1, "cat", 1, 0.5), (1, "dog", 2, 0.3), (2, "cat", 5, 0.1)]
    assert evidence.merge_frames(frames.where("false")).count() == 0


def test_videos_and_samples(spark):
    paths = [("/a/b.MP4",), ("/a/.mp4",), ("/a/b.jpg",), ("/a.mov/b",), (None,), ("x.webm",)]
    df = spark.createDataFrame(paths, "p string").select(evidence.is_video(F.col("p")).alias("v"))
    assert [r["v"] for r in df.collect()] == [True, False, False, False, False, True]
    totals = spark.createDataFrame([(100,), (3,), (0,), (None,)], "n int").select(evidence.sampled_frames(F.col("n"), 4).alias("f"))
    assert [r["f"] for r in totals.collect()] == [[12, 37, 62, 87], [0, 1, 1], [], []]


def test_walked_frames(spark):
    df = spark.createDataFrame([(10.5, 35), (None, 100), (0.0, 30), (25.0, None)], "fps double, read int")
    got = df.select(evidence.walked_frames(F.col("fps"), F.col("read"), 3).alias("f")).collect()
    assert [r["f"] for r in got] == [[5, 15, 25], [12, 37, 62], [12], []]


def test_hints_round_like_exact_values(spark):
    boxes = spark.createDataFrame([(1, 1, "cat", 0.825), (2, 1, "dog", 0.995), (3, 1, "cat", 0.1), (4, 2, "cat", 0.2)], BOXES)
    assert {r["image_id"]: r["hint"] for r in evidence.hints(boxes, RULES).collect()} == {1: f"dog ({0.995:.0%}), cat ({0.825:.0%})"}
