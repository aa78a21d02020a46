"""The queries outside the llm subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import index, state_queries
from tarnwell.functions.hashes import hex16
from tarnwell.operators import evidence, export, reporting, scan, semantic, similarity, state
from tarnwell.oracles import ORACLES  # noqa: F401
from tarnwell.operators.moments import p2_clocks, p2_found
from tarnwell.operators.nested import p5_found, p5_subjects, p5_variants
from tarnwell.plans import actions
from tarnwell.plans.rules import parse_ruleset, starter
from tarnwell.tables import current_rows, read_table

#: Rules that use every kind of condition; the SQL below says the same by hand.
RULES = parse_ruleset(
    {
        "rules": [
            {"name": "pets", "when": {"all_of": ["cat", {"class": "dog", "min_confidence": 0.5, "min_review_confidence": 0.3}]}, "action": "copy"},
            {"name": "crowd", "when": {"class": "person", "min_count": 3, "min_confidence": 0.6}, "action": "move", "folder": "People"},
            {"name": "street", "when": {"all_of": [{"any_of": ["car", "bus", {"class": "bicycle", "min_confidence": 0.4}]}, {"not": "person"}]}, "action": "copy"},
            {"name": "cat", "when": "cat", "action": "copy"},
            {"name": "off", "when": {"class": "dog", "min_confidence": 0.9, "ollama_review": False}, "enabled": False},
            {"name": "quiet", "when": {"none_of": [{"any_detection": True, "min_confidence": 0.2}]}, "action": "ignore"},
            {"name": "busy", "when": {"any_detection": True, "min_count": 4}, "action": "delete"},
            {"name": "rest", "when": {"always": True}, "action": "ignore"},
        ]
    }
)
STARTER = starter(["cat", "dog", "video"])
PLACE = actions.Place("/out", "/trash", ("/lib",))


def _images(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return index.images(spark, d, *columns)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d, "missing").select(F.col("id").alias("image_id"))


def decide_first_match(spark: SparkSession, d: str) -> DataFrame:
    return evidence.decide(_ids(spark, d), index.boxes(spark, d), RULES).select("image_id", "category", "action")


def needs_review(spark: SparkSession, d: str) -> DataFrame:
    return evidence.decide(_ids(spark, d), index.boxes(spark, d), RULES).select("image_id", F.col("needs_review").cast("int").alias("needs_review"))


def uncertain_classes(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.uncertain_classes(index.boxes(spark, d), RULES)
    return found.select("image_id", F.array_join("classes", ",").alias("classes"))


def class_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = [(c, b.confidence, b.review_confidence, b.second_opinion) for c, b in RULES.bands().items()]
    return spark.createDataFrame(rows, "class string, confidence double, review_confidence double, second_opinion boolean")


def adjudicated_detections(spark: SparkSession, d: str) -> DataFrame:
    return evidence.adjudicated(index.boxes(spark, d), index.verdicts(spark, d), RULES)


def recheck(spark: SparkSession, d: str) -> DataFrame:
    live = _images(spark, d, "missing", "deleted", "detect_state").where("missing = 0 and deleted = 0 and detect_state = 2")
    decided = evidence.recheck(live.select(F.col("id").alias("image_id")), index.boxes(spark, d), index.verdicts(spark, d), RULES)
    return decided.withColumn("needs_review", F.col("needs_review").cast("int"))


def recheck_tally(spark: SparkSession, d: str) -> DataFrame:
    return recheck(spark, d).groupBy("category", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("needs_review").alias("doubtful"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    return events.select(
        F.col("user_id").alias("file_id"), (F.col("event_id") % 8).alias("frame"), F.col("event_id").alias("seq"), F.col("event_type").alias("class"),
        (F.least("value", F.lit(100.0)) / 100.0).alias("confidence"),
    )


def merge_frames(spark: SparkSession, d: str) -> DataFrame:
    return evidence.merge_frames(_frames(spark, d))


def frames_by_strength(spark: SparkSession, d: str) -> DataFrame:
    return evidence.by_strength(evidence.merge_frames(_frames(spark, d))).select("file_id", "class", "place").distinct()


def video_boxes(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d, "path").select(F.col("id").alias("image_id"), "path")
    marked = evidence.with_video_class(index.boxes(spark, d), images.where(evidence.is_video(F.col("path"))))
    return marked.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))


def frame_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").select("p_partkey", "p_size")
    return rows.select("p_partkey", F.array_join(evidence.sampled_frames(F.col("p_size"), 8), ",").alias("frames"), evidence.middle_frame(F.col("p_size")).alias("middle"))


def detection_hints(spark: SparkSession, d: str) -> DataFrame:
    return evidence.hints(index.boxes(spark, d), RULES)


def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d, "missing", "deleted", "detect_state", "adjudicate_state", "analyze_state", "needs_review", "action")
    return reporting.pipeline_counts(rows, state_queries.links(spark, d))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.category_counts(_images(spark, d, "missing", "category"))


def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.action_counts(_images(spark, d, "missing", "action"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.class_counts(index.boxes(spark, d))


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.verdict_counts(index.verdicts(spark, d))


def distinct_roots(spark: SparkSession, d: str) -> DataFrame:
    return reporting.distinct_roots(_images(spark, d, "root"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return reporting.exact_duplicates(_images(spark, d, "missing", "hash", "path"))


def duplicate_listing(spark: SparkSession, d: str) -> DataFrame:
    return reporting.largest_duplicate_groups(_images(spark, d, "missing", "hash", "path"), 20)


def document_duplicates(spark: SparkSession, d: str) -> DataFrame:
    texts = read_table(spark, d, "documents").where("text is not null")
    rows = texts.select(F.lit(0).alias("missing"), F.sha2("text", 256).alias("hash"), F.col("doc_id").cast("string").alias("path"))
    return reporting.exact_duplicates(rows)


def _embedding_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    bits = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))
    return rows.select("vec_id", bits.alias("bits"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.hamming_pairs(_embedding_bits(spark, d), "vec_id", "bits", 18)


def similarity_components(spark: SparkSession, d: str) -> DataFrame:
    hashes = _embedding_bits(spark, d)
    pairs = similarity.hamming_pairs(hashes, "vec_id", "bits", 18).select("a", "b")
    return similarity.components(pairs.unionByName(similarity.copies(hashes, "vec_id", "bits")))


def _photos(spark: SparkSession, d: str) -> DataFrame:
    return _embedding_bits(spark, d).select(F.col("vec_id").alias("id"), F.col("bits").alias("h"), (F.col("vec_id") % 7).alias("width"), F.lit(10).alias("height"), F.lit(1).alias("size"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return similarity.keeper_groups(_photos(spark, d), similarity_components(spark, d), 18)


def largest_groups(spark: SparkSession, d: str) -> DataFrame:
    items = _photos(spark, d).select("id", F.concat(F.lit("f"), (F.col("id") % 10).cast("string")).alias("filename"))
    marks = items.where("id % 3 = 0").select(F.col("id").alias("image_id"), F.lit("keep").alias("mark"))
    return similarity.group_members(duplicate_groups(spark, d), items, marks, 10).select("keeper", "n", "least", "place", "id", "mark")


def dhash_bits(spark: SparkSession, d: str) -> DataFrame:
    from tarnwell.functions.hashes import difference_hash

    rows = read_table(spark, d, "embeddings").select("vec_id", F.concat("embedding", F.slice("embedding", 1, 8)).alias("pixels"))
    return rows.select("vec_id", hex16(difference_hash("pixels")).alias("dhash"))


def _claim(stage: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return state.claim(_images(spark, d, "path", "missing", "deleted", "needs_review", "action", "detect_state", "adjudicate_state", "analyze_state"), stage, 32)

    return query


def sync_queues(spark: SparkSession, d: str) -> DataFrame:
    columns = ("missing", "deleted", "needs_review", "action", "detect_state", "adjudicate_state", "analyze_state")
    return state.sync_queues(_images(spark, d, *columns)).select("id", "adjudicate_state", "analyze_state")


def retry_count(spark: SparkSession, d: str) -> DataFrame:
    return state.retry_count(_images(spark, d, "detect_state", "adjudicate_state", "analyze_state"))


def stale_detections(spark: SparkSession, d: str) -> DataFrame:
    changed = _images(spark, d, "needs_review").where("needs_review = 1")
    return scan.stale_rows(index.boxes(spark, d), changed).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def _planned(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d, "path", "filename", "missing", "deleted", "detect_state")
    decided = evidence.decide(images.select(F.col("id").alias("image_id")), index.boxes(spark, d), RULES)
    rows = images.join(decided.withColumnRenamed("image_id", "id").withColumn("needs_review", F.col("needs_review").cast("int")), "id")
    return actions.plan_actions(rows, RULES, PLACE)


def plan_actions(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d)


def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return actions.dry_run(_planned(spark, d))


def prune_links(spark: SparkSession, d: str) -> DataFrame:
    return actions.stale_links(state_queries.links(spark, d), _planned(spark, d))


def existing_links(spark: SparkSession, d: str) -> DataFrame:
    return actions.existing_links(state_queries.links(spark, d), _planned(spark, d))


def apply_tally(spark: SparkSession, d: str) -> DataFrame:
    present = _images(spark, d, "path", "size").where("size > 0").select("path")
    return actions.apply_tally(actions.outcomes(_planned(spark, d), state_queries.links(spark, d), present))


def plan_preview(spark: SparkSession, d: str) -> DataFrame:
    return reporting.preview(_planned(spark, d), 50)[1]


def starter_decisions(spark: SparkSession, d: str) -> DataFrame:
    marked = evidence.with_video_class(index.boxes(spark, d), _images(spark, d, "path").where(evidence.is_video(F.col("path"))).select(F.col("id").alias("image_id"), "path"))
    return evidence.decide(_ids(spark, d), marked, STARTER).select("image_id", "category", "action")


def rule_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the readers of rules say of some rule sets: names in order, classes, floor, second opinions, folders, problems."""
    table = []
    sets = {"starter": STARTER, "moved": STARTER.moved("dog", -5), "far": STARTER.moved("cat-dog", 99), "all kinds": RULES, "none": parse_ruleset({"rules": []})}
    sets["bad"] = parse_ruleset({"rules": [{"name": "x", "when": {"class": "unicorn", "min_confidence": 0.2}, "action": "fly"}, {"name": "in-doubt", "when": "cat", "action": "delete"}]})
    for name, rules in sets.items():
        known = sorted(rules.required_classes())
        folders = ",".join(r.target_folder for r in rules.rules)
        problems = len(rules.problems(actions.ACTIONS, ["cat", "dog", "video", "person", "car", "bus", "bicycle"]))
        again = parse_ruleset(rules.to_json()) == rules
        table.append((name, ",".join(rules.names), ",".join(known), rules.confidence_floor(), rules.needs_second_opinion(), folders, problems, again))
    return spark.createDataFrame(table, "name string, rules string, classes string, floor double, asks boolean, folders string, problems int, round_trip boolean")


def _current_metadata(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(read_table(spark, d, "metadata"), "image_id", "created_at", ["json"])


def search_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = reporting.search(_current_metadata(spark, d), _images(spark, d, "path", "category", "missing"), "Kitchen")
    return found.select("id", "path", "category")


def coerce_reply(spark: SparkSession, d: str) -> DataFrame:
    rows = semantic.coerced_replies(_current_metadata(spark, d), "image_id", "json", ["bird", "cat", "dog"])
    lists = [c for c, t in rows.dtypes if t == "array<string>"]
    return rows.withColumns({c: F.array_join(c, "|") for c in lists})


def parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    replies = read_table(spark, d, "adjudications").select("id", "verdict", "confidence").dropDuplicates(["id"])
    text = F.to_json(F.struct(F.col("verdict").alias("cat_verdict"), F.col("confidence").alias("cat_confidence")))
    parsed = replies.select("id", F.explode(semantic.parse_verdicts(F.concat(F.lit("Well: "), text), ["cat"])).alias("v"))
    return parsed.select("id", "v.class", "v.verdict", "v.confidence")


def json_highlights(spark: SparkSession, d: str) -> DataFrame:
    rows = _current_metadata(spark, d)
    return rows.select("image_id", F.array_join(semantic.highlights(rows, "json", ["cat", "dog"]), "; ").alias("highlights"))


def history(spark: SparkSession, d: str) -> DataFrame:
    log = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("image_id"), F.col("event_type").alias("action"), F.col("props").cast("string").alias("detail"))
    return reporting.history(log, _images(spark, d, "path"), 30)


def samples(spark: SparkSession, d: str) -> DataFrame:
    return reporting.samples(_images(spark, d, "path", "filename", "category", "action", "needs_review", "missing", "deleted"), 60)


def export_records(spark: SparkSession, d: str) -> DataFrame:
    columns = ("path", "filename", "hash", "width", "height", "taken_at", "category", "action", "needs_review", "missing")
    rows = export.records(_images(spark, d, *columns), index.boxes(spark, d), _current_metadata(spark, d))
    return rows.select("id", "path", "category", "metadata", F.size("detections").alias("boxes"), F.get("detections", F.lit(0))["confidence"].alias("top"))


def export_csv(spark: SparkSession, d: str) -> DataFrame:
    columns = ("path", "filename", "hash", "width", "height", "taken_at", "category", "action", "needs_review", "missing")
    return export.csv_rows(export.records(_images(spark, d, *columns), index.boxes(spark, d), _current_metadata(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        recheck, decide_first_match, needs_review, uncertain_classes, class_bands, adjudicated_detections, recheck_tally, merge_frames, frames_by_strength, video_boxes,
        frame_positions, detection_hints, pipeline_counts, category_counts, action_counts, class_counts, verdict_counts, distinct_roots, exact_duplicates,
        duplicate_listing, document_duplicates, hamming_pairs, similarity_components, duplicate_groups, largest_groups, dhash_bits, sync_queues,
        retry_count, stale_detections, plan_actions, dry_run_counts, prune_links, existing_links, apply_tally, plan_preview, starter_decisions, rule_outcomes, search_metadata, coerce_reply, parse_verdict,
        json_highlights, history, samples, export_records, export_csv, p2_found, p2_clocks, p5_found, p5_variants, p5_subjects,
    )
} | {f"claim_{s}": _claim(s) for s in ("detect", "adjudicate", "analyze")} | state_queries.QUERIES
