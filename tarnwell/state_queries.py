"""Queries that put an index through its transitions, links and duplicates' reviews, with DuckDB SQL written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import index
from tarnwell.operators import export, reporting, scan, similarity, state
from tarnwell.plans import actions
from tarnwell.tables import current_rows, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The moment of a transition.
NOW = 1_800_000_000.0


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with the SQL that gives the same."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__], ORACLES[function.__name__] = function, sql
        return function

    return register


_I = "i AS (SELECT * FROM images WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CLASS = f"lower({_TRIM.format('class')})"
_B = f"b AS (SELECT DISTINCT id, image_id, {_CLASS} AS class, confidence FROM detections WHERE id IS NOT NULL AND image_id IS NOT NULL AND {_CLASS} <> '' AND confidence IS NOT NULL)"
# The index as it was half-way between its first and its last change, and the files that are there now.
_CUT = "cut AS (SELECT (min(updated_at) + max(updated_at)) / 2 AS t FROM images)"
_THEN = "y AS (SELECT * FROM images, cut WHERE id IS NOT NULL AND updated_at <= t QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_WALK = "n AS (SELECT * FROM i WHERE missing = 0)"
_DIFF = """diff AS (SELECT coalesce(n.path, y.path) AS path, CASE WHEN y.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'missing'
    WHEN n.size IS NOT DISTINCT FROM y.size AND abs(coalesce(n.mtime, 0) - coalesce(y.mtime, 0)) < 0.000001 THEN 'unchanged' ELSE 'changed' END AS status
    FROM n FULL JOIN y ON n.path = y.path)"""
_VERSIONS = f"WITH {_I}, {_CUT}, {_THEN}, {_WALK}, {_DIFF}"
# What an earlier run had put out: the images that the index says are copied, under their category.
_LINKS = "l AS (SELECT id AS image_id, '/out/' || upper(category[1]) || lower(category[2:]) || '/' || filename AS link_path FROM i WHERE action = 'copy' AND category IS NOT NULL AND category <> '')"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return index.images(spark, d)


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, d, "images")
    middle = rows.agg(((F.min("updated_at") + F.max("updated_at")) / 2).alias("t")).head()[0]
    then = current_rows(rows.where(F.col("updated_at") <= F.lit(middle)), "id", "updated_at", rows.columns)
    return _images(spark, d).where("missing = 0"), then.select(*rows.columns)


@query(f"{_VERSIONS} SELECT path, status FROM diff")
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return scan.snapshot_diff(*_versions(spark, d))


@query(f"{_VERSIONS} SELECT status, count(*) AS n FROM diff GROUP BY status")
def scan_tally(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_tally(scan_diff(spark, d))


@query(
    f"""{_VERSIONS}, hit AS (SELECT n.* FROM n JOIN diff USING (path) WHERE status IN ('added', 'changed')),
    top AS (SELECT coalesce(max(id), 0) AS t FROM y)
    SELECT y.id, path, coalesce(h.size, y.size) AS size, CASE WHEN h.path IS NULL THEN y.category END AS category, CASE WHEN h.path IS NULL THEN y.detect_state ELSE 0 END AS detect_state,
        y.adjudicate_state, CASE WHEN h.path IS NULL THEN y.missing ELSE 0 END AS missing, y.first_seen FROM y LEFT JOIN hit h USING (path)
    UNION ALL SELECT top.t + row_number() OVER (ORDER BY h.path), h.path, h.size, NULL, 0, 0, 0, {NOW} FROM hit h, top WHERE h.path NOT IN (SELECT path FROM y)"""
)
def upsert_scanned(spark: SparkSession, d: str) -> DataFrame:
    now, then = _versions(spark, d)
    found = scan.snapshot_diff(now, then).where("status in ('added', 'changed')")
    merged = scan.upsert(then, now.join(found.select("path"), "path", "left_semi"), NOW)
    return merged.select("id", "path", F.col("size"), "category", "detect_state", "adjudicate_state", "missing", "first_seen")


@query(f"{_VERSIONS} SELECT y.id, CASE WHEN n.path IS NULL THEN 1 ELSE 0 END AS missing, CASE WHEN n.path IS NULL THEN y.deleted ELSE 0 END AS deleted FROM y LEFT JOIN n USING (path)")
def rescan_flags(spark: SparkSession, d: str) -> DataFrame:
    now, then = _versions(spark, d)
    return scan.touch_present(scan.flag_missing(then), now).select("id", "missing", "deleted")


@query(f"WITH {_I}, {_B} SELECT class, count(*) AS n FROM b WHERE image_id NOT IN (SELECT id FROM i WHERE needs_review = 1) GROUP BY class")
def fresh_detections(spark: SparkSession, d: str) -> DataFrame:
    changed = _images(spark, d).where("needs_review = 1")
    return scan.without_stale(index.boxes(spark, d), changed).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_I}, k AS (SELECT id FROM i WHERE missing IS DISTINCT FROM 1)
    SELECT 'images' AS name, count(*) AS n FROM k UNION ALL SELECT 'detections', count(*) FROM detections WHERE image_id IN (FROM k)
    UNION ALL SELECT 'adjudications', count(*) FROM adjudications WHERE image_id IN (FROM k) UNION ALL SELECT 'metadata', count(*) FROM metadata WHERE image_id IN (FROM k)
    UNION ALL SELECT 'dupe_dismissals', count(*) FROM dupe_dismissals WHERE image_id_a IN (FROM k) AND image_id_b IN (FROM k)"""
)
def purge_missing(spark: SparkSession, d: str) -> DataFrame:
    tables = {"images": _images(spark, d)} | {n: read_table(spark, d, n) for n in ("detections", "adjudications", "metadata", "dupe_dismissals")}
    left = scan.purge(tables, F.col("missing") == 1)
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in left.items()]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return rows


@query(f"WITH {_I} SELECT DISTINCT root FROM i WHERE root NOT IN (SELECT root FROM library_roots WHERE trust >= 3)")
def unconfigured_roots(spark: SparkSession, d: str) -> DataFrame:
    return scan.unconfigured_roots(_images(spark, d), read_table(spark, d, "library_roots").where("trust >= 3"))


def _running(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    return state.mark_running(rows, "detect", state.claim(rows, "detect", 32))


_CLAIMED = "c AS (SELECT id FROM i WHERE detect_state = 0 AND missing = 0 ORDER BY id LIMIT 32)"


@query(f"WITH {_I}, {_CLAIMED} SELECT CASE WHEN id IN (FROM c) THEN 1 ELSE detect_state END AS detect_state, count(*) AS n FROM i GROUP BY 1")
def mark_running(spark: SparkSession, d: str) -> DataFrame:
    return _running(spark, d).groupBy("detect_state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_I} SELECT id, CASE WHEN detect_state = 1 THEN 0 ELSE detect_state END AS detect_state FROM i")
def reset_running(spark: SparkSession, d: str) -> DataFrame:
    return state.reset_running(_running(spark, d), "detect").select("id", "detect_state")


# Decisions of a stage: what the strongest class of an image says, in doubt below 0.65.
_DECISIONS = f"""{_B}, dec AS (SELECT image_id, arg_max(class, (confidence, class)) AS category, 'copy' AS action, max(confidence) < 0.65 AS doubt FROM b GROUP BY image_id)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    best = index.boxes(spark, d).groupBy("image_id").agg(F.max(F.struct("confidence", "class")).alias("x"))
    return best.select("image_id", F.col("x.class").alias("category"), F.lit("copy").alias("action"), (F.col("x.confidence") < 0.65).alias("needs_review"))


@query(
    f"""WITH {_I}, {_DECISIONS} SELECT id, coalesce(dec.category, i.category) AS category, CASE WHEN doubt IS NULL THEN needs_review ELSE doubt::INT END AS needs_review,
    CASE WHEN doubt IS NULL THEN detect_state ELSE 2 END AS detect_state, CASE WHEN doubt THEN 0 WHEN NOT doubt THEN 4 ELSE adjudicate_state END AS adjudicate_state,
    CASE WHEN doubt IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM i LEFT JOIN dec ON image_id = id"""
)
def finish_detect(spark: SparkSession, d: str) -> DataFrame:
    done = state.finish_detect(_images(spark, d), _decisions(spark, d), NOW)
    return done.select("id", "category", "needs_review", "detect_state", "adjudicate_state", "updated_at")


@query(
    f"""WITH {_I}, {_DECISIONS} SELECT id, coalesce(dec.category, i.category) AS category, CASE WHEN doubt IS NULL THEN needs_review ELSE doubt::INT END AS needs_review,
    CASE WHEN doubt IS NULL THEN adjudicate_state ELSE 2 END AS adjudicate_state, CASE WHEN doubt IS NULL THEN error END AS error FROM i LEFT JOIN dec ON image_id = id"""
)
def finish_adjudicate(spark: SparkSession, d: str) -> DataFrame:
    return state.finish_adjudicate(_images(spark, d), _decisions(spark, d), NOW).select("id", "category", "needs_review", "adjudicate_state", "error")


@query(f"WITH {_I}, m AS (SELECT DISTINCT image_id FROM metadata) SELECT id, CASE WHEN image_id IS NULL THEN analyze_state ELSE 2 END AS analyze_state FROM i LEFT JOIN m ON image_id = id")
def finish_analyze(spark: SparkSession, d: str) -> DataFrame:
    described = read_table(spark, d, "metadata").select(F.col("image_id").alias("id"))
    return state.finish_analyze(_images(spark, d), described, NOW).select("id", "analyze_state")


@query(f"WITH {_I}, {_DECISIONS} SELECT action, count(*) AS n FROM (SELECT coalesce(dec.action, i.action) AS action FROM i LEFT JOIN dec ON image_id = id) GROUP BY action")
def set_decisions(spark: SparkSession, d: str) -> DataFrame:
    return state.set_decisions(_images(spark, d), _decisions(spark, d), NOW).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_I} SELECT id, CASE WHEN width IS NULL THEN 3 ELSE detect_state END AS detect_state, CASE WHEN width IS NULL THEN left(repeat(path, 30), 500) ELSE error END AS error FROM i")
def fail_unreadable(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    errors = rows.where("width is null").select("id", F.repeat("path", 30).alias("message"))
    return state.fail(rows, "detect", errors, NOW).select("id", "detect_state", "error")


@query(
    f"""WITH {_I} SELECT id, CASE WHEN detect_state = 3 THEN 0 ELSE detect_state END AS detect_state, CASE WHEN analyze_state = 3 THEN 0 ELSE analyze_state END AS analyze_state,
    CASE WHEN detect_state = 3 OR adjudicate_state = 3 OR analyze_state = 3 THEN NULL ELSE error END AS error FROM i"""
)
def retry_errors(spark: SparkSession, d: str) -> DataFrame:
    return state.retry_errors(_images(spark, d)).select("id", "detect_state", "analyze_state", "error")


@query(f"WITH {_I} SELECT 0 AS detect_state, 0 AS adjudicate_state, analyze_state, NULL::VARCHAR AS category, count(*) AS images, 0::BIGINT AS detections, 0::BIGINT AS adjudications FROM i GROUP BY analyze_state")
def reset_detect(spark: SparkSession, d: str) -> DataFrame:
    tables = {"images": _images(spark, d), "detections": read_table(spark, d, "detections"), "adjudications": read_table(spark, d, "adjudications")}
    after = state.reset(tables, "detect")
    rows = after["images"].groupBy("detect_state", "adjudicate_state", "analyze_state", "category").agg(F.count(F.lit(1)).alias("images"))
    return rows.withColumns({n: F.lit(after[n].count()).cast("bigint") for n in ("detections", "adjudications")})


@query(
    f"""WITH {_I} SELECT id, CASE WHEN action = 'move' THEN '/out/' || id || '/' || filename ELSE path END AS path, CASE WHEN action = 'move' THEN '/out/' || id ELSE root END AS root,
    CASE WHEN action = 'delete' THEN 1 ELSE deleted END AS deleted FROM i"""
)
def settle_moves(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    moves = rows.where("action = 'move'").select("id", F.concat(F.lit("/out/"), F.col("id").cast("string"), F.lit("/"), "filename").alias("path"))
    after = state.mark_deleted(state.relocate(rows, moves, NOW), rows.where("action = 'delete'").select("id"), NOW)
    return after.select("id", "path", "root", "deleted")


@query(
    f"""WITH {_I}, {_B}, seen AS (SELECT id FROM i WHERE needs_review = 1) SELECT id, image_id, class, confidence FROM b WHERE image_id NOT IN (FROM seen)
    UNION ALL SELECT id, image_id, class, confidence / 2 FROM b WHERE image_id IN (FROM seen) AND class = 'cat'"""
)
def replace_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = index.boxes(spark, d)
    seen = _images(spark, d).where("needs_review = 1").select(F.col("id").alias("image_id"))
    fresh = boxes.join(seen, "image_id", "left_semi").where("class = 'cat'").withColumn("confidence", F.col("confidence") / 2)
    return state.replace_for_images(boxes, fresh, seen).select("id", "image_id", "class", "confidence")


@query(
    """WITH e AS (SELECT user_id AS image_id, event_type AS action, event_id::VARCHAR AS detail FROM events WHERE event_id % 2 = 1)
    SELECT event_id AS id, user_id AS image_id, event_type AS action FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT (SELECT max(event_id) FROM events WHERE event_id % 2 = 0) + row_number() OVER (ORDER BY image_id, action, detail), image_id, action FROM e"""
)
def append_log(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select(
        F.col("event_id").cast("bigint").alias("id"), F.col("user_id").cast("bigint").alias("image_id"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("detail"), F.lit(0.0).alias("created_at")
    )
    return state.append_log(events.where("id % 2 = 0"), events.where("id % 2 = 1"), NOW).select("id", "image_id", "action")


@query(
    f"""WITH {_I}, p AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM i a JOIN i b ON a.id < b.id AND a.hash = b.hash WHERE a.needs_review = 1 AND b.needs_review = 1)
    SELECT image_id_a, image_id_b, min(created_at) AS created_at FROM (SELECT least(image_id_a, image_id_b) AS image_id_a, greatest(image_id_a, image_id_b) AS image_id_b, created_at
        FROM dupe_dismissals WHERE image_id_a <> image_id_b UNION ALL SELECT a, b, {NOW} FROM p) GROUP BY ALL"""
)
def dismiss_selection(spark: SparkSession, d: str) -> DataFrame:
    chosen = _images(spark, d).where("needs_review = 1 and hash is not null").select("hash", F.col("id").alias("image_id"))
    pairs = similarity.all_pairs(chosen, "hash", "image_id")
    known = read_table(spark, d, "dupe_dismissals")
    empty = state.dismiss(known.where("false"), known, 0.0).drop("created_at").join(
        known.select(F.least("image_id_a", "image_id_b").alias("image_id_a"), F.greatest("image_id_a", "image_id_b").alias("image_id_b"), "created_at"), ["image_id_a", "image_id_b"]
    )
    return state.dismiss(empty, pairs, NOW)


@query(f"WITH {_I} SELECT id AS image_id, CASE WHEN deleted = 1 THEN 'discard' ELSE 'keep' END AS mark FROM i WHERE needs_review = 1 AND NOT coalesce(missing = 1, false)")
def review_marks(spark: SparkSession, d: str) -> DataFrame:
    from tarnwell.schema import TABLES

    rows = _images(spark, d).where("needs_review = 1").select(F.col("id").alias("image_id"), "missing", "deleted")
    marks = state.set_marks(spark.createDataFrame([], TABLES["dupe_marks"]), rows, "keep", NOW)
    marks = state.set_marks(marks, rows.where("deleted = 1"), "discard", NOW)
    return state.set_marks(marks, rows.where("missing = 1"), None, NOW).select("image_id", "mark")


def links(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier run had put out: the images that the index says are copied, under their category."""
    rows = _images(spark, d).where("action = 'copy' and category <> ''")
    folder = F.concat(F.upper(F.substring("category", 1, 1)), F.lower(F.expr("substring(category, 2)")))
    return rows.select(F.col("id").alias("image_id"), F.concat(F.lit("/out/"), folder, F.lit("/"), "filename").alias("link_path"))


@query(f"WITH {_I}, {_LINKS} SELECT l.* FROM l JOIN i ON i.id = l.image_id WHERE root = (SELECT min(root) FROM i)")
def links_of_root(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    return actions.links_of_root(links(spark, d), rows, rows.agg(F.min("root")).head()[0])


@query(
    f"""WITH {_I}, {_LINKS}, made AS (SELECT id AS image_id, '/out/Cat/' || filename AS link_path FROM i WHERE detect_state = 3 QUALIFY row_number() OVER (PARTITION BY filename ORDER BY id) = 1)
    SELECT link_path, image_id FROM l WHERE link_path NOT IN (SELECT link_path FROM made) AND link_path NOT LIKE '/out/Dog/%' UNION ALL FROM (SELECT link_path, image_id FROM made)"""
)
def record_links(spark: SparkSession, d: str) -> DataFrame:
    failed = _images(spark, d).where("detect_state = 3").groupBy("filename").agg(F.min("id").alias("image_id"))
    made = failed.select("image_id", F.concat(F.lit("/out/Cat/"), "filename").alias("link_path"))
    known = links(spark, d)
    left = actions.forget_links(known, known.where("link_path like '/out/Dog/%'"))
    return actions.record_links(left, made).select("link_path", "image_id")


@query(
    f"""WITH {_I}, {_LINKS}, there AS (SELECT path FROM i WHERE size > 0), k AS (SELECT count(*) FILTER (path IS NOT NULL) AS ok, count(*) FILTER (path IS NULL) AS gone
        FROM l LEFT JOIN (SELECT DISTINCT replace(path, root, '/out/Cat') AS path FROM i WHERE size > 0) t ON t.path = link_path)
    SELECT ok AS copies_ok, gone AS copies_missing, (SELECT count(*) FROM i WHERE missing = 0 AND deleted = 0 AND path NOT IN (SELECT path FROM there)) AS sources_missing FROM k"""
)
def verify_outputs(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    there = rows.where("size > 0").select("path").unionByName(rows.where("size > 0").select(F.replace("path", F.col("root"), F.lit("/out/Cat")).alias("path")))
    return actions.verify(links(spark, d), rows, there)


@query(f"WITH {_I}, m AS (SELECT image_id, json FROM metadata WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1) SELECT i.id, path, category, json FROM m JOIN i ON i.id = m.image_id WHERE missing = 0 AND lower(json) LIKE '%ka_i%' ORDER BY i.id LIMIT 25")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    metadata = current_rows(read_table(spark, d, "metadata"), "image_id", "created_at", ["json"])
    return reporting.search(metadata, _images(spark, d), "KA_I", 25)


@query(f"WITH {_I} SELECT id, path, filename, category, action, needs_review FROM i WHERE missing = 0 AND deleted = 0 AND category = 'dog' ORDER BY id LIMIT 60")
def samples_of_category(spark: SparkSession, d: str) -> DataFrame:
    return reporting.samples(_images(spark, d), 60, "dog")


@query("SELECT stage, n > 0 AS busy FROM (WITH " + _I + """ SELECT 'detect' AS stage, count(*) FILTER (detect_state IN (0, 1) AND missing = 0) AS n FROM i
    UNION ALL SELECT 'adjudicate', count(*) FILTER (adjudicate_state IN (0, 1) AND detect_state = 2 AND needs_review = 1 AND missing = 0 AND deleted = 0) FROM i)""")
def stages_in_flight(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    return spark.createDataFrame([(s, reporting.in_flight(rows, s)) for s in ("detect", "adjudicate")], "stage string, busy boolean")


@query(f"WITH {_B} SELECT id, image_id, class, confidence, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, id) - 1 AS rank FROM b")
def ranked_boxes(spark: SparkSession, d: str) -> DataFrame:
    return export.ranked_boxes(index.boxes(spark, d))


@query(
    """WITH v AS (SELECT image_id, lower(trim(class)) AS class, count(*) AS n FROM adjudications WHERE image_id IS NOT NULL AND trim(class) <> '' GROUP BY ALL)
    SELECT image_id, class FROM v WHERE image_id IN (SELECT image_id FROM detections WHERE confidence > 0.9)"""
)
def verdicts_of_images(spark: SparkSession, d: str) -> DataFrame:
    sure = read_table(spark, d, "detections").where("confidence > 0.9").select("image_id")
    return reporting.verdicts_of(index.verdicts(spark, d), sure).select("image_id", "class")
