"""Counts, listings and searches over an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.schema import DONE, ERROR, PENDING, RUNNING, STAGES


def _is(column: str, *values: object) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def ready(stage: str) -> Column:
    """Whether an image may enter a stage, apart from its state in it."""
    there, live = _is("missing", 0), _is("missing", 0) & _is("deleted", 0)
    if stage == "detect":
        return there
    if stage == "adjudicate":
        return _is("detect_state", DONE) & _is("needs_review", 1) & live
    wanted = F.col("action").isNotNull() & (F.col("action") != "ignore")
    return _is("detect_state", DONE) & ~F.col("adjudicate_state").isin(PENDING, RUNNING) & live & wanted


def pending(stage: str) -> Column:
    """Whether an image waits for a stage and may enter it."""
    return _is(f"{stage}_state", PENDING) & ready(stage)


def pipeline_counts(images: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row of all progress counts, from one scan: totals, per stage pending, done and error, and stable totals."""
    live = _is("missing", 0) & _is("deleted", 0)
    detected = _is("detect_state", DONE) & live
    asked = _is("needs_review", 1) | _is("adjudicate_state", DONE, ERROR)
    wanted = F.col("action").isNotNull() & (F.col("action") != "ignore")
    counts = {"total": _is("missing", 0), "missing": _is("missing", 1), "deleted": _is("deleted", 1)}
    for stage in STAGES:
        counts |= {f"{stage}_pending": pending(stage), f"{stage}_done": _is(f"{stage}_state", DONE), f"{stage}_error": _is(f"{stage}_state", ERROR)}
    counts |= {"adjudicate_total": detected & asked, "analyze_total": detected & wanted, "review": _is("needs_review", 1) & _is("missing", 0)}
    row = images.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    total = links.agg(F.count(F.lit(1)).alias("links_total")) if links is not None else None
    return row.withColumn("links_total", F.lit(0).cast("bigint")) if total is None else row.join(F.broadcast(total))


def in_flight(images: DataFrame, stage: str) -> bool:
    """Whether any image waits for a stage or is in it."""
    state = F.col(f"{stage}_state")
    return not images.where(state.isin(PENDING, RUNNING) & ready(stage)).limit(1).isEmpty()


def category_counts(images: DataFrame) -> DataFrame:
    """Images there are by category, deleted ones too; null counts as ``unprocessed``."""
    return images.where("missing = 0").groupBy(F.coalesce("category", F.lit("unprocessed")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def action_counts(images: DataFrame) -> DataFrame:
    """Images there are by action, where they have one."""
    return images.where("missing = 0 and action is not null").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def class_counts(boxes: DataFrame) -> DataFrame:
    """Boxes by class, whatever became of their images."""
    return boxes.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Verdicts by kind."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def distinct_roots(images: DataFrame) -> DataFrame:
    """The folders that images come from."""
    return images.select("root").distinct()


def exact_duplicates(images: DataFrame, hash_column: str = "hash") -> DataFrame:
    """``hash, n, path``: one row per file of each group of files with equal content; deleted rows count, missing don't.

    The groups are counted map-side and joined back, so a group with a third of all rows is never in one place.
    """
    there = images.where((F.col("missing") == 0) & F.col(hash_column).isNotNull()).select(F.col(hash_column).alias("hash"), "path")
    sizes = there.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return there.join(sizes, "hash").select("hash", "n", "path")


def largest_duplicate_groups(images: DataFrame, limit: int, hash_column: str = "hash") -> DataFrame:
    """``hash, n, paths`` of the ``limit`` largest groups, their paths sorted and joined by line ends (a report).

    A group's paths are one text, as the report has it; ``exact_duplicates`` is the form for groups of any size.
    """
    rows = exact_duplicates(images, hash_column)
    top = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hash").limit(limit)
    listed = rows.join(top.select("hash"), "hash", "left_semi").groupBy("hash", "n")
    return listed.agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("paths"))


def verdicts_of(verdicts: DataFrame, images: DataFrame) -> DataFrame:
    """The verdicts on some images (image_id), by image and class."""
    return verdicts.join(images.select("image_id").distinct(), "image_id", "left_semi").orderBy("image_id", "class")


def preview(plan: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """What a plan would do: ``action, n``, and its first ``limit`` steps by image and place."""
    counts = plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return counts, plan.orderBy("image_id", "seq").limit(limit).select("action", "source", "target")


def history(log: DataFrame, images: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` entries of the action log with their images' paths."""
    rows = log.join(images.select(F.col("id").alias("image_id"), "path"), "image_id")
    return rows.orderBy(F.desc("id")).limit(limit).select("id", "action", "detail", "path")


def samples(images: DataFrame, limit: int, category: str | None = None) -> DataFrame:
    """The first ``limit`` live images that have a category (that one, if named), by id."""
    rows = images.where("missing = 0 and deleted = 0 and category is not null")
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.orderBy("id").limit(limit).select("id", "path", "filename", "category", "action", "needs_review")


def like_pattern(term: str) -> tuple[str, str]:
    """The LIKE pattern of a search term, whose own % and _ are wildcards, and an escape character that it lacks."""
    escape = next(c for c in "~^|!\x01\x02\x03" if c not in term)
    return f"%{term.lower()}%", escape


def search(metadata: DataFrame, images: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """``id, path, category, json`` of images there are whose metadata holds a term, letter case aside, by id."""
    pattern, escape = like_pattern(term)
    found = metadata.where(F.like(F.lower("json"), F.lit(pattern), F.lit(escape)))
    rows = found.select(F.col("image_id").alias("id"), "json").join(images.where("missing = 0").select("id", "path", "category"), "id")
    rows = rows.select("id", "path", "category", "json")
    return rows if limit is None else rows.orderBy("id").limit(limit)

