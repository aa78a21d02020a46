"""What a stage does to the rows of an index, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.reporting import pending
from tarnwell.operators.scan import numbered
from tarnwell.schema import DONE, ERROR, PENDING, RUNNING, SKIPPED, STAGES


def claim(images: DataFrame, stage: str, limit: int) -> DataFrame:
    """The first ``limit`` images by id that wait for a stage and may enter it: a batch of its queue."""
    return images.where(pending(stage)).orderBy("id").limit(limit).select("id", "path")


def _set(images: DataFrame, when, values: dict) -> DataFrame:
    hit = F.coalesce(when, F.lit(False))
    typed = {c: F.lit(v).cast(images.schema[c].dataType) if not hasattr(v, "alias") else v for c, v in values.items()}
    return images.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in typed.items()})


def mark_running(images: DataFrame, stage: str, claimed: DataFrame) -> DataFrame:
    """``images`` with the claimed ones in the stage."""
    taken = claimed.select("id", F.lit(True).alias("__taken"))
    both = images.join(taken, "id", "left")
    return _set(both, F.col("__taken").isNotNull(), {f"{stage}_state": RUNNING}).select(*images.columns)


def reset_running(images: DataFrame, stage: str) -> DataFrame:
    """``images`` with those that a broken run left in a stage waiting again."""
    return _set(images, F.col(f"{stage}_state") == RUNNING, {f"{stage}_state": PENDING})


def sync_queues(images: DataFrame) -> DataFrame:
    """``images`` with the queues of second opinions and descriptions brought in line with current decisions.

    Detected rows in doubt that were skipped wait again; waiting ones no longer in doubt are skipped; verdicts given stay.
    Descriptions of ignored images are skipped once no verdict is outstanding.
    """
    detected = F.col("detect_state") == DONE
    again = detected & (F.col("adjudicate_state") == SKIPPED) & (F.col("needs_review") == 1) & (F.col("missing") == 0) & (F.col("deleted") == 0)
    settled = detected & (F.col("adjudicate_state") == PENDING) & (F.col("needs_review") == 0)
    state = F.when(again, PENDING).when(settled, SKIPPED).otherwise(F.col("adjudicate_state")).cast("int")
    queued = images.withColumn("adjudicate_state", state)
    idle = detected & (F.col("analyze_state") == PENDING) & ~F.col("adjudicate_state").isin(PENDING, RUNNING)
    return _set(queued, idle & (F.col("action").isNull() | (F.col("action") == "ignore")), {"analyze_state": SKIPPED})


def finish_detect(images: DataFrame, decisions: DataFrame, now: float) -> DataFrame:
    """``images`` with the decisions (image_id, category, action, needs_review) of a stage's batch; doubt waits for a second opinion."""
    return _decided(images, decisions, now, {"detect_state": F.lit(DONE), "adjudicate_state": F.when(F.col("__doubt"), PENDING).otherwise(SKIPPED), "error": F.lit(None).cast("string")})


def finish_adjudicate(images: DataFrame, decisions: DataFrame, now: float) -> DataFrame:
    """``images`` with the decisions that second opinions led to."""
    return _decided(images, decisions, now, {"adjudicate_state": F.lit(DONE), "error": F.lit(None).cast("string")})


def set_decisions(images: DataFrame, decisions: DataFrame, now: float) -> DataFrame:
    """``images`` with decisions made anew from stored evidence."""
    return _decided(images, decisions, now, {})


def _decided(images: DataFrame, decisions: DataFrame, now: float, more: dict) -> DataFrame:
    new = decisions.select(F.col("image_id").alias("id"), F.col("category").alias("__category"), F.col("action").alias("__action"), F.col("needs_review").alias("__doubt"))
    both = images.join(new, "id", "left")
    hit = F.col("__doubt").isNotNull()
    values = {"category": F.col("__category"), "action": F.col("__action"), "needs_review": F.col("__doubt").cast("int"), "updated_at": F.lit(now), **more}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(*images.columns)


def finish_analyze(images: DataFrame, described: DataFrame, now: float) -> DataFrame:
    """``images`` with the stage done for those described (``id``); their decisions stay."""
    both = images.join(described.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return _set(both, F.col("__hit").isNotNull(), {"analyze_state": DONE, "updated_at": now}).select(*images.columns)


def fail(images: DataFrame, stage: str, errors: DataFrame, now: float) -> DataFrame:
    """``images`` with a stage failed for those in ``errors`` (id, message); messages are cut at 500 characters."""
    both = images.join(errors.select("id", F.substring("message", 1, 500).alias("__message")), "id", "left")
    hit = F.col("__message").isNotNull()
    return _set(both, hit, {f"{stage}_state": ERROR, "error": F.col("__message"), "updated_at": now}).select(*images.columns)


def retry_errors(images: DataFrame, *stages: str) -> DataFrame:
    """``images`` with failed ones waiting again in the stages named, or in all."""
    chosen = stages or STAGES
    failed = [F.coalesce(F.col(f"{s}_state") == ERROR, F.lit(False)) for s in chosen]
    hit = failed[0]
    for f in failed[1:]:
        hit = hit | f
    cleared = {"error": F.when(hit, F.lit(None)).otherwise(F.col("error"))}
    return images.withColumns({**{f"{s}_state": F.when(f, PENDING).otherwise(F.col(f"{s}_state")) for s, f in zip(chosen, failed)}, **cleared})


def retry_count(images: DataFrame) -> DataFrame:
    """``n``: how many stages wait again after ``retry_errors``; an image that failed in two counts twice."""
    return images.agg(F.sum(sum(((F.col(f"{s}_state") == ERROR).cast("bigint") for s in STAGES), F.lit(0))).alias("n"))


def reset_stage(images: DataFrame, stage: str) -> DataFrame:
    """``images`` with a stage to do again for all; detection takes what was derived from it along."""
    values: dict = {f"{stage}_state": PENDING}
    if stage == "detect":
        values |= {"adjudicate_state": PENDING, "category": None, "action": None, "needs_review": 0}
    return _set(images, F.lit(True), values)


#: Stage -> the tables whose rows it or what follows it has made.
DERIVED = {"detect": ("detections", "adjudications"), "adjudicate": ("adjudications",), "analyze": ("metadata",)}


def reset(tables: dict[str, DataFrame], *stages: str) -> dict[str, DataFrame]:
    """An index with the stages named, or all, to do again, without the rows derived by them.

    After a reset of second opinions the images have to be decided anew from their boxes, for a verdict may have cleared
    the doubt that puts them in the queue.
    """
    out = dict(tables)
    for stage in stages or STAGES:
        out["images"] = reset_stage(out["images"], stage)
        for name in DERIVED[stage]:
            if name in out:
                out[name] = truncate(out[name])
    return out


def truncate(table: DataFrame) -> DataFrame:
    """A table without rows."""
    return table.where(F.lit(False))


def rebuilt(tables: dict[str, DataFrame], version: str, current: str) -> dict[str, DataFrame]:
    """An index as it may be used: itself if it is of the current version, else its tables emptied, to be filled anew."""
    return dict(tables) if version == current else {k: truncate(v) for k, v in tables.items()}


def append_log(log: DataFrame, entries: DataFrame, now: float) -> DataFrame:
    """The action log with new entries (image_id, action, detail), numbered after its greatest id in order of image and action."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
    fresh = numbered(entries.select("image_id", "action", "detail"), ["image_id", "action", "detail"], last + 1)
    return log.unionByName(fresh.withColumn("created_at", F.lit(now)).select(*log.columns))


def batch_size(batch: int, budget: int | None) -> int:
    """How many rows to claim next with so many left to spend in a run (None: no limit); 0 when it is spent."""
    return batch if budget is None else max(0, min(batch, budget))


def replace_for_images(stored: DataFrame, fresh: DataFrame, images: DataFrame) -> DataFrame:
    """A derived table in which the rows of ``images`` (image_id), those that were looked at again, give way to ``fresh``.

    An image with nothing in ``fresh`` keeps nothing.
    """
    kept = stored.join(images.select("image_id").distinct(), "image_id", "left_anti").select(*stored.columns)
    return kept.unionByName(fresh.select(*stored.columns))


def relocate(images: DataFrame, moves: DataFrame, now: float) -> DataFrame:
    """``images`` at their new places: ``moves`` has id and path; the root becomes the folder of the file."""
    both = images.join(moves.select("id", F.col("path").alias("__path")), "id", "left")
    parts = F.split("__path", "/")
    values = {"filename": F.element_at(parts, -1), "root": F.regexp_extract("__path", "^(.*)/[^/]*$", 1), "path": F.col("__path"), "updated_at": F.lit(now)}
    return _set(both, F.col("__path").isNotNull(), values).select(*images.columns)


def mark_deleted(images: DataFrame, gone: DataFrame, now: float) -> DataFrame:
    """``images`` with those in ``gone`` (id) deleted; their rows stay, lest the files be taken for new ones."""
    both = images.join(gone.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return _set(both, F.col("__hit").isNotNull(), {"deleted": 1, "updated_at": now}).select(*images.columns)


def dismiss(dismissed: DataFrame, pairs: DataFrame, now: float) -> DataFrame:
    """Dismissals and new pairs (image_id_a, image_id_b, either way round), each pair once; known ones stay as they are."""
    fresh = pairs.where("image_id_a <> image_id_b").select(
        F.least("image_id_a", "image_id_b").alias("image_id_a"), F.greatest("image_id_a", "image_id_b").alias("image_id_b"), F.lit(now).alias("created_at")
    )
    return dismissed.unionByName(fresh).groupBy("image_id_a", "image_id_b").agg(F.min("created_at").alias("created_at"))


def set_marks(marks: DataFrame, image_ids: DataFrame, mark: str | None, now: float) -> DataFrame:
    """Marks with those of the images in ``image_ids`` set anew, or cleared where ``mark`` is None."""
    if mark not in ("keep", "discard", None):
        raise ValueError(f"unknown mark {mark!r}")
    kept = marks.join(image_ids.select("image_id").distinct(), "image_id", "left_anti").select(*marks.columns)
    if mark is None:
        return kept
    return kept.unionByName(image_ids.select("image_id").distinct().select("image_id", F.lit(mark).alias("mark"), F.lit(now).alias("created_at")))
