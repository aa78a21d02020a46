"""Evidence: decisions from boxes, second opinions folded into them, frames of a video merged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.plans.conditions import Count
from tarnwell.plans.rules import UNMATCHED, VIDEO, RuleSet


def _name(count: Count) -> str:
    return f"n_{count[0] or '*'}_{count[1]}"


def _at(threshold: float) -> str:
    return f"at_{threshold}"


def per_class(boxes: DataFrame, rules: RuleSet) -> DataFrame:
    """``image_id, class, best`` and the number of boxes at each threshold that a rule uses.

    Boxes combine map-side, so an image with a third of all boxes is no heavier than its number of classes.
    """
    thresholds = sorted({t for _, t in rules.counts()})
    return boxes.groupBy("image_id", "class").agg(
        F.max("confidence").alias("best"), *[F.count_if(F.col("confidence") >= t).alias(_at(t)) for t in thresholds]
    )


def unsettled(rules: RuleSet, cls: Column, best: Column, escalatable_only: bool = False) -> Column:
    """Whether a class was seen in its review band and never above it: its best box lies in the band."""
    low, high = rules.band_column(cls, "review_confidence"), rules.band_column(cls, "confidence")
    in_band = (best >= low) & (best < high)
    return in_band & rules.band_column(cls, "second_opinion") if escalatable_only else in_band


def decide(images: DataFrame, boxes: DataFrame, rules: RuleSet) -> DataFrame:
    """``image_id, category, action, needs_review`` of every image, with or without boxes.

    ``images`` has unique ``image_id``; ``boxes`` image_id, class and confidence. The first enabled rule that matches
    decides; review is independent of rules. Boxes without class, image or confidence are no evidence.
    """
    return _judge(images, per_class(boxes.where("class is not null and image_id is not null and confidence is not null"), rules), rules)


def _judge(images: DataFrame, seen: DataFrame, rules: RuleSet) -> DataFrame:
    """The decisions that follow from the counts of ``per_class``."""
    counts = [
        F.sum(F.when(F.lit(cls is None) | (F.col("class") == F.lit(cls or "")), F.col(f"`{_at(t)}`")).otherwise(0)).alias(_name((cls, t)))
        for cls, t in rules.counts()
    ]
    doubt = F.max(unsettled(rules, F.col("class"), F.col("best"))).alias("doubt")
    evidence = seen.groupBy("image_id").agg(*counts, doubt)
    counted = lambda c: F.coalesce(F.col(f"`{_name(c)}`"), F.lit(0))
    joined = images.select("image_id").join(evidence, "image_id", "left")
    return joined.select(
        "image_id",
        F.coalesce(rules.choose(counted, lambda r: r.name), F.lit(UNMATCHED[0])).alias("category"),
        F.coalesce(rules.choose(counted, lambda r: r.action), F.lit(UNMATCHED[1])).alias("action"),
        F.coalesce("doubt", F.lit(False)).alias("needs_review"),
    )


def uncertain_classes(boxes: DataFrame, rules: RuleSet) -> DataFrame:
    """``image_id, classes``: sorted, the classes of an image that a second opinion should settle; images without are left out."""
    best = boxes.groupBy("image_id", "class").agg(F.max("confidence").alias("best"))
    asked = best.where(unsettled(rules, F.col("class"), F.col("best"), escalatable_only=True))
    return asked.groupBy("image_id").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def adjudicated(boxes: DataFrame, verdicts: DataFrame, rules: RuleSet) -> DataFrame:
    """``boxes`` as second opinions leave them.

    ``boxes``: id (unique), image_id, class, confidence and more; ``verdicts``: image_id, class (unique together),
    verdict, verdict_confidence. Boxes at or above their class's confidence stay. Below it, ``absent`` drops all of a
    class, ``present`` raises the best one (smallest id of equal ones) to the threshold or the verdict's confidence if
    that is more, anything else changes nothing. The best box comes from a map-side combined maximum, not a window.
    """
    said = verdicts.select("image_id", "class", "verdict", "verdict_confidence")
    both = boxes.join(said, ["image_id", "class"], "left")
    threshold = rules.band_column(F.col("class"), "confidence")
    weak = F.col("confidence") < threshold
    best = (
        both.where(weak & (F.col("verdict") == "present"))
        .groupBy("image_id", "class")
        .agg((-F.max(F.struct("confidence", (-F.col("id")).alias("minus")))["minus"]).alias("__raised"))
        .select("__raised")
    )
    kept = both.where(~(weak & F.coalesce(F.col("verdict") == "absent", F.lit(False))))
    raised = kept.join(best, F.col("id") == F.col("__raised"), "left")
    confidence = F.when(F.col("__raised").isNotNull(), F.greatest(threshold, F.col("verdict_confidence"))).otherwise(F.col("confidence"))
    return raised.withColumn("confidence", confidence).select(*boxes.columns)


def recheck(images: DataFrame, boxes: DataFrame, verdicts: DataFrame, rules: RuleSet) -> DataFrame:
    """Stored evidence replayed: the decisions that the rules make of the boxes as verdicts leave them.

    The same as ``decide`` on ``adjudicated``, without ever building the boxes that verdicts leave: a verdict only moves
    the counts of its image and class. They are counted first, map-side, with the number of settled boxes and the best
    unsettled one beside them; ``absent`` leaves the settled ones, ``present`` counts the best unsettled one at its new
    confidence instead of its own. So each table is read once and the join is one of images and classes, not of boxes.
    """
    thresholds = sorted({t for _, t in rules.counts()})
    known = boxes.where("class is not null and image_id is not null and confidence is not null")
    high = rules.band_column(F.col("class"), "confidence")
    weak = F.col("confidence") < high
    seen = known.groupBy("image_id", "class").agg(
        F.max("confidence").alias("best"),
        F.count_if(~weak).alias("__settled"),
        F.max(F.when(weak, F.col("confidence"))).alias("__weak"),
        *[F.count_if(F.col("confidence") >= t).alias(_at(t)) for t in thresholds],
    )
    said = verdicts.select("image_id", "class", "verdict", "verdict_confidence")
    both = seen.join(said, ["image_id", "class"], "left")
    absent = F.coalesce(F.col("verdict") == "absent", F.lit(False))
    raised = F.when((F.col("verdict") == "present") & F.col("__weak").isNotNull(), F.greatest(high, F.col("verdict_confidence")))

    def after(t: float):
        count, settled = F.col(f"`{_at(t)}`"), F.col("__settled")
        moved = (raised >= t).cast("long") - (F.col("__weak") >= t).cast("long")
        return F.when(absent, F.least(count, settled)).otherwise(count + F.coalesce(moved, F.lit(0))).alias(_at(t))

    left = both.where(~absent | (F.col("__settled") > 0))  # a class of which nothing is left is no evidence
    adjusted = left.select("image_id", "class", F.greatest("best", raised).alias("best"), *[after(t) for t in thresholds])
    return _judge(images, adjusted, rules)


def merge_frames(frames: DataFrame) -> DataFrame:
    """One set of boxes for a video: per class those of the frame that saw most of it.

    ``frames``: file_id, frame, class, confidence and more. The best frame has the most boxes, then the most confident
    one, then comes first. Files without boxes have none; the order of the result is not defined.
    """
    each = frames.groupBy("file_id", "frame", "class").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))
    busiest = F.max(F.struct("n", "top", (-F.col("frame")).alias("early")))
    best = each.groupBy("file_id", "class").agg((-busiest["early"]).alias("frame"))
    return frames.join(best, ["file_id", "class", "frame"]).select(*frames.columns)


def with_video_class(boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """``boxes`` (image_id, class, confidence) and for each video one box of the class ``video``, which is certain."""
    mark = videos.select("image_id", F.lit(VIDEO).alias("class"), F.lit(1.0).alias("confidence"))
    return boxes.select("image_id", "class", "confidence").unionByName(mark)


def is_video(path: Column) -> Column:
    """Whether a path's suffix is a video's; a name that is only a dot and letters has no suffix."""
    # The suffixes of videos.
    suffixes = [".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".3gp", ".3g2", ".mpg", ".mpeg", ".wmv"]
    return F.coalesce(F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)).isin(suffixes), F.lit(False))


def sampled_frames(total: Column, count: int) -> Column:
    """The frames that stand for a video of ``total`` frames: the middle of each of ``count`` equal slices."""
    index = F.sequence(F.lit(0), F.least(F.lit(count), total.cast("int")) - 1)
    return F.when(total > 0, F.transform(index, lambda i: F.floor(total * (i + F.lit(0.5)) / F.lit(count)).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def middle_frame(total: Column) -> Column:
    """The frame that stands for a whole video where one picture of it is wanted; null where there is none."""
    return F.get(sampled_frames(total, 1), F.lit(0))


def by_strength(merged: DataFrame) -> DataFrame:
    """``merge_frames``'s rows with ``place``: the classes of a file from 0, those with most boxes first, then the most confident, then by name."""
    sizes = merged.groupBy("file_id", "class").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))
    order = Window.partitionBy("file_id").orderBy(F.desc("n"), F.desc("top"), "class")  # as many rows as a file has classes
    return merged.join(sizes.select("file_id", "class", (F.row_number().over(order) - 1).alias("place")), ["file_id", "class"]).select(*merged.columns, "place")


def walked_frames(fps: Column, read: Column, count: int, limit: int = 900) -> Column:
    """The frames that stand for a video of unknown length: about one a second of the first ``limit`` that could be read.

    ``fps`` null or 0 counts as 25; each second is represented by its middle frame, and ``count`` frames are enough.
    """
    stride = F.coalesce(F.when(fps >= 1, F.floor(fps)), F.lit(25)).cast("int")
    every = F.sequence(F.lit(0), F.lit(limit - 1))
    kept = F.filter(every, lambda i: (i % stride == F.floor(stride / 2)) & (i < F.coalesce(read, F.lit(0))))
    return F.slice(kept, 1, count)


def hints(boxes: DataFrame, rules: RuleSet) -> DataFrame:
    """``image_id, hint``: the settled boxes of each image as ``class (NN%)``, most confident first; images without are left out.

    Percentages are rounded as the exact binary value, halves to even, which no built-in function does; that is the
    one Arrow function here.
    """
    @F.pandas_udf("string")
    def percent(c: pd.Series) -> pd.Series:
        return c.map(lambda x: f"{x:.0%}")

    sure = boxes.where(F.col("confidence") >= rules.band_column(F.col("class"), "confidence"))
    label = F.concat(F.col("class"), F.lit(" ("), percent("confidence"), F.lit(")"))
    rows = sure.select("image_id", F.struct((-F.col("confidence")).alias("c"), F.col("id"), label.alias("label")).alias("x"))
    listed = rows.groupBy("image_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select("image_id", F.array_join(F.transform("xs", lambda x: x["label"]), ", ").alias("hint"))
