"""Records of an index for other programs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.scan import numbered
from tarnwell.session import materialize

CSV_COLUMNS = ["id", "path", "category", "needs_review", "width", "height", "taken_at", "detections", "metadata"]


def ranked_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` (id, image_id, confidence and more) with ``rank``: their place in their image, most confident first, from 0.

    The long form of an image's boxes. All boxes are sorted together, so an image that has a tenth of them is spread over
    as many tasks as its rows need; a box's rank is its place in this order less that of its image's first one.
    """
    rows = materialize(numbered(boxes, ["image_id", F.desc("confidence"), "id"], 0, "__place"), "ranked")
    first = rows.groupBy("image_id").agg(F.min("__place").alias("__first"))
    return rows.join(first, "image_id").select(*boxes.columns, (F.col("__place") - F.col("__first")).alias("rank"))


def boxes_by_image(boxes: DataFrame) -> DataFrame:
    """``image_id, detections``: the boxes of each image, most confident first (equal ones by id).

    One row per image is what the nested formats ask for, so the largest image has to fit into a row; ``ranked_boxes`` is
    the form without that bound.
    """
    columns = [c for c in boxes.columns if c not in ("id", "image_id", "confidence")]
    box = F.struct((-F.col("confidence")).alias("order"), "id", *columns, "confidence")
    listed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("xs"))
    named = F.transform("xs", lambda x: F.struct(*[x[c].alias(c) for c in columns], x["confidence"].alias("confidence")))
    return listed.select("image_id", named.alias("detections"))


def records(images: DataFrame, boxes: DataFrame, metadata: DataFrame, category: str | None = None) -> DataFrame:
    """One row per image that is there: its columns, ``metadata`` (text or null) and ``detections`` (empty if none)."""
    rows = images.where("missing = 0")
    rows = rows.where(F.col("category") == category) if category else rows
    rows = rows.select("id", "path", "filename", "hash", "width", "height", "taken_at", "category", "action", "needs_review")
    found = boxes_by_image(boxes).withColumnRenamed("image_id", "id")
    text = metadata.select(F.col("image_id").alias("id"), F.col("json").alias("metadata"))
    joined = rows.join(text, "id", "left").join(found, "id", "left")
    empty = F.array().cast(joined.schema["detections"].dataType)
    return joined.withColumn("detections", F.coalesce("detections", empty))


def write_json(rows: DataFrame, path: str) -> None:
    """Records as JSON lines, a file per partition; metadata is nested where it is JSON."""
    nested = F.when(F.try_parse_json("metadata").isNotNull(), F.try_parse_json("metadata"))
    rows.withColumn("metadata", nested).write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str) -> int:
    """Records in order of id as one pretty JSON array in a file of the driver; returns how many.

    They come to the driver a partition at a time, so the file may be larger than its memory.
    """
    nested = F.when(F.try_parse_json("metadata").isNotNull(), F.to_json(F.try_parse_json("metadata")))
    texts = rows.withColumn("__meta", nested).orderBy("id")
    text = texts.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"), "__meta")
    count = 0
    with open(path, "w", encoding="utf-8") as file:
        file.write("[")
        for row in text.toLocalIterator():
            record = json.loads(row["row"]) | {"metadata": None if row["__meta"] is None else json.loads(row["__meta"])}
            file.write((",\n" if count else "\n") + json.dumps(record, indent=2, ensure_ascii=False))
            count += 1
        file.write("\n]\n")
    return count


def csv_rows(rows: DataFrame) -> DataFrame:
    """Records as the nine columns of the CSV export; boxes as ``class:0.00`` joined by ``;``.

    Confidences are rounded as exact binary values, which only a function outside the JVM does.
    """

    @F.pandas_udf("string")
    def shown(detections: pd.Series) -> pd.Series:
        return detections.map(lambda ds: ";".join(f"{d['class']}:{d['confidence']:.2f}" for d in ds))

    return rows.withColumns({"detections": shown("detections"), "metadata": F.coalesce("metadata", F.lit(""))}).select(*CSV_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """The CSV export, a file with header per partition."""
    csv_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
