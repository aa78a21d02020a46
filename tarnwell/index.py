"""An index as its operators see it: current images, each box and verdict once, spellings of classes unified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.tables import current_rows, read_table

# The three verdicts, and what models say instead.
VERDICTS = ("present", "absent", "unsure")
ALIASES = {"yes": "present", "true": "present", "no": "absent", "false": "absent", "none": "absent"}


def bare(column: Column) -> Column:
    """A text without white space around it."""
    return F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def label(column: Column) -> Column:
    """A class in lower case without outer blanks; null for blank ones."""
    c = F.lower(bare(column))
    return F.when(c != "", c)


def verdict(column: Column) -> Column:
    """One of the three verdicts; whatever can't be read has told nothing and is ``unsure``."""
    c = F.lower(bare(column))
    said = F.create_map(*[F.lit(x) for k, v in (ALIASES | {v: v for v in VERDICTS}).items() for x in (k, v)])
    return F.coalesce(F.try_element_at(said, c), F.lit("unsure"))


def images(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows of the images; only ``columns`` if any are named."""
    table = read_table(spark, folder, "images")
    return current_rows(table, "id", "updated_at", list(columns) or table.columns)


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """id, image_id, class, confidence of each detection once, without those that lack one of them."""
    rows = read_table(spark, folder, "detections").select("id", "image_id", label(F.col("class")).alias("class"), "confidence")
    return rows.dropna().distinct()  # repeats are equal, so no column has to be carried beside the key


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, class, verdict, verdict_confidence: the last verdict on each class of an image."""
    rows = read_table(spark, folder, "adjudications").select(
        "image_id", label(F.col("class")).alias("class"), verdict(F.col("verdict")).alias("verdict"), "confidence", "created_at", "id"
    )
    last = F.max_by(F.struct("verdict", "confidence"), F.struct("created_at", "id"))
    held = rows.dropna(subset=["image_id", "class"]).groupBy("image_id", "class").agg(last.alias("x"))
    return held.select("image_id", "class", "x.verdict", F.coalesce("x.confidence", F.lit(0.0)).alias("verdict_confidence"))
