"""Frequency of every distinct term, kept up to date by signed deltas.

``TermCounts`` is a persistent state: postings (field, term, image -> occurrences) and totals per term and per field. All
three are append-only: an update aggregates its signed records map-side (every added record counts +1, every deleted one
-1, a changed one both), writes them as one more segment of postings, looks up what the images it touches had before,
and writes by how much the totals of its terms and fields move. Where an image's count of a term starts or stops being
positive, the term's number of images moves by one. Nothing that was written is written again, until there are so many
segments that they are merged.

Postings are sorted by a bucket, the hash of their image, within each file. An update reads only the pages of the
buckets that it touches, so it costs what it brings, not what there is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.terms import term
from tarnwell.session import new_table_path
from tarnwell.tables import current_rows, read_table

POSTINGS = "field string, term string, image_id bigint, bucket int, change bigint"
TERMS = "field string, term string, occurrences bigint, images bigint"
FIELDS = "field string, images bigint"
#: Postings lie in so many buckets; they are an order within files, not files of their own, so there may be many.
BUCKETS = 1 << 16
#: Beyond so many segments they are merged.
SEGMENTS = 12
#: Up to so many buckets are named in the filter of a lookup; an update that touches more reads nearly all pages anyway.
NAMED_BUCKETS = 4_000

#: A term in fewer images than this is rare; one in more than this share of the images of its field is common.
RARE_BELOW, COMMON_ABOVE = 5, 0.25


def signed_changes(new: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows of ``new`` and ``old`` that differ, with ``weight`` +1 for what came and -1 for what went.

    Both have unique ``keys`` and need only hold the records that may have changed. Without ``old`` everything came. Rows
    that stayed the same cancel out and are dropped.
    """
    came = new.withColumn("weight", F.lit(1))
    if old is None:
        return came
    columns = [c for c in new.columns if c != "weight"]
    both = came.unionByName(old.select(*columns).withColumn("weight", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("weight").cast("int").alias("weight")).where("weight <> 0")


class TermCounts:
    """Counts of terms under a folder in storage that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, segments: int = SEGMENTS) -> None:
        self.spark, self.path, self.segments = spark, path.rstrip("/"), segments
        self._state = self._load()

    # A manifest names the segments of each table. Each update adds one under the next number, renamed into place as a
    # whole, so a failed update changes nothing; the one with the greatest number holds. Segments that a merge replaces
    # stay until the update after it, for tables read before may still be in use.
    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _load(self) -> dict:
        fs, where = self._fs(f"{self.path}/manifest-*.json")
        found = sorted(int(f.getPath().getName()[9:-5]) for f in (fs.globStatus(where) or []))
        if not found:
            return {"number": 0, "postings": [], "terms": [], "fields": [], "retired": []}
        lines = self.spark.read.text(f"{self.path}/manifest-{found[-1]}.json").collect()
        return json.loads("\n".join(r[0] for r in lines))

    def _save(self, state: dict, drop: list[str]) -> None:
        state["number"] += 1
        fs, fresh = self._fs(f"{self.path}/new-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(fresh, self._fs(f"{self.path}/manifest-{state['number']}.json")[1]):
            raise RuntimeError(f"update {state['number']} was made by someone else meanwhile")
        self._state = state
        self._delete(drop)

    def _delete(self, folders: list[str]) -> None:
        for folder in folders:
            fs, where = self._fs(folder)
            fs.delete(where, True)

    def drop(self) -> None:
        """Removes the state from storage."""
        self._delete([self.path])

    def _write(self, df: DataFrame, table: str) -> str:
        folder = f"{self.path}/{table}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def _read(self, table: str, schema: str, state: dict | None = None) -> DataFrame:
        folders = (state or self._state)[table]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _before(self, delta: DataFrame) -> DataFrame:
        """What the images of ``delta`` had in its fields: field, term, image_id and ``before``."""
        touched = [r[0] for r in delta.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
        held = self._read("postings", POSTINGS)
        if len(touched) <= NAMED_BUCKETS:
            held = held.where(F.col("bucket").isin(touched))
        images = delta.where("image_id is not null").select("field", "image_id").distinct()
        return held.join(images, ["field", "image_id"], "left_semi").groupBy("field", "term", "image_id").agg(F.sum("change").alias("before"))

    def update(self, changes: DataFrame) -> None:
        """Takes in ``changes``: field, term, image_id and weight (+1 or -1) of each record that came or went.

        Records without term are left out. A record without image counts as an occurrence in no image. Repeating an
        update counts twice; the caller sends each change once. With no changes nothing happens.
        """
        summed = (
            changes.where(F.col("field").isNotNull() & F.col("term").isNotNull())
            .groupBy("field", "term", "image_id")
            .agg(F.sum(F.col("weight").cast("bigint")).alias("change"))
            .where("change <> 0")
        )
        bucket = F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("int")
        segment = self._write(summed.withColumn("bucket", bucket).sortWithinPartitions("bucket"), "postings")
        delta = self.spark.read.schema(POSTINGS).parquet(segment)
        if delta.isEmpty():
            self._delete([segment])
            return
        scratch = []
        rows = delta.withColumn("before", F.lit(0).cast("bigint"))
        if self._state["postings"]:
            known = self._before(delta).select("field", "term", "image_id", F.lit(0).cast("bigint").alias("change"), "before")
            rows = rows.select("field", "term", "image_id", "change", "before").unionByName(known)
            rows = rows.groupBy("field", "term", "image_id").agg(F.sum("change").alias("change"), F.sum("before").alias("before"))
            scratch = [self._write(rows, "touched")]
            rows = self.spark.read.schema(rows.schema).parquet(*scratch)
        had, has = F.col("before") > 0, F.col("before") + F.col("change") > 0
        step = F.when(F.col("image_id").isNotNull(), has.cast("bigint") - had.cast("bigint")).otherwise(F.lit(0))
        terms = rows.where("change <> 0").groupBy("field", "term").agg(F.sum("change").alias("occurrences"), F.sum(step).alias("images"))
        members = rows.where("image_id is not null").groupBy("field", "image_id").agg(F.max(had.cast("int")).alias("had"), F.max(has.cast("int")).alias("has"))
        fields = members.groupBy("field").agg(F.sum((F.col("has") - F.col("had")).cast("bigint")).alias("images"))
        fresh = {"postings": segment, "terms": self._write(terms, "terms"), "fields": self._write(fields, "fields")}
        state = {**self._state, **{k: [*self._state[k], v] for k, v in fresh.items()}}
        drop, state["retired"] = [*state["retired"], *scratch], []
        if len(state["postings"]) > self.segments:
            merged = self._merged(state)
            state["retired"] = [x for k in merged for x in state[k]]
            state |= merged
        self._save(state, drop)

    def _merged(self, state: dict) -> dict:
        """One segment in place of all of each table; what has come and gone again leaves no row."""
        postings = self._read("postings", POSTINGS, state).groupBy("field", "term", "image_id", "bucket").agg(F.sum("change").alias("change"))
        terms = self._sums(self._read("terms", TERMS, state), ["field", "term"], ["occurrences", "images"])
        fields = self._sums(self._read("fields", FIELDS, state), ["field"], ["images"])
        return {
            "postings": [self._write(postings.where("change <> 0").sortWithinPartitions("bucket"), "postings")],
            "terms": [self._write(terms, "terms")],
            "fields": [self._write(fields, "fields")],
        }

    @staticmethod
    def _sums(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(" or ".join(f"{c} <> 0" for c in sums))

    def terms(self) -> DataFrame:
        """``field, term, occurrences, images`` of every term; empty before the first update."""
        return self._sums(self._read("terms", TERMS), ["field", "term"], ["occurrences", "images"])

    def fields(self) -> DataFrame:
        """``field, images``: in how many images each field has any term."""
        return self._sums(self._read("fields", FIELDS), ["field"], ["images"])

    def marked(self, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
        """``terms`` with ``marks``, an array of ``rare`` and ``common``."""
        total = self.fields().withColumnRenamed("images", "field_images")
        marks = F.array_compact(
            F.array(
                F.when(F.col("images") < rare_below, F.lit("rare")),
                F.when(F.col("images") > F.coalesce("field_images", F.lit(0)) * F.lit(common_above), F.lit("common")),
            )
        )
        return self.terms().join(total, "field", "left").withColumn("marks", marks).drop("field_images")


def _records(rows: DataFrame, field: str, value: str) -> DataFrame:
    """``field, record_id, image_id, term`` of rows of detections or adjudications, each record once.

    Rows of null id can't be told apart by it: each distinct content (image and value) is a record.
    """
    rows = rows.select("id", "image_id", F.col(value).alias("value"))
    unnamed = [F.when(F.col("id").isNull(), F.col(c)).alias(f"__{c}") for c in ("image_id", "value")]
    once = rows.groupBy("id", *unnamed).agg(F.first("image_id").alias("image_id"), F.first("value").alias("value"))
    return once.select(F.lit(field).alias("field"), F.col("id").alias("record_id"), "image_id", term("value").alias("term"))


def _categories(images: DataFrame) -> DataFrame:
    """The same of the current rows among some versions of images."""
    current = current_rows(images, "id", "updated_at", ["category"])
    return current.select(F.lit("images.category").alias("field"), F.col("id").alias("record_id"), F.col("id").alias("image_id"), term("category").alias("term"))


def _since(column: str, moment: float) -> Column:
    return F.coalesce(F.col(column) > moment, F.lit(False))


def records_until(spark: SparkSession, folder: str, moment: float) -> DataFrame:
    """``field, record_id, image_id, term`` of the index as it was at a moment; rows without time were always there."""
    parts = [_records(read_table(spark, folder, t).where(~_since("created_at", moment)), f"{t}.{c}", c) for t, c in (("detections", "class"), ("adjudications", "verdict"))]
    images = _categories(read_table(spark, folder, "images").where(~_since("updated_at", moment)))
    return parts[0].unionByName(parts[1]).unionByName(images).where("term is not null")


def changes_since(spark: SparkSession, folder: str, moment: float) -> DataFrame:
    """The signed records that lead from the index at a moment to the index now, from the rows that came since.

    Boxes and verdicts never change, so their new rows are new records. A new version of an image takes back what its
    last one before the moment had said; those are looked up for the images with new versions only.
    """
    fresh = [_records(read_table(spark, folder, t).where(_since("created_at", moment)), f"{t}.{c}", c) for t, c in (("detections", "class"), ("adjudications", "verdict"))]
    came = fresh[0].unionByName(fresh[1])
    images = read_table(spark, folder, "images").select("id", "category", "updated_at")
    newer = images.where(_since("updated_at", moment))
    older = images.where(~_since("updated_at", moment)).join(newer.select("id").distinct(), "id", "left_semi")
    signed = [x.withColumn("weight", F.lit(w)) for x, w in ((came, 1), (_categories(newer), 1), (_categories(older), -1))]
    return signed[0].unionByName(signed[1]).unionByName(signed[2]).where("term is not null")


#: The queries take the rows up to this quantile of the images' times as the state that there was, the rest as changes to it.
KNOWN_BEFORE = 0.9


def counted(spark: SparkSession, folder: str) -> TermCounts:
    """The state of an index: what it was at a moment, then the signed changes since."""
    counts = TermCounts(spark, new_table_path(spark, "terms"))
    moment = read_table(spark, folder, "images").agg(F.percentile_approx(F.nanvl("updated_at", F.lit(None).cast("double")), KNOWN_BEFORE)).head()[0]
    moment = 0.0 if moment is None else moment
    counts.update(records_until(spark, folder, moment).withColumn("weight", F.lit(1)))
    counts.update(changes_since(spark, folder, moment))
    return counts


def take_back_gone(spark: SparkSession, folder: str, counts: TermCounts) -> None:
    """Deletes from ``counts`` the records of images whose current row is missing or deleted."""
    flags = current_rows(read_table(spark, folder, "images"), "id", "updated_at", ["missing", "deleted"])
    gone = flags.where((F.col("missing") == 1) | (F.col("deleted") == 1)).select(F.col("id").alias("image_id"))
    everything = records_until(spark, folder, float("inf"))
    counts.update(everything.join(gone, "image_id", "left_semi").withColumn("weight", F.lit(-1)))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p1_found."""
    return counted(spark, folder).marked().select("field", "term", F.explode("marks").alias("mark"))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Query p1_counts: every term with its occurrences and images."""
    return counted(spark, folder).terms()


def p1_live(spark: SparkSession, folder: str) -> DataFrame:
    """Query p1_live: the same once the records of images that are missing or deleted have been taken back."""
    counts = counted(spark, folder)
    take_back_gone(spark, folder, counts)
    return counts.terms()
