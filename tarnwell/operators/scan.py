"""Incremental scans: a listing of files against the index, and what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.schema import CHILDREN, PENDING
from tarnwell.session import materialize

#: Times that differ by less are the same.
TOLERANCE = 1e-6
#: What a file's content and place determine.
CONTENT = ("hash", "phash", "size", "mtime", "width", "height", "format", "taken_at")


def snapshot_diff(walk: DataFrame, index: DataFrame, key: str = "path", tolerance: float = TOLERANCE) -> DataFrame:
    """``key, status`` of every file in either: ``added``, ``changed``, ``missing`` or ``unchanged``.

    Both have ``key``, size and mtime. A file is unchanged if its size is equal and its times differ by less than the
    tolerance; a null time counts as 0, a null size equals only null. One full outer join on the key.
    """
    w = walk.select(F.col(key), F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"), F.lit(True).alias("walked"))
    i = index.select(F.col(key), F.col("size").alias("size_then"), F.col("mtime").alias("mtime_then"), F.lit(True).alias("indexed"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    same = F.col("size_now").eqNullSafe(F.col("size_then")) & (F.abs(zero("mtime_now") - zero("mtime_then")) < tolerance)
    status = F.when(F.col("indexed").isNull(), "added").when(F.col("walked").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return w.join(i, key, "full_outer").select(key, status.alias("status"))


def scan_tally(diff: DataFrame) -> DataFrame:
    """``status, n``."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert(index: DataFrame, rows: DataFrame, now: float, next_id: int | None = None) -> DataFrame:
    """The images after a scan's new and changed rows (unique ``path``; filename, root and the content columns).

    Known paths keep id, root, filename, first_seen and adjudicate_state, get the new content and start over; new paths
    get ids after the greatest known one, in order of path. Rows of other paths stay as they are.
    """
    fresh = rows.select("path", F.col("filename").alias("__filename"), F.col("root").alias("__root"), *[F.col(c).alias(f"__{c}") for c in CONTENT], F.lit(True).alias("__hit"))
    both = index.join(fresh, "path", "full_outer")
    hit, new = F.coalesce("__hit", F.lit(False)), F.col("id").isNull()
    reset = {
        "category": F.lit(None).cast("string"), "action": F.lit(None).cast("string"), "error": F.lit(None).cast("string"),
        "needs_review": F.lit(0), "detect_state": F.lit(PENDING), "analyze_state": F.lit(PENDING), "missing": F.lit(0), "deleted": F.lit(0), "updated_at": F.lit(now),
    }
    values = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in CONTENT}
    values |= {c: F.when(hit, v).otherwise(F.col(c)) for c, v in reset.items()}
    values |= {c: F.coalesce(c, f"__{c}") for c in ("filename", "root")}
    values |= {"first_seen": F.coalesce("first_seen", F.lit(now)), "adjudicate_state": F.coalesce("adjudicate_state", F.lit(PENDING))}
    merged = both.select(*[values.get(c, F.col(c)).cast(index.schema[c].dataType).alias(c) for c in index.columns])
    known, added = merged.where("id is not null"), merged.where("id is null")
    start = next_id if next_id is not None else (index.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0] + 1)
    return known.unionByName(numbered(added.drop("id"), "path", start).select(*index.columns))


def numbered(df: DataFrame, order: str | list, start: int, name: str = "id") -> DataFrame:
    """``df`` with ``id``: consecutive from ``start`` in the order of some columns, without ordering all rows in one task.

    Rows are sorted into ranges; each range is numbered by itself and shifted by the sizes of those before it.
    """
    sorted_rows = df.sort(*([order] if isinstance(order, str) else order)).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(sorted_rows, "numbered")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first")).orderBy("__part").collect()  # one row a partition
    shifts, total = [], start
    for r in sizes:
        shifts.append((r["__part"], total - r["first"]))
        total += r["n"]
    if not shifts:
        return rows.withColumn(name, F.lit(None).cast("bigint")).drop("__part", "__row")
    moved = df.sparkSession.createDataFrame(shifts, "__part int, __shift bigint")
    return rows.join(F.broadcast(moved), "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def flag_missing(images: DataFrame, root: str | None = None) -> DataFrame:
    """``images`` with all files of a root (or of all) marked missing until a scan finds them."""
    gone = F.lit(True) if root is None else F.col("root") == root
    return images.withColumn("missing", F.when(gone, 1).otherwise(F.col("missing")))


def touch_present(images: DataFrame, present: DataFrame) -> DataFrame:
    """``images`` with those in ``present`` (path) neither missing nor deleted."""
    seen = present.select("path", F.lit(True).alias("__seen")).distinct()
    hit = F.col("__seen").isNotNull()
    both = images.join(seen, "path", "left")
    return both.withColumns({c: F.when(hit, 0).otherwise(F.col(c)) for c in ("missing", "deleted")}).select(*images.columns)


def stale_rows(derived: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of a derived table that belong to changed images (``id``) and so no longer hold."""
    return derived.join(changed.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def without_stale(derived: DataFrame, changed: DataFrame) -> DataFrame:
    """A derived table without the rows of changed images."""
    return derived.join(changed.select(F.col("id").alias("image_id")), "image_id", "left_anti")


def purge(tables: dict[str, DataFrame], gone) -> dict[str, DataFrame]:
    """The tables of an index without the images that meet a condition, and without the rows that hang on them."""
    kept = tables["images"].where(~F.coalesce(gone, F.lit(False)))
    ids = kept.select("id")
    out = {**tables, "images": kept}
    for name in CHILDREN:
        if name in tables:
            for column in [c for c in ("image_id", "image_id_a", "image_id_b") if c in tables[name].columns]:
                out[name] = out[name].join(ids.withColumnRenamed("id", column), column, "left_semi").select(*tables[name].columns)
    return out


def unconfigured_roots(images: DataFrame, configured: DataFrame) -> DataFrame:
    """Roots that the index has and the settings don't."""
    return images.select("root").distinct().join(configured.select("root"), "root", "left_anti")
