"""Best representative of each group of duplicates, by skyline selection and dominance layers.

One record dominates another when it is at least as complete, at least as trusted and more recent (of equally recent ones
the smaller id counts as more recent, so that no two records tie). The undominated records are the first layer, the
skyline; those dominated by none but the first layer's are the second, and so on. The keeper comes from the skyline by a
lexicographic policy; each field is taken from the first layer that has a value for it, the best-ranked record within
the layer (trust, recency, id), so what the skyline lacks is filled from the layers behind it.

Completeness is either the set of fields that a record offers (``fields``: a dominating record offers them all) or their
number (``number``). With sets a field's best-ranked record is never dominated by one that lacks the field, so layers
give the best-ranked value of every field; with numbers a fuller record goes first and layers fill what it lacks.

Records of one group that agree in trust and offered fields are first reduced, map-side, to the most recent, which
dominates the others and offers what they do; so at most (levels of trust) x (sets of fields) candidates of a group
ever meet, however large the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.hashes import content_digest
from tarnwell.tables import current_rows, is_live, read_table


def usable(value: Column) -> Column:
    """The value where it is not null and positive."""
    return F.when(value > 0, value.cast("bigint"))


def survivors(df: DataFrame, group: str, key: str, trust: str, recency: str, fields: list[str], complete: str = "fields") -> DataFrame:
    """One row for each ``group`` of two or more records: ``keeper_id``, the value of each field, group's size, skyline's and number of layers.

    Fields must be null where unusable. Records rank by trust (high first), recency (late first) and key (small first);
    null trust or recency ranks lowest. The keeper is the record of the skyline with most fields, then the best-ranked. A
    field that no record has is null. Records without group or key are left out, an empty table gives no rows.
    """
    if complete not in ("fields", "number"):
        raise ValueError(f"completeness is compared by 'fields' or 'number', not {complete!r}")
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fields)])
    late = F.col(recency).cast("double")
    late = F.when(late.isNull() | F.isnan(late), F.lit(float("-inf"))).otherwise(late)
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("group"),
        F.coalesce(F.col(trust).cast("long"), F.lit(-(2**62))).alias("trust"),
        mask.alias("mask"),
        F.struct(late.alias("late"), (-F.col(key)).alias("minus_id"), *[F.col(f).cast("bigint").alias(f"f{i}") for i, f in enumerate(fields)]).alias("row"),
    )
    cells = rows.groupBy("group", "trust", "mask").agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("n"))
    candidate = F.struct("trust", "row.late", "row.minus_id", "mask", *[F.col(f"row.f{i}").alias(f"f{i}") for i in range(len(fields))])
    met = cells.groupBy("group").agg(F.sort_array(F.collect_list(candidate), asc=False).alias("met"), F.sum("n").alias("records")).where("records > 1")

    def dominates(s: Column, r: Column) -> Column:
        later = (s["late"] > r["late"]) | ((s["late"] == r["late"]) & (s["minus_id"] > r["minus_id"]))
        full = s["mask"].bitwiseAND(r["mask"]) == r["mask"] if complete == "fields" else F.bit_count(s["mask"]) >= F.bit_count(r["mask"])
        return full & (s["trust"] >= r["trust"]) & later

    # By rank, every record comes after all that dominate it, so one pass over them knows each one's layer.
    kind = met.schema["met"].dataType.elementType.simpleString()
    none_yet = F.array().cast(f"array<struct<row:{kind},layer:int>>")

    def placed(so_far: Column, r: Column) -> Column:
        above = F.transform(F.filter(so_far, lambda s: dominates(s["row"], r)), lambda s: s["layer"])
        return F.concat(so_far, F.array(F.struct(r.alias("row"), (F.coalesce(F.array_max(above), F.lit(0)) + 1).cast("int").alias("layer"))))

    layered = met.select("group", "records", F.explode(F.array(F.aggregate("met", none_yet, placed))).alias("all"))
    skyline = F.filter("all", lambda x: x["layer"] == 1)
    keeper = F.element_at(F.sort_array(F.transform(skyline, lambda x: F.struct(F.bit_count(x["row"]["mask"]).alias("fields"), x["row"])), asc=False), 1)["row"]

    def filled(i: int) -> Column:
        offers = F.filter("all", lambda x: x["row"][f"f{i}"].isNotNull())
        ranked = lambda x: F.struct((-x["layer"]).alias("layer"), x["row"].alias("row"))
        return F.array_max(F.transform(offers, ranked))["row"][f"f{i}"]

    return layered.select(
        F.col("group").alias(group),
        (-keeper["minus_id"]).alias("keeper_id"),
        *[filled(i).alias(f) for i, f in enumerate(fields)],
        "records",
        F.size(skyline).alias("skyline"),
        F.array_max(F.transform("all", lambda x: x["layer"])).alias("layers"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p6_found."""
    columns = ["hash", "root", "width", "height", "size", "missing", "deleted"]
    images = read_table(spark, folder, "images")
    current = current_rows(images, "id", "updated_at", [*columns, "updated_at"])
    live = current.where(is_live(F.col("missing"), F.col("deleted")))
    trust = read_table(spark, folder, "library_roots").groupBy("root").agg(F.max("trust").alias("trust"))
    records = live.join(trust, "root", "left").select(
        "id", content_digest("hash").alias("hash"), "trust", "updated_at", *[usable(F.col(f)).alias(f) for f in ("width", "height", "size")]
    )
    best = survivors(records, "hash", "id", "trust", "updated_at", ["width", "height", "size"])
    return best.select("hash", "keeper_id", "width", "height", "size")
