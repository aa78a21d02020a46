"""Consolidating pairwise matches into groups.

``connected`` is hash-to-min: every vertex keeps a cluster, at first itself and its neighbours; in each round it sends
the whole cluster to the cluster's smallest member and that smallest member to all others, until nothing changes.
A cluster is rows (vertex, member), never an array, and only sorted and combined by shuffles. The clusters of vertices that
hold very many members are not brought together even for their join: their smallest members are sent to where the rows
are. The state of each round is a table in the shared folder; a lost executor costs one round at most.

The pairs come from ``operators.near``. Copies are no problem of the pair search: equal hashes are one vertex, and whether
two vertices are linked in spite of pairs that are excepted is counted, not enumerated (``vertices``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.hashes import hamming, perceptual_bits
from tarnwell.operators.near import near_bits
from tarnwell.session import drop_table, materialize
from tarnwell.tables import current_rows, is_live, read_table

#: A vertex with more members than this is heavy. There can't be more heavy ones than rows divided by this, so what is
#: broadcast of them (two numbers each) is 16 MB for 10^12 rows.
HEAVY = 1_000_000


def connected(links: DataFrame, a: str, b: str, heavy: int = HEAVY) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``links``; the component is its smallest vertex.

    Null ends and loops link nothing; repeated links and either direction are the same. No links give no rows.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.explode(
        F.array(*[F.struct(F.col(v).alias("vertex"), F.col(m).alias("member")) for v, m in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))])
    )
    state = materialize(pairs.select(both.alias("x")).select("x.*").distinct().withColumn("new", F.lit(True)).withColumn("old", F.lit(False)), "clusters")
    changed = not state.isEmpty()
    scratch: list[DataFrame] = []
    while changed:
        clusters = state.select("vertex", "member")
        sizes = clusters.groupBy("vertex").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("members"))
        least = sizes.select("vertex", "least")
        if state.count() <= heavy:  # then no vertex can be
            known = clusters.join(least, "vertex")
        else:
            sizes = materialize(sizes, "sizes")
            scratch.append(sizes)
            large = F.broadcast(sizes.where(F.col("members") > heavy).select("vertex", "least"))
            light = clusters.join(large, "vertex", "left_anti").join(sizes.where(F.col("members") <= heavy).select("vertex", "least"), "vertex")
            known = clusters.join(large, "vertex").unionByName(light)
        sent = known.select(
            F.explode(
                F.array(
                    F.struct(F.col("least").alias("vertex"), F.col("member")),
                    F.struct(F.col("member").alias("vertex"), F.col("least").alias("member")),
                )
            ).alias("x")
        )
        flagged = sent.select("x.*", F.lit(True).alias("new"), F.lit(False).alias("old")).unionByName(
            clusters.withColumn("new", F.lit(False)).withColumn("old", F.lit(True))
        )
        merged = materialize(flagged.groupBy("vertex", "member").agg(F.max("new").alias("new"), F.max("old").alias("old")), "clusters")
        changed = not merged.where("new <> old").isEmpty()
        for old in (state, *scratch):
            drop_table(old)
        scratch = []
        state = merged.where("new")
        state._tarnwell_path = merged._tarnwell_path
    return state.groupBy("vertex").agg(F.min("member").alias("component"))


def excepted_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different ids, as ``id_a < id_b``."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return known.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()


def vertices(items: DataFrame, excepted: DataFrame) -> DataFrame:
    """``(id, h, vertex)``: items of one hash share a vertex where exceptions can't part them.

    If any item of a hash has no exception within it, it links all others. Else an item excepted from fewer than half
    of the others has, with every other such item, a common neighbour; these share one vertex, and only the remaining
    ones, whose number the exceptions bound, are vertices of their own. So no pairs of copies are ever listed.
    """
    ends = excepted.join(items.select(F.col("id").alias("id_a"), F.col("h").alias("h_a")), "id_a").join(
        items.select(F.col("id").alias("id_b"), F.col("h").alias("h_b")), "id_b"
    )
    within = ends.where("h_a = h_b").select(F.explode(F.array("id_a", "id_b")).alias("id"), F.col("h_a").alias("h"))
    degrees = within.groupBy("id", "h").agg(F.count(F.lit(1)).alias("degree"))
    sizes = items.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    touched = degrees.groupBy("h").agg(F.count(F.lit(1)).alias("touched"))
    parted = touched.join(sizes, "h").where("touched = size").select("h", "size")
    loose = degrees.join(parted, "h").withColumn("alone", F.col("degree") * 2 >= F.col("size") - 2)
    firsts = loose.where("not alone").groupBy("h").agg(F.min("id").alias("first_together"))
    own = loose.join(firsts, "h", "left").select("id", F.when(F.col("alone"), F.col("id")).otherwise(F.col("first_together")).alias("own"))
    return items.join(sizes.select("h", "first"), "h").join(own, "id", "left").select("id", "h", F.coalesce("own", "first").alias("vertex"))


def groups(items: DataFrame, excepted: DataFrame, distance: int = 3) -> DataFrame:
    """``(group_id, id)`` of all items in groups of two or more; ``items`` has unique ``id`` and the 64 bits ``h``.

    Items match when their bits differ in at most ``distance`` places and the pair is not in ``excepted`` (``id_a``,
    ``id_b``); groups hold all that is linked directly or indirectly and are named by their smallest id.
    """
    items = materialize(items.where("id is not null and h is not null").select("id", "h"), "items")
    at = materialize(vertices(items, excepted), "vertices")
    vertex = at.groupBy("vertex", "h").agg(F.count(F.lit(1)).alias("size"))
    pairs = near_bits(items, "h", distance)
    one = vertex.select(F.col("vertex").alias("v_a"), F.col("h").alias("hash_a"), F.col("size").alias("s_a"))
    two = vertex.select(F.col("vertex").alias("v_b"), F.col("h").alias("hash_b"), F.col("size").alias("s_b"))
    split = vertex.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("hash_a"), F.col("h").alias("hash_b"))
    linked = pairs.unionByName(split).join(one, "hash_a").join(two, "hash_b").where("v_a <> v_b")
    linked = linked.select(F.least("v_a", "v_b").alias("v_a"), F.greatest("v_a", "v_b").alias("v_b"), (F.col("s_a") * F.col("s_b")).alias("possible")).distinct()
    where = at.select("id", "vertex")
    barred = (
        excepted.join(where.select(F.col("id").alias("id_a"), F.col("vertex").alias("x")), "id_a")
        .join(where.select(F.col("id").alias("id_b"), F.col("vertex").alias("y")), "id_b")
        .groupBy(F.least("x", "y").alias("v_a"), F.greatest("x", "y").alias("v_b"))
        .agg(F.count(F.lit(1)).alias("barred"))
    )
    links = linked.join(barred, ["v_a", "v_b"], "left").where("coalesce(barred, 0) < possible")
    labels = connected(links, "v_a", "v_b")
    named = at.join(labels, "vertex", "left").select("id", F.coalesce("component", "vertex").alias("component"))
    big = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group_id")).where("n > 1")
    return named.join(big, "component").select("group_id", "id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p4_found."""
    current = current_rows(read_table(spark, folder, "images"), "id", "updated_at", ["phash", "missing", "deleted"])
    live = current.where(is_live(F.col("missing"), F.col("deleted"))).select("id", perceptual_bits("phash").alias("h"))
    dismissed = excepted_pairs(read_table(spark, folder, "dupe_dismissals"), "image_id_a", "image_id_b")
    return groups(live, dismissed).select("group_id", F.col("id").alias("image_id"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Query p4_links: the pairs of distinct perceptual hashes of live images that differ in 1 to 3 bits."""
    current = current_rows(read_table(spark, folder, "images"), "id", "updated_at", ["phash", "missing", "deleted"])
    live = current.where(is_live(F.col("missing"), F.col("deleted"))).select(perceptual_bits("phash").alias("h"))
    pairs = near_bits(live, "h")
    return pairs.withColumn("bits", hamming("hash_a", "hash_b"))
