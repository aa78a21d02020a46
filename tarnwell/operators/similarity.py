"""Near-duplicates by perceptual hash: Hamming join, components, groups around keepers."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.hashes import hamming, similarity
from tarnwell.operators.near import near_bits, signed
from tarnwell.session import drop_table, materialize

#: Up to this distance pairs meet under choices of equal blocks; beyond, blocks are too short and bands are probed.
BLOCK_DISTANCE = 4
#: A plan holds at most so many probes as literals.
MOST_PROBES = 20_000
#: A band's value shared by more hashes than this is met in parts.
CROWDED_BAND = 5_000


def _probes(bands: int, distance: int) -> int:
    width, radius = 64 // bands, distance // bands
    return bands * sum(comb(64 - width * (bands - 1), i) for i in range(radius + 1))


def choose_bands(rows: int, distance: int) -> int:
    """Into how many bands 64 bits are best cut for a search up to ``distance`` bits.

    Two hashes agree in some of m bands up to distance // m bits, so probing every value that near to a band's finds
    all pairs. More bands mean fewer probes each but shorter, fuller keys; the cheapest by expected rows wins among those
    whose probes fit into a plan.
    """
    fitting = [m for m in range(1, min(distance + 1, 16) + 1) if _probes(m, distance) <= MOST_PROBES]
    return min(fitting or [min(distance + 1, 16)], key=lambda m: _probes(m, distance) * (1 + rows / 2 ** (64 // m)))


def probed_pairs(classes: DataFrame, distance: int, bands: int | None = None, crowded: int = CROWDED_BAND) -> DataFrame:
    """``hash_a, hash_b``, a < b, of distinct hashes ``h`` up to ``distance`` bits apart, by probing the values near each band.

    A value that more than ``crowded`` hashes share in a band is cut in parts by a hash of theirs, and what probes it goes
    to all parts, so no task has to meet a crowd as a whole.
    """
    known = classes.count()
    m = bands or choose_bands(known, distance)
    radius, edges = distance // m, [64 * i // m for i in range(m + 1)]
    masks, probes = [], []
    for low, high in zip(edges, edges[1:]):
        masks.append(signed(((1 << high) - 1) ^ ((1 << low) - 1)))
        probes.append([signed(sum(1 << b for b in flips)) for r in range(radius + 1) for flips in combinations(range(low, high), r)])
    stored = classes.select("h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(x)) for x in masks])).alias("band", "value"))
    flips = F.array(*[F.array(*[F.lit(f) for f in fs]) for fs in probes])
    near = stored.select(F.col("h").alias("g"), "band", "value", F.explode(F.element_at(flips, F.col("band") + 1)).alias("flip"))
    near = near.select("g", "band", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    full = stored.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded)
    keys = ["band", "value"]
    parts = materialize(full.select(*keys, F.ceil(F.col("n") / crowded).cast("int").alias("parts")), "crowds") if known > crowded else None
    if parts is not None and not parts.isEmpty():
        some = F.coalesce("parts", F.lit(1))
        stored = stored.join(parts, keys, "left").withColumn("part", F.pmod(F.xxhash64("h"), some).cast("int")).drop("parts")
        near = near.join(parts, keys, "left").select("g", *keys, F.explode(F.sequence(F.lit(0), some - 1)).alias("part"))
        keys = [*keys, "part"]
    met = stored.join(near, keys).where((F.col("h") < F.col("g")) & (hamming("h", "g") <= distance))
    return met.select(F.col("h").alias("hash_a"), F.col("g").alias("hash_b")).distinct()


def hash_pairs(hashes: DataFrame, bits: str, distance: int, bands: int | None = None) -> DataFrame:
    """``hash_a, hash_b``, a < b: all pairs of distinct values of ``bits`` that differ in at most ``distance`` bits."""
    if distance <= BLOCK_DISTANCE and bands is None:
        return near_bits(hashes, bits, distance)
    classes = hashes.where(F.col(bits).isNotNull()).select(F.col(bits).cast("bigint").alias("h")).distinct()
    return probed_pairs(classes, distance, bands)


def hamming_pairs(hashes: DataFrame, key: str, bits: str, distance: int, bands: int | None = None) -> DataFrame:
    """``a, b, distance, similarity``: all pairs of different 64-bit hashes that differ in at most ``distance`` bits.

    ``a`` and ``b``, a < b, are the smallest keys that have the hashes; ``copies`` tells which other keys share them, so
    a hash that a third of all rows have makes no pairs of its own. Always an equi-join, never a join of all with all.
    Null hashes match nothing.
    """
    rows = hashes.where(F.col(bits).isNotNull()).select(F.col(key).alias("key"), F.col(bits).cast("bigint").alias("h"))
    named = rows.groupBy("h").agg(F.min("key").alias("key"))
    linked = hash_pairs(rows, "h", distance, bands)
    pairs = linked.join(named.select(F.col("h").alias("hash_a"), F.col("key").alias("x")), "hash_a").join(named.select(F.col("h").alias("hash_b"), F.col("key").alias("y")), "hash_b")
    return pairs.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hamming("hash_a", "hash_b").alias("distance"), similarity("hash_a", "hash_b").alias("similarity")
    )


def copies(hashes: DataFrame, key: str, bits: str) -> DataFrame:
    """``a, b``: for every row whose hash an earlier key has too, that smallest key and its own."""
    rows = hashes.where(F.col(bits).isNotNull()).select(F.col(key).alias("b"), F.col(bits).alias("h"))
    first = rows.groupBy("h").agg(F.min("b").alias("a"))
    return rows.join(first, "h").where("a < b").select("a", "b")


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those dismissed, whichever way round (image_id_a, image_id_b)."""
    barred = dismissed.select(F.least("image_id_a", "image_id_b").alias("a"), F.greatest("image_id_a", "image_id_b").alias("b")).distinct()
    return pairs.join(barred, ["a", "b"], "left_anti")


def all_pairs(groups: DataFrame, group: str, member: str) -> DataFrame:
    """The unordered pairs of a person's own selection (a few ids per group), as dismissing a group records them."""
    a, b = groups.select(group, F.col(member).alias("image_id_a")), groups.select(group, F.col(member).alias("image_id_b"))
    return a.join(b, group).where("image_id_a < image_id_b").select("image_id_a", "image_id_b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``pairs`` (a, b); the component is its smallest id.

    Each round, every id takes the smallest label among its own, its neighbours' and its label's; labels halve their
    way like union-find's path compression. Each round's labels are a table, so lineage stays short.
    """
    edges = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        reached = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lifted = labels.select(F.col("id").alias("__of"), F.col("label").alias("lifted"))
        step = labels.join(reached, labels["id"] == reached["a"]).join(lifted, labels["label"] == lifted["__of"])
        fresh = materialize(step.select("id", F.least("label", "near", "lifted").alias("label"), (F.col("label") > F.least("near", "lifted")).alias("moved")), "labels")
        settled = fresh.where("moved").isEmpty()
        drop_table(labels)
        labels = fresh
        if settled:
            drop_table(edges)
            return labels.select("id", F.col("label").alias("component"))


def keeper_groups(items: DataFrame, labels: DataFrame, distance: int, pairs: DataFrame | None = None) -> DataFrame:
    """``component, keeper, id, similarity``: components cut into groups within ``distance`` bits of a keeper.

    ``items``: id, h, width, height, size; ``labels``: id, component; ``pairs`` (hash_a, hash_b) of hashes that near, found
    here if not given. Over and over the best of what is left of a component (most pixels, then bytes, then smallest id)
    takes all within the distance; groups of one aren't kept. Every member is thus as near to its keeper as promised,
    which a chain of matches isn't.

    Equal hashes of a component are one node, for they are always taken together. A node that beats all its undecided
    neighbours is a keeper at once, whatever goes on elsewhere, so a round settles many keepers of a component, and its
    neighbours are out; in the end each of them belongs to the best keeper next to it. No group is ever in one place.
    """
    pixels = F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))
    known = items.join(labels, "id").select("id", "component", "h", pixels.alias("pixels"), F.coalesce("size", F.lit(0)).alias("size"))
    known = materialize(known, "ranked")
    rank = F.struct("pixels", "size", (-F.col("id")).alias("minus"))
    nodes = materialize(known.groupBy("component", "h").agg(F.max(rank).alias("rank")), "nodes")
    near = hash_pairs(known, "h", distance) if pairs is None else pairs
    one = nodes.select("component", F.col("h").alias("hash_a"), F.col("rank").alias("rank_a"))
    two = nodes.select("component", F.col("h").alias("hash_b"), F.col("rank").alias("rank_b"))
    beside = near.join(one, "hash_a").join(two, ["component", "hash_b"])
    ahead = F.col("rank_a") > F.col("rank_b")
    better, worse = (F.struct(F.when(x, F.col("hash_a")).otherwise(F.col("hash_b")).alias("h"), F.when(x, F.col("rank_a")).otherwise(F.col("rank_b")).alias("rank")) for x in (ahead, ~ahead))
    edges = materialize(beside.select("component", better.alias("better"), worse.alias("worse")), "edges")
    state = materialize(nodes.select("component", "h", F.lit(None).cast("boolean").alias("keeps")), "settled")
    open_edges = edges.select("component", F.col("better.h").alias("b"), F.col("worse.h").alias("w"))
    while True:
        # what is undecided and beaten by nobody undecided keeps; what lies next to it is taken
        beaten = open_edges.select("component", F.col("w").alias("h"), F.lit(True).alias("beaten")).distinct()
        step = state.join(beaten, ["component", "h"], "left")
        keeping = materialize(step.withColumn("keeps", F.when(F.col("keeps").isNull() & F.col("beaten").isNull(), True).otherwise(F.col("keeps"))).drop("beaten"), "keeping")
        taken = open_edges.join(keeping.where("keeps").select("component", F.col("h").alias("b")), ["component", "b"], "left_semi")
        taken = taken.select("component", F.col("w").alias("h"), F.lit(True).alias("taken")).distinct()
        fresh = keeping.join(taken, ["component", "h"], "left")
        fresh = materialize(fresh.withColumn("keeps", F.when(F.col("taken"), False).otherwise(F.col("keeps"))).drop("taken"), "settled")
        left = fresh.where("keeps is null").select("component", "h")
        between = open_edges.join(left.withColumnRenamed("h", "b"), ["component", "b"], "left_semi").join(left.withColumnRenamed("h", "w"), ["component", "w"], "left_semi")
        done = left.isEmpty()
        if not done:
            between = materialize(between.select("component", "b", "w"), "between")
        for old in (state, keeping, open_edges):
            drop_table(old)
        state, open_edges = fresh, between
        if done:
            break
    keepers = state.where("keeps").select("component", F.col("h").alias("keeper_h"))
    reach = edges.select("component", F.col("better.h").alias("keeper_h"), F.col("better.rank").alias("rank"), F.col("worse.h").alias("h")).join(keepers, ["component", "keeper_h"], "left_semi")
    owner = reach.groupBy("component", "h").agg(F.max(F.struct("rank", "keeper_h")).alias("k")).join(state.where("not keeps").select("component", "h"), ["component", "h"], "left_semi")
    own = nodes.join(keepers.select("component", F.col("keeper_h").alias("h")), ["component", "h"], "left_semi")
    chosen = owner.select("component", "h", F.col("k.keeper_h").alias("keeper_h"), (-F.col("k.rank.minus")).alias("keeper")).unionByName(
        own.select("component", "h", F.col("h").alias("keeper_h"), (-F.col("rank.minus")).alias("keeper"))
    )
    rows = known.join(chosen, ["component", "h"]).select("component", "keeper", "id", similarity("h", "keeper_h").alias("similarity"))
    several = rows.groupBy("component", "keeper").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(several.select("component", "keeper"), ["component", "keeper"], "left_semi")


def group_members(groups: DataFrame, items: DataFrame, marks: DataFrame, limit: int) -> DataFrame:
    """``component, keeper, n, least, place, id, similarity, filename, mark`` of the ``limit`` largest groups, in order.

    ``items``: id, filename; ``marks``: image_id, mark (null where unmarked). Members come by similarity, then file name.
    """
    top = ranked_groups(groups, limit)
    named = groups.join(F.broadcast(top), ["component", "keeper"]).join(items.select("id", "filename"), "id")  # at most ``limit`` rows
    marked = named.join(marks.select(F.col("image_id").alias("id"), "mark"), "id", "left")
    place = F.row_number().over(Window.partitionBy("component", "keeper").orderBy(F.desc("similarity"), "filename", "id"))
    return marked.select("component", "keeper", "n", "least", place.alias("place"), "id", "similarity", "filename", "mark")


def ranked_groups(groups: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` largest groups, those of equal size by least similarity (high first), then keeper."""
    sized = groups.groupBy("component", "keeper").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    return sized.orderBy(F.desc("n"), F.desc("least"), "keeper").limit(limit)
