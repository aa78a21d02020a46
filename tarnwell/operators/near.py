"""All pairs of 64-bit hashes that differ in few bits, exactly and without comparing all with all.

The bits are cut in blocks; two hashes that differ in at most d bits agree in all but d blocks at least, so they meet under
the key of some choice of blocks. A key that too many hashes share is refined by a choice among the bits it leaves open,
again and again until it is small or hardly any bit is left: hashes are distinct, so r open bits leave at most 2^r of
them. However alike the hashes are, no group of more than ``CROWDED`` is ever paired out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.session import materialize

#: A key shared by more hashes than this is refined.
CROWDED = 400


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    """``bits`` cut into ``count`` runs of nearly equal length."""
    ends = [round(len(bits) * i / count) for i in range(count + 1)]
    return [bits[x:y] for x, y in zip(ends, ends[1:])]


def signed(x: int) -> int:
    """64 bits as the signed integer with these bits."""
    return x - (1 << 64) if x >> 63 else x


def _choices(bits: list[int], count: int, distance: int) -> list[tuple[int, list[int]]]:
    """Masks of every choice of blocks that ``distance`` differing bits leave equal, each with the bits left open."""
    blocks = _blocks(bits, count)
    kept = [[b for block in choice for b in block] for choice in combinations(blocks, count - distance)]
    return [(sum(1 << b for b in fixed), sorted(set(bits) - set(fixed))) for fixed in kept]


def _first_equal(x: Column, masks: list[int]) -> Column:
    """The number of the first mask under which ``x`` is zero: two hashes are compared only under that key."""
    return F.coalesce(*[F.when(x.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])


def _meet(keyed: DataFrame, keys: list[str]) -> DataFrame:
    a, b = keyed.withColumnRenamed("h", "hash_a"), keyed.withColumnRenamed("h", "hash_b")
    return a.join(b, keys).where("hash_a < hash_b").withColumn("x", F.col("hash_a").bitwiseXOR(F.col("hash_b")))


def near_bits(hashes: DataFrame, column: str, distance: int = 3, blocks: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """``(hash_a, hash_b)``, a < b: all pairs of distinct values of ``column`` that differ in 1 to ``distance`` bits.

    ``blocks`` must exceed ``distance`` (two more if not given); more blocks mean longer keys and more of them. Nulls match
    nothing, an empty table gives no pairs.
    """
    outer = _choices(list(range(64)), blocks or distance + 2, distance)
    masks = [m for m, _ in outer]
    values = hashes.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("h")).distinct()
    keys = F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("choice", "key")
    keyed = materialize(values.select("h", keys).withColumn("outer", F.col("choice")), "keys")
    crowds = _crowds(keyed, dict(enumerate(outer)), distance, crowded)
    hot = not crowds.isEmpty()
    usual = keyed.join(crowds, ["choice", "key"], "left_anti") if hot else keyed
    met = _meet(usual.drop("outer"), ["choice", "key"]).where(_first_equal(F.col("x"), masks) == F.col("choice"))
    pairs = met.where(F.bit_count("x") <= distance).select("hash_a", "hash_b")
    nodes, deeper = dict(enumerate(outer)), None
    while hot:
        present = [r[0] for r in crowds.select("choice").distinct().collect()]  # no more than there are choices
        finer: dict[int, tuple[int, list[int]]] = {}
        links = []
        for n in present:
            for mask, rest in _choices(nodes[n][1], distance + 3, distance):
                links.append((n, len(finer), signed(nodes[n][0] | mask)))
                finer[len(finer)] = (nodes[n][0] | mask, rest)
        table = keyed.sparkSession.createDataFrame(links, "choice int, finer int, mask bigint")
        crowd = keyed.join(crowds, ["choice", "key"], "left_semi").join(F.broadcast(table), "choice")  # as many rows as choices
        keyed = materialize(crowd.select("h", F.col("finer").alias("choice"), F.col("h").bitwiseAND(F.col("mask")).alias("key"), "outer"), "keys")
        nodes = finer
        crowds = _crowds(keyed, nodes, distance, crowded)
        hot = not crowds.isEmpty()
        usual = keyed.join(crowds, ["choice", "key"], "left_anti") if hot else keyed
        met = _meet(usual, ["outer", "choice", "key"]).where(_first_equal(F.col("x"), masks) == F.col("outer"))
        found = met.where(F.bit_count("x") <= distance).select("hash_a", "hash_b")
        deeper = found if deeper is None else deeper.unionByName(found)
    return pairs if deeper is None else pairs.unionByName(deeper.distinct())


def _crowds(keyed: DataFrame, nodes: dict[int, tuple[int, list[int]]], distance: int, crowded: int) -> DataFrame:
    """``choice, key`` of the keys that too many hashes share, where bits are left to refine them by."""
    refinable = [n for n, (_, rest) in nodes.items() if len(rest) >= distance + 3]
    rows = keyed if len(refinable) == len(nodes) else keyed.where(F.col("choice").isin(refinable))
    counted = rows.groupBy("outer", "choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded)
    return materialize(counted.select("choice", "key").distinct(), "crowds")
