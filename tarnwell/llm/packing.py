"""Filling containers of fixed capacity with items of varying length, by harmonic packing.

Lengths fall in reciprocal-capacity classes: class j holds lengths in (C/(j+1), C/j], and a container opened for class
j takes exactly j items of it. What such a container leaves open is topped up from smaller classes, largest fitting
length first. Lengths are whole numbers up to C, so the containers can be planned on the histogram of lengths, which
has at most C rows whatever the number of items; the plan names runs of equal containers. Items then find their place
by their rank among the items of their length, taken in salted groups of bounded size, independently across workers.

An item longer than C is cut into full containers and a rest, which is packed like any item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.llm.tokenize import TOKENIZERS, token_count
from tarnwell.session import materialize
from tarnwell.tables import own_name, read_table

CAPACITY = 2048
#: Ranks within one length are taken in groups of about so many items.
GROUP = 50_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of equal containers as ``(length, first_rank, first_container, containers, per_container, slot)``.

    The items of ``length`` with ranks from ``first_rank`` on go, ``per_container`` to each, into ``containers``
    containers from ``first_container`` on, after ``slot`` tokens. Every item of the histogram has one place.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    out: list[tuple[int, int, int, int, int, int]] = []
    container = 0
    for i, opener in enumerate(lengths):
        while left[opener]:
            share = min(capacity // opener, left[opener])  # its class; at the end of its length, what is left of it
            pattern, room = [(opener, share)], capacity - opener * share
            for n in lengths[i + 1 :]:
                if n <= room and left[n]:
                    take = min(room // n, left[n])
                    pattern.append((n, take))
                    room -= n * take
            runs, slot = min(left[n] // take for n, take in pattern), 0
            for n, take in pattern:
                out.append((n, rank[n], container, runs, take, slot))
                rank[n] += runs * take
                left[n] -= runs * take
                slot += n * take
            container += runs
    return out


def containers(items: DataFrame, key: str, length: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``container_id, slot, key, part_no, first, length``: the place of every item or part of one.

    ``slot`` is the part's offset in its container, ``first`` its offset in the item. Items of null, zero or negative
    length need no place. Items of equal length are ranked by a hash and their key. Repeated
    rows are items of their own, a null key is a key, and a key named like a column of the result gets an underscore.
    """
    spark = items.sparkSession
    # No filter on the length: pushed below its projection, it would compute the length twice. Null explodes to no row.
    sized = items.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("n"))
    last = F.expr(f"(n - 1) div {capacity}")
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), last))
    parts = sized.select("key", "n", F.explode(numbers).alias("part_no"))
    parts = parts.select("key", "part_no", F.least(F.lit(capacity), F.col("n") - F.col("part_no") * capacity).alias("part"))
    parts = materialize(parts, "parts")
    histogram = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}  # at most ``capacity`` rows
    schema = "part bigint, from_rank bigint, first_container bigint, runs bigint, per bigint, slot bigint"
    planned = spark.createDataFrame(plan(histogram, capacity), schema)
    step = F.struct("from_rank", "first_container", "per", "slot")
    planned = planned.groupBy("part").agg(F.sort_array(F.collect_list(step)).alias("plan"))
    salts = spark.createDataFrame([(n, 1 + c // group) for n, c in histogram.items()], "part bigint, salts bigint")
    salted = parts.join(F.broadcast(salts), "part").withColumn("salt", F.pmod(F.xxhash64("key", "part_no"), F.col("salts")))
    before = W.partitionBy("part").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("part", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("part", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("part", "salt").orderBy("key", "part_no")
    ranked = salted.withColumn("in_salt", F.row_number().over(within) - 1).join(offsets, ["part", "salt"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("in_salt")).join(F.broadcast(planned), "part")
    placed = ranked.withColumn("at", F.element_at(F.filter("plan", lambda r: r["from_rank"] <= F.col("rank")), -1))
    nth = F.col("rank") - F.col("at.from_rank")
    return placed.select(
        (F.col("at.first_container") + F.expr("(rank - at.from_rank) div at.per")).alias("container_id"),
        (F.col("at.slot") + F.pmod(nth, F.col("at.per")) * F.col("part")).alias("slot"),
        F.col("key").alias(own_name(key, ("container_id", "slot", "part_no", "first", "length"))),
        "part_no",
        (F.col("part_no") * capacity).alias("first"),
        F.col("part").alias("length"),
    )


def p8_containers(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Query p8_containers: container, slot, document, part, first token and number of tokens of each part."""
    documents = read_table(spark, folder, "documents")
    sized = documents.select("doc_id", token_count(spark, F.col("text"), tokenizers).alias("n_tokens"))
    return containers(sized, "doc_id", "n_tokens").withColumnsRenamed({"first": "first_token", "length": "n_tokens"})


def violations(placed: DataFrame, sized: DataFrame, key: str, length: str, capacity: int = CAPACITY) -> DataFrame:
    """One row on ``placed`` (container_id, slot, key, part_no, first, length) of the items in ``sized`` (unique key, length).

    ``items`` and ``parts`` are how many have a place; what must be 0 are ``lost`` (items of which not every token has
    exactly one place), ``divided`` (items cut though they fit, or not into full containers and a rest), ``overfull``
    containers and ``overlapping`` parts (which don't begin where the one before them in their container ends).
    """
    own = placed.groupBy(key).agg(
        F.sum("length").alias("held"), F.count(F.lit(1)).alias("parts"), F.countDistinct("part_no").alias("numbers"), F.max("part_no").alias("last"), F.count_if(F.col("first") != F.col("part_no") * capacity).alias("shifted")
    )
    both = sized.select(key, F.coalesce(F.col(length), F.lit(0)).alias("size")).join(own, key, "full_outer")
    needed = F.ceil(F.col("size") / capacity)
    right = (F.col("held") == F.col("size")) & (F.col("numbers") == F.col("parts")) & (F.col("shifted") == 0)
    per_item = both.agg(
        F.count("held").alias("items"),
        F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"),
        F.count_if((F.coalesce("size", F.lit(0)) > 0) & ~F.coalesce(right, F.lit(False)) | F.col("held").isNotNull() & (F.coalesce("size", F.lit(0)) <= 0)).alias("lost"),
        F.count_if((F.col("parts") != needed) | (F.col("last") != needed - 1)).alias("divided"),
    )
    before = W.partitionBy("container_id").orderBy("slot")
    chained = placed.withColumn("end", F.coalesce(F.lag(F.col("slot") + F.col("length")).over(before), F.lit(0)))
    per_container = chained.groupBy("container_id").agg(F.sum("length").alias("full"), F.count_if(F.col("slot") != F.col("end")).alias("apart"))
    room = per_container.agg(F.count_if(F.col("full") > capacity).alias("overfull"), F.coalesce(F.sum("apart"), F.lit(0)).alias("overlapping"))
    return per_item.withColumn("one", F.lit(1)).join(room.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def p8_violations(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Query p8_violations: that every token of every document has one place in a container that holds it."""
    documents = read_table(spark, folder, "documents")
    sized = materialize(documents.select("doc_id", token_count(spark, F.col("text"), tokenizers).alias("n_tokens")), "sizes")
    placed = materialize(containers(sized, "doc_id", "n_tokens"), "places")
    return violations(placed, sized, "doc_id", "n_tokens").drop("parts")
