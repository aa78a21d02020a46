"""Items that appear together: pairs per basket, with lift and pointwise mutual information.

Items are deduplicated per basket, marginals counted, and items too rare to reach the least support dropped before any
pair exists: a pair can't be in more baskets than either item. With a least support of N/1000 baskets the items left are
at most 1000 times the mean number of items in a basket, whatever the size of the input, and so are those of the largest
basket. Pairs come from one equi-join on the basket and are counted map-side before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.terms import term
from tarnwell.session import materialize
from tarnwell.tables import read_table


def cooccurrence(
    df: DataFrame,
    basket: str,
    item: str,
    least_count: int = 1,
    least_per_mille: int = 0,
    least_lift: int = 0,
) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n_ab, baskets, lift, pmi`` of each pair of different items in one basket, a < b.

    Kept are pairs with n_ab >= ``least_count``, 1000 n_ab >= ``least_per_mille`` N and n_ab N >= ``least_lift`` n_a n_b,
    where N is the number of baskets with any item. Rows without basket or item don't count; repeated items count once a
    basket. Items are ordered by code points. An empty table gives no pairs.
    """
    once = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    once = materialize(once, "baskets")
    total = once.agg(F.countDistinct("basket")).head()[0]
    marginals = once.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("n") * 1000 >= F.lit(least_per_mille * total)
    frequent = marginals.where((F.col("n") >= least_count) & enough)
    rows = once.join(frequent.select("item"), "item", "left_semi")
    a, b = rows.select("basket", F.col("item").alias("item_a")), rows.select("basket", F.col("item").alias("item_b"))
    together = a.join(b, "basket").where("item_a < item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))
    together = together.where((F.col("n_ab") >= least_count) & (F.col("n_ab") * 1000 >= F.lit(least_per_mille * total)))
    known = (
        together.join(frequent.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(frequent.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("baskets", F.lit(total).cast("bigint"))
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = known.where(wide("n_ab") * wide("baskets") >= F.lit(least_lift) * wide("n_a") * wide("n_b"))
    lift = F.col("n_ab").cast("double") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return kept.select("item_a", "item_b", "n_a", "n_b", "n_ab", "baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p3_found."""
    seen = read_table(spark, folder, "detections").select("image_id", term("class").alias("term"))
    pairs = cooccurrence(seen, "image_id", "term", least_count=5, least_per_mille=1, least_lift=3)
    return pairs.select(F.col("item_a").alias("class_a"), F.col("item_b").alias("class_b"))
