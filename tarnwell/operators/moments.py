"""Mixed timestamp formats and time zones brought to one moment in UTC.

Texts are parsed in the JVM (``functions.timestamps``). A zone in the text holds; else the clock of the row's source
counts, which ``estimate_zones`` chooses: local times are aligned with the moments their rows were ingested, and of the
candidate offset histories the one with the fewest violations wins. A declared zone is the estimator's prior: it comes
before all evidence, and the evidence still tells whether it fits.

What a violation is, is learned, not set: rows whose moment is known without any clock (counts of time, written zones)
show how long ingestion usually takes. A time is violated where its delay lies outside the span of delays that are
common among those; times after ingestion are the simplest case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import timestamps
from tarnwell.session import materialize
from tarnwell.tables import current_rows, read_table

#: Offset histories tried besides those that sources declare.
CANDIDATE_ZONES = ("UTC",)
#: Delays are counted in bins of so many microseconds; every offset in use is a multiple of it.
BIN_US = 300_000_000
#: A delay is common where its density is at least this share of the greatest; densities are taken over 15 minutes.
COMMON_SHARE, DENSITY_BINS = 0.1, 3
#: With fewer known delays than this, a violation is only what lies after its ingestion.
LEAST_KNOWN = 100
#: Share of a source's times that may be violated by chance when only the one side of the span is known.
TOLERATED = 0.01


@dataclass(frozen=True)
class DelaySpan:
    """The common delays between a moment and its ingestion, in bins: first, last and mean; no last where none is known."""

    first: int = 0
    last: int | None = None
    mean: float | None = None


def delay_span(known: DataFrame, moment_us: str, ingested_us: str) -> DelaySpan:
    """The span of common delays of rows whose moment is known; rows without one of the two are left out."""
    bins = F.floor((F.col(ingested_us) - F.col(moment_us)) / F.lit(BIN_US))
    counted = known.where(F.col(ingested_us).isNotNull() & F.col(moment_us).isNotNull()).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "delays")
    dense = counted.groupBy(F.floor(F.col("bin") / DENSITY_BINS).alias("slot")).agg(F.sum("n").alias("n"))
    all_of, peak = dense.agg(F.sum("n"), F.max("n")).head()
    if (all_of or 0) < LEAST_KNOWN:
        return DelaySpan()
    low, high = dense.where(F.col("n") >= COMMON_SHARE * peak).agg(F.min("slot"), F.max("slot")).head()
    first, last = low * DENSITY_BINS, high * DENSITY_BINS + DENSITY_BINS - 1
    mean = counted.where(F.col("bin").between(first, last)).agg(F.try_divide(F.sum(F.col("bin") * F.col("n")), F.sum("n"))).head()[0]
    return DelaySpan(first, last, float(mean))


def estimate_zones(
    local: DataFrame,
    source: str,
    fields: str,
    ingested_us: str,
    candidates: list[str],
    declared: DataFrame | None = None,
    span: DelaySpan = DelaySpan(),
    least: int = 1,
) -> DataFrame:
    """``(source, zone, n, violations, estimate)``: the offset history of each source's clock.

    ``local`` holds zone-less times (``fields`` of ``timestamps.fields``) and the moment each row was ingested (null: no
    evidence). Each candidate is scored by how many delays it puts outside ``span``, ties by how far the delays within
    lie from the usual mean, then by name; ``estimate`` is the best by evidence, null with fewer than ``least`` times.
    Where the span has no upper end, the histories that hardly violate more than the best compete by their least delay.
    ``declared`` (source, zone) is the prior: a declared zone is ``zone`` whatever the evidence says, ``violations`` are
    its own; sources that are only declared have no times and still a row.

    Times are first counted by source, day and delay, map-side, so the work on candidates doesn't grow with the rows and
    a source with a third of all rows is no heavier than others. An empty table gives the declared sources only.
    """
    day = F.struct(*[F.col(fields)[k].alias(k) for k in ("year", "month", "day")])
    apart = F.floor((F.col(ingested_us) - timestamps.to_micros(F.col(fields), F.lit("UTC"))) / F.lit(BIN_US))
    seen = local.where(F.col(fields).isNotNull() & F.col(ingested_us).isNotNull() & F.col(source).isNotNull())
    cells = seen.groupBy(F.col(source).alias("__source"), day.alias("__day"), apart.alias("__apart")).agg(F.count(F.lit(1)).alias("__n"))
    zones = F.explode(F.array(*[F.lit(z) for z in sorted(set(candidates))]))
    tried = cells.select("*", zones.alias("__zone"))
    noon = lambda z: F.unix_micros(F.try_make_timestamp(F.col("__day.year"), F.col("__day.month"), F.col("__day.day"), F.lit(12), F.lit(0), F.lit(0), z))
    offset = F.floor((noon(F.lit("UTC")) - noon(F.col("__zone"))) / F.lit(BIN_US))
    delay = F.col("__apart") + offset
    outside = (delay < span.first) | (F.lit(False) if span.last is None else delay > span.last)
    inside = F.when(~outside, F.col("__n")).otherwise(0)
    scored = tried.select("__source", "__zone", "__n", delay.alias("__delay"), outside.alias("__out"), inside.alias("__in"))
    scored = scored.groupBy("__source", "__zone").agg(
        F.sum("__n").alias("n"),
        F.sum(F.when(F.col("__out"), F.col("__n")).otherwise(0)).alias("violations"),
        F.min(F.when(~F.col("__out"), F.col("__delay"))).cast("double").alias("floor"),
        F.try_divide(F.sum(F.col("__delay") * F.col("__in")), F.sum("__in")).alias("mean"),
    )
    gap = F.col("floor") if span.mean is None else F.abs(F.col("mean") - F.lit(span.mean))
    entry = F.struct("violations", F.coalesce(gap, F.lit(float("inf"))).alias("gap"), F.col("__zone").alias("zone"), "n")
    listed = scored.groupBy("__source").agg(F.sort_array(F.collect_list(entry)).alias("__all"))  # as many as candidates
    best = F.col("__all")[0]
    if span.last is None:
        allowed = best["violations"] + F.floor(best["n"] * F.lit(TOLERATED))
        close = F.filter("__all", lambda x: x["violations"] <= allowed)
        best = F.sort_array(F.transform(close, lambda x: F.struct(x["gap"].alias("gap"), x["zone"].alias("zone"))))[0]
    estimate = F.when(F.col("__all")[0]["n"] >= least, best["zone"])
    guessed = listed.select("__source", "__all", estimate.alias("estimate"))
    if declared is None:
        guessed = guessed.withColumn("__said", F.lit(None).cast("string"))
    else:
        said = declared.where(F.col(source).isNotNull() & F.col("zone").isNotNull()).groupBy(F.col(source).alias("__source")).agg(F.min("zone").alias("__said"))
        guessed = guessed.join(said, "__source", "full_outer")
    chosen = F.coalesce("__said", "estimate")
    own = F.filter("__all", lambda x: x["zone"] == chosen)
    return guessed.select(
        F.col("__source").alias(source), chosen.alias("zone"), F.coalesce(F.col("__all")[0]["n"], F.lit(0)).alias("n"), F.get(own, F.lit(0))["violations"].alias("violations"), "estimate"
    )


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: the generator keeps the optimizer from inlining it where it's used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parsed_times(df: DataFrame, text: str, day_first: str, ingested_us: str) -> DataFrame:
    """``df`` with ``__epoch`` (microseconds of a count), ``__fields`` (date, time and written zone) and ``__known``.

    ``__known`` is the moment where no clock is needed to tell it. The result is a table of its own, for estimation and
    conversion both read it.
    """
    parsed = _let(df, "__bare", timestamps.bare_text(F.col(text)))
    parsed = _let(parsed, "__parsed", timestamps.parse_parts(F.col("__bare"), F.col(day_first)))
    parsed = _let(parsed, "__fields", timestamps.fields(F.col("__parsed")))
    known = F.coalesce(F.col("__parsed.epoch_us"), timestamps.to_micros(F.col("__fields"), F.col("__fields.zone")))
    return materialize(parsed.withColumn("__epoch", F.col("__parsed.epoch_us")).withColumn("__known", known).drop("__bare", "__parsed"), "parsed")


def clocks_of(parsed: DataFrame, source: str, declared: DataFrame | None, ingested_us: str, candidates: list[str], least: int = 1) -> DataFrame:
    """``estimate_zones`` of every source in a table of ``parsed_times``; ``declared`` (source, zone) is the prior."""
    span = delay_span(parsed.where("__known is not null"), "__known", ingested_us)
    zoneless = parsed.where("__fields is not null and __fields.zone is null")
    return estimate_zones(zoneless, source, "__fields", ingested_us, candidates, declared, span, least)


def known_zones(declared: DataFrame, zone: str, candidates: list[str] | None = None) -> list[str]:
    """The candidates: those given and every zone declared; there are no more than the time-zone database has."""
    return sorted({*(candidates or CANDIDATE_ZONES), *(r[0] for r in declared.select(zone).where(F.col(zone).isNotNull()).distinct().collect())})


def normalise(
    df: DataFrame,
    text: str,
    zone: str,
    day_first: str,
    source: str,
    ingested_us: str,
    out: str = "moment_us",
    candidates: list[str] | None = None,
    declared: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the column ``out``: the moment its ``text`` names, in microseconds of UTC, or null if it names none.

    Null, blank, very long and unreadable texts, impossible dates and times give null; so does a written zone that
    doesn't exist. ``zone`` is the declared zone of the row's source, null where it declares none: there
    ``estimate_zones`` finds it among ``candidates`` and all declared zones (those of ``declared``, a table of source and
    zone, or of ``df``), and where it has no evidence either, UTC holds. A source that is null has no clock of its own
    but the declared one. Other columns pass unchanged but for one named like ``out``,
    which gives way; repeated rows stay repeated.
    """
    parsed = parsed_times(df, text, day_first, ingested_us)
    if declared is None:
        declared = parsed.select(source, F.col(zone).alias("zone")).distinct()
    tried = known_zones(declared, "zone", candidates)
    clocks = clocks_of(parsed, source, declared, ingested_us, tried).select(F.col(source).alias("__source"), F.col("zone").alias("__clock"))
    joined = parsed.join(clocks, F.col(source) == F.col("__source"), "left")
    clock = F.coalesce("__fields.zone", F.col(zone), "__clock", F.lit("UTC"))
    moment = F.coalesce("__epoch", timestamps.to_micros(F.col("__fields"), clock))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()], moment.alias(out))


def taken_rows(images: DataFrame, roots: DataFrame) -> DataFrame:
    """The current image rows that have a ``taken_at``, with their root's clock and the moment of the file in microseconds.

    A file is written when it is taken in from a camera, so ``mtime`` is the ingestion; one that is null or not positive
    is no evidence.
    """
    current = current_rows(images, "id", "updated_at", ["taken_at", "root", "mtime"])
    clocks = roots.groupBy("root").agg(F.first("tz_name").alias("tz_name"), F.first("day_first").alias("day_first"))
    ingested = F.when(F.col("mtime") > 0, (F.col("mtime") * 1_000_000).try_cast("bigint"))
    return current.where(F.col("taken_at").isNotNull()).join(clocks, "root", "left").withColumn("__ingested", ingested)


def taken_moments(images: DataFrame, roots: DataFrame) -> DataFrame:
    """``(image_id, taken_us)`` of each current image row, live or not, whose ``taken_at`` names a moment."""
    declared = roots.select("root", F.col("tz_name").alias("zone"))
    moments = normalise(taken_rows(images, roots), "taken_at", "tz_name", "day_first", "root", "__ingested", "taken_us", declared=declared)
    return moments.where(F.col("taken_us").isNotNull()).select(F.col("id").alias("image_id"), "taken_us")


def clocks(images: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, zone, n, violations, estimate`` of every root that is declared or has times without zone."""
    rows = taken_rows(images, roots)
    parsed = parsed_times(rows, "taken_at", "day_first", "__ingested")
    declared = roots.select("root", F.col("tz_name").alias("zone"))
    return clocks_of(parsed, "root", declared, "__ingested", known_zones(declared, "zone"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p2_found."""
    return taken_moments(read_table(spark, folder, "images"), read_table(spark, folder, "library_roots"))


def p2_clocks(spark: SparkSession, folder: str) -> DataFrame:
    """Query p2_clocks: the clock of each root, and how many of its times have no zone and an ingestion to compare with."""
    return clocks(read_table(spark, folder, "images"), read_table(spark, folder, "library_roots")).select("root", "zone", "n")
