"""Timestamps against the datetime module, and zones that have to be estimated."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tarnwell.operators.moments import estimate_zones, normalise, taken_moments
from tarnwell.functions import timestamps

SCHEMA = "id long, text string, zone string, day_first boolean, source string, seen long"


def read(spark, rows):
    df = spark.createDataFrame([(i, t, z, d, "s", None) for i, (t, z, d) in enumerate(rows)], SCHEMA)
    return [r["us"] for r in normalise(df, "text", "zone", "day_first", "source", "seen", "us").orderBy("id").collect()]


def us(y, mo, d, h=0, mi=0, s=0, micro=0, zone="UTC", hours=None):
    tz = dt.timezone(dt.timedelta(hours=hours)) if hours is not None else ZoneInfo(zone)
    moment = dt.datetime(y, mo, d, h, mi, s, micro, tz)
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


B = "Europe/Berlin"
CASES = [
    ("2018:04:16 03:56:20", us(2018, 4, 16, 3, 56, 20, zone=B)),
    ("2018-04-16T03:56", us(2018, 4, 16, 3, 56, zone=B)),
    ("20180416", us(2018, 4, 16, zone=B)),
    ("20180416035620", us(2018, 4, 16, 3, 56, 20, zone=B)),
    ("20180416_035620", us(2018, 4, 16, 3, 56, 20, zone=B)),
    ("1719004509", 1719004509_000000),
    ("1338294472.46", 1338294472_460000),
    ("1454313449222", 1454313449222000),
    ("1711842152376063", 1711842152376063),
    ("2018-12-06T21:55:58.966543999Z", us(2018, 12, 6, 21, 55, 58, 966543)),
    ("2014-12-26 21:15:18,870", us(2014, 12, 26, 21, 15, 18, 870000, zone=B)),
    ("2012-01-20T20:20:20-0330", us(2012, 1, 20, 20, 20, 20, hours=-3.5)),
    ("2014-12-18T06:47:31−08:00", us(2014, 12, 18, 6, 47, 31, hours=-8)),
    ("2015-09-12 02:25:03 America/Phoenix", us(2015, 9, 12, 2, 25, 3, zone="America/Phoenix")),
    ("2023-12-13T07:28:41+13:00[Pacific/Auckland]", us(2023, 12, 13, 7, 28, 41, hours=13)),
    ("2017:08:09 07:02:01 (UTC+5:45)", us(2017, 8, 9, 7, 2, 1, hours=5.75)),
    ("2018:04:06 02:25:24 PST", us(2018, 4, 6, 2, 25, 24, hours=-8)),
    ("Wed, 04 Nov 2020 15:17:42 +1300", us(2020, 11, 4, 15, 17, 42, hours=13)),
    ("Mon Dec  7 10:59:12 2020", us(2020, 12, 7, 10, 59, 12, zone=B)),
    ("Jul 12, 2017, 12:18:46 AM", us(2017, 7, 12, 0, 18, 46, zone=B)),
    ("Jun 27, 2012, 12:37:41p.m.", us(2012, 6, 27, 12, 37, 41, zone=B)),
    ("21. März 2022, 19:24 Uhr", us(2022, 3, 21, 19, 24, zone=B)),
    ("1 fév" + "rier 2021 à 11:59:43", us(2021, 2, 1, 11, 59, 43, zone=B)),
    ("7/11/2022 13:36:41", us(2022, 11, 7, 13, 36, 41, zone=B)),
    ("05.03.2020", us(2020, 3, 5, zone=B)),
    (' "2023:04:22 12:19:23"\x00\x00 ', us(2023, 4, 22, 12, 19, 23, zone=B)),
    ("2021-10-31 02:30:00", us(2021, 10, 31, 0, 30)),  # twice: the first
    ("2021-03-28 02:30:00", us(2021, 3, 28, 1, 30)),  # skipped: the offset before
    ("2021-03-28T02:30:00 Europe/Berlin", us(2021, 3, 28, 1, 30)),
]
NONE = [None, "", "   ", "2018:00", "2022", "summer 2017", "2021-04-31", "0000:00:00 00:00:00", "2021-02-29", "2020-01-01 24:00:00", "2020-01-01 10:60",
        "2020-01-01 10:00:60", "13:00 PM 2020-01-01", "Jun 27, 2012, 0:37:41 PM", "12:00:00", "2020-01-01 10:00 No/Where", "2020-01-01 10:00 XYZ", "null", "x" * 100_000]


def test_notations(spark):
    got = read(spark, [(t, B, True) for t, _ in CASES])
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[1]) for c in CASES]
    assert read(spark, [(t, B, True) for t in NONE]) == [None] * len(NONE)


def test_order_of_slashes(spark):
    assert read(spark, [("7/11/2022", "UTC", False), ("16/3/2016", "UTC", False), ("3/16/2016", "UTC", None)]) == [us(2022, 7, 11), None, us(2016, 3, 16)]


ZONES = ["Europe/Paris", "America/Phoenix", "America/Los_Angeles", "America/Denver", "Asia/Kathmandu", "Asia/Tokyo", "Asia/Kolkata", "Pacific/Auckland",
         "America/St_Johns", "Europe/London", "Australia/Brisbane", "Australia/Sydney", "Australia/Lord_Howe", "Europe/Athens", "America/New_York"]


def planted(seed: int, sources: list[tuple[str, int]], known: int, outliers: float = 0.03):
    """Rows whose moments and clocks are known: texts without zone on each source's clock, ingested 10 minutes to 5 hours later."""
    rng, rows, truth = random.Random(seed), [], {}
    for number, (zone, n) in enumerate(sources):
        for i in range(n + known):
            moment = dt.datetime(2015, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=rng.randrange(6 * 365 * 86400))
            seen = int(moment.timestamp()) + rng.randrange(600, 18_000) + (rng.randrange(-(10**8), 10**8) if rng.random() < outliers else 0)
            local = moment.astimezone(ZoneInfo(zone))
            if i < n and local.replace(fold=0).timestamp() != local.timestamp():
                continue  # the second of two equal clock times can't be told from the first
            text = local.strftime("%Y:%m:%d %H:%M:%S") if i < n else str(int(moment.timestamp()))
            truth[len(rows)] = int(moment.timestamp()) * 1_000_000
            rows.append((len(rows), text, None, True, f"source {number}", seen * 1_000_000))
    return rows, truth


def test_hidden_zones_are_estimated_from_ingestion(spark):
    sources = [(z, 300) for z in ZONES[1:]] + [(ZONES[0], 3_000)]  # one source has a third of all rows
    rows, truth = planted(7, sources, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["us"] for r in normalise(df, "text", "zone", "day_first", "source", "seen", "us", [*ZONES, "Europe/Moscow", "Asia/Shanghai"]).collect()}
    right = sum(got[i] == t for i, t in truth.items())
    assert right >= 0.99 * len(truth)


def test_hidden_zones_without_known_delays(spark):
    rows, truth = planted(8, [(z, 400) for z in ("Asia/Tokyo", "America/New_York", "Europe/London", "Asia/Kolkata")], 0)
    df = spark.createDataFrame(rows, SCHEMA)
    candidates = ["Asia/Tokyo", "America/New_York", "Europe/London", "Asia/Kolkata", "Pacific/Auckland", "America/Los_Angeles"]
    got = {r["id"]: r["us"] for r in normalise(df, "text", "zone", "day_first", "source", "seen", "us", candidates).collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.9 * len(truth)


def test_declared_zone_is_the_prior(spark):
    tokyo = [(f"2020-01-0{i} 09:00:00", us(2020, 1, i, 9, zone="Asia/Tokyo") + 60_000_000) for i in range(1, 8)]
    rows = [(i, t, None, True, "far", seen) for i, (t, seen) in enumerate(tokyo)] + [(100, "2020-01-01 09:00:00", "Asia/Tokyo", True, "known", None)]
    rows += [(150, "2020-01-01 09:00:00", "America/New_York", True, "odd", us(2020, 1, 1, 9, zone="Asia/Tokyo"))]
    rows += [(200, "2020-01-01 09:00:00", None, True, "silent", None), (201, "2020-01-01 09:00:00", None, True, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["us"] for r in normalise(df, "text", "zone", "day_first", "source", "seen", "us", ["UTC", "America/New_York"]).collect()}
    assert got[0] == us(2020, 1, 1, 9, zone="Asia/Tokyo") == got[100] and got[200] == us(2020, 1, 1, 9) == got[201]
    assert got[150] == us(2020, 1, 1, 9, zone="America/New_York")  # whatever the evidence says
    fields = df.withColumn("f", timestamps.fields(timestamps.parse_parts(timestamps.bare_text(F.col("text")), F.col("day_first"))))
    declared = df.select("source", "zone").where("zone is not null").distinct()
    best = {r["source"]: (r["zone"], r["n"], r["violations"], r["estimate"]) for r in estimate_zones(fields, "source", "f", "seen", ["UTC", "America/New_York", "Asia/Tokyo"], declared).collect()}
    assert best == {"far": ("Asia/Tokyo", 7, 0, "Asia/Tokyo"), "odd": ("America/New_York", 1, 1, "Asia/Tokyo"), "known": ("Asia/Tokyo", 0, None, None)}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert normalise(empty, "text", "zone", "day_first", "source", "seen", "us").count() == 0
    clash = spark.createDataFrame([(1, "20200101", "UTC", True, "s", 5, 7)], SCHEMA + ", US long")
    out = normalise(clash, "text", "zone", "day_first", "source", "seen", "us")
    assert out.columns.count("us") == 1 and "US" not in out.columns and out.head()["us"] == us(2020, 1, 1)


def test_current_rows_only(spark):
    images = spark.createDataFrame(
        [(1, "2020-01-01", "r", 1.0, 1.0), (1, "2021-01-01", "r", 1.0, 2.0), (1, "2021-01-01", "r", 1.0, 2.0), (2, "20200101", "other", None, None), (None, "20200101", "r", 1.0, 1.0)],
        "id long, taken_at string, root string, mtime double, updated_at double",
    )
    roots = spark.createDataFrame([("r", "Asia/Tokyo", True)], "root string, tz_name string, day_first boolean")
    got = sorted(tuple(r) for r in taken_moments(images, roots).collect())
    assert got == [(1, us(2021, 1, 1, zone="Asia/Tokyo")), (2, us(2020, 1, 1))]


@pytest.mark.parametrize("zone", ["Australia/Lord_Howe", "America/St_Johns", "Asia/Kathmandu", "Pacific/Auckland"])
def test_all_hours_of_changes(spark, zone):
    times = [dt.datetime(2021, m, d, h, 30) for m, days in ((3, (13, 14, 15)), (4, (3, 4, 5)), (9, (25, 26, 27)), (10, (2, 3, 4))) for d in days for h in range(0, 5)]
    got = read(spark, [(t.isoformat(), zone, True) for t in times])
    for t, g in zip(times, got):
        first = t.replace(tzinfo=ZoneInfo(zone), fold=0)  # fold 0: the first of two, the offset before a gap
        assert g == (first - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
