"""Timestamps of any notation, precision and zone as microseconds since 1970 in UTC, all in JVM expressions.

Each notation is one regular expression that rewrites a text to ten parts parted by ``|``: year, month (number or
name), day, hour, minute, second, fraction, am/pm, zone, and ``s`` where day and month may have to be swapped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their usual short forms, without accents.
MONTHS = {
    1: "january jan januar jaenner janner janvier janv enero ene",
    2: "february feb februar fevrier fevr febrero",
    3: "march mar marz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez decembre diciembre dic",
}
# Zone abbreviations and their offsets.
ABBREVIATIONS = {
    "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "BST": "+01:00", "WEST": "+01:00",
    "CET": "+01:00", "MEZ": "+01:00", "CEST": "+02:00", "MESZ": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "MSK": "+03:00", "IST": "+05:30", "NPT": "+05:45", "HKT": "+08:00", "SGT": "+08:00", "AWST": "+08:00",
    "JST": "+09:00", "KST": "+09:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00",
    "LHST": "+10:30", "LHDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00", "NST": "-03:30", "NDT": "-02:30",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00",
    "HST": "-10:00",
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?![a-z]))?(?: ?uhr)?"
_ZONE = r"(?: ?\(?(z|[a-z]{2,5}(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+-]+)+)\)?(?: ?\[[^\]]*\])?)?"
_WEEKDAY = r"(?:[a-z]{2,10}\.?,? )?"
_NAME = r"([a-z]{3,10})\.?"
_AT = r"(?:,|t| |, | at | um | a | a las )"

#: Notation -> (pattern, the ten parts).
NOTATIONS = {
    "year first": (rf"(?i)^(\d{{4}})([-:/.])(\d{{1,2}})\2(\d{{1,2}})(?:[t ]{_TIME}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|"),
    "digits only": (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t_ -]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    "slashes": (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|s"),
    "day first": (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    "day and name": (rf"(?i)^{_WEEKDAY}(\d{{1,2}})\.?[ -](?:de )?{_NAME}[ -](?:de )?(\d{{4}})(?:{_AT}{_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    "name and day": (rf"(?i)^{_WEEKDAY}{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:{_AT}{_TIME}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    "year last": (rf"(?i)^{_WEEKDAY}{_NAME} (\d{{1,2}}) {_TIME}(?: ([a-z]{{3,5}}|[+-]\d{{2}}:?\d{{2}}))? (\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8|"),
}


def bare_text(text: Column) -> Column:
    """The text without surrounding white space, quotes and NULs, its inner spaces single, its accents gone."""
    edge = r"[\s\p{Z}\p{Cc}\p{Cf}\"'`\u201c\u201d\u201e\u2018\u2019\u00ab\u00bb]+"
    c = F.regexp_replace(text, rf"^{edge}|{edge}$", "")
    c = F.translate(
        c,
        "\u2212\u2010\u2011éÉûÛäÄàÀ\uff0b\uff0d\uff1a\uff0f",
        "---eEuUaAaA+-:/",
    )
    c = F.regexp_replace(c, r"[\u0300-\u036f\u200b-\u200f\ufeff]", "")
    return F.regexp_replace(c, r"[\s\p{Z}]+", " ")


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.cast("int"))


def _month(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])
    return F.coalesce(_number(c), F.try_element_at(names, F.lower(c)))


def _zone(c: Column) -> Column:
    """The zone as written, as an offset or region; null where none is written, ``?`` where it names none."""
    low = F.lower(c)
    offset = r"(?i)^(?:utc|gmt|ut|z)?([+-])(\d{1,2}?):?(\d{2})?$"
    hours = F.lpad(F.regexp_extract(c, offset, 2), 2, "0")
    minutes = F.rpad(F.regexp_extract(c, offset, 3), 2, "0")
    numeric = F.concat(F.regexp_extract(c, offset, 1), hours, F.lit(":"), minutes)
    known = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k.lower(), v)])
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(low == "z", F.lit("+00:00"))
        .when(c.rlike(offset), F.when((hours.cast("int") <= 18) & (minutes.cast("int") <= 59), numeric).otherwise("?"))
        .when(c.contains("/"), c)
        .otherwise(F.coalesce(F.try_element_at(known, low), F.lit("?")))
    )


def parse_parts(bare: Column, day_first: Column) -> Column:
    """A struct of what a text, already made bare, says: ``epoch_us`` of a count, or the date's and time's fields and the written zone.

    Both are null where the text is neither. Parts of the time that are missing are zero; digits beyond microseconds
    are cut. ``day_first`` orders dates with slashes (null: month first).
    """
    c = bare
    parts = reduce(
        lambda rest, x: F.when(c.rlike(x[0]), F.regexp_replace(c, x[0], x[1])).otherwise(rest),
        reversed(list(NOTATIONS.values())),
        F.lit(None).cast("string"),
    )
    count = (
        F.when(c.rlike(r"^\d{10}([.,]\d+)?$"), F.substring(c, 1, 10).cast("bigint") * 1_000_000 + _micros(F.substring(c, 12, 6)))
        .when(c.rlike(r"^\d{13}$"), c.cast("bigint") * 1000)
        .when(c.rlike(r"^\d{16}$"), c.cast("bigint"))
    )
    return F.struct(count.alias("epoch_us"), F.split(parts, r"\|").alias("parts"), F.coalesce(day_first, F.lit(False)).alias("day_first"))


def _micros(digits: Column) -> Column:
    return F.rpad(F.coalesce(digits, F.lit("")), 6, "0").cast("int")


def fields(parsed: Column) -> Column:
    """The numbers of ``parse_parts``'s parts, with ``zone`` as written; null where they name no valid date and time."""
    p = parsed["parts"]
    swap = (p[9] == "s") & parsed["day_first"]
    month, day = F.when(swap, p[2]).otherwise(p[1]), F.when(swap, p[1]).otherwise(p[2])
    zero = lambda x: F.coalesce(_number(x), F.lit(0))
    hour, half = zero(p[3]), F.lower(p[7])
    hour24 = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    right_hour = F.when(half.isin("a", "p"), hour.between(1, 12)).otherwise(hour <= 23)
    minute, second = zero(p[4]), zero(p[5])
    built = F.struct(
        _number(p[0]).alias("year"),
        _month(month).alias("month"),
        _number(day).alias("day"),
        hour24.alias("hour"),
        minute.alias("minute"),
        second.alias("second"),
        _micros(F.substring(p[6], 1, 6)).alias("micros"),
        _zone(p[8]).alias("zone"),
    )
    date = F.try_make_timestamp(_number(p[0]), _month(month), _number(day), F.lit(0), F.lit(0), F.lit(0), F.lit("+00:00"))
    return F.when(date.isNotNull() & (_number(p[0]) >= 1) & right_hour & (minute <= 59) & (second <= 59), built)


def to_micros(f: Column, zone: Column) -> Column:
    """Microseconds of ``fields`` on the clock of ``zone``.

    A clock time that occurs twice means its first occurrence; a skipped one is read with the offset in force before
    the change. Both are what ``java.time`` does. A zone that doesn't exist gives null.
    """
    at = F.try_make_timestamp(f["year"], f["month"], f["day"], f["hour"], f["minute"], f["second"], zone)
    return F.unix_micros(at) + f["micros"]
