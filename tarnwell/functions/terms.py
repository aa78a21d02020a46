"""Spellings reduced to terms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that show nothing although Unicode doesn't class them as format characters.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
# White space, hyphens, dashes and underscores.
_GAP = re.compile("[\\s\\-_\u2010-\u2015\u2212\u2043\ufe58\ufe63\uff0d\uff3f]+")


def _shows(ch: str) -> bool:
    if ch.isascii():
        return ch >= " " or ch in "\t\n\v\f\r\x1c\x1d\x1e\x1f"
    if ch in INVISIBLE or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or "\u180b" <= ch <= "\u180f":
        return False
    category = unicodedata.category(ch)
    return category != "Cf" and (category != "Cc" or ch == "\x85")


def fold(text: str | None) -> str | None:
    """The term of a spelling: lower case, NFKC, words parted by single spaces; None if nothing is left."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", "".join(filter(_shows, text)))
        text = unicodedata.normalize("NFKC", text.lower())
        text = "".join(filter(_shows, text))
    else:
        text = "".join(filter(_shows, text)).lower()
    return _GAP.sub(" ", text).strip() or None


def _fold_series(values: pd.Series) -> pd.Series:
    codes, spellings = pd.factorize(values, use_na_sentinel=True)
    folded = [fold(s) for s in spellings]
    return pd.Series([folded[c] if c >= 0 else None for c in codes], dtype=object)


_fold_udf = None


def term(column: Column | str) -> Column:
    """Column of terms. Plain spellings stay in the JVM; only others pass, batch by batch, through Python.

    Null, blank and wholly invisible values give null.
    """
    global _fold_udf
    if _fold_udf is None:
        _fold_udf = F.pandas_udf(_fold_series, StringType())
    raw = F.col(column) if isinstance(column, str) else column
    plain = raw.rlike("^[a-z0-9]+( [a-z0-9]+)*$")
    return F.when(plain, raw).otherwise(_fold_udf(F.when(~plain, raw)))
