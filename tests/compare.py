"""Results of Spark and DuckDB brought to one form."""

from __future__ import annotations

import datetime
import decimal


def plain(value):
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def spark_rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(str([plain(r[c]) for c in columns]) for r in df.collect())


def duck_rows(connection, sql: str) -> tuple[list[str], list[str]]:
    result = connection.sql(sql)
    at = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    return sorted(result.columns), sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
