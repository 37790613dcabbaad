"""Dates and numbers as people write them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from corvane.functions.text import trimmed

GRANULARITIES = ("raw", "month", "week")
_DAY, _HOUR, _MINUTE, _SECOND = r"\d{4}-\d{1,2}-\d{1,2}", r"(?:[01]?\d|2[0-3])", r"[0-5]?\d", r"(?:[0-5]?\d|60)"
#: A day with a time: either separator without an offset; T, a fraction and an offset; or RFC 3339 to the digit.
_TIMES = (
    rf"[ T]{_HOUR}:{_MINUTE}(?::{_SECOND})?Z?", rf"T{_HOUR}:{_MINUTE}:{_SECOND}(?:\.\d+)?(?:[+-]\d{{2}}:?[0-5]\d)?Z?",
    r"(?<=\d{4}-\d{2}-\d{2})[ Tt](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[zZ]|[+-](?:[01]\d|2[0-3]):[0-5]\d)",
)


def date_of(value: Column) -> Column:
    """The local date of a period value, null where none can be read.

    A time of day must be one; it and an offset from UTC are then dropped, not applied.
    """
    bare = F.regexp_replace(value, rf"^({_DAY})(?:{'|'.join(_TIMES)})$", "$1")
    month = F.when(value.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(value, F.lit("-01")), "yyyy-M-d")).when(value.rlike(r"^\d{4}/\d{2}$"), F.try_to_date(F.concat(value, F.lit("/01")), "yyyy/M/d"))
    shapes = ((rf"^{_DAY}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"))
    days = F.coalesce(*[F.when(bare.rlike(shape), F.try_to_date(bare, pattern)) for shape, pattern in shapes])
    return F.when(value.rlike(r"^\d{4}[-/]\d{2}$"), month).otherwise(days)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week_of(day: Column) -> Column:
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def bucketed(value: Column, granularity: str) -> Column:
    """The period of a raw value: itself, its month or its ISO week; empty where it can't be read."""
    text = F.coalesce(trimmed(value), F.lit(""))
    if granularity == "raw":
        return text
    made = month_of(date_of(text)) if granularity == "month" else week_of(date_of(text))
    return F.coalesce(made, F.lit(""))


def period_in(rows: DataFrame, column: str, granularity: str) -> Column:
    """The period of a column of a table: dates and timestamps as they are, anything else by its text."""
    value, kind = F.col(f"`{column}`"), rows.schema[column].dataType
    if granularity != "raw" and isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return F.coalesce(month_of(value) if granularity == "month" else week_of(value), F.lit(""))
    return bucketed(value.cast("string"), granularity)


_NUMBER = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|infinity|nan)$"


def plain_number(value: Column) -> Column:
    """A number without separators or signs of money; null for other text."""
    return F.when(F.lower(value).rlike(_NUMBER), F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"))


def metric_in(rows: DataFrame, column: str) -> Column:
    """The figure of a column of a table: numbers as they are, anything else by its text."""
    if isinstance(rows.schema[column].dataType, NumericType):
        return F.col(f"`{column}`").cast("double")
    return metric_of(F.col(f"`{column}`").cast("string"))


def metric_of(value: Column) -> Column:
    """A figure: separators and a leading currency sign dropped, parentheses as a minus; null for other text."""
    bare = F.regexp_replace(F.replace(trimmed(value), F.lit(","), F.lit("")), r"^[$€£¥]+", "")
    wrapped = bare.rlike(r"^\(.*\)$")
    number = plain_number(F.when(wrapped, F.regexp_replace(bare, r"^\(+|\)+$", "")).otherwise(bare))
    return F.when(wrapped, -number).otherwise(number)
