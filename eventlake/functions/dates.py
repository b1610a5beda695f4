"""Column functions on dates: flexible parsing, effective dates, named windows, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats tried in order.
FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd h:mm a",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
]
WEEKDAY = r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?,?\s+"


def parse_flexible(c: Column, formats: list[str] = FORMATS) -> Column:
    """Timestamp by the first format that fits, after a leading weekday is cut; else null."""
    t = F.regexp_replace(F.trim(c), WEEKDAY, "")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats))


def effective_date(end_date: Column, start: Column, date_str: Column) -> Column:
    """Date by end date, else start, else the text."""
    return F.coalesce(F.to_date(end_date), F.to_date(start), F.to_date(parse_flexible(date_str)))


def windows(spark: SparkSession, as_of: str) -> DataFrame:
    """key, first, last: the named windows around a date. Asked on a Sunday, this_weekend is the next one."""
    d = F.to_date(F.lit(as_of))
    monday = F.weekday(d)
    saturday = F.date_add(d, F.pmod(F.lit(5) - monday, F.lit(7)))
    spans = {
        "today": (d, d),
        "tomorrow": (F.date_add(d, 1), F.date_add(d, 1)),
        "this_week": (d, F.date_add(d, F.lit(6) - monday)),
        "next_week": (F.date_add(d, F.lit(7) - monday), F.date_add(d, F.lit(13) - monday)),
        "this_weekend": (saturday, F.date_add(saturday, 1)),
        "next_30_days": (d, F.date_add(d, 30)),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("key"), a.alias("first"), b.alias("last")) for k, (a, b) in spans.items()))
    return spark.range(1).select(F.inline(rows))


def requested(asked: DataFrame, as_of: str) -> DataFrame:
    """asked (start_date, end_date, relative_window, days_ahead, all text) with first and last: both dates, then a
    relative window, then a positive number of days ahead, then one date alone; else nulls. Text that is no date or
    number counts as absent."""
    d = F.lit(as_of).cast("date")
    start, end = (F.to_date(F.try_to_timestamp(F.substr(F.trim(c), F.lit(1), F.lit(10)), F.lit("yyyy-MM-dd"))) for c in ("start_date", "end_date"))
    days = F.trim("days_ahead").try_cast("int")
    named = windows(asked.sparkSession, as_of).select("key", F.struct("first", "last").alias("_named"))
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    found = (
        F.when(start.isNotNull() & end.isNotNull(), pair(start, end))
        .when(F.col("_named").isNotNull(), F.col("_named"))
        .when(days > 0, pair(d, F.date_add(d, days)))
        .otherwise(F.when(F.coalesce(start, end).isNotNull(), pair(F.coalesce(start, end), F.coalesce(start, end))))
    )
    key = F.lower(F.trim("relative_window"))
    out = asked.withColumn("_key", key).join(F.broadcast(named), F.col("_key") == F.col("key"), "left")  # six rows
    return out.withColumn("_found", found).select(*asked.columns, "_found.first", "_found.last")
