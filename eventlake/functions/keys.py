"""Keys, hashes and composed texts of event rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def event_key(*parts: Column) -> Column:
    """Parts joined by a double bar, missing ones empty."""
    return F.concat_ws("||", *map(_text, parts))


def dedupe_key(name: Column, date: Column, source: Column, link: Column, venue: Column) -> Column:
    """Name, date, source and `link:` or, without a link, `venue:`."""
    squeeze = lambda c: F.regexp_replace(F.lower(_text(c)), r"\s+", " ")
    last = F.when(squeeze(link) != "", F.concat(F.lit("link:"), squeeze(link))).otherwise(F.concat(F.lit("venue:"), squeeze(venue)))
    return F.concat_ws("||", squeeze(name), _text(date), squeeze(source), last)


def row_hash(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")).cast("binary"))


def fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """One digest of a table, whatever its order: row digests are folded within buckets of the key's digest, then over
    the buckets. There are as many buckets as the square root of the counted rows, so no list is longer than about that."""
    buckets = max(1, math.isqrt(max(0, df.count() - 1)) + 1)
    rows = df.select(F.md5(F.col(key).cast("string")).alias("k"), row_hash(F.col(text)).alias("h"))
    return (
        rows.groupBy(F.pmod(F.conv(F.substr("k", F.lit(1), F.lit(6)), 16, 10).cast("long"), F.lit(buckets)).alias("b"))
        .agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"])), 256).alias("h"))
        .agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256).alias("fingerprint"))
    )


def embedding_text(*parts: tuple[str, Column]) -> Column:
    """`label: value` lines of the parts that are not blank."""
    return F.concat_ws("\n", *(F.when(_text(c) != "", F.concat(F.lit(f"{k}: "), _text(c))) for k, c in parts))


def travel_key(origin_lat: Column, origin_lng: Column, dest_lat: Column, dest_lng: Column, mode: Column, at: Column) -> Column:
    """Coordinates to five decimals, mode, and the hour for driving, else `static`."""
    when = F.when(mode == "driving", F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd'T'HH")).otherwise("static")
    spot = lambda a, b: F.format_string("%.5f,%.5f", a, b)
    return F.concat_ws("|", spot(origin_lat, origin_lng), spot(dest_lat, dest_lng), mode, when)
