"""Filters, labels and work queues over event and venue rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import url_host
from .extract import content_system


def in_window(day: Column, first: Column, last: Column, undated: bool = False) -> Column:
    """Inclusive; bounds in either order; rows without a date only on request."""
    inside = day.between(F.least(first, last), F.greatest(first, last))
    return F.coalesce(inside, F.lit(False)) | (day.isNull() if undated else F.lit(False))


def next_days(at: Column, as_of: str, days: int) -> Column:
    """From as_of to so many days ahead; undated rows out; no filter for days below 1."""
    if days <= 0:
        return F.lit(True)
    now = F.lit(as_of).cast("timestamp_ntz")
    return F.coalesce(at.between(now, now + F.expr(f"INTERVAL {days} DAYS")), F.lit(False))


def is_past(at: Column, as_of: str) -> Column:
    """Before as_of; a row at midnight is one for the whole day."""
    now = F.lit(as_of).cast("timestamp_ntz")
    midnight = at == F.date_trunc("day", at).cast("timestamp_ntz")
    return F.coalesce(F.when(midnight, F.to_date(at) < F.to_date(now)).otherwise(at < now), F.lit(False))


def horizon_label(day: Column, as_of: str, ahead: int = 365) -> Column:
    """archive, keep, drop (too far ahead); undated rows are kept."""
    today = F.lit(as_of).cast("date")
    return F.when(day < today, "archive").when(day > F.date_add(today, ahead), "drop").otherwise("keep")


def contains_any(columns: Iterable[Column], needle: str) -> Column:
    """Case-insensitive substring over several columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return out


def weekend(at: Column) -> Column:
    return F.coalesce(F.weekday(at) >= 5, F.lit(False))


def within(cost: Column, limit: float, keep_unknown: bool) -> Column:
    """At most limit; unknown costs as told."""
    return F.coalesce(cost <= limit, F.lit(keep_unknown))


def marker_label(address: Column, venue: Column, allow: list[str], deny: list[str]) -> Column:
    """True where the place is clearly outside: the address decides if it has a marker, else the venue."""
    has = lambda c, ms: F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit("|".join(map(re.escape, ms))))
    return (
        F.when(has(address, allow), False)
        .when(has(address, deny), True)
        .otherwise(has(venue, deny) & ~has(venue, allow))
    )


#: Patterns and words of listings that are not venues.
LISTING_PATTERNS = [
    r"\d+\s*sqft", r"\d+\s*sq\s*ft", r"with\s+(free\s+)?equipment", r"meeting\s+room", r"seminar\s+room", r"conference\s+room",
    r"podcast\s+studio", r"recording\s+studio", r"photo\s+studio", r"film\s+studio", r"production\s+space", r"event\s+space\s+(for|in)",
    r"loft\s+(with|space|studio)", r"brownstone", r"townhouse", r"apartment", r"modern\s+(brooklyn|manhattan|nyc)",
    r"bright\s+(versatile|modern|spacious)", r"skyline\s+view", r"rooftop\s+access", r"flexible\s+(space|room)", r"multi-?use", r"content\s+creation",
]
DESCRIPTIVE = ["bright", "modern", "cozy", "spacious", "elegant", "stylish", "unique", "versatile", "artsy", "chic", "upscale", "industrial", "rustic", "airy", "sunlit"]
RENTAL_WORDS = ["loft", "space", "studio", "room", "house", "home", "apartment", "brownstone", "townhouse"]
NUMBERED_WORDS = ["studio", "space", "loft", "room", "floor", "sqft", "sq ft", "apartment", "suite"]
LISTING_MORE = [
    r"(manhattan|brooklyn|nyc|midtown|chelsea|tribeca|soho)\s+studio", r"\+\s*(free\s+)?equipment",
    r"(for rent|available for|book now|hourly)", r"(eco-?wellness|media\s+studio)",
]


def listing_name(name: Column, patterns: list[str] = LISTING_PATTERNS, words: list[str] = DESCRIPTIVE) -> Column:
    """Whether a name describes a rental rather than names a venue; missing names do."""
    n = F.lower(F.coalesce(name, F.lit("")))
    one = lambda ws: F.rlike(n, F.lit("|".join(map(re.escape, ws))))
    number = sum((F.contains(n, F.lit(w)).cast("int") for w in words), F.lit(0))
    first = F.regexp_extract(n, r"^\s*(\S*)", 1)
    return (
        (n == "")
        | F.rlike(n, F.lit("|".join([*patterns, *LISTING_MORE])))
        | (number >= 2)
        | (first.isin(words) & one(RENTAL_WORDS))
        | (F.rlike(n, F.lit(r"^\d+[a-z]?\s+")) & one(NUMBERED_WORDS))
        | (F.rlike(n, F.lit(r"(class|workshop|seminar)[/\s]")) & ~F.rlike(n, F.lit("theater|theatre|playhouse|stage")))
    )


def vague(address: Column, names: list[str]) -> Column:
    """Addresses that are only a name of the area, or empty."""
    return F.trim(F.replace(F.lower(F.coalesce(address, F.lit(""))), F.lit(","), F.lit(""))).isin([*names, ""])


def block_domains(df: DataFrame, url: str, blocked: DataFrame, key: str) -> DataFrame:
    """df with url and `url_blocked`: blanked where its host, or a domain above it, is in blocked.domain. Each host is
    exploded to its suffixes for an equi join."""
    host = url_host(F.col(url))
    suffixes = df.select(F.col(key), F.split(host, r"\.").alias("p")).select(
        key, F.explode(F.expr("transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p) - i + 1), '.'))")).alias("domain")
    )
    hit = suffixes.join(blocked.select("domain"), "domain", "left_semi").select(key).distinct().withColumn("url_blocked", F.lit(True))
    out = df.join(hit, key, "left").withColumn("url_blocked", F.coalesce("url_blocked", F.lit(False)))
    return out.withColumn(url, F.when(F.col("url_blocked"), "").otherwise(F.col(url)))


def last_seen(df: DataFrame, entity: str, at: str) -> DataFrame:
    return df.groupBy(entity).agg(F.max(at).alias("last_at"))


def is_fresh(last: Column, as_of: str, days: int) -> Column:
    """Seen within so many days; never seen is stale."""
    return F.coalesce(last > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def split_by(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the flag, and the rest (unknown ones included)."""
    return df.filter(flag), df.filter(~F.coalesce(flag, F.lit(False)))


#: Marks of page states.
CHALLENGE, PARKED = ["just a moment", "checking your browser", "cf-browser-verification"], ["domain is for sale", "parked free", "buy this domain"]


def page_state(html: Column, visible: Column) -> Column:
    """challenge, parked, script_calendar (much markup, little text), the content system's name, or plain."""
    h = F.lower(F.coalesce(html, F.lit("")))
    one = lambda ws: F.rlike(h, F.lit("|".join(map(re.escape, ws))))
    out = F.when(one(CHALLENGE), "challenge").when(one(PARKED), "parked")
    out = out.when((F.length(h) > 5000) & (F.length(visible) / F.length(h) < 0.05), "script_calendar")
    system = content_system(h)
    return out.when(system != "unknown", system).otherwise("plain")


def funnel(df: DataFrame, label: Column) -> DataFrame:
    """Counts of one labelled pass."""
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def latest(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group by order. Spark prunes to n rows per group and task before it shuffles."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
