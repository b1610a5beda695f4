"""Reports: counts by several keys, facets, rollups, nested lists, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """by, value, n: counts by each key alone and in total, in one pass."""
    by = F.lit("total")
    value = F.lit(None).cast("string")
    for k in keys:
        by = F.when(F.grouping(k) == 0, k).otherwise(by)
        value = F.when(F.grouping(k) == 0, F.col(k).cast("string")).otherwise(value)
    return df.groupingSets([[k] for k in keys] + [[]], *keys).agg(by.alias("by"), value.alias("value"), F.count("*").alias("n")).select("by", "value", "n")


def facets(df: DataFrame, key: str, known: Column) -> DataFrame:
    """Values with their counts and how many have something known, most frequent first, then by name."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(known).alias("n_known"))
    return out.orderBy(F.desc("n"), key)


def freshness_rollup(df: DataFrame, group: str, last: Column, since: Column) -> DataFrame:
    return df.groupBy(group).agg(
        F.count_if(last >= since).alias("fresh"), F.count_if(last < since).alias("stale"), F.count_if(last.isNull()).alias("never"), F.count("*").alias("total")
    )


def lists_by(df: DataFrame, group: str, part: Column, item: Column) -> DataFrame:
    """Sorted lists of a group's items, in parts so that no list grows without bound."""
    return df.groupBy(group, part.alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def top_elements(df: DataFrame, array: str, key: str, least: int, n: int) -> DataFrame:
    """Elements of an array column: count, first key, at least so often, most frequent first, at most n."""
    each = df.select(F.explode(array).alias("element"), key).groupBy("element").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return each.filter(F.col("n") >= least).orderBy(F.desc("n"), "element").limit(n)


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and its value where all rows agree."""
    both = df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("top"))
    return both.filter(F.col(value) == F.col("top")).drop("top")


def coverage(df: DataFrame, covered: Column, score: Column, least: float = 0.85) -> DataFrame:
    """Share covered, score range, and whether the share is low."""
    out = df.agg(F.avg(covered.cast("double")).alias("share"), F.min(score).alias("lowest"), F.max(score).alias("highest"))
    return out.withColumn("low", F.col("share") < least)
