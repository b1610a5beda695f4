"""Deduplication, batches, rolling sums and samples. Orders are explicit, so results do not hang on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A keyed minimum of one struct is combined before the shuffle, so a hot key costs one
    row for each task; a row_number window would gather it."""
    keys = [keys] if isinstance(keys, str) else keys
    lead = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns)), lead).alias("row"))
    return best.select("row.*")


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key; rows with a blank key go."""
    return _first(df.filter(F.coalesce(F.trim(F.col(key)), F.lit("")) != ""), key, order)


def completeness(parts: list[tuple[Column, float]]) -> Column:
    """Sum of the weights of the parts that are not blank."""
    return sum((F.when(F.trim(c.cast("string")) != "", w).otherwise(0.0) for c, w in parts), F.lit(0.0))


def keep_best(df: DataFrame, key: str | list[str], score: Column, order: list[Column]) -> DataFrame:
    """Row with the highest score of each key; of equals the first."""
    return _first(df, key, [-score, *order])


def oldest_first(df: DataFrame, last: Column, order: list[Column], n: int) -> DataFrame:
    """The n rows done longest ago, never-done ones first."""
    return df.orderBy(last.asc_nulls_first(), *order).limit(n)


def batches(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """batch: numbers of batches of n rows within each group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("batch", F.floor((nth - 1) / n).cast("long"))


def rolling(df: DataFrame, key: str, at: str, span: str, measures: dict[str, str]) -> DataFrame:
    """Measures (SQL aggregates) over the rows of the same key within a span of time up to each row."""
    over = f"OVER (PARTITION BY {key} ORDER BY {at} RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)"
    return df.selectExpr("*", *(f"{m} {over} AS {name}" for name, m in measures.items()))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows chosen by a keyed digest: the same for the same seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def best_source(df: DataFrame, group: str, source: str, preferred: str) -> DataFrame:
    """The source with most rows of each group; ties to the preferred one, then by name."""
    n = df.groupBy(group, source).agg(F.count("*").alias("n"))
    return _first(n, group, [-F.col("n"), F.col(source) != preferred, F.col(source)])
