"""Set comparison and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def choose_source(status: DataFrame, fetched: DataFrame, cached: DataFrame, source: str) -> DataFrame:
    """Rows of each source by its status: fetched ones if `fetched`, else (fresh or failed) the cached ones."""
    new = status.filter("status = 'fetched'").select(source)
    old = status.filter("status <> 'fetched'").select(source)
    return fetched.join(new, source, "left_semi").unionByName(cached.join(old, source, "left_semi"))


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, n: keys in both, only left, only right."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(key).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def update_fields(stored: DataFrame, updates: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """stored with fields overwritten where an update supplies them (null: not supplied, blank: supplied); the last wins
    field by field."""
    last = updates.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields))
    out = stored.join(last, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return out


def fill_blanks(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Blank fields filled from incoming, unknown keys added; action: kept, updated or added."""
    a = stored.select(key, *(F.col(f).alias(f"a_{f}") for f in fields)).withColumn("_a", F.lit(True))
    b = incoming.select(key, *(F.col(f).alias(f"b_{f}") for f in fields)).withColumn("_b", F.lit(True))
    j = a.join(b, key, "full")
    gains = F.lit(False)
    for f in fields:
        gains = gains | (blank_to_null(F.col(f"a_{f}")).isNull() & blank_to_null(F.col(f"b_{f}")).isNotNull())
    action = F.when(F.col("_a").isNull(), "added").when(gains, "updated").otherwise("kept")
    return j.select(key, *(F.coalesce(blank_to_null(F.col(f"a_{f}")), F.col(f"b_{f}")).alias(f) for f in fields), action.alias("action"))


def insert_new(stored: DataFrame, incoming: DataFrame, key: str, order: str, stamp: Column) -> DataFrame:
    """stored with incoming rows of unknown keys, the first of each, stamped in date_added."""
    new = incoming.join(stored.select(key), key, "left_anti")
    new = new.groupBy(key).agg(F.min_by(F.struct(*(F.col(c) for c in incoming.columns)), order).alias("r")).select("r.*")
    return stored.unionByName(new.withColumn("date_added", stamp), allowMissingColumns=True)


def set_where(df: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """df with columns set on the rows whose key is listed."""
    out = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    for c, v in values.items():
        out = out.withColumn(c, F.when(F.col("_hit"), v).otherwise(F.col(c)))
    return out.drop("_hit")
