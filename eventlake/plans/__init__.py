"""Registered queries of the event catalogue engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators.dedupe import keep_best
from ..operators.filters import in_window
from ..operators.ranking import lexical_top, query_tokens
from . import extract, filters, joins, registry, reports, retrieval, sources  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as event rows: one per customer and day with the best score inside a window, ranked for a query."""
    o = registry.table(spark, sf_dir, "orders").join(registry.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        F.col("o_orderkey").alias("id"),
        F.coalesce(blank_to_null(F.col("c_name")), F.lit("unknown")).alias("name"),
        F.col("c_mktsegment").alias("type"),
        F.col("o_orderpriority").alias("text"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("quality"),
    )
    window = in_window(F.col("day"), F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    best = keep_best(rows.filter(window), ["name", "day"], F.col("quality"), [F.col("id")])
    asked = spark.createDataFrame([(1, "urgent building talks")], "q int, ask string")
    return lexical_top(best, "id", {"name": "name", "type": "type", "text": "text"}, query_tokens(asked, "q", "ask"), "q", 20)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.SQL
