"""Shards by sampled splitters, on DataFrame functions alone.

Rows get the key (hash of the text, id), so equal texts lie side by side. A size-weighted sample of keys gives
quantile boundaries; rows fall into the ranges between them, ranges found overfull are subdivided, and the exact
bytes before each range place every row at its global byte offset. A shard is a run of offsets, so sizes differ
by no more than about one row, whatever the sample was like.

Null text counts as no bytes; a null id sorts first; repeated rows are separate rows; an empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, read, write_table

ROW_OVERHEAD = 16
#: Keys drawn, ranges per shard, and the ranges compared at once; all bound what the driver holds.
SAMPLE, RANGES_PER_SHARD, FAN = 20_000, 32, 32


def _splitters(thin: DataFrame, total: int, n: int) -> list[tuple[int, int]]:
    """At most n - 1 keys that cut a size-weighted sample into equal parts."""
    u = (F.xxhash64("doc_id", "h", F.lit(7)) / F.lit(2.0**64)) + 0.5
    drawn = (
        thin.withColumn("u", u)
        .filter(F.col("u") < F.lit(float(SAMPLE)) * F.col("size") / F.lit(float(total)))
        .orderBy("u")
        .limit(2 * SAMPLE)
        .withColumn("part", F.ntile(n).over(Window.partitionBy(F.lit(0)).orderBy("h", "id")))
        .groupBy("part")
        .agg(F.min(F.struct("h", "id")).alias("k"))
        .filter("part > 1")
        .orderBy("part")
    )
    return sorted({(r.k.h, r.k.id) for r in drawn.collect()})


def _range_of(keys: list[tuple[int, int]]) -> tuple[Column, Column]:
    """Splitters at or below a row's key: blocks of FAN of them begun, and those in the last such block."""

    def lit(ks: list[tuple[int, int]]) -> str:
        return "[" + ",".join(f'{{"h":{h},"id":{i}}}' for h, i in ks) + "]"

    key = F.struct("h", "id")
    blocks = [keys[i : i + FAN] for i in range(0, len(keys), FAN)]
    tops = F.from_json(F.lit(lit([b[0] for b in blocks])), "array<struct<h:bigint,id:bigint>>")
    nested = F.from_json(F.lit("[" + ",".join(map(lit, blocks)) + "]"), "array<array<struct<h:bigint,id:bigint>>>")
    block = F.size(F.filter(tops, lambda s: s <= key))
    within = F.size(F.filter(F.get(nested, F.col("block") - 1), lambda s: s <= key))
    return block, within


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shard sizes are near equal in bytes."""
    thin = doc_text(docs, id_col, text_col).select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"),
        (F.octet_length("text") + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
    )
    thin = write_table(thin, "shard-keys")
    total = thin.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    n_ranges = n_shards * RANGES_PER_SHARD
    keys = _splitters(thin, total, n_ranges) if total else []
    if keys:
        block, within = _range_of(keys)
        ranged = thin.withColumn("block", block).withColumn(
            "range", F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * FAN + within)
        )
    else:
        ranged = thin.withColumn("range", F.lit(0))
    # Overfull ranges are cut further by a hash of the id; any fixed order within a range will do.
    limit = max(1, math.ceil(2 * total / n_ranges))
    parts = ranged.groupBy("range").agg(F.ceil(F.sum("size") / F.lit(limit)).cast("int").alias("parts"))
    cut = (
        ranged.join(F.broadcast(parts), "range")  # at most n_ranges rows
        .withColumn("sub", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "h"), F.col("parts"))).otherwise(0))
        .select("doc_id", "id", "size", "text_crc32", "h", "range", F.col("sub").cast("int"))
    )
    # At most n_ranges + total / limit cells, about 1.5 n_ranges: bounded by the parameters.
    cells = cut.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        "range",
        "sub",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    cell = Window.partitionBy("range", "sub").orderBy("h", "id", "size", "text_crc32")
    placed = (
        cut.withColumn("nth", F.row_number().over(cell))
        .withColumn("upto", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), ["range", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
            F.least(
                F.lit(n_shards - 1),
                F.floor((F.col("bytes_before") + F.col("upto") - F.col("size")) * n_shards / F.lit(max(1, total))),
            )
            .cast("int")
            .alias("shard"),
        )
    )
    placed = write_table(placed, "shard-ranks")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `bytes`."""
    return shard(read(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
