"""A versioned table of text vectors that is built again only as far as its texts have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import row_hash
from ..functions.udfs import embed
from ..operators.ranking import unit
from ..session import path_exists

MANIFEST = "version int, fingerprint string, n long, kept long, reused long, made long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each version: the fingerprint of its keys and texts, its rows, and how many of these kept their vector,
    took it from another key with the same text, or had it made."""
    if not path_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def current(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """key, digest, vector, how of the newest version; no rows where there is none or it was emptied."""
    newest = manifest(spark, path).orderBy(F.desc("version")).limit(1).collect()
    schema = f"key {key_type}, digest string, vector array<double>, how string"
    if not newest or not newest[0].n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={newest[0].version}")


def table_fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Count and fingerprint of rows (key, digest) in any order: sums and exclusive ors of hashes, combined before the
    shuffle."""
    h = [F.xxhash64("key", "digest", F.lit(i)) for i in range(2)]
    folded = [F.sum(F.pmod(x, F.lit(2**31))) for x in h] + [F.bit_xor(x) for x in h]
    got = rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.count("*"), *folded), 256).alias("f")).first()
    return got.n, got.f


def build_vectors(
    rows: DataFrame, key: str, text: Column, path: str, model: Callable[[list[str]], list[list[float]]], size: int, force: bool = False
) -> int:
    """Bring the table at path up to rows (filter out what is past first) and return its newest version.

    The same keys and texts as before: nothing is done. No rows: a version without rows. Else a key with the same text
    keeps its vector, other rows take the vector of their text wherever the table has it, and the model sees each text
    that is left once; force has all made anew. Vectors have length 1, or are zero if the model's are. The version is
    written before the manifest names it, so readers see the old one until the new one is whole. Null keys are left out,
    null texts are empty; of rows with one key the one with the smallest digest stays.
    """
    spark = rows.sparkSession
    whole = F.coalesce(text, F.lit(""))
    given = rows.select(F.col(key).alias("key"), row_hash(whole).alias("digest"), whole.alias("text")).filter("key IS NOT NULL")
    given = given.groupBy("key").agg(F.min(F.struct("digest", "text")).alias("r")).select("key", "r.digest", "r.text").persist()
    n, mark = table_fingerprint(given)
    past = manifest(spark, path).orderBy(F.desc("version")).limit(1).collect()
    if past and past[0].fingerprint == mark and not force:
        given.unpersist()
        return past[0].version
    version = past[0].version + 1 if past else 1
    old = current(spark, path, given.schema["key"].dataType.simpleString())
    old = old.limit(0) if force else old
    same = given.join(old.select("key", "digest", F.col("vector").alias("own")), ["key", "digest"], "left")
    by_text = old.groupBy("digest").agg(F.any_value("vector").alias("lent"))
    same = same.join(by_text, "digest", "left")
    new = same.filter("own IS NULL AND lent IS NULL").select("key", "text")
    made = embed(new, "key", "text", model, size).groupBy("digest").agg(F.any_value("vector").alias("made"))
    how = F.when(F.col("own").isNotNull(), "kept").when(F.col("lent").isNotNull(), "reused").otherwise("made")
    out = same.join(made, "digest", "left").select("key", "digest", F.coalesce("own", "lent", unit("made")).alias("vector"), how.alias("how"))
    out.write.mode("overwrite").parquet(f"{path}/version={version}")
    counts = {r.how: r["count"] for r in spark.read.parquet(f"{path}/version={version}").groupBy("how").count().collect()}
    note = (version, mark, n, *(counts.get(h, 0) for h in ("kept", "reused", "made")))
    spark.createDataFrame([note], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    given.unpersist()
    return version
