"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that may be broadcast after they have been counted; anything larger is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound is on rows alone.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_RECORD: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written within, as a list that grows."""
    token = _RECORD.set([])
    try:
        yield _RECORD.get()
    finally:
        _RECORD.reset(token)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    if _RECORD.get() is not None:
        _RECORD.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its bytes stay within limit. For materialised tables of numbers, strings and arrays."""
    sizes = [F.lit(16)]
    for name, kind in df.dtypes:
        own = F.octet_length(name) if kind in ("string", "binary") else F.size(name) * 24 if kind.startswith("array") else F.lit(8)
        sizes.append(F.greatest(F.coalesce(own, F.lit(0)), F.lit(0)).cast("long"))
    held = df.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0)).alias("b")).first().b
    return F.broadcast(df) if held <= limit else df


def in_batches(
    df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """df.mapInArrow(step, schema) with batches bounded by bytes too, whatever the length of the texts; a bound that the
    session has already stays."""
    bound, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(step, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, whatever else (clashing names included) the table has; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def double_array(values: list[float]) -> Column:
    """A constant array that Spark folds into one literal."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


#: The white space of the word contracts, as characters.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of `[^\\x20\\x09-\\x0D]+` as an array. Plain replacements and a one-character split run several times
    faster in the JVM than a regular expression or translate()."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")
