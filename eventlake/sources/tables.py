"""Scans and sinks: all-string tables, CSV, JSON documents, nested exports, slice replacement and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, bool_token
from ..session import path_exists


def scan_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table of text cells; short rows are padded with nulls. With columns the files have no header line, and a column
    `_line` holds the whole line of a row with too few or too many cells, null for others."""
    if columns is None:
        return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_line"])
    return spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Project text cells to types. Blanks and bad cells become null, or 0 for `int0`."""

    def cell(name: str, kind: str) -> Column:
        c = blank_to_null(F.col(name)) if name in df.columns else F.lit(None).cast("string")
        if kind == "int0":
            return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0))
        return bool_token(c) if kind == "boolean" else c if kind == "string" else F.trim(c).try_cast(kind)

    return df.select(*(cell(n, k).alias(n) for n, k in schema.items()))


def csv_rows(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Parse one CSV line per row."""
    return df.select(F.from_csv(F.col(line), schema).alias("r")).select("r.*")


def json_rows(df: DataFrame, document: str, path: str) -> DataFrame:
    """One row (`item`, variant) for each element of the array at a path of a JSON document; none where it is absent."""
    items = F.try_variant_get(F.try_parse_json(F.col(document)), path, "array<variant>")
    return df.withColumn("item", F.explode(items)).drop(document)


def json_map_rows(df: DataFrame, document: str, record: str) -> DataFrame:
    """key and record columns of a JSON object that maps keys to arrays of records."""
    parsed = F.from_json(F.col(document), f"map<string,array<{record}>>")
    return df.select(F.explode(parsed).alias("key", "records")).select("key", F.inline("records"))


def nested_groups(df: DataFrame, group: str, part: Column, fields: list[str], order: list[str]) -> DataFrame:
    """Groups in parts of bounded size: `rows`, a sorted array of structs, and `n`. Write it with write.json."""
    item = F.struct(*(F.col(c) for c in [*order, *(f for f in fields if f not in order)]))
    return df.groupBy(group, part.alias("part")).agg(F.sort_array(F.collect_list(item)).alias("rows"), F.count("*").alias("n"))


def replace_slice(stored: DataFrame, incoming: DataFrame, slice_column: str, value: str) -> DataFrame:
    """stored with one slice replaced by incoming's rows of that slice; incoming rows of others are ignored."""
    return stored.filter(~F.col(slice_column).eqNullSafe(F.lit(value))).unionByName(incoming.filter(F.col(slice_column) == value))


def overwrite_slices(df: DataFrame, path: str, slice_column: str) -> None:
    """Write df over just the slices that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_column).parquet(path)


def overwrite_slice(incoming: DataFrame, path: str, slice_column: str, value: str) -> None:
    """replace_slice on a stored table: other slices are neither read nor written, incoming rows of others are ignored,
    and a slice without incoming rows is emptied. Written twice, it is the same."""
    spark = incoming.sparkSession
    rows = incoming.filter(F.col(slice_column) == value)
    if rows.isEmpty():
        folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{slice_column}={folder}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    else:
        overwrite_slices(rows, path, slice_column)


def report_columns(at: str) -> dict[str, Column]:
    """Weekday, date and clock time of a report."""
    return {"day": F.date_format(at, "EEEE"), "date": F.date_format(at, "yyyy-MM-dd"), "time": F.date_format(at, "HH:mm")}


def write_report(df: DataFrame, path: str) -> None:
    """Replace a report: CSV files with a header line, quoted where a cell needs it; null and empty cells differ."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue='""', nullValue="", escape='"')


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The text cells of a written report."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True, emptyValue="", nullValue=None)


def to_archive(rows: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the archive lacks, once each; append them."""
    return rows.join(archive.select(*keys), keys, "left_anti").dropDuplicates(keys)


def append_archive(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the archive at path lacks. Done twice, or again after a failure, it adds nothing twice;
    only the archive's key columns are read."""
    spark = rows.sparkSession
    if path_exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    rows.dropDuplicates(keys).write.mode("append").parquet(path)
