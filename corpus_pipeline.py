"""A training corpus from `documents`: quality rules, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Its result is written as
Parquet in the shared folder and read again. Rejected documents go, one document of each near-duplicate component
stays, documents with a benchmark passage go, secrets in the others are replaced by marks, and the last stage returns
the piece ids of every remaining text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import decontaminate, near_dedup, pieces, quality, secrets
from eventlake.llm.common import delete_tables, read, recorded, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.quality_labels(spark, sf_dir))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, shingle=SHINGLE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs, pieces.default_model(), read_back=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


def stages() -> list[tuple[str, Stage]]:
    """The stages of one run. Each first deletes the tables that the stage before it wrote on its way: by the time a
    stage is called, the result of the one before is written and read again."""
    finished: list[str] = []

    def freeing(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            delete_tables(spark, finished)
            with recorded() as paths:
                out = stage(spark, docs, sf_dir)
            finished[:] = paths
            return out

        return run

    found = [quality_rules, minhash_near_dedup, benchmark_decontamination, secret_scans, sentencepiece]
    return [(stage.__name__, freeing(stage)) for stage in found]


#: For callers that write and read again between stages themselves, one run at a time.
STAGES = stages()

#: The quality model and the piece ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in stages():
        out = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = write_table(out, f"pipeline-{name}")
        delete_tables(spark, before)
        before = paths
    return docs
