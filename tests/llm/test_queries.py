"""The registered queries against their SQL on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlake.llm import catalog, decontaminate, near_dedup, quality, secrets
from eventlake.llm.common import read, write_table
from eventlake.session import ship_package

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    ship_package(spark)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert mine == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_every_row(spark, name):
    ship_package(spark)
    table = "pages" if name.startswith("op6") else "documents"
    assert catalog.queries()[name](spark, SF).count() == read(spark, SF, table).count()


def test_pipeline_stages(spark):
    ship_package(spark)
    docs = read(spark, SF, "documents")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "x " * 5, "en", "s", 10)], docs.schema)
    docs, columns = docs.unionByName(extra), docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "secret_scans":
            before = before.unionByName(spark.createDataFrame([(10**6 + 5, "my token = abcdefgh ok", "en", "s", 22)], docs.schema))
        after = write_table(stage(spark, before, SF), f"test-{name}")
        assert after.columns == columns
        ids = {r.doc_id for r in after.collect()}
        if name == "quality_rules":
            judged = quality.judge(before, quality.quality_labels(spark, SF)).filter("kept")
            assert ids == {r.doc_id for r in judged.collect()}
        elif name == "minhash_near_dedup":
            assert ids == {r.doc_id for r in near_dedup.link(before, shingle=corpus_pipeline.SHINGLE).filter("kept").collect()}
            assert near_dedup.link(after, shingle=corpus_pipeline.SHINGLE).filter("NOT kept").count() == 0
        elif name == "benchmark_decontamination":
            bad = decontaminate.find(before, read(spark, SF, "benchmark")).filter("contaminated")
            assert ids == {r.doc_id for r in before.collect()} - {r.doc_id for r in bad.collect()}
        else:
            assert after.count() == before.count()
            hidden = secrets.scan(before).filter(F.size("spans") > 0).count()
            assert hidden and secrets.scan(after).filter(F.size("spans") > 0).count() == 0
            assert after.filter("n_chars <> length(text)").count() == 0
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert final.count() == before.count() and final.filter("n_ids <> size(ids)").count() == 0


def test_pipeline_runs_whole(spark):
    ship_package(spark)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_pipeline_of_an_empty_table(spark):
    ship_package(spark)
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0
