"""Streams, run to the end, against their batch twins."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventlake.operators.filters import latest
from eventlake.session import ship_package
from eventlake.streaming import merging, streams


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def source(spark, tmp_path, parts=3):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.unionByName(e.filter("event_id % 5 = 0")).repartition(parts).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_intake_merges_each_key_once(spark, tmp_path):
    e, s = source(spark, tmp_path)
    path = str(tmp_path / "table")
    q = merging.start_merging(streams.intake(s, "event_id", "ts", "60 days"), path, "event_id", str(tmp_path / "cp"), every=None)
    q.awaitTermination(120)
    assert q.exception() is None
    kinds = "event_id long, user_id long, event_type string"
    out = merging.merged(spark, path, kinds)
    assert out.count() == e.count() == out.select("event_id").distinct().count()
    merging.merge_batches(path, "event_id")(e, 0)  # a batch that the ledger has does nothing
    assert merging.merged(spark, path, kinds).count() == e.count()


def test_merge_reads_no_more_as_the_table_grows(spark, tmp_path):
    path, merge = str(tmp_path / "table"), merging.merge_batches(str(tmp_path / "table"), "id", 4)
    for n in range(7):  # each batch repeats the last hundred keys of the one before, and itself
        ids = spark.range(n * 1000 - 100, n * 1000 + 1000).filter("id >= 0")
        merge(ids.unionByName(ids.filter("id % 3 = 0")).withColumn("at", F.lit(n)), n)
    read = {r.batch: r.folders_read for r in merging.ledger(spark, path).select("batch", "folders_read").distinct().collect()}
    assert read == {0: 0} | {n: 4 for n in range(1, 7)}  # of 4 to 24 folders those of the batch before
    rows = merging.merged(spark, path, "id long, at int")
    assert rows.count() == 7000 and rows.filter("at <> id div 1000").count() == 0
    merge(spark.createDataFrame([(5, 9), (None, 9), (6999, 9)], "id long, at int"), 7)  # one old key, one null, one recent
    assert merging.merged(spark, path, "id long, at int").count() == 7000
    last = merging.ledger(spark, path).filter("batch = 7").first()
    assert (last.bucket, last.n) == (-1, 0) and last.folders_read <= 14


def test_merge_writes_over_a_batch_that_failed(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, "x")], "id long, t string").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/rows/batch=0")
    assert merging.merged(spark, path, "id long, t string").count() == 0  # not in the ledger
    merging.merge_batches(path, "id")(spark.createDataFrame([(1, "y"), (2, "z")], "id long, t string"), 0)
    assert sorted((r.id, r.t) for r in merging.merged(spark, path, "id long, t string").collect()) == [(1, "y"), (2, "z")]


def test_stale_entities_fire_once(spark, tmp_path):
    ship_package(spark)
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [
        [("a", day(1)), ("b", day(1)), ("a", day(1)), (None, day(2)), ("c", None)],
        [("b", day(5)), ("c", day(6)), ("a", day(1)), ("a", day(4, 1))],  # a is seen again, twice late
        [("b", day(5)), ("c", day(13)), ("b", day(3))],  # a and b fall silent for a week
        [("a", day(14)), ("c", day(14)), ("b", day(2))],  # a comes back; a row of b far behind the watermark
        [("c", day(30))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    files = []
    for i in range(len(batches)):
        files += [str(p) for p in (tmp_path / f"in/{i}").glob("*.parquet")]
    (tmp_path / "all").mkdir()
    for i, f in enumerate(files):
        target = tmp_path / f"all/{i}.parquet"
        target.write_bytes(Path(f).read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))  # the source goes by time
    s = spark.readStream.schema("who string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    told = []
    finish(streams.stale_entities(s, "who", "at", 7, "1 hour").writeStream.outputMode("append").foreachBatch(lambda b, _: told.extend(map(tuple, b.collect()))), tmp_path)
    # c was seen again whenever the watermark could have passed its seven days
    assert sorted(told) == sorted([("a", day(4, 1), day(11, 1)), ("b", day(5), day(12)), ("a", day(14), day(21))])


def test_stale_entities_equal_freshness_of_all_events(spark, tmp_path):
    ship_package(spark)
    e, s = source(spark, tmp_path, 1)
    finish(streams.stale_entities(s, "user_id", "ts", 1, "0 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    end = e.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first().m
    seen = e.groupBy(F.col("user_id").cast("string").alias("u")).agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    want = {(r.u, r.last) for r in seen.collect() if r.last + dt.timedelta(days=1) < end}
    got = [(r.user_id, r.last_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_last_seen_equals_batch(spark, tmp_path):
    e, s = source(spark, tmp_path)
    finish(streams.last_seen(s, "user_id", "ts").writeStream.outputMode("complete").format("memory").queryName("seen"), tmp_path)
    want = {(r.user_id, r.last_at) for r in streams.last_seen(e, "user_id", "ts").collect()}
    assert {(r.user_id, r.last_at) for r in spark.table("seen").collect()} == want


def test_counters_equal_batch(spark, tmp_path):
    e, s = source(spark, tmp_path, 1)
    twice = e.unionByName(e.filter("event_id % 5 = 0"))
    finish(streams.counters(s, "ts", "event_type", "value", "1 day", delay="60 days").writeStream.outputMode("complete").format("memory").queryName("counts"), tmp_path)
    key = lambda r: (r.window.start, r.event_type, round(r.total, 4), r.n)
    want = {key(r) for r in streams.counters(twice, "ts", "event_type", "value", "1 day").collect()}
    assert {key(r) for r in spark.table("counts").collect()} == want


def test_recent_rows_equal_batch(spark, tmp_path):
    ship_package(spark)
    e, s = source(spark, tmp_path)
    rows = lambda d: d.select(F.col("event_type").alias("component"), F.col("event_id").alias("seq"), F.col("props").alias("detail"))
    seen: dict[str, list[int]] = {}

    def collect(batch, _):
        for r in batch.groupBy("component").agg(F.array_sort(F.collect_set("seq")).alias("s")).collect():
            seen[r.component] = r.s

    finish(streams.recent(rows(s), 5).writeStream.outputMode("update").foreachBatch(collect), tmp_path)
    want: dict[str, list[int]] = {}
    for r in latest(rows(e), "component", [F.desc("seq")], 5).collect():
        want.setdefault(r.component, []).append(r.seq)
    assert seen == {k: sorted(v) for k, v in want.items()}
