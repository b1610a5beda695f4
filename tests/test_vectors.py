"""The versioned vector table: what a second build keeps, takes over and makes."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.session import ship_package
from eventlake.sources import vectors


def model(texts):
    return [[float(len(t)), 4.0 if t else 0.0] for t in texts]


def build(spark, path, rows, **more):
    df = spark.createDataFrame(rows, "k long, t string")
    version = vectors.build_vectors(df, "k", F.col("t"), path, model, 2, **more)
    return version, {r.key: (r.how, [round(x, 3) for x in r.vector]) for r in vectors.current(spark, path).collect()}


def test_versions_follow_the_texts(spark, tmp_path):
    ship_package(spark)
    path = str(tmp_path / "v")
    assert vectors.current(spark, path).count() == 0
    first = [(1, "abc"), (2, "abc"), (3, None), (None, "x"), (4, "zz")]
    assert build(spark, path, first) == (1, {1: ("made", [0.6, 0.8]), 2: ("made", [0.6, 0.8]), 3: ("made", [0.0, 0.0]), 4: ("made", [0.447, 0.894])})
    assert build(spark, path, list(reversed(first)) + [(1, "abc")])[0] == 1  # the same in another order, one row twice
    version, held = build(spark, path, [(1, "abc"), (2, "new"), (5, "zz"), (3, "")])
    assert version == 2 and {k: h for k, (h, _) in held.items()} == {1: "kept", 2: "made", 5: "reused", 3: "kept"}
    assert held[5][1] == [0.447, 0.894]
    assert build(spark, path, []) == (3, {}) and build(spark, path, [])[0] == 3
    assert build(spark, path, [(1, "abc")])[1] == {1: ("made", [0.6, 0.8])}
    version, held = build(spark, path, [(1, "abc")], force=True)
    assert version == 5 and held[1][0] == "made"
    noted = [tuple(r) for r in vectors.manifest(spark, path).select("version", "n", "kept", "reused", "made").orderBy("version").collect()]
    assert noted == [(1, 4, 0, 0, 4), (2, 4, 2, 1, 1), (3, 0, 0, 0, 0), (4, 1, 0, 0, 1), (5, 1, 0, 0, 1)]


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    ship_package(spark)
    path = str(tmp_path / "v")
    build(spark, path, [(1, "abc")])
    spark.createDataFrame([(9, "d", [1.0], "made")], "key long, digest string, vector array<double>, how string").write.parquet(f"{path}/version=2")
    assert [r.key for r in vectors.current(spark, path).collect()] == [1]
    assert build(spark, path, [(2, "abc")])[1] == {2: ("reused", [0.6, 0.8])}
