"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index: a vector is rotated by a fixed random orthonormal matrix (into at least `LEAST_BITS` dimensions) and only the
signs are kept, packed, with two correction scalars: the factor that makes the signs' inner product with a rotated query
an unbiased estimate of the true one, and the deviation of that estimate. Nothing is fitted, so every row is indexed.

Search: queries and codes meet in a grid of tasks, each of a bounded part of the codes and a bounded part of the
queries. A task estimates from the packed bits, and reranks by the original vectors whatever could still be among the
best: estimate plus `SIGMAS` deviations at or above the lowest kept score. No candidate count is capped, no pair leaves
a task except each query's best. Missing a true neighbour takes an error of more than `SIGMAS` deviations (about one in
30,000); ties and scores are those of the exact sum in double precision, in the order of the dimensions.

Equal vectors are indexed once, with their k + 1 smallest ids (a query's own row aside, no other copy can be among k),
so that a vector that a third of the rows share costs one row. Vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do rows with a null id; repeated rows of one id and vector count once; vectors
meet queries of their own length only; queries without any candidate and empty tables give no rows. Other columns are
not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, read, write_table

LEAST_BITS, SIGMAS, SEED = 256, 4.0, 20240311
#: Bits of a rotated query's components.
QUERY_BITS = 6
#: Codes and queries of one task at most, and the least number of parts of the codes; rows of a step within a task.
PART_ROWS, PART_QUERIES, PARTS, STEP = 131_072, 32_768, 48, 16_384

CODE = "dim int, cid long, vec array<{0}>, code binary, factor double, spread double"


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """bits x dim with orthonormal columns; the same in every task."""
    bits = max(LEAST_BITS, -(-dim // 64) * 64)
    drawn = np.random.default_rng([SEED, dim]).standard_normal((bits, dim))
    q, r = np.linalg.qr(drawn)
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Arrow lists of dim numbers as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def encode_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows, factor (of the signs' inner product) and spread (deviation for a unit query)."""
    turned = x.astype(np.float64) @ rotation(x.shape[1]).T
    bits = turned.shape[1]
    length = np.sqrt(np.square(turned).sum(axis=1))
    own = np.abs(turned).sum(axis=1) / (length * np.sqrt(bits))  # cosine of a vector and its signs
    spread = length * np.sqrt(np.maximum(0, 1 - own * own)) / (own * np.sqrt(bits - 1))
    return np.packbits(turned > 0, axis=1), length / (own * np.sqrt(bits)), spread


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the dimensions."""
    out = np.zeros(len(x))
    for d, c in enumerate(q.astype(np.float64)):
        out += x[:, d].astype(np.float64) * c
    return out


class _Query:
    """A rotated query in bit planes."""

    def __init__(self, q: np.ndarray) -> None:
        turned = rotation(len(q)) @ q.astype(np.float64)
        low, high = turned.min(), turned.max()
        step = (high - low) / (2**QUERY_BITS - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        self.planes = [np.packbits(levels >> j & 1).view(np.uint64) for j in range(QUERY_BITS)]
        self.low, self.step = low, step
        self.total = (low + step * levels).sum()
        self.length = np.sqrt(np.square(turned).sum())
        self.rounding = np.sqrt(np.square(turned - low - step * levels).sum())

    def bounds(self, words: np.ndarray, ones: np.ndarray, factor: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products and their upper bounds."""
        held = np.zeros(len(words), np.int64)
        for j, plane in enumerate(self.planes):
            held += np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64) << j
        estimate = factor * (2 * (self.low * ones + self.step * held) - self.total)
        return estimate, estimate + SIGMAS * (spread * self.length + factor * self.rounding)


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best rows of a part."""
    asked = _Query(q)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        estimate, upper = asked.bounds(*(c[part] for c in codes))
        least = best[k - 1] if len(best) == k else -np.inf
        if least == -np.inf and len(estimate) > k:  # a first threshold from the best by estimate
            first = np.argpartition(-estimate, k - 1)[:k]
            least = exact(x[part][first], q).min()
        chosen = np.flatnonzero(~(upper < least))
        best_ids = np.concatenate([best_ids, ids[part][chosen]])
        best = np.concatenate([best, exact(x[part][chosen], q)])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best


def usable(vec: str) -> Column:
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def index(classes: DataFrame) -> DataFrame:
    """dim, cid, vec, code, factor, spread of every row of classes (cid, vec)."""
    kind = classes.schema["vec"].dataType.elementType.simpleString()

    def step(batches):
        for batch in batches:
            dims = np.diff(batch.column("vec").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                code, factor, spread = encode_rows(matrix(some.column("vec"), dim))
                columns = [pa.array(np.full(len(factor), dim, np.int32)), some.column("cid"), some.column("vec")]
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, packed, pa.array(factor), pa.array(spread)], names=["dim", "cid", "vec", "code", "factor", "spread"])

    return in_batches(classes.select("cid", "vec"), step, CODE.format(kind))


def search(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, cid, score: the k best rows of an index (see `index`) for each query (qid, vec), ties to the smaller cid."""
    rows, asked = codes.count(), queries.count()
    a, b = max(PARTS, -(-rows // PART_ROWS)), max(1, -(-asked // PART_QUERIES))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("*", part("cid", a).alias("a")).select("*", each(b).alias("b"))
    right = queries.select(F.size("vec").alias("dim"), "qid", "vec", part("qid", b).alias("b")).select("*", each(a).alias("a"))
    schema = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])

    def cell(codes: pa.Table, queries: pa.Table) -> pa.Table:
        if not codes.num_rows or not queries.num_rows:
            return schema.empty_table()
        dim = codes.column("dim")[0].as_py()
        x, ids = matrix(codes.column("vec"), dim), codes.column("cid").to_numpy()
        words = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint64).reshape(len(x), -1)
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        code = (words, ones, codes.column("factor").to_numpy(), codes.column("spread").to_numpy())
        found = [_nearest(q, x, ids, code, k) for q in matrix(queries.column("vec"), dim)]
        qids = np.repeat(queries.column("qid").to_numpy(), [len(i) for i, _ in found])
        return pa.table([pa.array(qids), *(pa.array(np.concatenate(c)) for c in zip(*found))], schema=schema)

    key = ["dim", "a", "b"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "qid long, cid long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    return hits.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query, its k nearest other rows by largest inner product."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable("vec"))
    rows = rows.groupBy("id", "vec").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))  # only k + 1 rows of a copy group leave a task
    classes = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = write_table(classes.select(F.get("ids", F.lit(0)).alias("cid"), "vec", "ids"), "classes")
    asked = write_table(rows.filter("asks").join(classes, "vec").select(F.col("id").alias("query_id"), "cid"), "asked")
    queries = classes.join(asked.select("cid").distinct(), "cid").select(F.col("cid").alias("qid"), "vec")
    hits = search(write_table(index(classes), "codes"), write_table(queries, "queries"), k + 1)
    rows_of = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))
    near = hits.join(classes.select("cid", "ids"), "cid").groupBy("qid").agg(F.flatten(F.collect_list(rows_of)).alias("near"))
    near = near.select(F.col("qid").alias("cid"), F.slice(F.array_sort("near"), 1, k + 1).alias("near"))  # k + 1 classes at most were collected
    own = F.filter("near", lambda n: n["id"] != F.col("query_id"))
    out = asked.join(near, "cid").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("nth", "n"))
    return out.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP11_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
