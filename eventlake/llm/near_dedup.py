"""MinHash near-dedup with HyperMinHash registers.

A document's set holds its distinct SHINGLE-word shingles of `[^\\x20\\x09-\\x0D]+` words, A-Z lower-cased (a shorter
text: its whole sequence; no words: the empty set, linked with nothing). Each of 324 buckets keeps, of the least hash
under its own permutation, the leading zeros (6 bits) and the 10 bits after the leading one. Six registers make a
band key (of two documents at the threshold, one pair in ten million shares none of the 54); of documents with one key,
all are first paired with the smallest id alone. Pairs pass a collision-corrected Jaccard estimate with a
wide margin and are then confirmed on their full sets.

Where a key's documents are still in several components, pairs from different components are ruled out by counts before
any is made. A pair x, y reaches the threshold only if their symmetric difference holds at most a ninth of both sizes.
So a document goes whose shingles that some other component has are too few. For the rest, D is the symmetric
difference from the key's pivot, a document of its first component: those near the pivot are linked with it, and any
other x and y have to share at least (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2 elements of D, one or more. Only pairs that
share one of a document's rarest such elements become candidates; no pair is lost, there is no cap, and a large group
of unlike variants of one text makes few pairs.

Copies (equal word sequences) are one node throughout. Rows that share an id count as one document. A null id is
linked with nothing, has a null component and is kept. Null text has no words. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .arrays import BASES, LOWER, U, column_bytes, mix, span_hashes, window_hashes, word_bounds, word_hashes
from .common import doc_text, in_batches, maybe_broadcast, read, write_table
from .components import components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, MANTISSA = 54, 6, 10
REGISTERS = BANDS * ROWS
#: Registers that the estimate uses, four to a long.
ESTIMATED, LANES = 128, 4
#: An estimate so far below the threshold (over five standard deviations) rules a pair out.
MARGIN = 0.2
#: A pair is similar enough if 100 + PERCENT times its symmetric difference is at most 100 - PERCENT times both sizes.
NEAR, FAR = 100 - PERCENT, 100 + PERCENT
_RNG = np.random.default_rng(77)
_FACTOR = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_SHIFT = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shingle_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, at = column_bytes(col)
    data = LOWER[data]
    begin, end, before = word_bounds(data, at)
    yield from _sets(word_hashes(data, begin, end), before, n)


def _sets(words: np.ndarray, before: np.ndarray, n: int) -> Iterator[np.ndarray]:
    starts = np.arange(max(0, len(words) - n + 1))
    every = window_hashes(words, starts, n) if len(starts) else np.zeros(0, U)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        else:
            yield window_hashes(words, np.array([a]), b - a) if b > a else np.zeros(0, U)


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS values of leading zeros and mantissa bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, U)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    part, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63).astype(np.uint16)
    return (zeros << MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def _longs(values: list[np.ndarray] | np.ndarray) -> pa.Array:
    """Rows of 64-bit values as a list column."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    flat = np.concatenate(values) if len(values) else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _sign(n: int) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            data = LOWER[data]
            begin, end, before = word_bounds(data, at)
            words = word_hashes(data, begin, end)
            full = np.flatnonzero(np.diff(before))
            seq = np.zeros((2, batch.num_rows), U)
            for k in range(2):
                seq[k, full] = span_hashes(words, before[:-1][full], before[1:][full], BASES[k])
            found = np.zeros((batch.num_rows, REGISTERS), np.uint16)
            size = np.zeros(batch.num_rows, np.int64)
            for i, s in enumerate(_sets(words, before, n)):
                size[i] = len(s)
                if len(s):
                    found[i] = registers(s)
            keys = np.zeros((batch.num_rows, BANDS), U)
            for j in range(ROWS):
                keys = mix(keys * U(BASES[0]) + found[:, j::ROWS].astype(U) + np.arange(1, BANDS + 1, dtype=np.uint64))

            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(mix(seq[0]).view(np.int64)),
                    pa.array((seq[1] + np.diff(before).astype(U)).view(np.int64)),
                    pa.array(size),
                    _longs(np.ascontiguousarray(found[:, :ESTIMATED]).view(U)),
                    _longs(keys),
                ],
                names=["doc_id", "a", "b", "n", "registers", "keys"],
            )

    return run


def estimate(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Jaccard estimate from two register arrays, less the share of registers expected to collide by chance."""

    def equal(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        lanes = [F.when(F.shiftrightunsigned(d, 16 * k).bitwiseAND(0xFFFF) == 0, 1).otherwise(0) for k in range(LANES)]
        return sum(lanes[1:], lanes[0])

    share = F.aggregate(F.zip_with(x, y, equal), F.lit(0), lambda a, v: a + v) / ESTIMATED
    chance = F.lit(0.7213 / (1 << MANTISSA)) * n * m / ((n + m) * (n + m))
    return (share - chance) / (1 - chance)


def _pairs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with the two sets of each of its rows. Rows of one u tend to be neighbours, so its set is kept."""
    last, own = None, None
    for batch in batches:
        texts, sets = batch.column("text_u").to_pylist(), []
        for i, other in enumerate(shingle_sets(batch.column("text_v"), n)):
            if last is None or last != texts[i]:
                last, own = texts[i], next(shingle_sets(pa.array([texts[i]], pa.string()), n))
            sets.append((own, other))
        yield batch, sets


def _confirm(n: int) -> Step:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _pairs(batches, n):
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
            keep = [b > 0 and 100 * b >= PERCENT * (len(x) + len(y) - b) for b, (x, y) in zip(both, sets)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _differ(n: int) -> Step:
    """u, v, comp, n, the size m of u's set, and d: the symmetric difference of the two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _pairs(batches, n):
            own = [batch.column(c) for c in ("u", "v", "comp", "n")]
            size = pa.array([len(x) for x, _ in sets], pa.int64())
            d = _longs([np.setxor1d(x, y, assume_unique=True) for x, y in sets])
            yield pa.record_batch([*own, size, d], names=["u", "v", "comp", "n", "m", "d"])

    return run


def _shingles(n: int) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), n))
            yield pa.record_batch([batch.column("id"), batch.column("comp"), _longs(sets)], names=["id", "comp", "g"])

    return run


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (its document is its component's first) of every row."""
    df = doc_text(docs, id_col, text_col)
    signed = write_table(
        in_batches(df, _sign(shingle), "doc_id long, a long, b long, n long, registers array<long>, keys array<long>"), "signatures"
    )
    known = signed.filter("n > 0 AND doc_id IS NOT NULL")
    copies = known.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c")
    copies = maybe_broadcast(write_table(copies, "copies"))
    rows = write_table(
        known.join(copies, ["a", "b"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n", "registers", "keys"), "nodes"
    )
    nodes = rows.filter("doc_id = rep").select(F.col("rep").alias("id"), "n", "registers", "keys")
    # A shared id may stand for several texts: each of its representatives is linked to the smallest.
    spread = rows.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).filter("u <> top")
    links = rows.select("doc_id", F.col("rep").alias("v")).join(spread, "doc_id").select("u", "v")

    keys = nodes.select("id", "n", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("c")).filter("c > 1").drop("c")
    members = write_table(keys.join(leaders, "key"), "members")
    nearby = members.select("id").unionByName(links.select(F.explode(F.array("u", "v")).alias("id")))
    candidates = write_table(nearby.distinct(), "candidates")
    texts = write_table(
        df.join(maybe_broadcast(candidates), df.doc_id == candidates.id).select("id", "text"), "candidate-texts"
    )
    sketches = nodes.select("id", "n", "registers").join(candidates, "id").distinct()
    pairs = write_table(members.filter("u <> id").select("u", F.col("id").alias("v")).distinct(), "pairs")
    links = write_table(links.unionByName(_confirmed(pairs, sketches, texts, shingle)), "links")
    labels = components(links)
    placed = members.join(labels, members.id == labels.node, "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    open_ = write_table(placed.join(_mixed(placed), "key").drop("least"), "open")
    if not open_.isEmpty():
        near, pairs = _across(open_, texts, shingle)
        pairs = write_table(pairs, "pairs")
        links = write_table(links.unionByName(near).unionByName(_confirmed(pairs, sketches, texts, shingle)), "links")
        labels = components(links)
    places = rows.select("doc_id", "rep").distinct().join(labels, F.col("rep") == labels.node, "left")
    places = places.groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("component_id"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(places, "doc_id", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, columns unchanged, whose document is the first of its component; of repeated ids one row, the
    first by text. Rows without an id stay."""
    kept = link(docs, id_col, text_col, shingle).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).alias("own"))
    nth = F.row_number().over(Window.partitionBy("own_id").orderBy("own"))
    named = own.join(kept, own.own_id == kept.kept_id, "left_semi").withColumn("nth", nth).filter("nth = 1")
    return named.select("row.*").unionByName(own.filter("own_id IS NULL").select("row.*"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Keys whose documents are in several components, the first of these as pivot, and their least set size."""
    found = placed.groupBy("key").agg(F.min("comp").alias("u"), F.max("comp").alias("y"), F.min("n").alias("least"))
    return found.filter("u <> y").select("key", "u", "least")


def _narrowed(rows: DataFrame) -> DataFrame:
    """Rows of still mixed keys whose document shares enough shingles (s) with other components for the least partner."""
    enough = f"{FAR} * s >= {PERCENT} * (n + greatest(least, ceil({PERCENT} * n / 100)))"
    return rows.drop("u").join(_mixed(rows), "key").filter(enough).drop("least")


def _across(open_: DataFrame, texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Links u, v with pivots, and other pairs of one key and different components that may be similar enough; none that
    is gets lost. open_: key, u (its pivot), id, n, comp."""
    own = open_.select("id", "comp").distinct()
    sets = write_table(in_batches(texts.join(own, "id").select("id", "comp", "text"), _shingles(shingle), "id long, comp long, g array<long>"), "open-sets")
    each = sets.select("id", "comp", F.explode("g").alias("g"))
    between = each.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("g")
    between = maybe_broadcast(write_table(between, "between"))
    shared = each.join(between, "g", "left_semi").groupBy("id").agg(F.count("*").alias("s"))
    left = write_table(_narrowed(_narrowed(open_.join(shared, "id"))), "narrowed")

    pairs = left.filter("u <> id").select("u", F.col("id").alias("v"), "comp", "n").distinct()
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v").join(
        texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u"
    )
    diffs = write_table(in_batches(both, _differ(shingle), "u long, v long, comp long, n long, m long, d array<long>"), "differences")
    near = diffs.filter(f"{FAR} * size(d) <= {NEAR} * (n + m)").select("u", "v")
    # Two of a pivot share 2 * FAR * common >= far + far elements at least.
    far = diffs.withColumn("far", F.expr(f"{FAR} * size(d) - {NEAR} * n"))
    by_comp = far.groupBy("u", "comp").agg(F.min("far").alias("far"))
    nearest = by_comp.groupBy("u").agg(F.min(F.struct("far", "comp")).alias("first"))
    second = by_comp.join(nearest, "u").filter("comp <> first.comp").groupBy("u", "first").agg(F.min("far").alias("second"))
    each = far.select("u", "v", "comp", "far", F.explode("d").alias("e"))
    usable = each.groupBy("u", "e").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("times"))
    usable = maybe_broadcast(write_table(usable.filter("x <> y").select("u", "e", "times"), "usable"))
    rarest = (
        each.join(usable, ["u", "e"])
        .groupBy("u", "v", "comp", "far")
        .agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("es"))  # bounded by two sets
        .join(maybe_broadcast(write_table(second, "pivots")), "u")
        .withColumn("need", F.expr(f"greatest(1, ceil((far + if(comp = first.comp, second, first.far)) / {2 * FAR}))"))
        .filter("size(es) >= need")
        .select("u", "v", "comp", "far", F.expr("size(es)").alias("k"), F.expr("explode(slice(es, 1, int(size(es) - need + 1)))").alias("e"))
    )
    index = write_table(rarest.withColumn("e", F.col("e.e")), "rarest")
    x = index.select("u", "e", *(F.col(c).alias(f"{c}_x") for c in ("v", "comp", "far", "k")))
    y = index.select("u", "e", *(F.col(c).alias(f"{c}_y") for c in ("v", "comp", "far", "k")))
    fits = f"v_x < v_y AND comp_x <> comp_y AND {2 * FAR} * least(k_x, k_y) >= far_x + far_y"
    return near, x.join(y, ["u", "e"]).filter(fits).select(F.col("v_x").alias("u"), F.col("v_y").alias("v")).distinct()


def _confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs u, v that pass the estimate and then the comparison of full sets."""
    x = sketches.select(F.col("id").alias("u"), F.col("n").alias("n"), F.col("registers").alias("x"))
    y = sketches.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("registers").alias("y"))
    likely = (
        pairs.join(x, "u")
        .join(y, "v")
        .filter(100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))
        .filter(estimate(F.col("x"), F.col("y"), F.col("n"), F.col("m")) >= PERCENT / 100 - MARGIN)
        .select("u", "v")
        .distinct()
    )
    both = (
        likely.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
        .join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
        .select("u", "v", "text_u", "text_v")
    )
    return in_batches(both, _confirm(shingle), "u long, v long")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM s x JOIN s y USING (g) JOIN n a ON a.doc_id = x.doc_id JOIN n b ON b.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, a.c, b.c HAVING 100 * count(*) >= 80 * (a.c + b.c - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
