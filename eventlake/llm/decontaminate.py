"""Benchmark decontamination by winnowing, on DataFrame functions alone.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Each document keeps the
least hash of its KGRAM-word grams in every sliding window of WINDOW - KGRAM + 1 grams; any WINDOW common words then
share a kept gram. Document fingerprints meet the grams of the benchmark in a semi join; around each hit the document
words are extended to the windows that can hold it, and those are joined with the benchmark's windows word for word.
An item of fewer words is one window of its own length; for such lengths (at most WINDOW - 1 of them, and only those
that the benchmark has) documents offer all their grams of that length by hash, and hits are confirmed word for word.

Null and empty texts have no words; items without words are ignored. Repeated documents are judged alike; rows that
share an id are told apart by their text, and a null id is an id like any other. Empty tables give no rows, or no hits.
Other columns are not read. Positions take POS_BITS bits of a fingerprint; a document of more words than that (16
million) is fingerprinted in blocks, which overlap so that each window lies within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, maybe_broadcast, read, write_table

WINDOW, KGRAM, POS_BITS = 10, 5, 24
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. ASCII texts take lower(), which is
    faster and the same for them."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, _BREAKS), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (tells rows of one id apart), text."""
    return docs.withColumn("th", F.xxhash64("text"))


def _join_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on doc_id, which may be null, and th; the keys of left."""
    right = right.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th"))).drop("hit_id", "hit_th")


def _gram(words: str, at: str, n: int) -> str:
    return f"xxhash64({n}, " + ", ".join(f"get({words}, {at} + {j})" for j in range(n)) + ")"


def windows_of(items: DataFrame) -> DataFrame:
    """win (words joined by a space), n (its words) and item_id: the distinct windows of each item."""
    return (
        items.withColumn("w", item_words(F.coalesce("text", F.lit(""))))
        .filter("size(w) > 0")
        .withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
        .select("item_id", "n", "w", F.explode(F.expr("sequence(0, size(w) - n)")).alias("i"))
        .select("item_id", "n", F.expr("array_join(slice(w, i + 1, n), ' ')").alias("win"))
        .distinct()
    )


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, items (ids as sorted strings) and contaminated of every row.
    items: item_id, text."""
    df = _keyed(doc_text(docs, id_col, text_col))
    windows = write_table(windows_of(items.select("item_id", "text")), "item-windows")
    wins = windows.select("win", "n").distinct()
    short = [r.n for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect()]  # WINDOW - 1 at most
    low = (1 << POS_BITS) - 1
    worded = df.withColumn("w", item_words(F.col("text")))

    # Fingerprints, with the position in the low bits so that ties go to the leftmost gram. Block b has the words from b
    # on, as many as the low bits can number; most documents are one block.
    step = low + 2 - WINDOW
    blocks = worded.select(
        "doc_id",
        "th",
        F.expr(
            f"inline_outer(transform(sequence(0, greatest(size(w) - {WINDOW}, 0), {step}), b -> struct(b, if(size(w) <= {low + 1}, w, slice(w, b + 1, {low + 1})))))"
        ).alias("b", "w"),
    )
    grams = blocks.withColumn(
        "h",
        F.expr(
            f"if(size(w) >= {WINDOW}, transform(sequence(0, size(w) - {KGRAM}), i -> ({_gram('w', 'i', KGRAM)} & ~{low}L) | i), array())"
        ),
    )
    span = WINDOW - KGRAM + 1
    least = "least(" + ", ".join(f"get(h, i + {j})" for j in range(span)) + ")"
    marks = grams.withColumn(
        "marks",
        F.expr(f"if(size(h) >= {span}, array_distinct(transform(sequence(0, size(h) - {span}), i -> {least})), array())"),
    )
    # An outer explode: of an inner one Spark derives a filter on `marks`, pushes it below the projections above and so
    # puts the whole tokenisation into the lambdas, once for each word.
    marks = marks.select("doc_id", "th", "b", F.explode_outer("marks").alias("mark")).filter("mark IS NOT NULL")
    marks = marks.select("doc_id", "th", F.expr(f"mark & ~{low}L").alias("fp"), F.expr(f"b + int(mark & {low}L)").alias("p"))
    known = write_table(
        wins.filter(F.col("n") == WINDOW)
        .withColumn("w", F.split("win", " "))
        .select(F.explode(F.expr(f"sequence(0, {WINDOW - KGRAM})")).alias("i"), "w")
        .select(F.expr(f"{_gram('w', 'i', KGRAM)} & ~{low}L").alias("fp"))
        .distinct(),
        "item-grams",
    )
    starts = marks.join(maybe_broadcast(known), "fp", "left_semi").select(
        "doc_id", "th", F.explode(F.expr(f"sequence(greatest(0, p - {WINDOW - KGRAM}), p)")).alias("p"), F.lit(WINDOW).alias("n")
    )
    for n in short:
        own = write_table(
            wins.filter(F.col("n") == n).withColumn("w", F.split("win", " ")).select(F.expr(_gram("w", "0", n)).alias("fp")), "short-grams"
        )
        every = worded.select(
            "doc_id",
            "th",
            F.posexplode_outer(F.expr(f"if(size(w) >= {n}, transform(sequence(0, size(w) - {n}), i -> {_gram('w', 'i', n)}), array())")).alias("p", "fp"),
        )
        starts = starts.unionByName(
            every.filter("fp IS NOT NULL").join(maybe_broadcast(own), "fp", "left_semi").select("doc_id", "th", "p", F.lit(n).alias("n"))
        )
    starts = write_table(
        starts.groupBy("doc_id", "th").agg(F.collect_set(F.struct("p", "n")).alias("starts")), "window-starts"
    )  # at most WINDOW entries for each word of a document
    at_hit = (
        _join_rows(df, maybe_broadcast(starts))
        .select("doc_id", "th", item_words(F.col("text")).alias("w"), "starts")
        .dropDuplicates(["doc_id", "th"])
        .select("doc_id", "th", "w", F.explode("starts").alias("s"))
        .filter("s.p + s.n <= size(w)")
        .select("doc_id", "th", "s.p", "s.n", F.expr("array_join(slice(w, s.p + 1, s.n), ' ')").alias("win"))
    )
    hits = write_table(at_hit.join(maybe_broadcast(wins), ["win", "n"]), "window-hits")
    covered = hits.groupBy("doc_id", "th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(p, p + n - 1)"))))).cast("long").alias("n_hit")
    )
    named = (
        hits.select("doc_id", "th", "win", "n")
        .distinct()
        .join(windows, ["win", "n"])
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return (
        df.select("doc_id", "th", F.size(F.array_remove(F.split("text", _BREAKS), "")).cast("long").alias("n_words"))
        .join(
            _join_rows(covered, named).withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"}),
            F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")),
            "left",
        )
        .select(
            "doc_id",
            "th",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, in which no window of an item occurs."""
    bad = write_table(find(docs, items, id_col, text_col).filter("contaminated").select("th").distinct(), "contaminated")
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")
    )
    return own.join(maybe_broadcast(bad), "th", "left_anti").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
b AS (SELECT DISTINCT id AS item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, least(len(w), 10) AS n FROM w WHERE k = 'b' AND len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
d AS (SELECT id AS doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM w, (SELECT DISTINCT n FROM b) s WHERE k = 'd')),
h AS (SELECT doc_id, i, d.n, item FROM d JOIN b USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.id LEFT JOIN m ON m.doc_id = w.id WHERE k = 'd'
"""
