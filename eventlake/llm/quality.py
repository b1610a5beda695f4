"""Quality rules: base features, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Each document is tokenised once: its base features and the hash buckets of its n-grams (single words and 3-word
windows, whose hashes the repetition rule needs anyway) go to a table in the shared folder. Raw counts then cover the
whole corpus; trusted counts cover the labelled good documents. A document's score is the mean over its n-grams of
log p(trusted) - log p(raw), with add-one smoothing. One threshold holds for every document: the cut with
fewest errors on the labelled documents that pass the base rule.

Null and empty texts have no words and fail the base rule. Repeated rows score alike. With no trusted rows all scores
are 0; as without bad labels, the threshold then is minus infinity: the base rule alone decides. Other columns are not
read.

All labels count. They travel as two bit masks for each 64 neighbouring ids, broadcast up to LABEL_BYTES and shuffled
beyond, and are joined before the features are made, so that features never move. The threshold is found in slices of
the sorted scores, of which the driver sees one row each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, double_array, maybe_broadcast, read, words, write_table

LEAST_BUCKETS = 1 << 12
#: Bytes of label masks that may be broadcast: some 100 million labels of neighbouring ids.
LABEL_BYTES = 64 << 20
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """Hash buckets for the n-grams of docs: a power of two near the square root of the text's bytes, so that the counts
    grow with the corpus as its vocabulary does."""
    held = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0)).alias("b")).first().b
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, held)) / 2))


def features(docs: DataFrame, buckets: int, *carried: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and grams: hash buckets;
    carried columns come along."""
    df = (
        docs.withColumn("w", words(F.col("text")))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))))
        .withColumn("h", F.transform("w", lambda t: F.xxhash64(t)))
        .withColumn("n", F.size("w"))
        .withColumn(
            "tri",
            F.expr("if(n >= 3, transform(sequence(0, n - 3), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2))), array())"),
        )
        .withColumn("low", F.expr("shiftleft(1L, int(length(bin(n)))) - 1"))
        # Only where some window hash comes twice: hash and position in one long, so that equal windows are
        # neighbours after a plain sort; neighbours are then compared word by word.
        .withColumn("twice", F.size(F.array_distinct("tri")) < F.size("tri"))
        .withColumn("packed", F.expr("if(twice, sort_array(transform(tri, (x, i) -> (x & ~low) | i)), array())"))
    )
    # A get() beyond either end is null, and so counts as different.
    same = "((p ^ get(packed, {b})) & ~low) = 0" + "".join(
        f" AND get(w, int(p & low) + {j}) = get(w, int(get(packed, {{b}}) & low) + {j})" for j in range(3)
    )
    starts = (
        f"if(twice, sort_array(filter(transform(packed, (p, k) -> if(({same.format(b='k - 1')})"
        f" OR ({same.format(b='k + 1')}), int(p & low), -1)), p -> p >= 0)), array())"
    )
    return (
        df.withColumn("starts", F.expr(starts))
        .select(
            *carried,
            "doc_id",
            F.col("n").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr(
                "aggregate(transform(starts, (p, k) -> if(k + 1 < size(starts), least(3, starts[k + 1] - p), 3)), 0L, (a, b) -> a + b)"
            ).alias("n_repeat_words"),
            F.transform(F.concat("h", "tri"), lambda x: F.pmod(x, F.lit(buckets)).cast("int")).alias("grams"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


@dataclass
class QualityModel:
    weights: list[float]
    threshold: float = -math.inf

    def scored(self, table: DataFrame) -> DataFrame:
        """table with score: the mean log-likelihood ratio of its grams; 0 for none."""
        w = double_array(self.weights)
        total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(w, b))
        return table.withColumn("score", total / F.greatest(F.size("grams"), F.lit(1)))


def label_masks(labels: DataFrame) -> DataFrame:
    """key, labelled, bad: for the ids from 64 * key on a bit each. labels: doc_id, good; an id with a bad label is bad."""
    bit = F.expr("shiftleft(1L, int(doc_id & 63))")
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "good")
        .filter("good IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.expr("shiftright(doc_id, 6)").alias("key"))
        .agg(F.bit_or(bit).alias("labelled"), F.bit_or(F.when(F.col("good"), 0).otherwise(bit)).alias("bad"))
    )


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id and more) with good: null where there is no label."""
    masks = maybe_broadcast(write_table(label_masks(labels), "quality-labels"), LABEL_BYTES)
    has = lambda c: F.expr(f"getbit({c}, int(doc_id & 63)) = 1")
    found = docs.withColumn("key", F.expr("shiftright(doc_id, 6)")).join(masks, "key", "left")
    return found.withColumn("good", F.when(has("labelled"), ~has("bad"))).drop("key", "labelled", "bad")


@dataclass
class Slice:
    """Labelled documents with neighbouring scores: the ends, how many are good and bad, and the best cut inside as
    (errors more than below the slice, gap below zero, cut)."""

    low: float
    high: float
    good: int
    bad: int
    inner: tuple[int, float, float] | None = None


def best_cut_of(slices: list[Slice]) -> float:
    """best_cut() of slices in order."""
    errors = sum(s.bad for s in slices)
    if errors in (0, errors + sum(s.good for s in slices)):
        return -math.inf
    best = (errors, 0.0, -math.inf)
    for i, s in enumerate(slices):
        if s.inner:
            best = min(best, (errors + s.inner[0], *s.inner[1:]))
        errors += s.good - s.bad
        if i + 1 < len(slices) and slices[i + 1].low > s.high:
            after = slices[i + 1].low
            best = min(best, (errors, s.high - after, (s.high + after) / 2))
    return best[2]


def best_cut(scored: list[tuple[float, bool]]) -> float:
    """The cut with fewest labelled errors; among equals the one in the middle of the widest gap. One class: no cut."""
    return best_cut_of([Slice(s, s, int(good), int(not good)) for s, good in sorted(scored)])


def threshold(scored: DataFrame) -> float:
    """best_cut() of all rows of scored (score, good), whatever their number."""
    counts = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    sliced = write_table(counts, "quality-scores").repartitionByRange("score").withColumn("slice", F.spark_partition_id())
    upto = Window.partitionBy("slice").orderBy("score")
    cuts = sliced.withColumn("more", F.sum(F.col("good") - F.col("bad")).over(upto)).withColumn("after", F.lead("score").over(upto))
    inner = F.struct("more", (F.col("score") - F.col("after")).alias("gap"), ((F.col("score") + F.col("after")) / 2).alias("cut"))
    rows = cuts.groupBy("slice").agg(
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.sum("good").alias("good"),
        F.sum("bad").alias("bad"),
        F.min(F.when(F.col("after").isNotNull(), inner)).alias("inner"),
    )
    slices = [Slice(r.low, r.high, r.good, r.bad, tuple(r.inner) if r.inner else None) for r in rows.collect()]
    return best_cut_of(sorted(slices, key=lambda s: s.low))  # one for each partition


def fit(table: DataFrame, buckets: int) -> QualityModel:
    """Count the corpus, then set the threshold from the labelled documents. table: features() with good."""
    grams = table.select(F.coalesce(F.col("good"), F.lit(False)).alias("good"), F.explode("grams").alias("bucket"))
    counts = [(0, 0)] * buckets
    for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).collect():
        counts[r.bucket] = (r.raw, r.target)  # at most that many rows
    raw, target = (sum(c[k] for c in counts) + buckets for k in (0, 1))
    if target == buckets:
        return QualityModel([0.0] * buckets)
    model = QualityModel([math.log((t + 1) / target) - math.log((r + 1) / raw) for r, t in counts])
    model.threshold = threshold(model.scored(table.filter("NOT base_failed AND good IS NOT NULL")).select("score", "good"))
    return model


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base features, base_failed, score and kept of every row. labels: doc_id, good (boolean)."""
    buckets = bucket_count(docs, text_col)
    rows = with_labels(doc_text(docs, id_col, text_col), labels)
    table = write_table(features(rows, buckets, "good"), "quality-features")
    model = fit(table, buckets)
    return model.scored(table).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "score",
        (~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, that the rules keep. Rows travel with their features, so nothing more is joined."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    buckets = bucket_count(docs, text_col)
    table = write_table(features(with_labels(rows, labels), buckets, "row", "good"), "quality-rows")
    model = fit(table, buckets)
    return model.scored(table).filter(~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))).select("row.*")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are those of quality 1 that are not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return read(spark, sf_dir, "labels").select("doc_id", good.alias("good"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))
