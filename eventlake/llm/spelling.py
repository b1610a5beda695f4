"""Spelling variants by a dictionary of trie-node pairs.

The nodes of the trie of all words, and of the trie of all reversed words, are numbered; a word is then a path of numbers
either way. Leaving out position i gives the pair (node of the prefix before i, node of the suffix after i), and a cut
at i the pair (node before, node behind). Two words differ by a replaced letter if they share a left-out pair, and by an
inserted one if a left-out pair of the longer is a cut of the shorter; so one grouping of integer pairs finds all near
words exactly. In a run of equal letters only the run's first position counts as left out for insertions, so that each
pair of near words meets in one group only.

Numbers: words are range-partitioned and sorted, and each task numbers the nodes that its words add to the path of the
word before. What a task's first word shares with the last word of the task before is renamed afterwards; for that the
driver sees the first and last word of each task, nothing else. A group holds at most one word for each letter of the
alphabet, and one cut word, however many words there are.

Words are made of the letters A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Null text has none; a null id
counts as an empty one; repeated rows count again; very long runs are words like others (numbers instead of strings are
exchanged for each position). Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, read, write_table

LETTERS = "A-Za-zÀ-ÿ"
#: A form has so many times the occurrences of its variant; chains of forms double in reach each round.
TIMES, ROUNDS = 10, 5
#: Bits of a node's number within its task.
LOCAL = 40
SPLIT, SKIP, SKIP_RUN = 0, 1, 2


def counted_words(docs: DataFrame, least_length: int, least_n: int, drop_every: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n. A run whose crc32 with its document's id is divisible by drop_every loses one letter first (see op12)."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", h.alias("h"), F.length("run").alias("m"))
    cut = F.expr("concat(substring(run, 1, int(h % m)), substring(run, int(h % m) + 2))")
    word = F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def number_nodes(words: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """rank (in order of key), key, keep and nodes: the numbers of the trie nodes on the path of key, from the root."""
    spark = words.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in [key, *keep])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        base = task << LOCAL
        before, path, unused, rank = None, [base], base + 1, base
        for batch in batches:
            flat, ends = [], [0]
            for word in batch.column(key).to_pylist():
                shared, most = 0, 0 if before is None else min(len(word), len(before))
                while shared < most and word[shared] == before[shared]:
                    shared += 1
                new = len(word) - shared
                path = path[: shared + 1] + list(range(unused, unused + new))
                unused, before = unused + new, word
                flat += path
                ends.append(len(flat))
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            k = batch.num_rows
            columns = [pa.array(np.full(k, task, np.int32)), pa.array(np.arange(rank, rank + k)), batch.column(key), *(batch.column(c) for c in keep), nodes]
            rank += k
            yield pa.RecordBatch.from_arrays(columns, names=["part", "rank", key, *keep, "nodes"])

    ranged = words.select(key, *keep).repartitionByRange(n, key).sortWithinPartitions(key)
    local = write_table(in_batches(ranged, numbered, f"part int, rank long, {kinds}, nodes array<long>"), "trie")
    ends = local.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("nodes"))
    known = F.broadcast(spark.createDataFrame(_renamed(ends.orderBy("part").collect()), "part int, known array<long>"))  # a row for each task
    place = lambda x: x - F.shiftleft(F.col("part").cast("long"), LOCAL)
    nodes = F.transform("nodes", lambda x: F.when(place(x) < F.size("known"), F.get("known", place(x).cast("int"))).otherwise(x))
    return local.join(known, "part").select("rank", key, *keep, nodes.alias("nodes"))


def _renamed(ends: list) -> list[tuple[int, list[int]]]:
    """For each task the numbers, in the tasks before, of the nodes that its first word shares with the word before. The
    first word's path has the task's numbers 0, 1, 2, ..., so these are places in the list."""
    out, before, path = [], None, []
    for e in ends:
        known, base = [], e.part << LOCAL
        if before is not None:
            known = [path[0]]
            for i, (a, b) in enumerate(zip(before, e.first)):
                if a != b:
                    break
                known.append(path[i + 1])
        out.append((e.part, known))
        before, path = e.last, [known[x - base] if x - base < len(known) else x for x in e.nodes]
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix node, suffix node, kind, rank and n of every position of every word."""
    for batch in batches:
        ahead, behind = batch.column("nodes"), batch.column("behind")
        size = np.diff(ahead.offsets.to_numpy())
        f, r = ahead.flatten().to_numpy(), behind.flatten().to_numpy()
        total, start = len(f), np.repeat(np.cumsum(size) - size, size)
        at = np.arange(total) - start  # place in its word, 0 to length
        length = np.repeat(size - 1, size)
        split = r[start + length - at]
        inner = at < length
        skip = r[(start + length - 1 - at)[inner]]
        chars = np.frombuffer("".join(f"{w}\0" for w in batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
        begins = (at == 0) | (chars != np.concatenate([[0], chars[:-1]]))
        word = np.repeat(np.arange(len(size)), size)
        rank, n = batch.column("rank").to_numpy(), batch.column("n").to_numpy()
        rows = [
            (f, split, np.zeros(total, np.int8), word),
            (f[inner], skip, np.where(begins[inner], SKIP_RUN, SKIP).astype(np.int8), word[inner]),
        ]
        p, s, kind, word = (np.concatenate(c) for c in zip(*rows))
        for a in range(0, len(p), 1 << 17):
            b = slice(a, a + (1 << 17))
            columns = [p[b], s[b], kind[b], rank[word[b]], n[word[b]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "s", "kind", "rank", "n"])


def _best_two(group: np.ndarray, member: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by group and preference: each group's number of members, its first and its second (or -1)."""
    rows = np.flatnonzero(member)
    g = group[rows]
    count = np.bincount(g, minlength=groups)
    begin = np.cumsum(count) - count
    at = np.append(rows, -1)
    return count, np.where(count > 0, at[np.minimum(begin, len(rows))], -1), np.where(count > 1, at[np.minimum(begin + 1, len(rows))], -1)


def _near(p: np.ndarray, s: np.ndarray, kind: np.ndarray, rank: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """rank, near words, best near word's n and rank, for whole groups sorted by n downwards and rank."""
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    skips, best, second = _best_two(group, kind != SPLIT, groups)
    runs, best_run, _ = _best_two(group, kind == SKIP_RUN, groups)
    cuts, cut, _ = _best_two(group, kind == SPLIT, groups)
    rows = np.arange(len(p))
    found = []
    other = np.where(best[group] == rows, second[group], best[group])  # replaced letters
    take = (kind != SPLIT) & (skips[group] > 1)
    found.append((rank[take], skips[group][take] - 1, other[take]))
    take = (kind == SKIP_RUN) & (cuts[group] > 0)  # the shorter word
    found.append((rank[take], np.ones(int(take.sum()), np.int64), cut[group][take]))
    take = (kind == SPLIT) & (runs[group] > 0)  # the longer words
    found.append((rank[take], runs[group][take], best_run[group][take]))
    who, count, near = (np.concatenate(c) for c in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(count.astype(np.int64)), pa.array(n[near]), pa.array(rank[near])], names=["rank", "n_near", "near_n", "near"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to near words; the last group of a batch waits for the next."""
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.int64, np.int64)]
    for batch in batches:
        c = [np.concatenate([h, x.to_numpy()]) for h, x in zip(held, batch.columns)]
        end = len(c[0])
        while end and c[0][end - 1] == c[0][-1] and c[1][end - 1] == c[1][-1]:  # a group has few rows
            end -= 1
        held = [x[end:] for x in c]
        if end:
            yield _near(*(x[:end] for x in c))
    if len(held[0]):
        yield _near(*held)


def near_words(words: DataFrame) -> DataFrame:
    """rank, word, n, n_near, near_n and near of every word: how many words differ by one letter, and n and rank (in
    code-point order) of the one with the largest n, of equals the first. words: word, n, each word once."""
    ahead = write_table(number_nodes(words, "word", ["n"]), "ahead")
    turned = ahead.select(F.reverse("word").alias("drow"), F.col("rank").alias("id"))
    behind = number_nodes(turned, "drow", ["id"]).select(F.col("id").alias("rank"), F.col("nodes").alias("behind"))
    pairs = in_batches(ahead.join(behind, "rank").select("rank", "n", "word", "nodes", "behind"), _pairs, "p long, s long, kind byte, rank long, n long")
    dealt = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "rank")
    found = in_batches(dealt, _joined, "rank long, n_near long, near_n long, near long")
    near = found.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("far"))).alias("b"))
    out = ahead.select("rank", "word", "n").join(near, "rank", "left")
    return out.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.near_n").alias("near_n"), (-F.col("b.far")).alias("near"))


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: form is the near word of largest n if that is at least times n, root the
    last word reached through forms. Occurrences grow by times with each step, so chains end."""
    near = near_words(words)
    known = write_table(near.withColumn("form", F.when(F.col("near_n") >= F.col("n") * times, F.col("near"))), "near")
    chains = write_table(known.filter("form IS NOT NULL").select("rank", F.col("form").alias("up")), "chains")
    for _ in range(ROUNDS):
        further = chains.select(F.col("rank").alias("up"), F.col("up").alias("next"))
        stepped = write_table(chains.join(further, "up", "left").select("rank", "up", "next"), "chains")
        if stepped.filter("next IS NOT NULL").isEmpty():
            break
        chains = stepped.select("rank", F.coalesce("next", "up").alias("up"))
    name = lambda key, value: known.select(F.col("rank").alias(key), F.col("word").alias(value))
    out = known.join(name("form", "form_word"), "form", "left").join(chains, "rank", "left").join(name("up", "root"), "up", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("near_n"))
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", form_n.alias("form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(counted_words(read(spark, sf_dir, "documents"), least_length=7, least_n=2, drop_every=31))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM g, t),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM w, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.cut = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.cut = w.word),
b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN (SELECT min(other) FROM p WHERE p.word = w.word AND p.n = top) END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL
"""
