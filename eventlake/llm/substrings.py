"""Substring dedup of word windows with a count-min prefilter.

First pass: every run of documents sketches the hashes of its 13-word windows; the merged sketch overestimates in how
many texts a window occurs, so a window estimated once is surely unique. Second pass: only windows estimated repeated
are grouped exactly, by a 128-bit fingerprint of their words; each group's smallest document id goes back to the
runs, which then mark covered words. No window is lost, and no group holds more than one entry per run.

Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window over it also starts in a document with a smaller id. Null
text has no words; copies with larger ids go wholly (if they have a window at all); repeated rows (same id) judge
alike and never each other; a null id neither loses words nor takes any. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, column_bytes, cover, window_hashes, window_starts, word_bounds, word_hashes
from .common import read
from .runs import (
    BLOCKS,
    EXACT,
    RUN_BYTES,
    RunTexts,
    Sketch,
    block_table,
    deal,
    replies_of,
    run_of,
    sketch_replies,
)

WINDOW, DEPTH, CELLS_PER_KEY = 13, 2, 4


class _Windows:
    """Windows of a run's distinct texts, in order of their hash, and those that may be repeated."""

    def __init__(self, texts: RunTexts, n: int) -> None:
        self.texts = texts
        self.begin, self.end, self.before = word_bounds(texts.data, texts.at)
        self.words = word_hashes(texts.data, self.begin, self.end)
        starts, doc = window_starts(self.before, n)
        keys = window_hashes(self.words, starts, n)
        order = np.argsort(keys, kind="stable")  # texts stay in order within equal keys
        self.keys, self.starts, self.doc = keys[order], starts[order], doc[order]
        self.n = n

    def one_per_text(self) -> np.ndarray:
        keep = np.ones(len(self.keys), bool)
        keep[1:] = (self.keys[1:] != self.keys[:-1]) | (self.doc[1:] != self.doc[:-1])
        return self.keys[keep]

    def narrow_to(self, repeated: np.ndarray) -> None:
        """Keep the windows estimated repeated, and group them exactly."""
        self.keys, self.starts, self.doc = self.keys[repeated], self.starts[repeated], self.doc[repeated]
        by_start = np.argsort(self.starts)
        other = np.empty(len(self.keys), U)
        second = word_hashes(self.texts.data, self.begin, self.end, 1) if len(other) else self.words
        other[by_start] = window_hashes(second, self.starts[by_start], self.n, 1)
        order = np.lexsort((other, self.keys))
        self.keys, self.starts, self.doc, other = (x[order] for x in (self.keys, self.starts, self.doc, other))
        new = np.ones(len(other), bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (other[1:] != other[:-1])
        self.group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.entry_keys, self.entry_other = self.keys[at], other[at]
        owner = self.texts.first[self.doc]
        self.entry_first = np.minimum.reduceat(owner, at) if len(at) else owner


def _cuts(keys: np.ndarray, slice_bits: int) -> np.ndarray:
    tops = np.arange(1, 1 << slice_bits, dtype=np.uint64) << U(64 - slice_bits) if slice_bits else np.zeros(0, U)
    return np.concatenate([[0], np.searchsorted(keys, tops), [len(keys)]])


def remove_repeats(docs: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by one space, UTF-8) of every row."""
    runs = deal(docs, id_col, text_col, RUN_BYTES)
    bits, exchange = runs.slice_bits, runs.exchange
    sketch = Sketch.sized(runs.n_bytes // 6, DEPTH, CELLS_PER_KEY, bits)

    def sketched(table: pa.Table) -> pa.Table:
        run = run_of(table)
        windows = _Windows(RunTexts.of(table), n)
        return exchange.sent(run, sketch.part(windows.one_per_text()))

    def narrowed(docs: pa.Table, replies: pa.Table) -> tuple[_Windows, dict]:
        got = replies_of(replies)
        windows = _Windows(RunTexts.of(docs), n)
        windows.narrow_to(sketch.known(windows.keys, got[-1]))
        return windows, got

    def entries(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return block_table([])
        windows, _ = narrowed(docs, replies)
        cuts = _cuts(windows.entry_keys, bits)
        return exchange.sent(
            run_of(docs),
            [
                (EXACT, s, [x[a:b] for x in (windows.entry_keys, windows.entry_other, windows.entry_first)])
                for s, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if b > a
            ],
        )

    def grouped(kind: int, part: int, got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """A bit for each entry: some run has the window in a document with a smaller id."""
        keys, other, first = (np.concatenate([g[i] for g in got]) for i in range(3))
        first = first.view(np.int64)
        order = np.lexsort((other, keys))
        k, o, f = keys[order], other[order], first[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        least = np.minimum.reduceat(f, np.flatnonzero(new))[np.cumsum(new) - 1]
        smaller = np.empty(len(k), bool)
        smaller[order] = least < f
        ends = np.cumsum([len(g[0]) for g in got])
        return [[np.packbits(smaller[e - len(g[0]) : e])] for g, e in zip(got, ends)]

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]
    )

    def removed(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        w, got = narrowed(docs, replies)
        smaller = np.zeros(len(w.entry_keys), bool)
        cuts = _cuts(w.entry_keys, bits)
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                smaller[a:b] = np.unpackbits(got[EXACT][s][0], count=int(b - a))
        t = w.texts
        hit = smaller[w.group] | (t.first[w.doc] > w.entry_first[w.group])
        gone = cover(w.starts[hit], n, len(w.words))
        made: dict = {}
        whole = t.data.tobytes()
        rows = []
        raw, raw_at = column_bytes(docs.column("text"))
        for i, doc in enumerate(t.ids):
            k = int(t.text_of[i])
            if k < 0:  # no id
                found = raw[raw_at[i] : raw_at[i + 1]].tobytes().split()
                kept = b" ".join(found)
                rows.append((doc, len(found), 0, kept))
                continue
            key = (k, doc > t.first[k])
            if key not in made:
                a, b = w.before[k], w.before[k + 1]
                left = np.flatnonzero(~gone[a:b]) + a
                if key[1] and b - a >= n:  # a copy of a text with a smaller id
                    left = left[:0]
                kept = b" ".join([whole[x:y] for x, y in zip(w.begin[left].tolist(), w.end[left].tolist())])
                made[key] = (int(b - a), int(b - a - len(left)), kept)
            rows.append((doc, *made[key]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def by_run(df: DataFrame):
        return df.groupBy("run")

    parts = by_run(runs.docs).applyInArrow(sketched, BLOCKS)
    estimates = sketch_replies(parts, exchange, sketch)
    exact = by_run(runs.docs).cogroup(by_run(estimates)).applyInArrow(entries, BLOCKS)
    verdicts = exchange.answers(exact, grouped)
    return (
        by_run(runs.docs)
        .cogroup(by_run(estimates.unionByName(verdicts)))
        .applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept binary")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
