"""Suffix-array dedup of byte strings by a common-prefix-aware distributed merge sort.

Every string of LENGTH bytes holds an anchor: the leftmost smallest hash among its GRAM-byte substrings, so equal
strings hold equal anchors at equal places. A sketch first tells which anchors may occur in two documents; only
suffixes that begin at those are sorted. Each run of documents sorts its suffixes (cut to LENGTH bytes, with the bytes
before the anchor behind them as a second key) and sends them front-coded: shared prefix length, then the rest. In
every slice of the anchor space a loser tree merges the runs; players carry the prefix length that they share with
the last winner, and bytes within a known prefix are never compared again. The merged order, with its shared-prefix
lengths, shows for each place of an anchor within a string which documents hold the same string; one bit for each
place goes back to the run.

Equal suffixes of one run travel once, with the smallest document id. An anchor in more than HOT_RUNS runs is replaced
by the strings around it, each placed by its own hash, so that what surrounds a common passage never meets in one
task.

Strings are judged on the input; matches never cross documents. Null text is empty; copies with larger ids go wholly
(from LENGTH bytes on); repeated rows (same id) judge alike and never each other; a null id neither loses bytes nor
takes any. Texts of any length are taken whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BASES, BLOCK, BYTE_CODES, U, column_bytes, mix
from .common import read
from .runs import (
    BLOCKS,
    EXACT,
    RunTexts,
    Sketch,
    block_table,
    deal,
    narrow,
    replies_of,
    run_of,
    sketch_replies,
)

LENGTH, GRAM = 50, 24
PLACES = LENGTH - GRAM + 1
BEFORE = PLACES - 1
#: A sorted row: LENGTH bytes of suffix, BEFORE bytes before it (nearest first), both lengths plus one.
ROW = LENGTH + BEFORE + 2
DEPTH, CELLS_PER_KEY = 1, 16
#: A hot anchor's strings are up to PLACES rows instead of one, so only what very many runs hold is worth it.
HOT_RUNS = 2048
#: Half the usual: the byte masks of a run take several times its size.
RUN_BYTES = 8 << 20
#: One hop for up to 8,192 runs: a task judges up to eight slices, and a run sends up to 1,024 blocks.
TOGETHER, WIDER = 3, 2
_LOW = U((1 << 18) - 1)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position, by doubling."""
    codes, base = BYTE_CODES[0][data], BASES[0]
    out, length, part, width = None, 0, codes, 1
    while True:
        if n & width:
            if out is None:
                out, length = part, width
            else:
                m = len(data) - length - width + 1
                out = out[:m] * U(pow(base, width, 1 << 64)) + part[length : length + m]
                length += width
        if 2 * width > n:
            return mix(out)
        m = len(data) - 2 * width + 1
        part = part[:m] * U(pow(base, width, 1 << 64)) + part[width : width + m]
        width *= 2


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        m = len(values) - width
        values = np.minimum(values[:m], values[width : width + m])
        width *= 2
    m = len(values) - (n - width)
    return np.minimum(values[:m], values[n - width : n - width + m])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all strings that lie within a text, ascending, and their hashes."""
    positions, hashes = [], []
    ends = np.repeat(at[1:].astype(np.int32), np.diff(at))
    for lo in range(0, len(data) - LENGTH + 1, BLOCK):
        hi = min(len(data), lo + BLOCK + LENGTH - 1)
        grams = rolling(data[lo:hi], GRAM)
        # The position in the low bits makes the leftmost of equals the least.
        least = sliding_least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), PLACES)
        least = least[ends[lo : lo + len(least)] - np.arange(lo, lo + len(least), dtype=np.int32) >= LENGTH]
        if len(least):
            pos = (least & _LOW).astype(np.int64)
            pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
            positions.append(pos + lo)
            # Least hashes are small ones; scrambled again they spread evenly over slices and cells.
            hashes.append(mix(grams[pos]))
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, U)
    pos, value = np.concatenate(positions), np.concatenate(hashes)
    new = np.concatenate([[True], pos[1:] > np.maximum.accumulate(pos)[:-1]])
    return pos[new], value[new]


class _Suffixes:
    """Anchors of a run's distinct texts, and the sorted distinct rows of those that may be repeated."""

    def __init__(self, texts: RunTexts) -> None:
        self.texts = texts
        self.pos, self.keys = anchors(texts.data, texts.at)
        self.doc = np.searchsorted(texts.at, self.pos, "right") - 1

    def one_per_text(self) -> np.ndarray:
        order = np.lexsort((self.doc, self.keys))
        k, d = self.keys[order], self.doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        return k[new]

    def gather(self, sketch: Sketch, replies: dict) -> None:
        order = np.argsort(self.keys)
        keys = self.keys[order]
        repeated, hot = np.empty(len(keys), bool), np.empty(len(keys), bool)
        repeated[order] = sketch.known(keys, replies)
        hot[order] = sketch.known(keys, replies, 1)
        common = np.flatnonzero(repeated & ~hot)
        busy = np.flatnonzero(repeated & hot)
        pos, doc = self.pos[common], self.doc[common]
        lo, hi = self.texts.at[doc], self.texts.at[doc + 1]
        rows = [self._rows(pos, np.minimum(LENGTH, hi - pos), np.minimum(BEFORE, pos - lo))]
        homes = [self.keys[common]]
        # Around hot anchors: the strings themselves.
        start = (self.pos[busy][:, None] - np.arange(PLACES)).ravel()
        own = np.repeat(self.doc[busy], PLACES)
        inside = (start >= self.texts.at[own]) & (start + LENGTH <= self.texts.at[own + 1])
        start, own = start[inside], own[inside]
        whole = np.full(len(start), LENGTH)
        rows.append(self._rows(start, whole, np.zeros(len(start), np.int64)))
        folded = np.zeros(len(start), U)
        for j in range(LENGTH):  # a hash of the whole string
            folded = folded * U(BASES[1]) + BYTE_CODES[1][self.texts.data[start + j]]
        homes.append(mix(folded))
        self.start, self.doc = np.concatenate([pos, start]), np.concatenate([doc, own])
        rows, homes = np.concatenate(rows), np.concatenate(homes)
        order = np.argsort(rows.view(f"S{ROW}").ravel(), kind="stable")
        rows, homes = rows[order], homes[order]
        shared = shared_prefixes(rows)
        new = shared < ROW
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.rows, self.homes = rows[new], homes[new]
        self.first = np.full(len(self.rows), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.entry, self.texts.first[self.doc])

    def _rows(self, pos: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(pos), ROW), np.uint8)
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), self.texts.data, np.zeros(LENGTH, np.uint8)])
        for j in range(LENGTH):
            rows[:, j] = np.where(j < after, padded[pos + BEFORE + j], 0)
        for j in range(BEFORE):
            rows[:, LENGTH + j] = np.where(j < before, padded[pos + BEFORE - 1 - j], 0)
        rows[:, -2], rows[:, -1] = after + 1, before + 1
        return rows

    def slices(self, bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """Entries of each slice, in sorted order."""
        where = (self.homes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.homes), np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange((1 << bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            yield int(s), order[cuts[s] : cuts[s + 1]]


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each sorted row shares with the one before (first row: 0)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared prefix lengths and the remaining bytes, column by column."""
    shared = shared_prefixes(rows)
    return shared.astype(np.uint8), rows.T[np.arange(rows.shape[1])[:, None] >= shared[None, :]]


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    n = len(shared)
    rows = np.empty((n, width), np.uint8)
    done = 0
    for j in range(width):
        own = shared <= j
        k = int(own.sum())
        # A row without its own byte here has that of the last row that does.
        rows[:, j] = rest[done : done + k][np.cumsum(own) - 1]
        done += k
    return rows


def merge_runs(runs: list[np.ndarray], shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of sorted runs of byte rows, as indexes into their concatenation, and what each shares with the one
    before. A loser tree: each node keeps the loser of its match and the prefix that it shares with the winner that
    passed; a longer shared prefix wins unseen, and equal ones are compared only beyond it."""
    width = runs[0].shape[1]
    keys = [[whole[i : i + width] for i in range(0, len(whole), width)] for whole in (r.tobytes() for r in runs)]
    gaps = [s.tolist() for s in shared]
    offset = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).tolist()
    n = 1
    while n < len(runs):
        n *= 2
    head = [0] * len(runs)
    done = width + 1  # more than any shared prefix: marks an exhausted player
    order, common = [], []

    def play(a: int, pa_: int, b: int, pb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix."""
        if pa_ < 0 or pb < 0:
            return (b, pb, a, pa_) if pa_ < 0 else (a, pa_, b, pb)
        if pa_ != pb:
            return (a, pa_, b, pb) if pa_ > pb else (b, pb, a, pa_)
        x, y = keys[a][head[a]], keys[b][head[b]]
        if pa_ == width:
            return (a, pa_, b, pb)
        u, v = x[pa_:], y[pa_:]
        if u == v:
            return (a, pa_, b, width)
        same = width - ((int.from_bytes(u) ^ int.from_bytes(v)).bit_length() + 7) // 8
        return (a, pa_, b, same) if u < v else (b, pb, a, same)

    losers: list[tuple[int, int]] = [(0, -1)] * n
    level = [(r, 0) if r < len(runs) and len(keys[r]) else (r, -1) for r in range(n)]
    first = n
    while first > 1:  # play the first matches upwards
        first //= 2
        after = []
        for i in range(0, len(level), 2):
            w, pw, lo, pl = play(*level[i], *level[i + 1])
            losers[first + i // 2] = (lo, pl)
            after.append((w, pw))
        level = after
    winner, prefix = level[0]
    while prefix >= 0:
        at = head[winner]
        order.append(offset[winner] + at)
        common.append(prefix)
        head[winner] = at = at + 1
        player, p = winner, (gaps[winner][at] if at < len(gaps[winner]) else -1)
        node = (n + player) // 2
        while node:
            other, po = losers[node]
            if p == po and p >= 0 or po < 0 or p < 0:
                player, p, lost, pl = play(player, p, other, po)
                losers[node] = (lost, pl)
            elif po > p:
                losers[node] = (player, p)
                player, p = other, po
            node //= 2
        winner, prefix = player, p
    return np.array(order, np.int64), np.array(common, np.int64)


def places_with_smaller(rows: np.ndarray, shared: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For sorted rows: bit o is set if the string from o bytes before the anchor is also in a row with a smaller id."""
    after, before = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    left = np.concatenate([rows[:, LENGTH : LENGTH + BEFORE], np.ones((len(rows), 1), np.uint8)], axis=1)
    by_left = np.argsort(left.view(f"S{BEFORE + 1}").ravel(), kind="stable")
    left_shared = shared_prefixes(left[by_left])
    mask = np.zeros(len(rows), np.uint32)
    for o in range(PLACES):
        right_class = np.cumsum(shared < LENGTH - o)
        left_class = np.empty(len(rows), np.int64)
        left_class[by_left] = np.cumsum(left_shared < o)
        at = np.flatnonzero((after >= LENGTH - o) & (before >= o))
        if not len(at):
            continue
        key = right_class[at] * (len(rows) + 1) + left_class[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = np.minimum.reduceat(first[at], np.flatnonzero(new))[np.cumsum(new) - 1]
        mask[at[least < first[at]]] |= np.uint32(1 << o)
    return mask


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed stretches) and kept (the remaining bytes) of every row."""
    runs = deal(docs, id_col, text_col, RUN_BYTES, TOGETHER, WIDER)
    bits, exchange = runs.slice_bits, runs.exchange
    sketch = Sketch.sized(runs.n_bytes // 12, DEPTH, CELLS_PER_KEY, bits)

    def sketched(table: pa.Table) -> pa.Table:
        run = run_of(table)
        found = _Suffixes(RunTexts.of(table))
        return exchange.sent(run, sketch.part(found.one_per_text()))

    def gathered(docs: pa.Table, replies: pa.Table) -> tuple[_Suffixes, dict]:
        got = replies_of(replies)
        found = _Suffixes(RunTexts.of(docs))
        found.gather(sketch, got[-1])
        return found, got

    def sorted_runs(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return block_table([])
        found, _ = gathered(docs, replies)
        return exchange.sent(
            run_of(docs),
            [
                (EXACT, s, [*front_code(found.rows[own]), narrow(found.first[own].view(np.uint64))])
                for s, own in found.slices(bits)
            ],
        )

    def merged(kind: int, part: int, got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        rows = [front_decode(g[0], g[1], ROW) for g in got]
        order, shared = merge_runs(rows, [g[0] for g in got])
        first = np.concatenate([g[2].astype(np.uint64).view(np.int64) for g in got])
        mask = np.empty(len(first), np.uint32)
        mask[order] = places_with_smaller(np.concatenate(rows)[order], shared, first[order])
        ends = np.cumsum([len(r) for r in rows])
        return [[mask[e - len(r) : e]] for r, e in zip(rows, ends)]

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    )

    def removed(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        found, got = gathered(docs, replies)
        t = found.texts
        mask = np.zeros(len(found.rows), np.uint32)
        for s, own in found.slices(bits):
            mask[own] = got[EXACT][s][0]
        hits = mask[found.entry]
        hits = np.where(t.first[found.doc] > found.first[found.entry], np.uint32((1 << PLACES) - 1), hits)
        edge = np.zeros(len(t.data) + 1, np.int32)
        after, before = found.rows[found.entry, -2].astype(np.int64) - 1, found.rows[found.entry, -1].astype(np.int64) - 1
        for o in range(PLACES):
            ok = (hits >> np.uint32(o) & np.uint32(1)).astype(bool) & (after >= LENGTH - o) & (before >= o)
            start = found.start[ok] - o
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
        gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
        del edge
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = t.at[:-1][np.diff(t.at) > 0]
        begins[starts] = gone[starts]
        # Sums up to each text's begin.
        n_gone, n_begins = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)])[t.at] for x in (gone, begins))
        whole = t.data.tobytes()
        raw, raw_at = column_bytes(docs.column("text"))
        rows = []
        for i, doc in enumerate(t.ids):
            k = int(t.text_of[i])
            if k < 0:  # no id
                own = raw[raw_at[i] : raw_at[i + 1]].tobytes()
                rows.append((doc, len(own), 0, 0, own))
                continue
            a, b = int(t.at[k]), int(t.at[k + 1])
            if doc > t.first[k] and b - a >= LENGTH:  # a copy of a text with a smaller id
                rows.append((doc, b - a, b - a, 1, b""))
            else:
                n = int(n_gone[k + 1] - n_gone[k])
                kept = t.data[a:b][~gone[a:b]].tobytes() if n else whole[a:b]
                rows.append((doc, b - a, n, int(n_begins[k + 1] - n_begins[k]), kept))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def by_run(df: DataFrame):
        return df.groupBy("run")

    estimates = sketch_replies(by_run(runs.docs).applyInArrow(sketched, BLOCKS), exchange, sketch, HOT_RUNS)
    exact = by_run(runs.docs).cogroup(by_run(estimates)).applyInArrow(sorted_runs, BLOCKS)
    verdicts = exchange.answers(exact, merged)
    return (
        by_run(runs.docs)
        .cogroup(by_run(estimates.unionByName(verdicts)))
        .applyInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
