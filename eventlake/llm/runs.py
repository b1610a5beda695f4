"""Runs: documents dealt to groups of about RUN_BYTES, and a count-min sketch over what the runs contain.

A run is the unit in which the two substring operators work: its texts fit a task's memory, copies of a text share a
run, and a text with so many copies that they would outgrow one is salted over several. Runs exchange sorted cells
and sorted keys in compressed blocks by slice of the key space, and get back one bit (or mask) per key in that order.
Blocks travel in hops, each of which tells 2**HOP_BITS slices and as many runs apart, so that a run sends and receives
that many blocks at most however large the corpus. A hop writes all blocks to disk once more; an operator may have one
task judge several slices, one after the other, and take more blocks where that saves a hop.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, column_bytes, mix
from .common import doc_text, maybe_broadcast, write_table

RUN_BYTES = 16 << 20
#: Bits of the slice number, and of the run number, that one hop of an exchange settles.
HOP_BITS = 8


@dataclass
class Runs:
    docs: DataFrame  # run, doc_id, text; partitioned by run
    n_runs: int
    n_bytes: int
    together: int = 0  # at most so many bits of the slice number are left to the task that judges
    wider: int = 0  # a single hop may settle so many bits more

    @property
    def slice_bits(self) -> int:
        return max(0, math.ceil(math.log2(self.n_runs)))

    @property
    def exchange(self) -> "Exchange":
        bits = self.slice_bits
        heads = bits - min(self.together, max(0, bits - HOP_BITS))
        hops = () if heads <= HOP_BITS + self.wider else range(HOP_BITS, heads, HOP_BITS)
        return Exchange((0, *hops, heads), bits)


def deal(docs: DataFrame, id_col: str, text_col: str, run_bytes: int = RUN_BYTES, together: int = 0, wider: int = 0) -> Runs:
    df = doc_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    sizes = write_table(
        df.groupBy("th").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "text-sizes"
    )
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    n = max(8, math.ceil(total / run_bytes))
    hot = sizes.filter(F.col("bytes") > run_bytes // 2).select(
        "th", F.ceil(F.col("bytes") / (run_bytes // 2)).cast("int").alias("salts")
    )
    dealt = df.join(maybe_broadcast(hot), "th", "left").select(
        F.pmod(
            F.xxhash64("th", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))), F.lit(n)
        ).cast("int").alias("run"),
        "doc_id",
        "text",
    )
    return Runs(dealt.repartition(n, "run"), n, total, together, wider)


@dataclass
class RunTexts:
    """Distinct texts of a run and their smallest ids; each row's text. Null ids take part in nothing: they come with
    owner -1 and no text of theirs counts."""

    ids: list
    text_of: np.ndarray
    data: np.ndarray
    at: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> "RunTexts":
        data, at = column_bytes(table.column("text"))
        whole = data.tobytes()
        ids = table.column("doc_id").to_pylist()
        number: dict[bytes, int] = {}
        first: list[int] = []
        text_of = np.full(len(ids), -1)
        for i, doc in enumerate(ids):
            if doc is None:
                continue
            k = text_of[i] = number.setdefault(whole[at[i] : at[i + 1]], len(number))
            if k == len(first):
                first.append(doc)
            elif doc < first[k]:
                first[k] = doc
        texts = list(number)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        return cls(ids, text_of, np.frombuffer(b"".join(texts), np.uint8), starts, np.array(first, np.int64))


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed block, byte plane by byte plane."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.array([len(a), a.dtype.itemsize], np.int64).tobytes())
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "big") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    whole = pa.decompress(block[8:], int.from_bytes(block[:8], "big"), codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(whole, np.int64, 1)[0]), 8, []
    for _ in range(n):
        length, width = (int(x) for x in np.frombuffer(whole, np.int64, 2, at))
        planes = np.frombuffer(whole, np.uint8, length * width, at + 16).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").ravel())
        at += 16 + length * width
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned values in the fewest bytes."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def twice_at_most(values: np.ndarray) -> np.ndarray:
    """Sorted values with at most two of each."""
    keep = np.ones(len(values), bool)
    keep[2:] = values[2:] != values[:-2]
    return values[keep]


def distinct(values: np.ndarray) -> np.ndarray:
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


@dataclass(frozen=True)
class Sketch:
    """A count-min sketch of `depth` rows with 2**bits cells; counts stop at two. Kept sparse: a run's part is its
    sorted cells, a cell seen by two of its texts twice."""

    depth: int
    bits: int
    slice_bits: int

    @classmethod
    def sized(cls, keys: int, depth: int, factor: float, slice_bits: int) -> "Sketch":
        """Cells for so many keys, factor cells a key."""
        return cls(depth, max(slice_bits + 8, math.ceil(math.log2(max(1, keys * factor)))), slice_bits)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """Row 0 keeps the order of the keys."""
        return (keys if row == 0 else mix(keys + U(row))) >> U(64 - self.bits)

    def cuts(self, cells: np.ndarray) -> np.ndarray:
        """Where each slice begins among sorted cells."""
        return np.searchsorted(cells, np.arange((1 << self.slice_bits) + 1, dtype=np.uint64) << U(self.bits - self.slice_bits))

    def part(self, keys: np.ndarray) -> list[tuple[int, int, list[np.ndarray]]]:
        """(row, slice, arrays) of a run; keys: sorted, one for each text that has it."""
        out = []
        for row in range(self.depth):
            cells = self.cells(twice_at_most(keys), row)
            cells = twice_at_most(cells if row == 0 else np.sort(cells))
            cuts = self.cuts(cells)
            for s in np.flatnonzero(np.diff(cuts)):
                own = cells[cuts[s] : cuts[s + 1]]
                out.append((row, int(s), [narrow(np.diff(own, prepend=U(int(s) << (self.bits - self.slice_bits))))]))
        return out

    def merged(self, part: int, got: list[list[np.ndarray]], hot: int) -> list[list[np.ndarray]]:
        """For each run's cells: a bit for each of its distinct cells, set if the merged count is two; then a bit set
        if more than `hot` runs have the cell."""
        base = U(part << (self.bits - self.slice_bits))
        runs = [np.cumsum(g[0].astype(np.uint64)) + base for g in got]
        every = np.sort(np.concatenate(runs))
        repeated = distinct(every[1:][every[1:] == every[:-1]])
        owns = [distinct(r) for r in runs]
        every = np.sort(np.concatenate(owns))
        many = distinct(every[hot:][every[hot:] == every[: len(every) - hot]]) if len(every) > hot else every[:0]
        return [[np.packbits(among(own, x)) for x in (repeated, many)] for own in owns]

    def known(self, keys: np.ndarray, replies: dict[tuple[int, int], list[np.ndarray]], which: int = 0) -> np.ndarray:
        """Which of the sorted keys (one for each text that has it) all rows estimate as repeated; which 1: as hot."""
        found = np.ones(len(keys), bool)
        for row in range(self.depth):
            mine = self.cells(keys, row)
            order = distinct(mine if row == 0 else np.sort(mine))
            cuts = self.cuts(order)
            flags = np.zeros(len(order), bool)
            for s in np.flatnonzero(np.diff(cuts)):
                n = int(cuts[s + 1] - cuts[s])
                flags[cuts[s] : cuts[s + 1]] = np.unpackbits(replies[row, int(s)][which], count=n)
            if row == 0:
                change = np.ones(len(mine), bool)
                change[1:] = mine[1:] != mine[:-1]
                found &= flags[np.cumsum(change) - 1]
            else:
                left = np.flatnonzero(found)
                found[left] = flags[np.searchsorted(order, mine[left])]
        return found


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of sorted values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


BLOCKS = "kind int, part int, run int, block binary"
BLOCK_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("run", pa.int32()), ("block", pa.binary())])


def block_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)


def run_of(table: pa.Table) -> int:
    return table.column("run")[0].as_py()


@dataclass
class Crate:
    """What some runs have for some slices: for each pair of them (a cell) the lengths of its arrays, which lie one
    cell after the other in data."""

    run: np.ndarray
    part: np.ndarray
    sizes: list[np.ndarray]
    data: list[np.ndarray]

    @classmethod
    def of(cls, cells: list[tuple[int, int, list[np.ndarray]]]) -> "Crate":
        run, part, arrays = zip(*cells)
        return cls(
            np.array(run, np.int64),
            np.array(part, np.int64),
            [np.array([len(a) for a in own], np.int64) for own in zip(*arrays)],
            [np.concatenate(own) for own in zip(*arrays)],
        )

    @classmethod
    def unpacked(cls, block: bytes) -> "Crate":
        run, part, *rest = unpack(block)
        k = len(rest) // 2
        return cls(run.astype(np.int64), part.astype(np.int64), [x.astype(np.int64) for x in rest[:k]], rest[k:])

    def packed(self) -> bytes:
        heads = [narrow(x.astype(np.uint64)) for x in (self.run, self.part, *self.sizes)]
        return pack(*heads, *self.data)

    @classmethod
    def joined(cls, crates: list["Crate"]) -> "Crate":
        each = zip(*([c.run, c.part, *c.sizes, *c.data] for c in crates))
        run, part, *rest = (np.concatenate(x) for x in each)
        return cls(run, part, rest[: len(rest) // 2], rest[len(rest) // 2 :])

    def split(self, by: np.ndarray) -> Iterator[tuple[int, "Crate"]]:
        """Cells of each value of by."""
        order = np.argsort(by, kind="stable")
        values, first = np.unique(by[order], return_index=True)
        sizes = [x[order] for x in self.sizes]
        data = []
        for own, old, values_of in zip(sizes, self.sizes, self.data):
            begin = (np.cumsum(old) - old)[order]
            data.append(values_of[np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))])
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
        for value, a, b in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            cut = [d[e[a] : e[b]] for d, e in zip(data, ends)]
            yield value, Crate(self.run[order[a:b]], self.part[order[a:b]], [x[a:b] for x in sizes], cut)

    def cells(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        ends = [np.cumsum(x) for x in self.sizes]
        for i, (run, part) in enumerate(zip(self.run.tolist(), self.part.tolist())):
            yield run, part, [d[e[i] - x[i] : e[i]] for d, e, x in zip(self.data, ends, self.sizes)]


@dataclass(frozen=True)
class Exchange:
    """Every run sends something to every slice and gets an answer. Before hop h a crate is for one value of the first
    known[h + 1] bits of the slice, from runs that share all but the last known[h] bits of their number; a hop joins
    the crates of 2**HOP_BITS such groups of runs and splits them by the next bits. Answers go the same way back. The
    slices that share the bits known in the end are judged by one task. bits: of the whole slice number."""

    known: tuple[int, ...]
    bits: int

    def sent(self, run: int, cells: list[tuple[int, int, list[np.ndarray]]]) -> pa.Table:
        """Blocks of a run's (kind, slice, arrays)."""
        rest = self.bits - self.known[1]
        by: dict[tuple[int, int], list] = {}
        for kind, part, arrays in cells:
            by.setdefault((kind, part >> rest), []).append((run, part, arrays))
        return block_table([(kind, head, run, Crate.of(own).packed()) for (kind, head), own in by.items()])

    def answers(self, sent: DataFrame, judge: Callable[[int, int, list[list[np.ndarray]]], list[list[np.ndarray]]]) -> DataFrame:
        """What judge(kind, slice, arrays of each run) says of each run's arrays, as blocks for the runs."""
        known, bits = self.known, self.bits

        def relay(df: DataFrame, group: int, head: int, target: Callable[[Crate], np.ndarray], row: Callable[[int, int, int], tuple[int, int]]) -> DataFrame:
            def step(table: pa.Table) -> pa.Table:
                kind, part, run = (table.column(c)[0].as_py() for c in ("kind", "part", "run"))
                whole = Crate.joined([Crate.unpacked(b) for b in table.column("block").to_pylist()])
                return block_table([(kind, *row(part, run, v), c.packed()) for v, c in whole.split(target(whole))])

            return df.groupBy("kind", F.shiftright("part", head), F.shiftright("run", group)).applyInArrow(step, BLOCKS)

        def judged(table: pa.Table) -> pa.Table:
            kind, head = (table.column(c)[0].as_py() for c in ("kind", "part"))
            crates = [list(Crate.unpacked(b).cells()) for b in table.column("block").to_pylist()]
            of: dict[int, list[tuple[int, int]]] = {}
            for i, own in enumerate(crates):
                for j, (_, part, _) in enumerate(own):
                    of.setdefault(part, []).append((i, j))
            for part, cells in of.items():  # each cell's arrays make way for the answer
                said = judge(kind, part, [crates[i][j][2] for i, j in cells])
                for (i, j), arrays in zip(cells, said):
                    crates[i][j] = (crates[i][j][0], part, arrays)
            return block_table(
                [(kind, head, first, Crate.of(own).packed()) for first, own in zip(table.column("run").to_pylist(), crates)]
            )

        hops = range(1, len(known) - 1)
        for h in hops:
            rest, own = bits - known[h + 1], known[h]
            sent = relay(
                sent, own, 0, lambda c, rest=rest: c.part >> rest, lambda part, run, v, own=own: (v, run >> own << own)
            )
        back = sent.groupBy("kind", "part").applyInArrow(judged, BLOCKS)
        for h in reversed(hops):
            head, own = known[h + 1] - known[h], known[h - 1]
            back = relay(
                back, known[h], head, lambda c, own=own: c.run >> own, lambda part, run, v, head=head, own=own: (part >> head, v << own)
            )
        return back


def replies_of(table: pa.Table) -> dict[int, dict]:
    """Answers by kind and slice; sketch rows are kinds 0 and up and come under -1 as (row, slice)."""
    out: dict[int, dict] = {-1: {}}
    for kind, block in zip(*(table.column(c).to_pylist() for c in ("kind", "block"))):
        for _, part, arrays in Crate.unpacked(block).cells():
            if kind < EXACT:
                out[-1][kind, part] = arrays
            else:
                out.setdefault(kind, {})[part] = arrays
    return out


#: Kind of the blocks of the exact pass.
EXACT = 100


def sketch_replies(parts: DataFrame, exchange: Exchange, sketch: Sketch, hot: int = 1 << 60) -> DataFrame:
    """Merge the runs' sketch parts slice by slice; the answers go back to the runs."""
    return exchange.answers(parts, lambda kind, part, got: sketch.merged(part, got, hot))
