"""Secret scans by one combined automaton, compiled from all rules' regular expressions.

The rules are parsed, joined into one nondeterministic automaton behind `any bytes`, made deterministic by subset
construction over byte classes and minimised; its transition array runs once over the bytes of every text and says
which rules occur in it. On just those texts the automaton of the reversed rules runs once from the end and marks the
bytes where a match of each rule begins; from a mark the rule's anchored automaton goes on to the longest match, and one
for the part before the counted group tells where that begins. Spans are leftmost and non-overlapping per kind, matches
that fail the rule's length being dropped. A private key is one span from its BEGIN line through its END line: the
header is found like other matches, and an exact pattern, as END must repeat BEGIN's words, follows the key from there.

Null and empty texts have no spans. Repeated rows are scanned alike; texts of any length are scanned whole. Spans are
in code points, end exclusive. `redact` carries all other columns along; `scan` reads none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import column_bytes
from .common import doc_text, in_batches, read


@dataclass(frozen=True)
class Rule:
    """found: the regular expression of a match, each text of which is read in one way only, so that the longest match
    is the greedy one; head: the part of it before what is counted; least: how many bytes of the rest a kept match
    has; bytes: an expression that occurs wherever a match is kept; rest: a pattern that a match is followed with."""

    kind: str
    found: str
    head: str
    least: int
    bytes: str
    rest: str = ""


_KEY = "(password|passwd|secret|token|api_?key)"
_ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in _KEY)
_GAP = r"""["']?\x20*[:=]\x20*["']?"""
_PEM = r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"
_END = r"----END\x20\1PRIVATE\x20KEY-----"
#: White space, also as escapes.
_BREAK = r"(?:\s|\\[nrt])"
#: A key through its own END line, if it comes before another BEGIN; else through its header fields and base64 text: long
#: runs, and a last one of any length that is alone on its line.
_PEM_KEY = (
    r"-----BEGIN\x20([A-Z\x20]*)PRIVATE\x20KEY-----"
    rf"(?:(?:[^-]++|-(?!----BEGIN\x20|{_END}))*+-{_END}"
    rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\r\n]*)*(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:(?:[\x20\t]*+[\r\n]\s*+|(?:\\[nr])++)[A-Za-z0-9+/]+={{0,2}}(?![^\r\n]))?)"
)
#: The first three kinds are the base contract.
RULES = (
    Rule("assign", f"{_ANY_CASE}{_GAP}[A-Za-z0-9+/_.=-]+", f"{_ANY_CASE}{_GAP}", 6, f"{_ANY_CASE}{_GAP}[A-Za-z0-9+/_.=-]"),
    Rule("access", "AKIA[A-Z0-9]+", "", 20, "AKIA[A-Z0-9]{4}"),
    Rule("hex", "[0-9a-f]+", "", 24, "[0-9a-f]{24}"),
    Rule("private_key", _PEM, "", 0, _PEM, _PEM_KEY),
    Rule("git_token", "gh[opsu]_[A-Za-z0-9]+", "", 24, "gh[opsu]_[A-Za-z0-9]{4}"),
)
BASE_KINDS = ("assign", "access", "hex")


class _Nfa:
    """Thompson's construction for literals, classes, groups, |, ?, *, + and {m}, {m,}, {m,n}."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def build(self, tree, at: int) -> int:
        """Append what tree matches after state at; the state after it."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            here = self.state()
            self.eps[at].append(here)
            self.step[here] = (rest[0], end)
            return end
        if kind == "cat":
            for part in rest[0]:
                at = self.build(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in rest[0]:
                start = self.state()
                self.eps[at].append(start)
                self.eps[self.build(part, start)].append(end)
            return end
        part, low, high = rest
        for _ in range(low):
            at = self.build(part, at)
        if high is None:
            loop = self.state()
            self.eps[at].append(loop)
            self.eps[self.build(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.eps[at].append(end)
            at = self.build(part, at)
        self.eps[at].append(end)
        return end


def _parse(text: str):
    """The tree of an expression over ASCII."""
    pos = 0

    def char() -> int:
        nonlocal pos
        c = text[pos]
        pos += 1
        if c != "\\":
            return ord(c)
        c = text[pos]
        pos += 1
        if c == "x":
            pos += 2
            return int(text[pos - 2 : pos], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def alternatives():
        nonlocal pos
        parts = [sequence()]
        while pos < len(text) and text[pos] == "|":
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal pos
        parts = []
        while pos < len(text) and text[pos] not in "|)":
            if text[pos] == "(":
                pos += 1
                part = alternatives()
                pos += 1
            elif text[pos] == "[":
                part = ("set", members())
            else:
                part = ("set", frozenset([char()]))
            parts.append(repeated(part))
        return ("cat", parts)

    def members() -> frozenset:
        nonlocal pos
        pos += 1
        negative = text[pos] == "^"
        pos += negative
        found: set[int] = set()
        while text[pos] != "]":
            first = char()
            if text[pos] == "-" and text[pos + 1] != "]":
                pos += 1
                found.update(range(first, char() + 1))
            else:
                found.add(first)
        pos += 1
        return frozenset(set(range(256)) - found if negative else found)

    def repeated(part):
        nonlocal pos
        while pos < len(text) and text[pos] in "?*+{":
            if text[pos] == "{":
                close = text.index("}", pos)
                low, comma, high = text[pos + 1 : close].partition(",")
                part = ("repeat", part, int(low), int(high) if high else None if comma else int(low))
                pos = close + 1
            else:
                part = ("repeat", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[text[pos]])
                pos += 1
        return part

    return alternatives()


@dataclass
class Automaton:
    """States are row offsets into the flat transition array; accept has a bit for each rule, by such offset."""

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    start: int
    n_states: int

    def rules_in(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the rules that occur in each text. The texts advance together, longest first; when few are left,
        each of them goes on alone."""
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        pos, falling = at[:-1][order], -lengths[order]
        coded = self.classes[data]
        state, hit = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int32)
        t, n = 0, int(np.searchsorted(falling, 0))
        while n > 64:
            now = self.table[state[:n] + coded[pos[:n] + t]]
            state[:n] = now
            hit[:n] |= self.accept[now]
            t += 1
            n = int(np.searchsorted(falling[:n], -t))
        table, accept = self.table.tolist(), self.accept.tolist()
        for i in range(n):
            s, h = int(state[i]), 0
            for c in coded[pos[i] + t : pos[i] - falling[i]].tobytes():
                s = table[s + c]
                if accept[s]:
                    h |= accept[s]
            hit[i] |= h
        out = np.empty_like(hit)
        out[order] = hit
        return out

    def marks(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the rules that end at each byte."""
        coded, out = self.classes[data], np.zeros(len(data), np.int32)
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        pos, falling = at[:-1][order], -lengths[order]
        state = np.full(len(order), self.start, np.int32)
        t, n = 0, int(np.searchsorted(falling, 0))
        while n > 64:
            now = self.table[state[:n] + coded[pos[:n] + t]]
            state[:n] = now
            out[pos[:n] + t] = self.accept[now]
            t += 1
            n = int(np.searchsorted(falling[:n], -t))
        table, accept = self.table.tolist(), self.accept.tolist()
        for i in range(n):
            s = int(state[i])
            for j, c in enumerate(coded[pos[i] + t : pos[i] - falling[i]].tobytes(), int(pos[i]) + t):
                s = table[s + c]
                if accept[s]:
                    out[j] = accept[s]
        return out

    def longest(self, data: bytes, at: int) -> int:
        """Where the longest match that begins at `at` ends; -1 if there is none. For anchored automata."""
        classes, table, accept, dead = self.lists
        s, end = self.start, at if accept[self.start] else -1
        for j in range(at, len(data)):
            s = table[s + classes[data[j]]]
            if s == dead:
                break
            if accept[s]:
                end = j + 1
        return end

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], int]:
        """Classes, table and accept as lists, and the state that nothing leaves."""
        width = int(self.classes.max()) + 1
        rows = self.table.reshape(-1, width)
        own = np.arange(len(rows), dtype=np.int32) * width
        dead = np.flatnonzero((rows == own[:, None]).all(axis=1) & (self.accept[::width] == 0))
        return self.classes.tolist(), self.table.tolist(), self.accept.tolist(), int(own[dead[0]]) if len(dead) else -1


def _reversed(tree):
    """The tree of the same texts read from their ends."""
    kind, *rest = tree
    if kind in ("cat", "alt"):
        parts = [_reversed(part) for part in rest[0]]
        return (kind, parts[::-1] if kind == "cat" else parts)
    return tree if kind == "set" else (kind, _reversed(rest[0]), *rest[1:])


@lru_cache(64)
def compile_rules(expressions: tuple[str, ...], backward: bool = False, anchored: bool = False) -> Automaton:
    """The minimal automaton that reports at each byte which expressions end there. Backward, it reads texts from their
    ends; anchored, matches begin with the text only."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, text in enumerate(expressions):
        start = nfa.state()
        nfa.eps[root].append(start)
        tree = _parse(text)
        ends[nfa.build(_reversed(tree) if backward else tree, start)] = 1 << k
    # Bytes that no set tells apart form a class.
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    keys = [tuple(b in s for s in sets) for b in range(256)]
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    classes = np.array([number[k] for k in keys], np.uint8)
    sample = [keys.index(k) for k in number]
    moves = [None if s is None else [b in s[0] for b in sample] for s in nfa.step]

    useful = sum(1 << s for s in range(len(nfa.step)) if nfa.step[s] or s in ends)

    def closure(state: int) -> int:
        """Bit set of the states reached without a byte."""
        seen, todo = 1 << state, [state]
        while todo:
            for e in nfa.eps[todo.pop()]:
                if not seen >> e & 1:
                    seen |= 1 << e
                    todo.append(e)
        return seen & useful

    begin = closure(root)
    reach = [closure(s[1]) if s else 0 for s in nfa.step]
    seen, rows = {begin: 0}, []
    queue = [begin]
    for states in queue:  # grows while it is read
        live = [s for s in range(states.bit_length()) if states >> s & 1 and moves[s]]
        row = []
        for c in range(len(sample)):
            after = 0 if anchored else begin
            for s in live:
                if moves[s][c]:
                    after |= reach[s]
            if after not in seen:
                seen[after] = len(seen)
                queue.append(after)
            row.append(seen[after])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([sum(bit for s, bit in ends.items() if states >> s & 1) for states in queue], np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:  # split blocks by where their states lead, until nothing splits
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    small, marks = np.empty((n, len(sample)), np.int64), np.empty(n, np.int64)
    small[block], marks[block] = block[table], accept
    width = len(sample)
    by_offset = np.zeros(n * width, np.int32)
    by_offset[::width] = marks
    return Automaton(classes, (small.ravel() * width).astype(np.int32), by_offset, int(block[0]) * width, n)


def spans_in(text: bytes, marks: np.ndarray, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(begin, rule number, end) of the kept matches in code points, in that order; marks: the rules that begin at each
    byte."""
    found = []
    for k, rule in enumerate(rules):
        starts = np.flatnonzero(marks >> k & 1)
        if not len(starts):
            continue
        whole, head = (compile_rules((e,), anchored=True) for e in (rule.found, rule.head))
        rest = re.compile(rule.rest.encode()) if rule.rest else None
        i = 0
        while i < len(starts):
            begin = int(starts[i])
            end = rest.match(text, begin).end() if rest else whole.longest(text, begin)
            if end - head.longest(text, begin) >= rule.least:
                found.append((begin, k, end))
            i += 1
            if i < len(starts) and starts[i] < end:
                i = int(np.searchsorted(starts, end))
    if not found:
        return []
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return sorted((int(points[b]), k, int(points[e])) for b, k, e in found)


def _found(
    batch: pa.RecordBatch, text_col: str, rules: tuple[Rule, ...], automaton: Automaton
) -> list[list[tuple[int, int, int]]]:
    data, at = column_bytes(batch.column(text_col))
    hit = np.flatnonzero(automaton.rules_in(data, at))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
    if len(hit):
        texts = [data[at[i] : at[i + 1]] for i in hit]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        whole = np.concatenate(texts)
        # From the end: the last byte of the last text comes first.
        backward = compile_rules(tuple(r.found for r in rules), backward=True)
        marks = backward.marks(whole[::-1], (ends[-1] - ends)[::-1])[::-1]
        for i, text, a, b in zip(hit.tolist(), texts, ends.tolist(), ends[1:].tolist()):
            out[i] = spans_in(text.tobytes(), marks[a:b], rules)
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, rank of the kind, begin, end), one row for each row of docs."""
    automaton = compile_rules(tuple(r.bytes for r in rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
        )
        for batch in batches:
            spans = [
                [{"kind": rules[k].kind, "rank": k, "begin": b, "end": e} for b, k, e in found]
                for found in _found(batch, "text", rules, automaton)
            ]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind string, rank int, begin long, end long>>"
    return in_batches(doc_text(docs, id_col, text_col), run, schema)


def redact(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """docs with each secret replaced by `[kind]` (overlapping ones by one mark), and its length column set anew."""
    automaton = compile_rules(tuple(r.bytes for r in rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for i, found in enumerate(_found(batch, text_col, rules, automaton)):
                if found:
                    parts, done = [], 0
                    for b, k, e in found:
                        if b >= done:
                            parts += [texts[i][done:b], f"[{rules[k].kind}]"]
                        done = max(done, e)
                    texts[i] = "".join([*parts, texts[i][done:]])
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text_col] = pa.array(texts, pa.string())
            if length_col:
                columns[length_col] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return in_batches(docs, run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
        )

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(number, BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
