"""SentencePiece encoding and decoding: merges in rank order for BPE files, a batched numpy Viterbi for unigram files.

The piece file is the caller's; nothing is trained. Text is normalised as the file says for identity normalisers (a
space before the text, spaces as U+2581) and cut into words, each a run of U+2581 and what follows up to the next:
no piece of two or more characters crosses such a border, so the words' ids make up the text's. The distinct words of
a batch are grouped by length, and the words of one length advance together. Characters without a piece become byte
pieces.

BPE file (the file says which it is): in every round each word merges the one neighbouring pair whose piece has the
highest score, of equals the leftmost, until no pair makes a piece; of each word only the two pairs at the merge are
looked up again. Words of more than LONG characters keep their pairs in a heap instead. Such a file with user-defined
or unused pieces is refused, as those follow other rules.

Other files: at every position all candidate substrings are looked up by hash among the sorted piece keys, and the best
sum of scores and its piece length are kept with vector operations.

Decoding restores every text exactly: a literal U+2581 is coded as bytes, not as a space. Null text is empty and gives
no ids, as does an empty text. Repeated rows are coded alike. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, mix
from .common import doc_text, in_batches, read

SPACE = "▁"
#: Stands for a literal U+2581 while words are cut: a code point that no valid text holds.
_LITERAL = "\ud800"
#: Score of a character without a piece, below the lowest.
UNKNOWN_PENALTY = 10.0
#: Distinct words remembered by a task, and characters of words coded at once.
MEMORY, AT_ONCE = 1 << 17, 1 << 18
#: Rows coded at once.
ROWS = 500
#: Longer words are merged one by one with a heap.
LONG = 64


_BPE = 2  # the trainer's model type


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """Pieces by id; keys: sorted hashes of the ordinary ones and their beginnings, with ids; first: where
    each value of a hash's leading bits begins among them; byte_ids: id of each byte's piece."""

    texts: list[str]
    scores: np.ndarray
    kinds: list[int]
    keys: np.ndarray
    first: np.ndarray
    key_ids: np.ndarray
    byte_ids: np.ndarray
    longest: int
    unknown: float
    most: int
    merges: "Merges | None"

    @classmethod
    def parse(cls, model: bytes) -> "Pieces":
        texts, scores, kinds, model_type = [], [], [], 1
        for number, value in _fields(model):
            if number == 1:  # a piece: text, score, kind (1 ordinary, 6 a byte)
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), np.float32)[0]))
                kinds.append(int(piece.get(3, 1)))
            elif number == 2:  # how it was trained
                model_type = dict(_fields(value)).get(3, 1)
        plain = [i for i, k in enumerate(kinds) if k == 1]
        # Every beginning of a piece has a key, so that a search stops where no piece goes on; -1: no piece itself.
        number = {texts[i][:k]: -1 for i in plain for k in range(1, len(texts[i]))} | {texts[i]: i for i in plain}
        by_length: dict[int, list[str]] = {}
        for text in number:
            by_length.setdefault(len(text), []).append(text)
        keys = np.concatenate([_key(_codes(own)) for own in by_length.values()])
        order = np.argsort(keys)
        keys, ids = keys[order], np.array([number[t] for own in by_length.values() for t in own], np.int64)[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("piece keys collide")
        byte_ids = np.zeros(256, np.int64)
        for i, k in enumerate(kinds):
            if k == 6:
                byte_ids[int(texts[i][3:5], 16)] = i
        least = min(scores[i] for i in plain)
        return cls(
            texts,
            np.array(scores),
            kinds,
            np.append(keys, [U(0)] * 8),
            np.searchsorted(keys, np.arange(1 << _LEAD, dtype=np.uint64) << U(64 - _LEAD)),
            np.append(ids, [0] * 8),
            byte_ids,
            max(len(texts[i]) for i in plain),
            least - UNKNOWN_PENALTY,
            int(np.bincount((keys >> U(64 - _LEAD)).astype(np.int64)).max()),
            Merges.of(texts, scores, kinds) if model_type == _BPE else None,
        )

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces', and their ids. The leading bits give the place among the sorted keys to within
        `most`, the largest number of pieces with the same ones."""
        at = self.first[key >> U(64 - _LEAD)]
        rows, ids = [], []
        for step in range(self.most):
            hit = np.flatnonzero(self.keys[at + step] == key)
            rows.append(hit)
            ids.append(self.key_ids[at[hit] + step])
        return np.concatenate(rows), np.concatenate(ids)

    @classmethod
    def load(cls, path: str) -> "Pieces":
        with open(path, "rb") as f:
            return cls.parse(f.read())


#: Rank of a pair that makes no piece.
_NEVER = np.int32(2**31 - 1)


@dataclass
class Merges:
    """Symbols are piece ids, then numbers for characters that only occur within pieces, then `n_symbols - 1` for any
    other. pairs: left * n_symbols + right to the piece that they make; keys, ids: the same sorted by hash, first: where
    each value of the leading bits begins; rank: order of merging by piece id, _NEVER for id -1."""

    n_symbols: int
    chars: np.ndarray
    pairs: dict[int, int]
    keys: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    most: int
    rank: np.ndarray

    @classmethod
    def of(cls, texts: list[str], scores: list[float], kinds: list[int]) -> "Merges":
        if {4, 5} & set(kinds):
            raise ValueError("user-defined or unused pieces in a BPE file")
        symbols = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == 1}
        for c in sorted({c for t in symbols for c in t} - symbols.keys()):
            symbols[c] = len(texts) + sum(v >= len(texts) for v in symbols.values())
        n = len(texts) + sum(v >= len(texts) for v in symbols.values()) + 1
        chars = np.full(0x110000, n - 1, np.int32)
        pairs = {}
        for text, i in symbols.items():
            if len(text) == 1:
                chars[ord(text)] = i
            for k in range(1, len(text)):
                left, right = symbols.get(text[:k]), symbols.get(text[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        keys, ids = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        lead = mix(keys) >> U(64 - _LEAD)
        order = np.argsort(lead, kind="stable")
        most = int(np.bincount(lead.astype(np.int64), minlength=1).max())
        rank = np.append(np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32), _NEVER)
        return cls(
            n,
            chars,
            pairs,
            np.append(keys[order], np.full(most + 1, 2**64 - 1, np.uint64)),
            np.append(ids[order], np.full(most + 1, -1, np.int32)),
            np.searchsorted(lead[order], np.arange(1 << _LEAD, dtype=np.uint64)),
            most,
            rank,
        )

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = left.astype(U) * U(self.n_symbols) + right.astype(U)
        at = self.first[mix(key) >> U(64 - _LEAD)]
        out = np.full(len(key), -1, np.int32)
        for step in range(self.most):
            hit = np.flatnonzero(self.keys[at + step] == key)
            out[hit] = self.ids[at[hit] + step]
        return out


_BASE = 0x9E3779B97F4A7C15
_LEAD = 18


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _key(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.full(len(codes), 7, U)
    for j in range(codes.shape[1]):
        h = _extend(h, codes[:, j])
    return mix(h)


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h + code.astype(U) + U(1)) * U(_BASE)


def best_paths(pieces: Pieces, codes: np.ndarray) -> list[list[int]]:
    """Piece ids of words of one length, given as rows of code points."""
    n, length = codes.shape
    score = np.full((length + 1, n), -np.inf)
    score[0] = 0
    back = np.zeros((length + 1, n), np.int32)  # length of the last piece, 0: a character without one
    piece = np.zeros((length + 1, n), np.int32)
    for i in range(length):
        # Without a piece for the character itself, byte pieces lead one further.
        alone = np.flatnonzero(score[i] + pieces.unknown > score[i + 1])
        score[i + 1, alone] = score[i, alone] + pieces.unknown
        back[i + 1, alone] = 0
        words, h = np.arange(n), np.full(n, 7, U)
        for j in range(i, min(length, i + pieces.longest)):
            h = _extend(h, codes[words, j])
            on, ids = pieces.find(mix(h))
            words, h = words[on], h[on]  # those that some piece begins with
            if not len(words):
                break
            ends = np.flatnonzero(ids >= 0)
            done, ids = words[ends], ids[ends]
            total = score[i, done] + pieces.scores[ids]
            better = total > score[j + 1, done]
            if j == i:  # a piece of its own always goes before bytes
                better |= back[j + 1, done] == 0
            done, ids = done[better], ids[better]
            score[j + 1, done] = total[better]
            back[j + 1, done] = j - i + 1
            piece[j + 1, done] = ids
    out: list[list[int]] = [[] for _ in range(n)]
    byte_ids = pieces.byte_ids.tolist()
    at, every = np.full(n, length), np.arange(n)
    while len(every):  # all words step back together; ids are gathered from the end
        size = back[at, every]
        for w, end, whole, own in zip(every.tolist(), at.tolist(), (size > 0).tolist(), piece[at, every].tolist()):
            if whole:
                out[w].append(own)
            else:
                c = chr(codes[w, end - 1])
                out[w] += [byte_ids[x] for x in reversed((SPACE if c == _LITERAL else c).encode())]
        at = at - np.maximum(size, 1)
        every, at = every[at > 0], at[at > 0]
    for ids in out:
        ids.reverse()
    return out


def _as_ids(pieces: Pieces, symbols: list[int], codes: list[int]) -> list[int]:
    """Ids of the symbols of a word; codes: the first code point of each. Characters without a piece become bytes."""
    n, byte_ids, out = len(pieces.texts), pieces.byte_ids, []
    for s, code in zip(symbols, codes):
        if s < n:
            out.append(s)
        else:
            c = chr(code)
            out += [int(byte_ids[x]) for x in (SPACE if c == _LITERAL else c).encode()]
    return out


def merged(pieces: Pieces, codes: np.ndarray) -> list[list[int]]:
    """Piece ids of words of one length, given as rows of code points, by merging pairs in the order of their rank."""
    m = pieces.merges
    n, length = codes.shape
    if length > LONG:
        return [_merged_long(pieces, row) for row in codes]
    # Two more columns stand for what is after the last and, as column -1, before the first character.
    final = np.full((n, length + 2), m.n_symbols - 1, np.int32)
    final[:, :length] = m.chars[codes]
    sym, every = final.copy(), np.arange(n)
    into = np.full((n, length + 2), -1, np.int32)
    into[:, : length - 1] = m.find(sym[:, : length - 1].ravel(), sym[:, 1:length].ravel()).reshape(n, -1)
    rank = m.rank[into]
    after = np.tile(np.arange(1, length + 3, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, length + 1, dtype=np.int32), (n, 1))
    while len(every):
        at = rank.argmin(1)
        on = np.flatnonzero(rank[np.arange(len(every)), at] != _NEVER)
        if len(on) <= 0.75 * len(every):  # finished words leave
            final[every] = sym
            every, sym, into, rank, after, before, at = (x[on] for x in (every, sym, into, rank, after, before, at))
            on = np.arange(len(every))
        left = at[on]
        gone = after[on, left]
        right, prior = after[on, gone], before[on, left]
        sym[on, left] = into[on, left]
        sym[on, gone] = -1
        rank[on, gone] = _NEVER
        after[on, left] = right
        before[on, right] = left
        made = m.find(sym[on, left], sym[on, right])
        into[on, left], rank[on, left] = made, m.rank[made]
        made = m.find(sym[on, prior], sym[on, left])
        into[on, prior], rank[on, prior] = made, m.rank[made]
    own = final[:, :length]
    there = own >= 0
    flat, ends = own[there].tolist(), np.cumsum(there.sum(1)).tolist()
    out = [flat[a:b] for a, b in zip([0, *ends], ends)]
    for w in np.flatnonzero((own >= len(pieces.texts)).any(1)).tolist():
        out[w] = _as_ids(pieces, out[w], codes[w, there[w]].tolist())
    return out


def _merged_long(pieces: Pieces, codes: np.ndarray) -> list[int]:
    """The same for one word, its pairs in a heap by rank and place."""
    m = pieces.merges
    n, pairs, rank = m.n_symbols, m.pairs, m.rank.tolist()
    sym = m.chars[codes].tolist()
    size = len(sym)
    after, before = [*range(1, size + 1)], [*range(-1, size - 1)]
    heap = [(rank[p], i, p) for i in range(size - 1) if (p := pairs.get(sym[i] * n + sym[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        # Out of date: the left symbol is gone, or the two no longer make this piece.
        if sym[i] < 0 or j == size or pairs.get(sym[i] * n + sym[j]) != p:
            continue
        sym[i], sym[j] = p, -1
        after[i] = right = after[j]
        if right < size:
            before[right] = i
        for a, b in ((before[i], i), (i, right)):
            if a >= 0 and b < size and (q := pairs.get(sym[a] * n + sym[b])) is not None:
                heapq.heappush(heap, (rank[q], a, q))
    there = [i for i, s in enumerate(sym) if s >= 0]
    return _as_ids(pieces, [sym[i] for i in there], codes[there].tolist())


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder:
    """Codes batches of texts; remembers words of earlier batches up to MEMORY."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.memory, self.numbers = pieces, {}, list(range(len(pieces.texts)))
        self.plain = [
            bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() for t, k in zip(pieces.texts, pieces.kinds)
        ]

    def words(self, text: str) -> list[str]:
        """Words of the normalised text, a literal U+2581 replaced by its stand-in."""
        if not text:
            return []
        return _WORD.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words(t or "") for t in texts]
        new = {w for ws in cut for w in ws} - self.memory.keys()
        if len(self.memory) + len(new) > MEMORY:
            self.memory = {}
            new = {w for ws in cut for w in ws}
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        code = merged if self.pieces.merges else best_paths
        for length, words in by_length.items():
            step = max(1, AT_ONCE // length)
            for i in range(0, len(words), step):
                part = words[i : i + step]
                coded = code(self.pieces, _codes(part))
                # One object for each id, however many words have it.
                self.memory.update((w, tuple(map(self.numbers.__getitem__, ids))) for w, ids in zip(part, coded))
        known = self.memory
        return [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of runs of byte pieces as they are, U+2581 of other pieces as spaces."""
        return b"".join(map(self.plain.__getitem__, ids)).decode()[1:]


@lru_cache(2)
def encoder_of(model: bytes) -> Encoder:
    """One encoder for a worker process, so that later tasks find pieces and words ready."""
    return Encoder(Pieces.parse(model))


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", read_back: bool = True
) -> DataFrame:
    """doc_id, ids, and decoded (the text read back from the ids; only with read_back) of every row. The driver reads
    the piece file and hands it to the tasks."""
    with open(model_path, "rb") as f:
        model = f.read()
    held = docs.sparkSession.sparkContext.broadcast(model)  # the file's size, some hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = encoder.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
                if read_back:
                    columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                yield pa.record_batch(columns, names=names)

    names = ["doc_id", "ids", "decoded"][: 3 if read_back else 2]
    return in_batches(doc_text(docs, id_col, text_col), run, "doc_id long, ids array<int>" + ", decoded string" * read_back)


def default_model() -> str:
    """Path of the installed public piece file."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, a digest of them, and the length and digest of the text decoded from them."""
    return encode(read(spark, sf_dir, "documents"), default_model()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
