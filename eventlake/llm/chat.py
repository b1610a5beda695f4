"""Chat formatting from event logs: partition by conversation, sort by sequence, fold, render, read back.

Events are (conv_id, seq, message_id, kind, role, text). A message's text is what its events leave: `message` and
`edit` set it, `start` and `regenerate` empty it, `delta` appends (to nothing after a `delete`), `delete` removes the message. Messages stand in the
order of their first events. Rows stream through sorted partitions, so memory holds one message and one part of
PART_CHARS at a time, however long a conversation is.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a backslash goes after the first
character of every control string and before every backslash (and before line feeds of a role), so no text can forge
a turn and dropping those backslashes restores it. The loss mask covers assistant texts.

`turn_log` writes tables of finished turns as such a log: an assistant's turn is started, drafted, regenerated and
streamed in pieces, any other turn is sent as a draft and edited.

Null role or text is empty; a null conv_id is one more conversation; null sequences come first; messages of equal
sequence are ordered by role, text and message, and all of them stay, repeated rows too. Turns are whole numbers below
2**37. An empty log gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, read

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates.
CONTROL = ["<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
PART_CHARS = 1 << 20
#: Code points of a streamed delta, and sequence numbers kept for the events of one turn.
DELTA_CHARS, TURN_EVENTS = 64, 1 << 25
_ESCAPE = re.compile(r"\\|" + "|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!\|))*+)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int]:
    """One turn, and where its text begins."""
    head = BEGIN + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + END, len(head)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded length."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 100
        if size > 4 * PART_CHARS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("message_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def messages() -> Iterator[tuple]:
        key = None
        for conv, message, seq, kind, by, text in _rows(batches, "conv_id", "message_id", "seq", "kind", "role", "text"):
            if kind == "message" or key is None or key[0] != (conv, message):
                if key and parts is not None:
                    yield (key[0][0], key[1], key[0][1], role, "".join(parts))
                key, role, parts = ((conv, message), seq), by, []
            if kind == "delete":
                parts = None
            elif kind == "delta":
                parts = [] if parts is None else parts
                parts.append(text)
            else:
                parts = [] if kind in ("start", "regenerate") else [text]
        if key and parts is not None:
            yield (key[0][0], key[1], key[0][1], role, "".join(parts))

    yield from _batches(messages(), schema)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def parts() -> Iterator[tuple]:
        conv, part, turns, loss, size = None, 0, [], [], 0
        for of, role, text in _rows(batches, "conv_id", "role", "text"):
            if turns and (of != conv or size > PART_CHARS):
                yield (conv, part, "".join(turns), loss)
                part, turns, loss, size = part + 1, [], [], 0
            if of != conv:
                conv, part = of, 0
            turn, begin = render(role, text)
            if role == "assistant":
                loss.append({"begin": size + begin, "end": size + len(turn) - len(END)})
            turns.append(turn)
            size += len(turn)
        if turns:
            yield (conv, part, "".join(turns), loss)

    yield from _batches(parts(), schema)


def turn_log(turns: DataFrame) -> DataFrame:
    """The events of conv_id, turn, role, text. Equal rows are counted first and get a message each."""
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    draft = F.substring(text, 1, DELTA_CHARS)

    def event(kind: str, said: Column):
        return F.struct(F.lit(kind).alias("kind"), said.alias("text"))

    streamed = F.concat(
        F.array(event("start", F.lit("")), event("delta", draft), event("regenerate", F.lit(""))),
        F.transform(pieces, lambda x: event("delta", x)),
    )
    sent = F.array(event("message", draft), event("edit", text))
    first = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 37))) * TURN_EVENTS
    return (
        turns.groupBy("conv_id", "turn", "role", "text")
        .agg(F.count("*").alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("conv_id", first.alias("first"), F.xxhash64("turn", "role", "text", "copy").alias("message_id"), "role",
                F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(sent)).alias("nth", "event"))
        .select("conv_id", (F.col("first") + F.col("nth")).alias("seq"), "message_id", "event.kind", "role", "event.text")
    )


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, part, formatted and loss (spans of code points in this part). Parts of a conversation are neighbours,
    in order, within one partition; each ends with a whole turn."""
    clean = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("seq").cast("long").alias("seq"),
        F.col("message_id").cast("long").alias("message_id"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_events = clean.repartition("conv_id").sortWithinPartitions("conv_id", "message_id", "seq", "role", "text")
    messages = in_batches(sorted_events, _fold, "conv_id long, nth long, message_id long, role string, text string")
    return in_batches(
        messages.sortWithinPartitions("conv_id", "nth", "role", "text", "message_id"),
        _render,
        "conv_id long, part long, formatted string, loss array<struct<begin: long, end: long>>",
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, pa.string() if n.endswith("256") else pa.int64()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
    )

    def digests() -> Iterator[tuple]:
        first, conv = True, None
        for of, text, spans in _rows(batches, "conv_id", "formatted", "loss"):
            if first or of != conv:
                if not first:
                    yield (conv, n, turns.hexdigest(), chars, loss.hexdigest(), length)
                first, conv, n, chars, length, turns, loss = False, of, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            done = 0
            for m in _TURN.finditer(text):
                assert m.start() == done
                done, n = m.end(), n + 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            assert done == len(text)
            length += len(text)
            for s in spans:
                said = unescape(text[s["begin"] : s["end"]])
                chars += len(said)
                loss.update(said.encode())
        if not first:
            yield (conv, n, turns.hexdigest(), chars, loss.hexdigest(), length)

    yield from _batches(digests(), schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, loss text and lengths of each conversation, parsed from what format_log made."""
    return in_batches(
        formatted,
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = (
        read(spark, sf_dir, "conversations")
        .select("conv_id", "turn", "role", "text")
        .union(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    )
    return read_back(format_log(turn_log(turns)))


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '<|', '|')))
    + (length(text) - length(replace(text, '[INST]', 'INST]'))) + (length(text) - length(replace(text, '[/INST]', '/INST]')))
    + (length(text) - length(replace(text, '<<SYS>>', '<SYS>>'))) + (length(text) - length(replace(text, '<</SYS>>', '</SYS>>')))
    + (length(text) - length(replace(text, '<s>', 's>'))) + (length(text) - length(replace(text, '</s>', '/s>'))) AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + escaped + 24) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
