"""The few functions without a built-in form, as vectorised Python: similarity ratio, embedding, chunks, entities."""

from __future__ import annotations

import difflib
import html
import itertools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity, 0 to 100; null counts as empty. Give it distinct pairs only."""
    return pd.Series([100 * difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def html_unescape(c: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return c.map(lambda x: None if x is None else html.unescape(x))


def embed(
    df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64, tokens: int = 20_000
) -> DataFrame:
    """key and vector of each row: the model (called within tasks, at most batch texts and about tokens tokens of four
    characters at a time) sees each distinct text once."""
    named = df.select(key, F.sha1(F.coalesce(text, F.lit(""))).alias("digest"), F.coalesce(text, F.lit("")).alias("t"))
    distinct = named.groupBy("digest").agg(F.any_value("t").alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors, part, cost = [], [], 0

            def flush() -> None:
                if part:
                    made = model(part)
                    if any(len(v) != size for v in made):
                        raise ValueError(f"the model's vectors do not have {size} values")
                    vectors.extend(made)
                    part.clear()

            for t in f["t"]:
                if part and (len(part) == batch or cost + len(t) // 4 > tokens):
                    flush()
                    cost = 0
                part.append(t)
                cost += len(t) // 4
            flush()
            yield pd.DataFrame({"digest": f["digest"], "vector": vectors})

    vectors = distinct.mapInPandas(run, "digest string, vector array<float>")
    return named.select(key, "digest").join(vectors, "digest").select(key, "digest", "vector")


def chunk_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Begin and end of overlapping pieces of at most size characters, cut at a paragraph, line, sentence or space in
    their last half; together they cover the text."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cuts = [text.rfind(b, at + size // 2, end) for b in ("\n\n", "\n", ". ", " ")]
            end = next((c + 1 for c in cuts if c > 0), end)
        yield at, end
        if end == len(text):
            break
        at = max(at + 1, end - overlap)


def chunk_text(text: str, size: int, overlap: int, most: int | None = None) -> list[str]:
    """The pieces of chunk_spans; the first `most` where a caller wants no more."""
    return [text[a:b] for a, b in itertools.islice(chunk_spans(text, size, overlap), most)]


def chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, keep: Sequence[str] = (), rows: int = 2000) -> DataFrame:
    """key, keep, nth, start, chunk: all pieces of every text, by characters from 0. Null and empty texts have none.
    Tasks hand out rows at a time, however long a text is."""
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in names), ("nth", pa.int32()), ("start", pa.int32()), ("chunk", pa.string())])
            given = zip(*(batch.column(c).to_pylist() for c in [*names, text]))
            made = ((*head, i, a, t[a:b]) for *head, t in given for i, (a, b) in enumerate(chunk_spans(t, size, overlap)))
            while part := list(itertools.islice(made, rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.filter(F.length(text) > 0).select(*names, text).mapInArrow(run, f"{kinds}, nth int, start int, chunk string")
