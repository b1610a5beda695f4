"""Pieces of texts: whole texts are covered, listings are preferred."""

from __future__ import annotations

import random
import re

from eventlake.functions import udfs
from eventlake.operators import extract
from eventlake.session import ship_package


def start_of(text):
    best = 0
    for p in extract.LISTING_STARTS:
        found = re.search(p, text)
        if found and found.start() > best:
            best = max(0, found.start() - 200)
    return best if best > 1000 else 0


def expected(texts, size, overlap, most):
    out = set()
    for k, text in texts:
        if not text:
            continue
        a = start_of(text)
        pieces = [(i, a + b, text[a + b : a + e]) for i, (b, e) in enumerate(udfs.chunk_spans(text[a:], size, overlap))]
        flags = [any(re.search(p, c) for p in extract.LISTING_SIGNS) for _, _, c in pieces]
        preferred = [i for i, f in enumerate(flags) if f] or list(range(len(pieces)))
        out |= {(k, i, b, c, f, i in preferred[:most]) for (i, b, c), f in zip(pieces, flags)}
    return out


def test_listing_chunks_equal_brute_force(spark):
    ship_package(spark)
    r = random.Random(6)
    words = ["plain", "words", "é", "Jan 5", "7:30 PM", "ticket", "2024-01-02", "\n\n", ". ", "mayor", "register."]
    prose = lambda n, odd: " ".join(r.choice(words[3:]) if r.random() < odd else r.choice(words[:3]) for _ in range(n))
    texts = [(i, prose(r.randint(0, 300), r.choice([0, 0, 0.02, 0.3]))) for i in range(30)]
    texts += [(40, prose(400, 0) + " Upcoming EVENTS " + prose(300, 0.01)), (41, prose(50, 0) + " sort by " + prose(50, 0)), (42, prose(400, 0) + " May 2025 " + prose(200, 0) + " items 1-20 of " + prose(90, 0.2))]
    texts += [(50, None), (51, ""), (None, "a talk"), (52, "x" * 5000), (2**60 + 1, "y y"), (53, "word " * 40_000)]
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in texts], "k long, text string, nth int, start string")
    got = extract.listing_chunks(df, "k", "text", 300, 40, 3)
    rows = [tuple(x) for x in got.select("k", "nth", "start", "chunk", "listing", "chosen").collect()]
    want = expected(texts, 300, 40, 3)
    assert set(rows) == want and len(rows) == len(want)
    assert any(f and not c for *_, f, c in rows) and any(c and not f for *_, f, c in rows)


def test_chunks_lose_no_tail(spark):
    ship_package(spark)
    text = "".join(chr(97 + i % 26) * 7 + (" " if i % 3 else "\n") for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    rows = udfs.chunks(df, "id", "t", 40, 5).orderBy("nth").collect()
    assert len(rows) > 10_000 and rows[-1].start + len(rows[-1].chunk) == len(text)
    assert all(text[x.start : x.start + len(x.chunk)] == x.chunk for x in rows)
    assert all(a.start + len(a.chunk) >= b.start for a, b in zip(rows, rows[1:]))
