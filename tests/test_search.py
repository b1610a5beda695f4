"""Search requests, rule tables and listing pages: small tables with ties, nulls, empty tables and clashing names."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from eventlake.operators import extract, rules, search
from eventlake.session import ship_package

ROWS = "id long, name string, kind string, v array<double>, day date, cat string, first string, n int"
ASKS = "q long, text string, e array<double>, first date, last date, categories array<string>, score int"
DAY = dt.date(2024, 5, 1)


def retrieve(spark, rows, asks):
    ship_package(spark)
    r, a = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asks, ASKS)
    found, stages = search.retrieve_each(r, "id", {"name": "name", "type": "kind"}, "v", "day", "cat", a, "q", "text", "e", "2024-05-01")
    return {(x.q, x["rank"]): x.id for x in found.collect()}, {x.q: x[1:] for x in stages.collect()}, found


def test_stages_and_ties(spark):
    rows = [(i, "red ring", None if i % 2 else "small", [1.0, float(i % 3)] if i < 8 else None, DAY + dt.timedelta(i) if i != 5 else None, "a" if i < 30 else None, "x", 1) for i in range(40)]
    rows += [(99, None, None, [5.0, 0.0], DAY - dt.timedelta(1), "a", None, None)]  # past: no use as a vector
    jazz, vec = "free jazz in soho tonight and more", [1.0, 0.0]
    asks = [
        (1, jazz, vec, None, None, None, 0),
        (2, jazz, None, None, None, ["a"], 0),
        (3, jazz, vec, DAY + dt.timedelta(12), DAY + dt.timedelta(10), None, 0),  # bounds in either order
        (4, "small", None, None, None, [], 0),
        (5, "small", None, dt.date(2030, 1, 1), dt.date(2030, 1, 2), None, 0),
        (6, None, None, DAY, None, [""], 0),  # half a window is none; the empty category is the null one
        (7, "small things", vec, DAY, DAY + dt.timedelta(6), ["a", "a", "none"], 0),
    ]
    got, stages, found = retrieve(spark, rows, asks)
    assert stages[1] == ("vector", 41, 41, 8) and stages[2] == ("lexical_without_vector", 31, 31, 8)
    assert stages[3] == ("lexical_without_overlap", 41, 3, 0) and stages[4][0] == "filtered_empty"
    assert stages[5] == ("date_empty", 41, 0, 0) and stages[6] == ("lexical", 10, 10, 0) and stages[7] == ("lexical", 31, 6, 6)
    of = lambda q: [i for (p, _), i in sorted(got.items()) if p == q]
    assert of(1) == [0, 3, 6, 1, 4, 7, 2, 5]
    assert of(2) == list(range(25)) and of(3) == [10, 11, 12] and of(4) == of(5) == []
    assert of(6) == list(range(30, 40)) and of(7) == [0, 2, 4, 6, 1, 3]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    assert retrieve(spark, [], [])[:2] == ({}, {})
    assert retrieve(spark, [], [(1, "x", None, None, None, None, 0)])[:2] == ({}, {1: ("filtered_empty", 0, 0, 0)})
    assert retrieve(spark, [(1, "a", "b", None, None, None, None, None)], [])[:2] == ({}, {})


def test_allowed_categories(spark):
    ship_package(spark)
    rows = spark.createDataFrame([("music",), ("film",), (None,), ("",), ("music",)], "cat string")
    asks = [(1, None, None), (2, ["film", "no"], []), (3, [], ["musik", None]), (4, ["film"], ["musik"]), (5, None, ["zzz"])]
    got = search.allowed_categories(spark.createDataFrame(asks, "q int, a array<string>, b array<string>"), "q", "a", "b", rows, "cat")
    assert dict(got.collect()) == {1: None, 2: ["film", "no"], 3: ["music"], 4: [], 5: []}


def test_rules(spark):
    table = [rules.Rule("x", (("a", "kin", ["msg"]), ("n", "below", 3))), rules.Rule("y", (("a", "blank", None),)), rules.Rule("z", (("n", "zero", None),))]
    df = spark.createDataFrame([("The MSG hall", 2), ("m", None), (None, 5), (" ", None), ("other", 0), ("other", 1)], "a string, n int")
    got = [tuple(r.r) if r.r else None for r in df.select(rules.choose(table).alias("r")).collect()]
    # the blank text is part of any other, so it is kin of the listed ones
    assert got == [("x", 1), ("x", 1), ("y", 2), ("x", 1), ("z", 3), None]
    with pytest.raises(ValueError):
        rules.choose([rules.Rule("x", (("a", "odd", None),))])
    with pytest.raises(ValueError):
        rules.choose([])


def test_listing_quota(spark):
    site = "https://a.example"
    links = [(site, f"https://a.example/programs-{i:02}", i, 1) for i in range(30)] + [(site, "https://a.example/events", 40, 1)] * 2
    links += [(site, u, 50, 1) for u in (None, "", "https://b.example/events", "https://www.a.example/events/2024/5/6/x", "/events/talk-1")] + [(None, "https://a.example/shows", 1, 1)]
    links += [("https://empty.example", None, 1, 1)]
    df = spark.createDataFrame(links, "site string, url string, at int, rank int")
    got = {}
    for r in extract.listing_pages(df, "site", "url", "at").orderBy("rank").collect():
        got.setdefault(r.site, []).append(r.url.removeprefix(r.site))
    # the linked usual path scores -3 + 3 - 4; the twelve best, then two more usual paths
    linked = [f"/programs-{i:02}" for i in range(30)]
    assert got[site][:12] == linked[:12] and len(got[site]) == 15
    assert got[site][12:] == ["/events", "/events.html", "/program"]
    assert len(got["https://empty.example"]) == 12 and None not in got


def test_equal_requests_are_answered_once(spark, monkeypatch):
    """Hits grow with distinct sets of tokens and filters, not with requests times rows."""
    kept = {}
    monkeypatch.setattr(search, "written", lambda df, name, write=search.written: kept.setdefault(name, write(df, name)))
    rows = [(i, f"red ring {i:04}", "small", None, None, "a", None, None) for i in range(400)]
    got, stages, _ = retrieve(spark, rows, [(q, f"red w{q}ww", None, None, None, None, 0) for q in range(200)])
    assert got == {(q, n + 1): n for q in range(200) for n in range(25)} and {s[0] for s in stages.values()} == {"lexical"}
    assert kept["hits"].count() == 25 and kept["scored"].count() == 1


def test_words_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc1") for _ in range(r.randint(2, 4)))
    rows = [(i, f"{word()} {word()}-{word()}", None if i % 7 == 0 else word().upper(), None, DAY + dt.timedelta(i % 9) if i % 5 else None, r.choice(["a", "b", None]), None, None) for i in range(300)]
    asks = [(q, " ".join(word() for _ in range(r.randint(1, 5))), None, DAY + dt.timedelta(q % 3) if q % 2 else None, DAY + dt.timedelta(q % 7), r.choice([None, ["a"], ["b", ""], ["a", "b"]]), 0) for q in range(60)]
    got, stages, _ = retrieve(spark, rows, asks)
    want = {}
    for q, text, _, first, last, cats, _ in asks:
        assert stages[q][0].startswith(("lexical", "date"))
        tokens = {t for w in text.split() if len(w) > 2 for t in (w,)}
        inside = [x for x in rows if (first is None or x[4] and min(first, last) <= x[4] <= max(first, last)) and (cats is None or (x[5] or "") in cats)]
        score = lambda x: sum(3.0 * (t in x[1]) + 2.5 * (t in (x[2] or "").lower()) for t in tokens)
        want |= {(q, n + 1): x[0] for n, x in enumerate(sorted(inside, key=lambda x: (-score(x), x[0]))[:25])}
    assert got == want
