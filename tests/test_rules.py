"""Small literal tables for rules that are easy to get wrong."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventlake.functions import dates, text, udfs
from eventlake.operators import dedupe, extract, filters, joins, merges, ranking
from eventlake.session import ship_package


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_name_variants(spark):
    name = lambda s, v: one(spark, text.normalize_name(F.lit(s), v))
    assert name("The Bell House", "cache") == "bell house"
    assert name("(Le) Poisson Rouge", "venue") == "le poisson rouge"
    assert name("Foo NYC Club", "cache") == "foo nyc"
    assert name("foo !", "venue") == "foo "
    assert name("a-b", "lookup") == "a b"
    assert name("The Band Tour", "artist") == "band"
    assert name("", "feed") == "" and one(spark, text.normalize_name(F.lit(None).cast("string"), "feed")) == ""


def test_blanks_and_decoding(spark):
    for blank in ("", " ", "None", None):
        assert one(spark, text.blank_to_null(F.lit(blank).cast("string"))) is None
    assert one(spark, text.blank_to_null(F.lit("not_found"))) == "not_found"
    assert one(spark, text.int_or_zero(F.lit("x"))) == 0
    assert one(spark, text.int_via_float(F.lit("3.9"))) == 3
    assert one(spark, text.bool_token(F.lit("YES"))) is True
    assert one(spark, text.coordinate(F.lit(40.7000000))) == "40.7"


def test_flexible_dates(spark):
    day = lambda s: one(spark, F.to_date(dates.parse_flexible(F.lit(s))))
    for s in ("2026-02-26", "02/26/2026", "2026-02-26 7:00 PM", "Thursday, February 26, 2026"):
        assert day(s) == dt.date(2026, 2, 26), s
    assert day("soon") is None


def test_weekend_asked_on_a_sunday_is_the_next_one(spark):
    for asked, first in (("2024-01-07", "2024-01-13"), ("2024-01-06", "2024-01-06"), ("2024-01-08", "2024-01-13")):
        w = {r.key: r for r in dates.windows(spark, asked).collect()}
        assert str(w["this_weekend"]["first"]) == first


def test_midnight_row_stays_for_the_day(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, filters.is_past(t("2024-01-05 00:00:00"), "2024-01-05 18:00:00")) is False
    assert one(spark, filters.is_past(t("2024-01-05 09:00:00"), "2024-01-05 18:00:00")) is True
    assert one(spark, filters.next_days(t("2024-01-05 00:00:00"), "2024-01-05 18:00:00", 3)) is False


def test_horizon_and_unknown_costs(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, filters.horizon_label(d("2024-12-31"), "2024-01-01")) == "keep"
    assert one(spark, filters.horizon_label(d("2025-01-01"), "2024-01-01")) == "drop"
    assert one(spark, filters.horizon_label(d(None), "2024-01-01")) == "keep"
    unknown = F.lit(None).cast("double")
    assert one(spark, filters.within(unknown, 5, True)) is True and one(spark, filters.within(unknown, 5, False)) is False


def test_url_parts(spark):
    u = lambda s: (one(spark, text.url_host(F.lit(s))), one(spark, text.url_path(F.lit(s))))
    assert u("HTTP://www.X.org//a//b/?q=1#z") == ("x.org", "/a/b")
    assert u("x.org") == ("x.org", "/")
    assert one(spark, text.feed_key(F.lit("https://www.x.org/A/?B=1"))) == "x.org/a?b=1"
    assert one(spark, F.size(text.host_variants(F.lit("https://www.thefoo.org/x")))) <= 8


def test_keep_best_ties_and_idempotence(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 1.0), ("b", 4, 0.0), (" ", 5, 9.0)], "k string, id int, s double")
    best = dedupe.keep_best(df, "k", F.col("s"), [F.col("id")])
    assert {r.id for r in best.collect()} == {1, 4, 5}
    first = dedupe.keep_first(df, "k", [F.col("id")])
    assert {r.id for r in first.collect()} == {1, 4}
    assert sorted(dedupe.keep_first(first, "k", [F.col("id")]).collect()) == sorted(first.collect())


def test_conflicts_are_strict_and_all_day_counts_once(spark):
    t = lambda h, d=5: dt.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, 1, t(10), t(12)), (1, 2, t(1, 6), t(3, 6))], "u int, k int, start timestamp_ntz, end timestamp_ntz")
    right = spark.createDataFrame(
        [(1, 10, t(12), t(13), False), (1, 11, t(11), t(23), False), (1, 12, t(0), t(0, 8), True), (1, 13, t(9), t(11), None)],
        "u int, o int, start timestamp_ntz, end timestamp_ntz, all_day boolean",
    )
    got = sorted((r.k, r.o) for r in joins.overlaps(left, right, "u", "k", "o").collect())
    assert got == [(1, 11), (1, 12), (1, 13)]


def test_relevance_fallbacks(spark):
    def kept(scores, shared=False):
        rows = [("g", i, s) for i, s in enumerate(scores)]
        return sorted(r.score for r in joins.relevant(spark.createDataFrame(rows, "g string, i int, score int"), "g", "i", 20, shared).collect())

    assert kept([0, 0]) == [0, 0]
    assert kept([11, 0, 0]) == []
    assert kept([12, 1, 2, 3, 4, 0, 0, 0]) == [1, 2, 3, 4, 12]
    assert kept([35, 19]) == [35]
    assert kept([0], shared=True) == []


def test_updates_tell_absent_from_blank(spark):
    stored = spark.createDataFrame([("a", "x", "y")], "k string, p string, q string")
    updates = spark.createDataFrame([("a", 1, "1", None), ("a", 2, "", None)], "k string, n int, p string, q string")
    out = merges.update_fields(stored, updates, "k", "n", ["p", "q"]).first()
    assert (out.p, out.q) == ("", "y")
    assert merges.update_fields(merges.update_fields(stored, updates, "k", "n", ["p", "q"]), updates, "k", "n", ["p", "q"]).first() == out


def test_query_tokens(spark):
    q = spark.createDataFrame([(1, "talks in the cities"), (2, "a of")], "q int, t string")
    got = {(r.q, r.token) for r in ranking.query_tokens(q, "q", "t").collect()}
    assert {(1, "talk"), (1, "lecture"), (1, "city"), (1, "citie")} <= got and not [g for g in got if g[0] == 2]


def test_chunks_cover_the_text():
    t = "word " * 900
    parts = udfs.chunk_text(t, 500, 50, 1000)
    assert parts[0][:5] == "word " and parts[-1] == t[-len(parts[-1]) :] and all(len(p) <= 500 for p in parts)
    at = 0
    for p in parts:
        at = t.index(p, max(0, at - 500)) if p not in t[at : at + len(p)] else at
    assert udfs.chunk_text("", 10, 1, 5) == [] and len(udfs.chunk_text(t, 100, 10, 3)) == 3


def test_python_functions(spark):
    ship_package(spark)
    assert round(one(spark, udfs.match_ratio(F.lit("abcd"), F.lit("bcde"))), 2) == 75.0
    assert one(spark, udfs.html_unescape(F.lit("&eacute;&#233;"))) == "éé"


def test_best_page_stops_at_the_first_good_one(spark):
    df = spark.createDataFrame([("s", 1, 9), ("s", 2, 18), ("s", 3, 40), ("t", 1, 7), ("u", 1, 9), ("u", 2, 9)], "s string, n int, score int")
    assert {(r.s, r.n) for r in extract.best_page(df, "s", "n", "score").collect()} == {("s", 2), ("u", 1)}


def test_cosine_and_ladder_beyond_one_block(spark, monkeypatch):
    from eventlake.operators import joins, ranking

    names = spark.createDataFrame([(i, f"n{i % 30:02d}") for i in range(90)] + [(99, "zn07z")], "id long, name string")
    asked = spark.createDataFrame([("n03",), ("n07",), ("an11b",), ("n",), ("qq",)], "q string")
    vectors = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 5), 1.0]) for i in range(60)], "id long, v array<double>")
    queries = vectors.select(vectors.id.alias("q"), vectors.v.alias("e"))

    def both():
        found = joins.ladder(asked.withColumn("k", asked.q), "k", "q", names, "name", "id").collect()
        return sorted(map(tuple, found)), sorted((r.q, r.id) for r in ranking.cosine_top(vectors, "id", "v", queries, "q", "e", 3).collect())

    whole = both()
    assert whole[0] == [("an11b", 71, "partial"), ("n", 99, "partial"), ("n03", 3, "exact"), ("n07", 7, "exact"), ("qq", None, "stub")]
    monkeypatch.setattr(ranking, "PART_ROWS", 4)
    monkeypatch.setattr(ranking, "PART_QUERIES", 16)
    assert both() == whole
