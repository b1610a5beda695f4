"""Containment, likeness and ranking by equi joins, against brute force; no nested loop or cartesian join in their plans."""

from __future__ import annotations

import difflib
import io
import random
import re
from contextlib import redirect_stdout

import duckdb
from pyspark.sql import functions as F

from eventlake import plans
from eventlake.functions.udfs import match_ratio
from eventlake.operators import joins, matching, ranking
from eventlake.session import ship_package


def names(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab ") if r.random() < 0.7 else r.choice("cdé%_") for _ in range(r.randint(0, 9))) for _ in range(n)] + ["", None, "a", "%", "_a", "aa", "aaa"]


def strings(spark, values, c):
    return spark.createDataFrame([(v,) for v in values], f"{c} string")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_contained_pairs_equal_brute_force(spark):
    x, y = names(1, 150), names(2, 200)
    got = matching.contained_pairs(strings(spark, x, "n"), "n", strings(spark, y, "h"), "h")
    want = {(a, b) for a in set(x) for b in set(y) if a and b and a in b}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 200
    assert not re.search("NestedLoop|Cartesian", plan(got))


def test_alike_pairs_lose_no_ratio(spark):
    x, y = names(3, 120), names(4, 120)
    for least in (40, 72, 100):
        got = matching.alike_pairs(strings(spark, x, "a"), "a", strings(spark, y, "b"), "b", least)
        rows = {tuple(r) for r in got.collect()}
        all_pairs = {(a, b) for a in set(x) for b in set(y) if a and b}
        want = {(a, b) for a, b in all_pairs if 100 * difflib.SequenceMatcher(None, a, b).ratio() >= least}
        assert want <= rows and len(rows) < len(all_pairs)
        assert not re.search("NestedLoop|Cartesian", plan(got))


def test_best_term_of_more_terms_than_a_block(spark):
    ship_package(spark)
    values, terms = ["small rings", "red widget", "green", "", None, "zzz"], [f"term {i}" for i in range(11_000)] + ["smal rings", "red widgets", "rings small"]
    t = spark.createDataFrame(list(enumerate(terms)), "ord int, term string")
    got = joins.best_term(strings(spark, values, "v"), "v", t, "term", "ord", match_ratio("v", "term"), 72)
    ratio = lambda a, b: 100 * difflib.SequenceMatcher(None, a, b).ratio()
    want = {}
    for v in filter(None, values):
        score, nth = max((ratio(v, x), -i) for i, x in enumerate(terms))
        if score >= 72:
            want[v] = terms[-nth]
    assert {r.v: r.term for r in got.collect()} == want and want["small rings"] == "smal rings"


def test_containing_goes_both_ways(spark):
    rows = strings(spark, ["red widget", "ring", "blue", "", None, "a small ring set"], "v")
    terms = strings(spark, ["red", "small ring", "", None], "t")
    got = joins.containing(rows, "v", terms, "t")
    assert {r.v for r in got.collect()} == {"red widget", "ring", "a small ring set"}


def test_artist_takes_the_longest_then_the_first(spark):
    known = strings(spark, ["red", "Red Widget Band", "red widget", "The U2!", "wid", "  ", None, "blue moon", "moon blue"], "a")
    rows = spark.createDataFrame(
        [(1, "RED Widget band live", None), (2, "the u2 tour", []), (3, "redwid", []), (4, "blue moon blue", ["x", "u2"]), (5, "moon blue moon", ["nobody"]), (6, None, None), (7, "u23", [])],
        "k int, name string, artists array<string>",
    )
    got = {r.k: r.matched for r in joins.artist_match(rows, "k", "name", "artists", known, "a").collect()}
    assert got == {1: "red widget band", 2: "u2", 3: None, 4: "u2", 5: "blue moon", 6: None, 7: None}


def test_ladder_orders_by_its_own_column(spark):
    stored = spark.createDataFrame([(5, 1, "ab x"), (1, 2, "ab y"), (9, 0, "ab"), (7, 3, "cd")], "id int, at int, name string")
    asked = strings(spark, ["ab", "ab z", "b", "", None, "q"], "q").withColumn("k", F.col("q"))
    got = {r.k: (r.id, r.how) for r in joins.ladder(asked, "k", "q", stored, "name", "id", "at").collect()}
    assert got == {"ab": (9, "exact"), "ab z": (9, "partial"), "b": (1, "partial"), "": (None, "stub"), None: (None, "stub"), "q": (None, "stub")}


def test_lexical_scores_equal_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc1") for _ in range(r.randint(1, 4)))
    data = [(i, " ".join(word() for _ in range(3)), f"{word()}-{word()}".upper(), None if i % 5 == 0 else word()) for i in range(60)]
    rows = spark.createDataFrame(data, "id int, a string, b string, c string")
    tokens = [(1, "ab"), (1, "c"), (2, "abc1"), (2, "b"), (3, "zz"), (4, "1")]
    got = ranking.lexical_top(rows, "id", {"name": "a", "type": "b", "text": "c"}, spark.createDataFrame(tokens, "q int, token string"), "q", 12)
    want = []
    for q in {t[0] for t in tokens}:
        score = lambda d: sum(w * (t in (x or "").lower()) for p, t in tokens if p == q for w, x in zip((3.0, 2.5, 1.5), d[1:]))
        best = sorted(data, key=lambda d: (-score(d), d[0]))[:12]
        want += [(q, d[0], score(d), i + 1) for i, d in enumerate(best)]
    assert sorted((x.q, x.id, x.score, x["rank"]) for x in got.collect()) == sorted(want)
    assert not re.search("Cartesian", plan(got))


def test_cosine_grid_ignores_nulls_and_other_lengths(spark):
    ship_package(spark)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0, 1.0, 1.0]), (5, [3.0, 0.0]), (6, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(10, [2.0, 0.0]), (11, None), (12, [1.0, 1.0, 0.0])], "q long, e array<double>")
    got = sorted((r.q, r["rank"], r.id) for r in ranking.cosine_top(v, "id", "v", q, "q", "e", 2).collect())
    assert got == [(10, 1, 1), (10, 2, 5), (12, 1, 4)]
    assert not re.search("NestedLoop|Cartesian", plan(ranking.cosine_top(v, "id", "v", q, "q", "e", 2)))


def test_cosine_ranks_scores_as_rounded(spark, tmp_path):
    """Scores that differ beyond the digits of the SQL are ties, which go to the smaller id."""
    ship_package(spark)
    near = [0.3 + 1e-7 * i for i in range(30)]
    rows = [(100, [1.0, 0.0], 0)] + [(i + 1, [x, (1 - x * x) ** 0.5], 0) for i, x in enumerate(near)] + [(50, [-1.0, 0.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in plans.queries()["i2_cosine"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(con.sql(plans.oracle_sql()["i2_cosine"]).fetchall()) and len(got) == 10
    v, q = (spark.createDataFrame(r, f"{c} long, e array<double>") for r, c in (([(1, [1.0, 1e-4]), (2, [1.0, 0.0])], "id"), ([(9, [1.0, 0.0])], "q")))
    first = lambda digits: ranking.cosine_top(v, "id", "e", q, "q", "e", 1, digits=digits).first().id
    assert (first(12), first(6)) == (2, 1)
