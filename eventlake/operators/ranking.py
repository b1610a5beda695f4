"""Ranking and retrieval: lexical scores, cosine top-k, query specificity, the retrieval ladder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import contained_pairs

#: Rows and queries of one task at most, the least number of parts of the rows, and queries multiplied at a time.
PART_ROWS, PART_QUERIES, MIN_PARTS, STEP = 65_536, 16_384, 8, 256

#: Words that stand for each other, and the weights of the fields.
TALKS = ["talk", "lecture", "panel", "seminar", "discussion", "workshop"]
WEIGHTS = {"name": 3.0, "type": 2.5, "text": 1.5, "venue": 0.5, "date": 0.5}


def query_tokens(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, token: words over two characters, their singular forms, and the talk group if one of it is there."""
    t = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    raw = queries.select(key, t.alias("t")).filter(F.length("t") > 2)
    forms = F.array(
        F.col("t"),
        F.when(F.endswith("t", F.lit("ies")) & (F.length("t") > 4), F.concat(F.expr("left(t, length(t) - 3)"), F.lit("y"))),
        F.when(F.endswith("t", F.lit("s")) & (F.length("t") > 4), F.expr("left(t, length(t) - 1)")),
    )
    tokens = raw.select(key, F.explode(F.array_compact(forms)).alias("token")).distinct()
    talks = tokens.filter(F.col("token").isin(TALKS)).select(key).distinct()
    more = talks.select(key, F.explode(F.array(*map(F.lit, [*TALKS, "presentation"]))).alias("token"))
    return tokens.unionByName(more).distinct()


def lexical_top(rows: DataFrame, ident: str, fields: dict[str, str], tokens: DataFrame, key: str, k: int) -> DataFrame:
    """key, ident, score, rank: the k best rows of each query by weighted substring hits, ties by ident. fields: weight
    name to column. tokens: key, token, of letters a-z and digits as query_tokens makes them.

    A token lies within one word of a field, so each distinct word is matched once and the rows follow by their words;
    rows without a hit are only read for queries that hit fewer than k.
    """
    k = max(1, k)
    hits = lexical_hits(rows, ident, fields, tokens, key)
    best = top_k(hits, key, F.desc("score"), ident, k)
    # At most k - 1 of the first 2k - 1 rows are hits of a query that needs more.
    few = tokens.select(key).distinct().join(best.groupBy(key).agg(F.count("*").alias("n")), key, "left").filter(F.coalesce("n", F.lit(0)) < k).select(key)
    spare = rows.select(ident).orderBy(ident).limit(2 * k).agg(F.collect_list(ident).alias("ids"))
    rest = few.withColumn("one", F.lit(1)).join(spare.withColumn("one", F.lit(1)), "one").select(key, F.explode("ids").alias(ident))
    rest = rest.join(best.select(key, ident), [key, ident], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.drop("rank").unionByName(rest), key, F.desc("score"), ident, k)


def lexical_hits(rows: DataFrame, ident: str, fields: dict[str, str], tokens: DataFrame, key: str) -> DataFrame:
    """key, ident, score of the rows that a query's tokens hit."""
    cut = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    each = F.array(*(F.struct(F.lit(w).alias("f"), cut(c).alias("ws")) for w, c in fields.items()))
    posted = rows.select(ident, F.explode(each).alias("p")).select(ident, "p.f", F.explode("p.ws").alias("word"))
    met = contained_pairs(tokens, "token", posted, "word")
    asked = tokens.distinct().join(met, "token")
    weight = reduce(lambda a, w: a.when(F.col("f") == w, WEIGHTS[w]), list(fields)[1:], F.when(F.col("f") == next(iter(fields)), WEIGHTS[next(iter(fields))]))
    return posted.join(asked, "word").select(key, ident, "token", "f").distinct().groupBy(key, ident).agg(F.sum(weight).alias("score"))


def top_k(scored: DataFrame, key: str | list[str], order: Column, ident: str, k: int) -> DataFrame:
    """Rank within key. Tasks keep k rows for each key before the shuffle."""
    w = Window.partitionBy(key).orderBy(order, ident)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: str | Column) -> Column:
    """The vector divided by its length; a zero vector as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


#: Whether each query (second table) may have each row (first table), as a matrix of queries by rows.
Mask = Callable[[pa.Table, pa.Table], np.ndarray]


def cosine_top(
    vectors: DataFrame, ident: str, vector: str, queries: DataFrame, key: str, query_vector: str, k: int,
    carried: tuple[list[str], list[str]] = ((), ()), mask: Mask | None = None, digits: int = 12,
) -> DataFrame:
    """key, ident, score, rank: exact top k of the given rows (filter them first) for each query. mask tells from columns
    carried from rows and from queries which of them may meet.

    Rows and queries meet in a grid of tasks with a bounded part of each; a task multiplies them as matrices and keeps
    the k best of each query, so no pair is ever a row. Scores are rounded to digits and ranked as rounded, so that ties
    are ties in whatever order a product is summed. Vectors meet those of their own length; null ones take no part.
    """
    more, asks = map(list, carried)
    once = vectors.filter(F.col(vector).isNotNull()).groupBy(ident).agg(F.any_value(F.struct(F.col(vector).alias("v"), *more)).alias("r"))
    once = once.select(ident, "r.*").withColumn("v", unit("v"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select(key, *asks, unit(query_vector).alias("v"))
    a, b = (max(1, -(-d.count() // n)) for d, n in ((once, PART_ROWS), (asked, PART_QUERIES)))
    a = max(a, MIN_PARTS)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = once.select(F.size("v").alias("dim"), ident, *more, "v", part(ident, a).alias("a")).select("*", each(b).alias("b"))
    right = asked.select(F.size("v").alias("dim"), key, *asks, "v", part(key, b).alias("b")).select("*", each(a).alias("a"))

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, q = rows.column(ident), asked.column(key)
        if not len(ids) or not len(q):
            return pa.table({key: q.slice(0, 0), ident: ids.slice(0, 0), "score": pa.array([], pa.float64())})
        dim = rows.column("dim")[0].as_py()
        x, y = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for t in (rows, asked))
        order = np.argsort(ids.to_pylist(), kind="stable")  # so that ties go to the smaller ident
        x, ids, nth, found, scores = x[order], ids.take(pa.array(order)), [], [], []
        rows = rows.take(pa.array(order)) if mask else rows
        for at in range(0, len(y), STEP):
            got = np.round(y[at : at + STEP] @ x.T, digits)
            if mask:
                got[~mask(rows, asked.slice(at, STEP))] = -np.inf
            for i, row in enumerate(got):
                top = np.argsort(-row, kind="stable")[:k]
                top = top[row[top] > -np.inf]
                nth.append(np.full(len(top), at + i)), found.append(top), scores.append(row[top])
        nth, found = pa.array(np.concatenate(nth)), pa.array(np.concatenate(found))
        return pa.table({key: q.take(nth), ident: ids.take(found), "score": np.concatenate(scores)})

    types = {c: d.schema[c].dataType.simpleString() for c, d in ((key, asked), (ident, once))}
    keys = ["dim", "a", "b"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"`{key}` {types[key]}, `{ident}` {types[ident]}, score double")
    return top_k(hits, key, F.desc("score"), ident, k)


#: Phrases by what they constrain, and their weights; a further pattern of a group counts like a phrase.
LEXICON: dict[str, tuple[int, list[str]]] = {
    "category": (2, [
        "music", "concert", "live music", "jazz", "classical", "opera", "comedy", "standup", "improv", "talk", "lecture", "panel",
        "workshop", "film", "movie", "art", "gallery", "museum", "dance", "theater", "theatre", "book", "poetry",
    ]),
    "location": (2, [
        "brooklyn", "manhattan", "queens", "bronx", "staten island", "harlem", "greenpoint", "williamsburg", "soho", "chelsea",
        "lower east side", "upper west side", "upper east side", "midtown", "downtown",
    ]),
    "price": (1, ["free", "cheap", "under $", "under ", "budget", "no cover"]),
    "time": (1, [
        "today", "tomorrow", "tonight", "this weekend", "next weekend", "next week", "this week", "before the end of the month",
        "after", "before", "am", "pm",
    ]),
    "audience": (1, ["kid-friendly", "family", "outdoor", "indoor", "date night", "beginner", "advanced", "networking", "meetup"]),
    "vague": (-2, [
        "what should i attend", "what should i do", "anything", "something", "interesting", "free time", "looking for ideas", "surprise me",
    ]),
}
PATTERNS = {"location": r"\bin\s+[a-z]{3,}", "price": r"\$"}


def specificity(text: Column, lexicon: dict[str, tuple[int, list[str]]] = LEXICON, patterns: dict[str, str] = PATTERNS) -> Column:
    """How constrained a query is: group weights for any phrase or pattern, one less for at most five words."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    score = F.lit(0)
    for group, (weight, phrases) in lexicon.items():
        said = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))
        if group in patterns:
            said = said | F.rlike(t, F.lit(patterns[group]))
        score = score + F.when(said, weight).otherwise(0)
    return score - F.when(F.regexp_count(t, F.lit("[a-z0-9$]+")) <= 5, 1).otherwise(0)


def rule_score(place: Column, saturday: Column, undated: Column) -> Column:
    """50, 30 more for the place, 20 more on the Saturday asked for, 20 less without a date."""
    pick = lambda c, n: F.when(c, n).otherwise(0)
    return F.lit(50) + pick(place, 30) + pick(saturday, 20) - pick(undated, 20)


def retrieve(
    rows: DataFrame, ident: str, fields: dict[str, str], vector: str, queries: DataFrame, key: str, text: str, query_vector: str, k: int, digits: int = 12
) -> DataFrame:
    """key, ident, rank, mode: specific queries (score of 2 and up) with a vector by cosine, the others lexically."""
    q = queries.withColumn("_specific", (specificity(F.col(text)) >= 2) & F.col(query_vector).isNotNull())
    by_vector = cosine_top(rows.filter(F.col(vector).isNotNull()), ident, vector, q.filter("_specific"), key, query_vector, k, digits=digits)
    by_words = lexical_top(rows, ident, fields, query_tokens(q.filter("NOT _specific"), key, text), key, k)
    return by_vector.select(key, ident, "rank", F.lit("vector").alias("mode")).unionByName(by_words.select(key, ident, "rank", F.lit("lexical").alias("mode")))
