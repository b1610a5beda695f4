"""Lookups and matches: normalised keys, path prefixes, containment, mentions, intervals, ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name, url_host, url_path
from .matching import alike_pairs, contained_pairs


def first_per_key(df: DataFrame, key: str, value: str, order: str, last: bool = False) -> DataFrame:
    """key, value of the first (or last) row by order that has a value."""
    pick = F.max_by if last else F.min_by
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(pick(value, order).alias(value))


def lookup(df: DataFrame, keys: list[str], tables: list[DataFrame], value: str) -> DataFrame:
    """df with value from the first of several keyed tables (key, value) that knows the row's key for it."""
    found = []
    for i, (key, t) in enumerate(zip(keys, tables)):
        df = df.join(t.select(F.col(t.columns[0]).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(value, F.coalesce(*found)).drop(*(f"_{x}{i}" for i in range(len(keys)) for x in "kv"))


def path_prefixes(path: Column) -> Column:
    """`/a/b` gives `/a`, `/a/b`; the root alone gives itself."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) > 0, made).otherwise(F.array(F.lit("/")))


def url_cascade(df: DataFrame, key: str, url: str, known: DataFrame, value: str) -> DataFrame:
    """key, value, how: by exact host and path, else the longest known path prefix (the root matches itself alone), else
    the host's value if it has only one. known: url, value. Prefixes are exploded, so all three are equi joins."""
    k = known.select(url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p"), F.col(value).alias("v")).filter("v IS NOT NULL")
    pages = k.groupBy("h", "p").agg(F.min("v").alias("v"))
    hosts = k.groupBy("h").agg(F.min("v").alias("v"), F.max("v").alias("top")).filter("v = top").select("h", F.col("v").alias("host_v"))
    probe = df.select(F.col(key), url_host(F.col(url)).alias("h"), url_path(F.col(url)).alias("path"))
    steps = probe.select(key, "h", "path", F.explode(path_prefixes(F.col("path"))).alias("p"))
    best = steps.join(pages, ["h", "p"]).groupBy(key).agg(F.max_by("v", F.length("p")).alias("page_v"), F.max(F.col("p") == F.col("path")).alias("exact"))
    out = probe.join(best, key, "left").join(hosts, "h", "left")
    how = F.when(F.col("exact"), "exact").when(F.col("page_v").isNotNull(), "prefix").when(F.col("host_v").isNotNull(), "host")
    return out.select(key, F.coalesce("page_v", "host_v").alias(value), how.alias("how"))


def containing(df: DataFrame, column: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows whose value contains a term or is contained in one, neither empty; see contained_pairs."""
    v, t = df.select(F.col(column).alias("_v")), terms.select(F.col(term).alias("_t"))
    hit = contained_pairs(t, "_t", v, "_v").select("_v").unionByName(contained_pairs(v, "_v", t, "_t").select("_v"))
    return df.join(hit, F.col(column) == F.col("_v"), "left_semi")


def best_term(df: DataFrame, column: str, terms: DataFrame, term: str, order: str, ratio: Column, least: float) -> DataFrame:
    """column, term, score: the best term of each distinct value at or above least; of equals the first by order. ratio
    is a matching-blocks ratio; only pairs that can reach least are scored (see alike_pairs)."""
    pairs = alike_pairs(df, column, terms, term, least).join(terms.groupBy(term).agg(F.min(order).alias(order)), term)
    scored = pairs.withColumn("score", ratio).filter(F.col("score") >= least)
    return scored.groupBy(column).agg(F.max_by(term, F.struct("score", -F.col(order))).alias(term), F.max("score").alias("score"))


def mentions(df: DataFrame, key: str, text: str, names: DataFrame, name: str, max_words: int) -> DataFrame:
    """key, name: names that occur as whole words of a text, by exploded word n-grams and an equi join."""
    w = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), " "), lambda x: x != "")
    words = df.select(key, w.alias("w")).filter(F.size("w") > 0)
    grams = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(max_words)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " ")))
    )
    each = words.select(key, F.explode(F.array_distinct(grams)).alias(name))
    return each.join(names.select(F.lower(name).alias(name)).filter(F.length(name) > 0).distinct(), name).select(key, name).distinct()


def relevance(tokens: DataFrame, hay: DataFrame, group: str, item: str, named: Column, domain: Column) -> DataFrame:
    """group, item, score: 60 for the name, 8 for each matched token up to 40, 15 for the domain. tokens: group, token;
    hay: group, item, words (array) and what named and domain need."""
    own = tokens.groupBy(group).agg(F.collect_set("token").alias("_tokens"))  # a group's few words; texts are not exploded
    matched = F.size(F.array_intersect(F.coalesce("words", F.array()), F.coalesce("_tokens", F.array())))
    score = named.cast("int") * 60 + F.least(matched * 8, F.lit(40)) + domain.cast("int") * 15
    return hay.join(own, group, "left").select(group, item, score.cast("int").alias("score"))


def relevant(scored: DataFrame, group: str, item: str, least: int, shared: bool) -> DataFrame:
    """Items at or above least. A group without any: none if the feed is shared, all if it has at most two, else its top
    five if the best reaches 12."""
    # Group figures are combined before the shuffle and the top five pruned within tasks: a group of any size is fine.
    figures = scored.groupBy(group).agg(F.max("score").alias("best"), F.count("*").alias("n"))
    s = scored.join(figures, group)
    few = F.lit(not shared) & (F.col("n") <= 2)
    kept = s.filter(F.when(F.col("best") >= least, F.col("score") >= least).otherwise(few)).select(group, item, "score")
    if shared:
        return kept
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), item))
    rest = s.filter((F.col("best") < least) & (F.col("n") > 2) & (F.col("best") >= 12))
    return kept.unionByName(rest.withColumn("rank", rank).filter("rank <= 5").select(group, item, "score"))


def relevant_by_feed(scored: DataFrame, group: str, item: str, shared: Column, registry: Column, same: Column) -> DataFrame:
    """group, item, score of the items kept. A group with an item from a place registry keeps only those of the same
    place, with score 100. Else the least score is 35 if one of its items is from a shared feed, and 20 otherwise, and
    the rules of `relevant` hold for a group that has nothing at or above it."""
    marked = scored.withColumns({"_s": shared, "_r": registry, "_same": F.coalesce(same, F.lit(False))})
    figures = marked.groupBy(group).agg(
        F.max("score").alias("_best"), F.count("*").alias("_n"), F.bool_or("_s").alias("_shared"), F.bool_or("_r").alias("_registry")
    )
    j = marked.join(figures, group).withColumn("_least", F.when(F.col("_shared"), 35).otherwise(20))
    exact = j.filter("_registry AND _same").select(group, item, F.lit(100).alias("score"))
    others = j.filter("NOT _registry")
    kept = others.filter("if(_best >= _least, score >= _least, NOT _shared AND _n <= 2)").select(group, item, "score")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), item))
    rest = others.filter("_best < _least AND NOT _shared AND _n > 2 AND _best >= 12")
    return exact.unionByName(kept).unionByName(rest.withColumn("_rank", rank).filter("_rank <= 5").select(group, item, "score"))


def artist_match(df: DataFrame, key: str, name: str, artists: str, known: DataFrame, artist: str) -> DataFrame:
    """key, matched: the first listed artist that is known, as listed; else the longest known artist (of equals the
    alphabetically first) that occurs in the event's name: anywhere if it has more than three characters, as whole words
    otherwise; else null. All names are compared in their artist form; empty forms match nothing."""
    form = lambda c: normalize_name(F.col(c), "artist")
    k = known.select(form(artist).alias("_a")).filter("trim(_a) <> ''").distinct()
    listed = df.select(key, F.posexplode(artists).alias("_nth", "_said")).join(k, form("_said") == F.col("_a"))
    first = listed.groupBy(key).agg(F.min_by("_said", "_nth").alias("_listed"))
    names = df.select(form(name).alias("_q")).distinct()
    words = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    j = contained_pairs(k, "_a", names, "_q").filter((F.length("_a") > 3) | F.contains(words("_q"), words("_a")))
    found = j.groupBy("_q").agg(F.min_by("_a", F.struct(-F.length("_a"), "_a")).alias("_found"))
    out = df.select(key, form(name).alias("_q")).join(found, "_q", "left").join(first, key, "left")
    return out.select(key, F.coalesce("_listed", "_found").alias("matched"))


def overlaps(left: DataFrame, right: DataFrame, by: str, key: str, other: str, bucket_s: int = 21600) -> DataFrame:
    """key, other of rows of one group whose spans [start, end) overlap strictly; an all-day row of right meets what
    begins on its first day. Spans are exploded to time buckets for an equi join; a pair is taken from the bucket where
    the later one begins, so that none comes twice."""
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    cut = lambda df: df.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / bucket_s), F.floor((F.col("e") - 1) / bucket_s))))
    x = left.select(F.col(by), F.col(key), sec("start").alias("s"), sec("end").alias("e"))
    day = F.unix_seconds(F.date_trunc("day", F.col("start").cast("timestamp")))
    y = right.select(
        F.col(by),
        F.col(other),
        F.when(F.col("all_day"), day).otherwise(sec("start")).alias("s"),
        F.when(F.col("all_day"), day + 86400).otherwise(sec("end")).alias("e"),
        F.coalesce("all_day", F.lit(False)).alias("all_day"),
    )
    a, b = cut(x).alias("a"), cut(y).alias("b")
    j = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.b") == F.col("b.b")))
    meets = (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")) & (~F.col("b.all_day") | (F.col("a.s") >= F.col("b.s")))
    once = F.col("a.b") == F.floor(F.greatest("a.s", "b.s") / bucket_s)
    return j.filter(meets & once).select(F.col(f"a.{key}").alias(key), F.col(f"b.{other}").alias(other))


def scored_back(df: DataFrame, scores: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with scores joined by key, unknown keys dropped, best first, at most n."""
    return df.join(scores, key).orderBy(F.desc("score"), key).limit(n)


def enrich(df: DataFrame, key: str, cache: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """df with value from cache (key, value), null where unresolved; and the distinct keys still to be looked up."""
    missing = df.select(key).distinct().join(cache, key, "left_anti")
    return df.join(cache.select(key, value), key, "left"), missing


def ladder(df: DataFrame, key: str, name: str, stored: DataFrame, stored_name: str, ident: str, order: str | None = None) -> DataFrame:
    """key, ident, how: exact name, else the last partial one (stored inside asked or asked inside stored), else a stub;
    an empty name is a stub. First and last are by order, or by ident where there is none."""
    row = F.struct(F.col(order or ident).alias("o"), F.col(ident).alias("i"))
    s = stored.groupBy(F.col(stored_name).alias("_s")).agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"))
    asked = df.select(F.col(name).alias("_q")).distinct()
    met = contained_pairs(asked, "_q", s, "_s").unionByName(contained_pairs(s, "_s", asked, "_q")).join(s, "_s")
    same = F.col("_s") == F.col("_q")
    best = met.groupBy("_q").agg(F.min(F.when(same, F.col("_lo"))).alias("_same"), F.max("_hi").alias("_part"))
    how = F.when(F.col("_same").isNotNull(), "exact").when(F.col("_part").isNotNull(), "partial").otherwise("stub")
    return df.select(key, F.col(name).alias("_q")).join(best, "_q", "left").select(key, F.coalesce("_same.i", "_part.i").alias(ident), how.alias("how"))


def combine(primary: DataFrame, secondary: DataFrame, key: str, rank: Column, slots: int, primary_rows: int) -> DataFrame:
    """key, origin: all of primary (`both` if secondary has it), then the best of secondary to fill up slots."""
    mark = secondary.select(key).distinct().withColumn("_in", F.lit(True))
    a = primary.join(mark, key, "left").select(key, F.when(F.col("_in"), "both").otherwise("primary").alias("origin"))
    rest = secondary.join(primary, key, "left_anti").orderBy(rank, key).limit(max(0, slots - primary_rows))
    return a.unionByName(rest.select(key, F.lit("secondary").alias("origin")))


def flag_members(df: DataFrame, members: DataFrame, key: str, at: Column) -> DataFrame:
    """df with in_index and indexed_at."""
    m = members.select(key).distinct().withColumn("in_index", F.lit(True))
    out = df.join(m, key, "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    return out.withColumn("indexed_at", F.when(F.col("in_index"), at))


def reuse_vectors(rows: DataFrame, stored: DataFrame, key: str, digest: str, vector: str) -> DataFrame:
    """rows with the stored vector where key and digest are the same, and `reused`."""
    old = stored.select(key, digest, vector)
    return rows.join(old, [key, digest], "left").withColumn("reused", F.col(vector).isNotNull())
