"""Queries on joins and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import match_ratio
from ..operators import joins as j
from ..operators import merges as m
from .registry import query, table


@query("""WITH b AS (SELECT c_mktsegment AS k, min_by(c_name, c_custkey) AS v FROM customer GROUP BY 1)
 SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE b.v END AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN b ON b.k = c_mktsegment""")
def d1_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("k1", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey"))).withColumn("k2", F.col("c_mktsegment"))
    by_id = j.first_per_key(c.withColumnRenamed("c_name", "place"), "c_custkey", "place", "c_custkey")
    by_segment = j.first_per_key(c.withColumnRenamed("c_name", "place"), "c_mktsegment", "place", "c_custkey")
    return j.lookup(o.select("o_orderkey", "k1", "k2"), ["k1", "k2"], [by_id, by_segment], "place").select("o_orderkey", "place")


_HP = "replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), 'www.', '') AS h, CASE WHEN regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') END AS p"


@query(f"""WITH u AS (SELECT page_id, {_HP} FROM pages), k AS (SELECT h, CASE WHEN page_id % 10 = 0 THEN '/' || split_part(p, '/', 2) ELSE p END AS p, page_id AS v FROM u WHERE page_id % 5 = 0),
 g AS (SELECT h, p, min(v) AS v FROM k GROUP BY ALL), hosts AS (SELECT h, min(v) AS v FROM k GROUP BY 1 HAVING min(v) = max(v)),
 c AS (SELECT page_id, g.v, u.p = g.p AS exact, length(g.p) AS l FROM u JOIN g ON u.h = g.h AND (u.p = g.p OR (g.p <> '/' AND starts_with(u.p, g.p || '/')))),
 b AS (SELECT page_id, max_by(v, l) AS v, bool_or(exact) AS exact FROM c GROUP BY 1)
 SELECT u.page_id, coalesce(b.v, hosts.v) AS place, CASE WHEN b.exact THEN 'exact' WHEN b.v IS NOT NULL THEN 'prefix' WHEN hosts.v IS NOT NULL THEN 'host' END AS how
 FROM u LEFT JOIN b USING (page_id) LEFT JOIN hosts USING (h)""")
def d2_url_cascade(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    lang = F.regexp_extract("url", r"^(https?://[^/?#]*/[^/?#]*)", 1)
    known = p.filter("page_id % 5 = 0").select(F.when(F.col("page_id") % 10 == 0, lang).otherwise(F.col("url")).alias("url"), F.col("page_id").alias("place"))
    return j.url_cascade(p, "page_id", "url", known, "place")


@query("""SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (VALUES ('red'), ('small ring'), ('a green bolt set')) t(x) WHERE contains(p_name, x) OR contains(x, p_name))""")
def d3_containment(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("red",), ("small ring",), ("a green bolt set",)], "x string")
    return j.containing(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", terms, "x").select("p_partkey")


@query()
def d4_fuzzy_category(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(1, "smal rings"), (2, "red widgets"), (3, "green")], "ord int, term string")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    best = j.best_term(p, "p_name", terms, "term", "ord", match_ratio("p_name", "term"), 72)
    return p.join(best, "p_name").select("p_partkey", "term", "score")


@query("""WITH n AS (SELECT DISTINCT lower(name) AS name FROM (SELECT p_name AS name FROM part UNION ALL SELECT split_part(text, ' ', 3) FROM documents) WHERE regexp_full_match(lower(name), '[a-z0-9]+( [a-z0-9]+)?')),
 w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS name FROM w)
 SELECT doc_id, name FROM g JOIN n USING (name)""")
def d5_mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(docs.select(F.get(F.split("text", " "), F.lit(2)).alias("name")))
    names = names.filter(F.rlike(F.lower("name"), F.lit("^[a-z0-9]+( [a-z0-9]+)?$")))
    return j.mentions(docs, "doc_id", F.col("text"), names, "name", 2)


@query("""WITH w AS (SELECT source, doc_id, text, list_distinct(string_split(lower(text), ' ')) AS w FROM documents WHERE text IS NOT NULL),
 t AS (SELECT source, unnest(['the', 'and', 'of', 'der', 'la', 'to']) AS token FROM (SELECT DISTINCT source FROM documents)),
 m AS (SELECT source, doc_id, count(*) AS m FROM (SELECT source, doc_id, unnest(w) AS token FROM w) JOIN t USING (source, token) GROUP BY ALL),
 s AS (SELECT w.source, w.doc_id, CASE WHEN contains(lower(text), 'thethe') THEN 60 ELSE 0 END + least(coalesce(m, 0) * 8, 40) + CASE WHEN w.doc_id % 7 = 0 THEN 15 ELSE 0 END AS score FROM w LEFT JOIN m ON w.doc_id = m.doc_id AND w.source = m.source),
 x AS (SELECT *, max(score) OVER p AS best, count(*) OVER p AS n, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM s WINDOW p AS (PARTITION BY source))
 SELECT source, doc_id, score FROM x WHERE CASE WHEN best >= 35 THEN score >= 35 ELSE n <= 2 OR (best >= 12 AND r <= 5) END""")
def d6_relevance(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("source", "doc_id", F.lower("text").alias("t")).withColumn("words", F.split("t", " "))
    tokens = docs.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ["the", "and", "of", "der", "la", "to"]))).alias("token"))
    scored = j.relevance(tokens, docs, "source", "doc_id", F.contains("t", F.lit("thethe")), F.col("doc_id") % 7 == 0)
    return j.relevant(scored, "source", "doc_id", 35, shared=False)


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey * 7 % 45 AS score, o_custkey % 4 = 0 AND o_orderpriority = '1-URGENT' AS shared, o_custkey % 5 = 0 AND o_orderstatus = 'F' AS reg, o_orderkey % 2 = 0 AS same FROM orders),
 x AS (SELECT *, max(score) OVER p AS best, count(*) OVER p AS n, bool_or(shared) OVER p AS sh, bool_or(reg) OVER p AS re, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS r FROM s WINDOW p AS (PARTITION BY o_custkey))
 SELECT o_custkey, o_orderkey, CASE WHEN re THEN 100 ELSE score END AS score FROM x
 WHERE CASE WHEN re THEN same WHEN best >= CASE WHEN sh THEN 35 ELSE 20 END THEN score >= CASE WHEN sh THEN 35 ELSE 20 END ELSE NOT sh AND (n <= 2 OR (best >= 12 AND r <= 5)) END""")
def d6_relevance_by_feed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("score", F.col("o_orderkey") * 7 % 45)
    shared = (F.col("o_custkey") % 4 == 0) & (F.col("o_orderpriority") == "1-URGENT")
    registry = (F.col("o_custkey") % 5 == 0) & (F.col("o_orderstatus") == "F")
    return j.relevant_by_feed(o, "o_custkey", "o_orderkey", shared, registry, F.col("o_orderkey") % 2 == 0)


_ARTIST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '\s+(live|tour|concert|presents?)$', ''), '^the\s+', ''), '[^a-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')"


@query(f"""WITH k AS (SELECT split_part(p_name, ' ', 2) AS a FROM part UNION SELECT p_name FROM part WHERE p_size % 7 = 0 UNION SELECT p_brand FROM part WHERE p_size < 10 UNION SELECT 'The Red!'),
 c AS (SELECT DISTINCT {_ARTIST.format('a')} AS a FROM k WHERE trim({_ARTIST.format('a')}) <> ''), q AS (SELECT DISTINCT {_ARTIST.format("p_name || ' Live'")} AS q FROM part),
 n AS (SELECT q, a, row_number() OVER (PARTITION BY q ORDER BY length(a) DESC, a) AS r FROM q, c WHERE contains(q, a) AND (length(a) > 3 OR contains(' ' || q || ' ', ' ' || a || ' ')))
 SELECT p_partkey, CASE WHEN l.a IS NOT NULL THEN p_brand ELSE n.a END AS matched FROM part LEFT JOIN c l ON l.a = {_ARTIST.format('p_brand')} LEFT JOIN n ON n.r = 1 AND n.q = {_ARTIST.format("p_name || ' Live'")}""")
def d5_artist_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    known = p.select(F.get(F.split("p_name", " "), F.lit(1)).alias("a")).union(p.filter("p_size % 7 = 0").select("p_name"))
    known = known.union(p.filter("p_size < 10").select("p_brand")).union(p.limit(1).select(F.lit("The Red!")))
    rows = p.select("p_partkey", F.concat("p_name", F.lit(" Live")).alias("p_name"), F.array(F.lit("nobody"), F.col("p_brand")).alias("artists"))
    return j.artist_match(rows, "p_partkey", "p_name", "artists", known, "a")


@query("""WITH l AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 2 HOURS AS e FROM events WHERE event_type = 'purchase'),
 r AS (SELECT event_id AS other, user_id, CASE WHEN event_id % 9 = 0 THEN date_trunc('day', ts) ELSE ts END AS s, CASE WHEN event_id % 9 = 0 THEN date_trunc('day', ts) + INTERVAL 1 DAY ELSE ts + INTERVAL 1 HOUR END AS e, event_id % 9 = 0 AS a FROM events WHERE event_type <> 'purchase')
 SELECT event_id, other FROM l JOIN r USING (user_id) WHERE epoch_us(l.s) // 1000000 < epoch_us(r.e) // 1000000 AND epoch_us(r.s) // 1000000 < epoch_us(l.e) // 1000000 AND (NOT a OR l.s >= r.s)""")
def d7_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    right = e.filter("event_type <> 'purchase'").select(
        "user_id", F.col("event_id").alias("other"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"), (F.col("event_id") % 9 == 0).alias("all_day")
    )
    return j.overlaps(left, right, "user_id", "event_id", "other")


@query("""SELECT event_id, event_type, user_id % 101 AS score FROM events WHERE event_id % 17 = 0 ORDER BY score DESC, event_id LIMIT 40""")
def d8_scored_back(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    scores = e.filter("event_id % 17 = 0").select("event_id", (F.col("user_id") % 101).alias("score")).unionByName(e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(999).cast("long").alias("score")))
    return j.scored_back(e, scores, "event_id", 40).select("event_id", "event_type", "score")


@query("""SELECT l_orderkey, l_linenumber, p_size AS minutes, p_partkey IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) ON l_partkey = p_partkey""")
def d9_enrich(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("minutes"))
    rows, missing = j.enrich(table(spark, d, "lineitem"), "l_partkey", cache, "minutes")
    return rows.join(missing.withColumn("missing", F.lit(True)), "l_partkey", "left").select("l_orderkey", "l_linenumber", "minutes", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("""SELECT s_suppkey, coalesce(c_name, s_name) AS address, CASE WHEN c_name IS NULL THEN 'not_found' ELSE 'verified' END AS status FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON s_suppkey = c_custkey""")
def d10_authoritative(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    s = table(spark, d, "supplier").join(found, "s_suppkey", "left")
    return s.select("s_suppkey", F.coalesce("c_name", "s_name").alias("address"), F.when(F.col("c_name").isNull(), "not_found").otherwise("verified").alias("status"))


@query("""WITH s AS (SELECT p_name AS s, max(p_partkey) AS id, min(p_partkey) AS lo FROM part GROUP BY 1), q AS (SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT 'zzz'),
 m AS (SELECT q, CASE WHEN bool_or(q = s) THEN min(CASE WHEN q = s THEN lo END) ELSE max(id) END AS id, max(CASE WHEN q = s THEN 1 ELSE 0 END) AS exact FROM q JOIN s ON contains(q, s) OR contains(s, q) GROUP BY 1)
 SELECT q, id, CASE WHEN exact = 1 THEN 'exact' WHEN exact = 0 THEN 'partial' ELSE 'stub' END AS how FROM q LEFT JOIN m USING (q)""")
def d11_ladder(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    asked = p.select(F.col("p_name").alias("q")).union(p.select(F.get(F.split("p_name", " "), F.lit(1)))).union(p.limit(1).select(F.lit("zzz"))).distinct().withColumn("k", F.col("q"))
    return j.ladder(asked, "k", "q", p, "p_name", "p_partkey").select(F.col("k").alias("q"), F.col("p_partkey").alias("id"), "how")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 30 = 0)
 SELECT k, CASE WHEN o.n IS NULL THEN 'primary' ELSE 'both' END AS origin FROM p LEFT JOIN o USING (k) UNION ALL
 SELECT * FROM (SELECT k, 'secondary' FROM o ANTI JOIN p USING (k) ORDER BY n DESC, k LIMIT (SELECT greatest(0, 200 - count(*)) FROM p))""")
def d12_combine(spark: SparkSession, d: str) -> DataFrame:
    primary = table(spark, d, "customer").filter("c_custkey % 30 = 0").select(F.col("c_custkey").alias("k"))
    secondary = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return j.combine(primary, secondary, "k", F.desc("n"), 200, primary.count())


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0) GROUP BY 1""")
def d13_new_only(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    new = o.join(o.filter("o_orderkey % 11 = 0").select("o_custkey"), "o_custkey", "left_anti")
    return new.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS in_index, CASE WHEN l.doc_id IS NOT NULL THEN '2024-02-01' END AS indexed_at FROM documents d LEFT JOIN labels l USING (doc_id)""")
def d14_membership(spark: SparkSession, d: str) -> DataFrame:
    return j.flag_members(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id", F.lit("2024-02-01"))


@query("""SELECT doc_id, vec_id IS NOT NULL AND doc_id % 4 <> 0 AS reused FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def d15_vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha1(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select("doc_id", digest.alias("digest"), F.col("doc_id").alias("k"))
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding").join(docs.select("k", "digest"), "k")
    stored = stored.withColumn("digest", F.when(F.col("k") % 4 == 0, "old").otherwise(F.col("digest")))
    return j.reuse_vectors(docs, stored, "k", "digest", "embedding").select("doc_id", "reused")


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'new' ELSE 'old' END AS origin FROM orders WHERE o_orderkey % 2 = 0 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def g1_choose_source(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rule = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "fetched").when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("fresh")
    status = o.select("o_orderpriority").distinct().withColumn("status", rule)
    return m.choose_source(status, o.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("new")), o.withColumn("origin", F.lit("old")), "o_orderpriority").select("o_orderkey", "o_orderpriority", "origin")


@query("""SELECT CASE WHEN c IS NOT NULL AND o IS NOT NULL THEN 'both' WHEN c IS NOT NULL THEN 'left' ELSE 'right' END AS side, count(*) AS n
 FROM (SELECT c_custkey AS c FROM customer WHERE c_custkey % 4 <> 0) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderkey % 5 = 0) ON c = o GROUP BY 1""")
def g2_compare(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return m.compare(left, table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH u AS (SELECT o_custkey AS c_custkey, max_by(o_orderpriority, o_orderkey) AS seg, max_by(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS name FROM orders GROUP BY 1)
 SELECT c_custkey, coalesce(name, c_name) AS c_name, coalesce(seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN u USING (c_custkey)""")
def g3_update_fields(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("c_name"), F.col("o_orderpriority").alias("c_mktsegment")
    )
    return m.update_fields(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), u, "c_custkey", "o_orderkey", ["c_name", "c_mktsegment"])


@query("""SELECT coalesce(s_suppkey, k) AS k, CASE WHEN s_suppkey IS NULL OR s_suppkey % 3 = 0 THEN n ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN 'added' WHEN s_suppkey % 3 = 0 AND n IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
 FROM supplier FULL JOIN (SELECT n_nationkey * 5 AS k, n_name AS n FROM nation) ON s_suppkey = k""")
def g4_fill_blanks(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("name"))
    return m.fill_blanks(stored, table(spark, d, "nation").select((F.col("n_nationkey") * 5).cast("long").alias("k"), F.col("n_name").alias("name")), "k", ["name"])


@query("""SELECT o_orderkey, '2024-01-01' AS date_added FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, '2024-02-01' FROM orders WHERE o_orderkey % 3 = 1""")
def g5_insert_new(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    stored = o.filter("o_orderkey % 3 = 0").withColumn("date_added", F.lit("2024-01-01"))
    incoming = o.filter("o_orderkey % 3 < 2")
    return m.insert_new(stored, incoming.unionByName(incoming), "o_orderkey", "o_custkey", F.lit("2024-02-01")).select("o_orderkey", "date_added")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def g6_set_where(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return m.set_where(table(spark, d, "orders"), keys, "o_custkey", {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)}).select("o_orderkey", "o_orderstatus", "o_totalprice")
