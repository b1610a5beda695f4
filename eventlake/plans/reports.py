"""Queries on aggregations, deduplication, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..operators import aggregates as a
from ..operators import dedupe as dd
from ..operators.filters import funnel, latest
from .registry import query, table


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'total' END AS by,
 coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def e1_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.counts_by(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH l AS (SELECT c_custkey, c_mktsegment, max(o_orderdate) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 10 = 0 GROUP BY ALL)
 SELECT c_mktsegment, count(*) FILTER (WHERE t >= TIMESTAMP '2000-01-01') AS fresh, count(*) FILTER (WHERE t < TIMESTAMP '2000-01-01') AS stale, count(*) FILTER (WHERE t IS NULL) AS never, count(*) AS total FROM l GROUP BY 1""")
def e2_freshness(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").filter("o_orderkey % 10 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("t"))
    j = table(spark, d, "customer").join(last, "c_custkey", "left")
    return a.freshness_rollup(j, "c_mktsegment", F.col("t"), F.lit("2000-01-01").cast("timestamp_ntz"))


@query("""SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS n_known FROM part GROUP BY 1""")
def e3_facets(spark: SparkSession, d: str) -> DataFrame:
    return a.facets(table(spark, d, "part"), "p_type", F.col("p_size") > 25)


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_known FROM orders GROUP BY 1""")
def e4_status(spark: SparkSession, d: str) -> DataFrame:
    return a.facets(table(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey") % 3 == 0)


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 2 GROUP BY ALL)
 SELECT o_orderstatus, count(*) FILTER (WHERE n > 0) AS non_empty, count(*) FILTER (WHERE n = 0) AS empty, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY 1""")
def e5_run_summary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).count()
    j = table(spark, d, "orders").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return j.groupBy("o_orderstatus").agg(F.count_if(F.col("n") > 0).alias("non_empty"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("total"))


@query("""SELECT o_custkey, extract(year FROM o_orderdate) AS part, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY ALL""")
def e6_lists(spark: SparkSession, d: str) -> DataFrame:
    out = a.lists_by(table(spark, d, "orders"), "o_custkey", F.year("o_orderdate").cast("long"), F.col("o_orderkey"))
    return out.select("o_custkey", "part", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("""SELECT l_partkey AS element, count(*) AS n, min(l_orderkey) AS first FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, element LIMIT 50""")
def e7_top_elements(spark: SparkSession, d: str) -> DataFrame:
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))  # an order's few lines
    return a.top_elements(arrays, "parts", "l_orderkey", 3, 50)


@query("""WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS lang FROM pages)
 SELECT host, min(lang) AS lang FROM h GROUP BY 1 HAVING count(DISTINCT lang) = 1""")
def e8_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1).alias("lang"))
    return a.unambiguous(h, "host", "lang")


@query("""SELECT round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS share, min(n_chars) AS lowest, max(n_chars) AS highest, avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) < 0.85 AS low FROM documents d LEFT JOIN labels l USING (doc_id)""")
def e9_coverage(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("in")), "doc_id", "left")
    return a.coverage(j, F.coalesce("in", F.lit(False)).cast("int"), F.col("n_chars")).withColumn("share", F.round("share", 6))


@query("""SELECT count(*) FILTER (WHERE p_partkey IS NOT NULL) AS cached, count(*) FILTER (WHERE p_partkey IS NULL) AS uncached, CAST(round(count(*) FILTER (WHERE p_partkey IS NULL) * 0.005, 4) AS DOUBLE) AS price
 FROM (SELECT DISTINCT l_partkey FROM lineitem) l LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) p ON l_partkey = p_partkey""")
def e10_cost_preview(spark: SparkSession, d: str) -> DataFrame:
    need = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    have = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull()
    return need.join(have, "k", "left").agg(F.count_if(hit).alias("cached"), F.count_if(~hit).alias("uncached"), F.round(F.count_if(~hit) * 0.005, 4).alias("price"))


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'not_ready' WHEN o_totalprice > 400000 THEN 'too_dear' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'past' ELSE 'kept' END AS label FROM orders) GROUP BY 1""")
def e11_funnel(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "P", "not_ready").when(F.col("o_totalprice") > 400000, "too_dear").when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "past")
    return funnel(table(spark, d, "orders"), label.otherwise("kept"))


_KEY = "regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')"


@query(f"""SELECT key, min(p_partkey) AS p_partkey FROM (SELECT {_KEY} AS key, p_partkey FROM part) GROUP BY 1""")
def f1_keep_first(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", normalize_name(F.concat(F.lit("The "), F.col("p_name")), "search").alias("key"))
    return dd.keep_first(p, "key", [F.col("p_partkey")]).select("key", "p_partkey")


@query("""SELECT md5(text) AS key, doc_id, n_score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_score DESC, doc_id) AS r FROM
 (SELECT *, CAST(CASE WHEN source IN ('src1', 'src2') THEN 3.0 ELSE 0.0 END + CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS n_score FROM documents WHERE text IS NOT NULL)) WHERE r = 1""")
def f2_best_quality(spark: SparkSession, d: str) -> DataFrame:
    score = dd.completeness([(F.when(F.col("source").isin("src1", "src2"), "x"), 3.0), (F.when(F.col("doc_id") % 2 == 0, "x"), 1.0)])
    docs = table(spark, d, "documents").filter("text IS NOT NULL").withColumn("key", F.md5("text")).withColumn("n_score", score)
    return dd.keep_best(docs.select("key", "doc_id", "n_score"), "key", F.col("n_score"), [F.col("doc_id")]).select("key", "doc_id", "n_score")


@query("""SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def f3_longest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", F.length("text").alias("len"))
    return dd.keep_best(docs, ["source", "lang"], F.col("len"), [F.col("doc_id")]).select("source", "lang", "doc_id")


@query("""WITH f AS (SELECT p_type, p_name, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT p_type, p_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY k) AS rank FROM f) WHERE rank <= 20""")
def f4_capped_names(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("k"))
    return latest(named, "p_type", [F.col("k")], 20).select("p_type", "p_name", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT c_custkey, max(o_orderdate) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 7 = 0 WHERE c_acctbal > 0 GROUP BY 1)
 SELECT c_custkey FROM l ORDER BY t ASC NULLS FIRST, c_custkey LIMIT 100""")
def f5_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").filter("o_orderkey % 7 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("t"))
    j = table(spark, d, "customer").filter("c_acctbal > 0").join(last, "c_custkey", "left")
    return dd.oldest_first(j, F.col("t"), [F.col("c_custkey")], 100).select("c_custkey")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY lower(event_type), CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END ASC NULLS LAST, event_id) AS up,
 row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END DESC NULLS FIRST, event_id) AS down FROM events""")
def f6_sort_orders(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    w = Window.partitionBy("user_id")
    up = F.row_number().over(w.orderBy(F.lower("event_type"), t.asc_nulls_last(), "event_id"))
    down = F.row_number().over(w.orderBy(t.desc_nulls_first(), "event_id"))
    return table(spark, d, "events").select("event_id", "user_id", up.cast("long").alias("up"), down.cast("long").alias("down"))


@query("""SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders""")
def f7_batches(spark: SparkSession, d: str) -> DataFrame:
    return dd.batches(table(spark, d, "orders"), "o_custkey", [F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "batch")


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def f8_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = dd.rolling(table(spark, d, "events"), "user_id", "ts", "INTERVAL '6' HOUR", {"total": "sum(value)", "n": "count(*)"})
    return out.select("event_id", F.round("total", 4).alias("total"), "n")


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY md5('7:' || event_id), event_id LIMIT 25""")
def f9_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-10'").select("event_id")
    return dd.seeded_sample(rows, "event_id", 7, 25)


@query("""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10""")
def f10_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 10).select("event_type", "event_id")


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_returnflag, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag <> 'N', l_returnflag) AS r FROM c) WHERE r = 1""")
def f11_best_source(spark: SparkSession, d: str) -> DataFrame:
    return dd.best_source(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "N")
