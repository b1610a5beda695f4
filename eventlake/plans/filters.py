"""Queries on filters and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category, html_text
from ..operators import filters as f
from ..operators import rules
from .registry import query, table

_DAY = "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")))


@query(f"""SELECT o_orderkey FROM orders WHERE {_DAY} BETWEEN DATE '1996-03-01' AND DATE '1996-05-31' OR o_orderkey % 9 = 0""")
def c1_date_window(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda s: F.lit(s).cast("date")
    return _dated(spark, d).filter(f.in_window(F.col("day"), lit("1996-05-31"), lit("1996-03-01"), undated=True)).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-13 12:00:00'""")
def c2_next_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(f.next_days(F.col("ts"), "2024-01-10 12:00:00", 3)).select("event_id")


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-03-02' AS past FROM orders""")
def c3_past(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", f.is_past(F.col("o_orderdate"), "1998-03-02 15:00:00").alias("past"))


@query(f"""SELECT CASE WHEN day < DATE '1998-01-01' THEN 'archive' WHEN day > DATE '1999-01-01' THEN 'drop' ELSE 'keep' END AS label, count(*) AS n
 FROM (SELECT {_DAY} AS day FROM orders) GROUP BY 1""")
def c4_horizon(spark: SparkSession, d: str) -> DataFrame:
    return f.funnel(_dated(spark, d), f.horizon_label(F.col("day"), "1998-01-01"))


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE (contains(lower(c_name), '12') OR contains(lower(o_orderpriority), '12') OR contains(lower(c_mktsegment), '12'))
 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND isodow(o_orderdate) >= 6 AND o_orderstatus <> 'P'""")
def c5_search(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hit = f.contains_any([F.col("c_name"), F.col("o_orderpriority"), F.col("c_mktsegment")], "12")
    found = j.filter(hit & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & f.weekend(F.col("o_orderdate")) & (F.col("o_orderstatus") != "P"))
    return found.orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").select("o_orderkey", "c_name")


@query("""SELECT p_partkey, p_type FROM part WHERE lower(p_type) IN ('economy', 'promo')""")
def c6_categories(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(" Economy ",), ("PROMO",)], "c string").select(category(F.col("c")).alias("category"))
    p = table(spark, d, "part").withColumn("category", category(F.col("p_type")))
    return p.join(F.broadcast(wanted), "category", "left_semi").select("p_partkey", "p_type")  # two rows


@query("""SELECT event_id, 1 AS kept FROM events WHERE event_id % 6 = 0 OR value <= 20""")
def c7_limit_unknown(spark: SparkSession, d: str) -> DataFrame:
    cost = F.when(F.col("event_id") % 6 != 0, F.col("value"))
    return table(spark, d, "events").filter(f.within(cost, 20, keep_unknown=True)).select("event_id", F.lit(1).alias("kept"))


@query("""WITH a AS (SELECT c_custkey, lower(n_name) AS addr, lower(r_name) AS venue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT c_custkey, CASE WHEN regexp_matches(addr, '1|2') THEN false WHEN regexp_matches(addr, '3|4|5') THEN true ELSE regexp_matches(venue, 'asia|europe') AND NOT regexp_matches(venue, '1|2') END AS outside FROM a""")
def c8_geo_markers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", f.marker_label(F.col("n_name"), F.col("r_name"), ["1", "2"], ["3", "4", "5", "asia", "europe"]).alias("outside"))


@query("""SELECT p_partkey, p_partkey % 3 <> 2 OR regexp_matches(p_name, '^\\d') AS listing FROM part""")
def c9_listing_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Bright Airy "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("23B "), F.col("p_name"), F.lit(" Studio"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", f.listing_name(name).alias("listing"))


@query("""SELECT n_nationkey, n_nationkey % 2 = 0 OR lower(r_name) = 'asia' AS vague FROM nation JOIN region ON n_regionkey = r_regionkey""")
def c10_vague_address(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    address = F.when(F.col("n_nationkey") % 2 == 0, F.lit(" New York, ")).otherwise(F.concat(F.initcap("r_name"), F.lit(",")))
    return j.select("n_nationkey", f.vague(address, ["new york", "asia"]).alias("vague"))


@query("""WITH h AS (SELECT page_id, url, replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), 'www.', '') AS h FROM pages)
 SELECT page_id, CASE WHEN h = 'example.org' OR ends_with(h, '.example.org') OR ends_with(h, 'casino-win.example.com') THEN '' ELSE url END AS url, h = 'example.org' OR ends_with(h, '.example.org') OR ends_with(h, 'casino-win.example.com') AS url_blocked FROM h""")
def c11_blocked_domains(spark: SparkSession, d: str) -> DataFrame:
    blocked = spark.createDataFrame([("example.org",), ("casino-win.example.com",)], "domain string")
    return f.block_domains(table(spark, d, "pages").select("page_id", "url"), "url", blocked, "page_id")


@query("""SELECT s_suppkey, CASE WHEN n_nationkey IN (1, 2, 3) THEN 'skip' WHEN s_suppkey % 5 = 0 AND n_nationkey % 2 = 0 THEN 'both' WHEN s_suppkey % 5 = 0 THEN 'ticketing_only' WHEN n_nationkey % 2 = 0 THEN 'scrape_only' ELSE 'skip' END AS strategy
 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def c12_strategy(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    listed = spark.createDataFrame([(1, True), (2, True), (3, True)], "n_nationkey int, skip boolean")  # a rule table of three rows
    ticket, site = F.col("s_suppkey") % 5 == 0, F.col("n_nationkey") % 2 == 0
    choice = F.when(F.col("skip"), "skip").when(ticket & site, "both").when(ticket, "ticketing_only").when(site, "scrape_only").otherwise("skip")
    return j.join(F.broadcast(listed), "n_nationkey", "left").select("s_suppkey", choice.alias("strategy"))


@query("""SELECT queue, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 4 = 0 THEN 'no_site' WHEN o_custkey % 3 = 2 THEN 'gave_up' WHEN o_orderstatus = 'P' THEN 'retry' ELSE 'new' END AS queue FROM orders) GROUP BY 1""")
def c13_work_queues(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    chain = F.when(s == "F", "done").when(F.col("o_orderkey") % 4 == 0, "no_site").when(F.col("o_custkey") % 3 >= 2, "gave_up").when(s == "P", "retry").otherwise("new")
    return f.funnel(table(spark, d, "orders"), chain).withColumnRenamed("label", "queue")


_STRATEGY_ROWS = """SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'Carnegie Hall Annex' WHEN 1 THEN 'City Library ' || s_suppkey WHEN 2 THEN 'MSG' ELSE s_name END AS name,
 CASE s_nationkey % 4 WHEN 0 THEN 'museums' WHEN 1 THEN 'jazz clubs' WHEN 2 THEN '' ELSE 'comedy' END AS category, s_suppkey % 5 <> 0 AS site, CASE s_suppkey % 7 WHEN 0 THEN 'ticketing' WHEN 1 THEN 'scrape' ELSE '' END AS preferred, s_nationkey % 3 = 0 AS ticketed FROM supplier"""


@query(f"""SELECT k, CASE WHEN preferred = 'ticketing' THEN CASE WHEN ticketed THEN 'ticketing_only' ELSE 'skip' END WHEN preferred = 'scrape' THEN CASE WHEN site THEN 'scrape_only' ELSE 'skip' END
 WHEN NOT site AND NOT ticketed THEN 'skip' WHEN NOT known AND (category = 'museums' OR contains(name, 'Library')) THEN CASE WHEN site THEN 'scrape_only' ELSE 'skip' END
 WHEN ticketed AND site THEN 'both' WHEN ticketed THEN 'ticketing_only' ELSE 'scrape_only' END AS strategy FROM (SELECT *, name IN ('Carnegie Hall Annex', 'MSG') AS known FROM ({_STRATEGY_ROWS}))""")
def c12_source_strategy(spark: SparkSession, d: str) -> DataFrame:
    s, k, n = table(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")
    rows = s.select(
        k.alias("k"), F.when(k % 6 == 0, "Carnegie Hall Annex").when(k % 6 == 1, F.concat(F.lit("City Library "), k.cast("string"))).when(k % 6 == 2, "MSG").otherwise(F.col("s_name")).alias("name"),
        F.when(n % 4 == 0, " Museums").when(n % 4 == 1, "Jazz clubs").when(n % 4 == 3, "comedy").alias("category"), F.when(k % 5 != 0, "https://x.example").alias("site"),
        F.when(k % 7 == 0, "ticketing").when(k % 7 == 1, "scrape").alias("preferred"), F.when(n % 3 == 0, "T9").when(n % 3 == 1, "Not_found").alias("ticket_id"),
    )
    return rows.select("k", rules.choose(rules.STRATEGY)["result"].alias("strategy"))


@query("""WITH p AS (SELECT ['', 'verified', 'reachable_no_events_page', 'search_failed', 'ambiguous', 'closed', 'dead_site', 'unreachable', 'odd'][o_orderkey % 9 + 1] AS st, o_orderkey % 4 <> 0 AS site, o_orderkey % 5 = 0 AS known, o_orderkey % 5 < 2 AS asked, o_orderkey % 3 = 0 AS ev,
  o_custkey % 5 AS att, coalesce(nullif(o_orderkey % 7, 6), 0) = 0 AS zero, o_custkey % 10 = 0 AS agg, o_custkey % 6 = 0 AS api, o_orderpriority = '1-URGENT' AS jazz, o_custkey % 8 = 0 AS placed, o_custkey % 3 = 0 AS homeless, o_custkey % 7 = 0 AS vague FROM orders),
 q AS (SELECT unnest([{'selector': 'validate', 'queue': CASE WHEN known THEN 'ticketed' WHEN site AND agg THEN 'validate' WHEN st = 'verified' THEN CASE WHEN site AND (NOT ev OR zero) THEN 'validate' ELSE st END
   WHEN st = 'reachable_no_events_page' THEN CASE WHEN site AND NOT ev THEN 'validate' ELSE st END WHEN st = 'search_failed' THEN CASE WHEN att < 3 THEN 'validate' ELSE st END WHEN st IN ('', 'odd') THEN 'validate' ELSE st END},
  {'selector': 'api', 'queue': CASE WHEN api THEN 'has_api' WHEN NOT site OR st <> 'verified' THEN 'not_ready' WHEN NOT jazz THEN 'other_category' ELSE 'scan' END},
  {'selector': 'ticketing', 'queue': CASE WHEN asked THEN 'checked' WHEN jazz THEN 'scan' ELSE 'not_ticketed' END},
  {'selector': 'listing', 'queue': CASE WHEN ev THEN 'has_listing' WHEN known THEN 'ticketed' WHEN st <> 'verified' OR NOT site THEN 'not_ready' ELSE 'scan' END},
  {'selector': 'fetch', 'queue': CASE WHEN st IN ('verified', 'reachable_no_events_page') THEN 'fetch' ELSE 'leave' END},
  {'selector': 'coordinates', 'queue': CASE WHEN NOT ev THEN 'no_listing' WHEN placed THEN 'placed' WHEN homeless THEN 'no_address' WHEN vague THEN 'bad_address' ELSE 'fill' END}], recursive := true) FROM p)
 SELECT selector, queue, count(*) AS n FROM q GROUP BY ALL""")
def c13_selectors(spark: SparkSession, d: str) -> DataFrame:
    """All six selectors over the orders as places, in one pass."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.array(*map(F.lit, ["", "Verified ", "reachable_no_events_page", "search_failed", "ambiguous", "closed", "dead_site", "unreachable", "odd"]))
    rows = table(spark, d, "orders").select(
        F.get(status, (k % 9).cast("int")).alias("status"), F.when(k % 4 != 0, "https://x.example").alias("site"), (c % 10 == 0).alias("aggregator"), F.when(k % 3 == 0, "u").otherwise(" ").alias("events_url"),
        (c % 5).alias("attempts"), F.when(k % 7 != 6, k % 7).alias("event_count"), F.when(k % 5 == 0, "T1").when(k % 5 == 1, "not_found").alias("ticket_id"), F.when(c % 6 == 0, "a").alias("api"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Old Jazz Clubs").otherwise("parks").alias("category"), F.when(c % 2 == 0, 40.5).alias("latitude"), F.when(c % 8 < 2, 0.0).alias("longitude"),
        F.when(c % 3 != 0, "1 Main St").alias("address"), (c % 7 == 0).alias("vague"),
    )
    return rules.queue_counts(rows, rules.work_queues(3, "jazz"))


@query("""SELECT user_id, max(ts) > TIMESTAMP '2024-01-28 00:00:00' AS fresh FROM events WHERE event_type = 'click' GROUP BY user_id""")
def c14_freshness(spark: SparkSession, d: str) -> DataFrame:
    seen = f.last_seen(table(spark, d, "events").filter("event_type = 'click'"), "user_id", "ts")
    return seen.select("user_id", f.is_fresh(F.col("last_at"), "2024-01-30 00:00:00", 2).alias("fresh"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END AS side FROM orders""")
def c15_split(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 1 == 0, F.col("o_totalprice"))
    yes, no = f.split_by(table(spark, d, "orders"), price > 250000)
    return yes.select("o_orderkey", F.lit("yes").alias("side")).unionByName(no.select("o_orderkey", F.lit("no").alias("side")))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'challenge' WHEN 1 THEN 'script_calendar' WHEN 2 THEN 'wordpress' ELSE 'plain' END AS state FROM pages""")
def c16_page_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    extra = F.when(k == 0, "<p>Just a moment...</p>").when(k == 1, F.concat(F.lit("<script>"), F.repeat(F.lit("x"), 5000 + 30 * F.length("html")), F.lit("</script>"))).when(k == 2, "<a href='/wp-content/x'>").otherwise("")
    p = table(spark, d, "pages").select("page_id", F.concat("html", extra).alias("html")).withColumn("visible", html_text(F.col("html")))
    return p.select("page_id", f.page_state(F.col("html"), F.col("visible")).alias("state"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'wordpress+tribe' WHEN 1 THEN 'squarespace' WHEN 2 THEN 'wix' WHEN 3 THEN 'webflow' WHEN 4 THEN 'wordpress' WHEN 5 THEN 'parked' WHEN 6 THEN 'challenge' ELSE 'plain' END AS state FROM pages""")
def c16_page_systems(spark: SparkSession, d: str) -> DataFrame:
    """Marks of all content systems in the pages, one of them beside a second system's, one on a parked page."""
    marks = ["<i class='Tribe_Events'></i><i data='wp-content'>", "SquareSpace.com", "www.wix.com", "webflow.com", "/wp-json/", "wix.com Parked FREE", "Checking your browser"]
    mark = F.get(F.array(*map(F.lit, marks)), (F.col("page_id") % 8).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat("html", F.coalesce(mark, F.lit(""))).alias("html"))
    return p.select("page_id", f.page_state(F.col("html"), html_text(F.col("html"))).alias("state"))
