"""Queries on scans, sinks and scalar work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, text
from ..session import shared_folder
from ..sources import tables
from .registry import query, table


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END AS o_custkey,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def a1_typed_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(
        k.cast("string").alias("o_orderkey"),
        F.when(k % 7 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(k % 11 == 0, "None").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return tables.typed(cells, {"o_orderkey": "bigint", "o_custkey": "int0", "o_totalprice": "double", "o_orderpriority": "string"})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS uneven FROM orders""")
def a1_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with too few and too many cells, written, scanned as text and typed."""
    path, k = shared_folder(spark, "lines"), F.col("o_orderkey")
    full = F.concat_ws(",", k.cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority")
    line = F.when(k % 7 == 0, k.cast("string")).when(k % 11 == 0, F.concat(full, F.lit(",more"))).otherwise(full)
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    cells = tables.scan_strings(spark, path, ["o_orderkey", "o_custkey", "o_orderpriority"])
    return tables.typed(cells, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderpriority": "string", "_line": "string"}).select("o_orderkey", "o_custkey", "o_orderpriority", F.col("_line").isNotNull().alias("uneven"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
 WHERE event_id % 10 <> 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'""")
def a2_csv_events(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    lines = table(spark, d, "events").select(F.concat_ws(",", F.col("event_id").cast("string"), at).alias("line"))
    rows = tables.csv_rows(lines, "line", "event_id long, at string").withColumn("t", F.try_to_timestamp("at"))
    return rows.filter((F.col("t") >= "2024-01-05") & (F.col("t") < "2024-01-12")).select("event_id", "at")


@query("""SELECT o_orderkey, i + 1 AS n, o_orderkey * 10 + i AS value FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 4 <> 0""")
def a3_json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    inner = F.format_string('[{"n":1,"v":%d},{"n":2,"v":%d}]', k * 10, k * 10 + 1)
    doc = F.when(k % 4 == 0, '{"data":{}}').otherwise(F.concat(F.lit('{"data":{"items":'), inner, F.lit("}}")))
    rows = tables.json_rows(table(spark, d, "orders").select("o_orderkey", doc.alias("doc")), "doc", "$.data.items")
    get = lambda p, t: F.try_variant_get("item", p, t)
    return rows.select("o_orderkey", get("$.n", "bigint").alias("n"), get("$.v", "bigint").alias("value"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS city, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0""")
def a4_json_seed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    doc = F.to_json(F.create_map(F.col("s_nationkey").cast("string"), F.array(F.struct(F.col("s_name").alias("name")))))
    rows = tables.json_map_rows(s.select(doc.alias("doc")), "doc", "struct<name:string>")
    known = s.filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"))
    return rows.join(known, "name", "left_anti").select(F.col("key").alias("city"), "name")


@query("""SELECT p_type, p_partkey // 1000 AS part, count(*) AS n, md5(string_agg(p_name || ':' || p_partkey, ',' ORDER BY p_name, p_partkey)) AS digest
 FROM part GROUP BY ALL""")
def a5_nested_export(spark: SparkSession, d: str) -> DataFrame:
    part = F.floor(F.col("p_partkey") / 1000)  # at most 1000 keys in a part
    out = tables.nested_groups(table(spark, d, "part"), "p_type", part, ["p_name", "p_partkey"], ["p_name", "p_partkey"])
    joined = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["p_name"], r["p_partkey"].cast("string"))), ",")
    return out.select("p_type", "part", "n", F.md5(joined).alias("digest"))


@query("""SELECT event_id, dayname(ts) AS day, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time FROM events""")
def a6_report_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in tables.report_columns("ts").items()))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, event_type || ', "' || event_id || '"' AS name, dayname(ts) AS day, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time FROM events""")
def a6_report_file(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV twice and read back; names have quotes and commas."""
    path, named = shared_folder(spark, "report"), F.concat("event_type", F.lit(', "'), F.col("event_id").cast("string"), F.lit('"'))
    rows = table(spark, d, "events").select("event_id", named.alias("name"), *(c.alias(n) for n, c in tables.report_columns("ts").items()))
    for part in (rows.filter("event_id % 2 = 0"), rows):
        tables.write_report(part, path)
    return tables.read_report(spark, path)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'
 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0""")
def a7_replace_slice(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    incoming = stored.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return tables.replace_slice(stored, incoming, "o_orderstatus", "O")


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)""")
def a7_stored_slices(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of orders by status: one slice replaced twice, another emptied, and read back."""
    path, stored = shared_folder(spark, "slices"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tables.overwrite_slices(stored, path, "o_orderstatus")
    incoming = stored.filter("o_orderkey % 2 = 0 AND o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for status in ("O", "P", "O"):
        tables.overwrite_slice(incoming, path, "o_orderstatus", status)
    return spark.read.schema(stored.schema).parquet(path)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'""")
def a8_stored_archive(spark: SparkSession, d: str) -> DataFrame:
    """Past orders appended in parts that overlap, one of them twice, and read back."""
    path = shared_folder(spark, "archive")
    past = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 2 = 0", "o_orderkey % 2 = 0", "true"):
        tables.append_archive(past.filter(part).unionByName(past.filter(part)), path, ["o_orderkey", "day"])
    return spark.read.schema(past.schema).parquet(path)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 3 <> 0""")
def a8_archive(spark: SparkSession, d: str) -> DataFrame:
    past = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return tables.to_archive(past, past.filter("o_orderkey % 3 = 0"), ["o_orderkey", "day"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_orderkey END AS whole, CAST(trunc(l_quantity) AS BIGINT) AS via_float,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS number, l_returnflag = 'R' AS flag,
 regexp_replace(regexp_replace(printf('%.7f', l_tax + l_orderkey), '0+$', ''), '\\.$', '') AS spot FROM lineitem""")
def b1_permissive_decode(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw = lambda c: F.col(c).cast("string")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        text.int_or_zero(F.when(n == 2, "n/a").otherwise(raw("l_orderkey"))).alias("whole"),
        text.int_via_float(raw("l_quantity")).alias("via_float"),
        text.float_or_null(F.when(n == 3, "?").otherwise(raw("l_discount"))).alias("number"),
        text.bool_token(F.when(F.col("l_returnflag") == "R", " Yes").otherwise("no")).alias("flag"),
        text.coordinate(F.col("l_tax") + F.col("l_orderkey")).alias("spot"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE o_orderpriority END AS name, coalesce(c_mktsegment, 'unknown') AS venue_name,
 CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.example/' || o_orderkey ELSE 'https://v.example/' || c_custkey END AS event_source_url
 FROM orders JOIN customer ON o_custkey = c_custkey""")
def b2_canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    url = F.when(k % 2 == 0, F.concat(F.lit("https://x.example/"), k.cast("string")))
    return o.select(
        "o_orderkey",
        F.coalesce(text.blank_to_null(name), "c_name").alias("name"),
        F.coalesce(text.blank_to_null(F.col("c_mktsegment")), F.lit("unknown")).alias("venue_name"),
        F.coalesce(url, F.concat(F.lit("https://v.example/"), F.col("c_custkey").cast("string"))).alias("event_source_url"),
    )


_NAMED = "CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name || ' NYC' WHEN 1 THEN '(' || p_name || ') Theatre' WHEN 2 THEN p_name || ' Club !' ELSE upper(p_name) || ' live' END"
_SUFFIX = "'\\s+(nyc|ny|club|venue|theater|theatre)$', ''"


@query(f"""WITH n AS (SELECT p_partkey, trim(lower({_NAMED})) AS t FROM part)
 SELECT p_partkey, regexp_replace(regexp_replace(t, {_SUFFIX}), '^the\\s+', '') AS cache,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^the\\s+', ''), '^\\(', ''), {_SUFFIX}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g') AS venue,
 regexp_replace(regexp_replace(regexp_replace(t, '^the\\s+', ''), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g') AS search,
 trim(regexp_replace(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), {_SUFFIX}), '^the\\s+', '')) AS feed,
 trim(regexp_replace(regexp_replace(t, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS lookup,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\s+(live|tour|concert|presents?)$', ''), '^the\\s+', ''), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g') AS artist
 FROM n""")
def b3_name_keys(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", F.expr(_NAMED).alias("name"))
    return named.select("p_partkey", *(text.normalize_name(F.col("name"), v).alias(v) for v in ("cache", "venue", "search", "feed", "lookup", "artist")))


@query("""SELECT p_partkey, lower(p_type) || ' / ' || lower(p_brand) || ' & co' AS category FROM part""")
def b4_categories(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  - "), F.col("p_type"), F.lit("/ "), F.col("p_brand"), F.lit("  &amp;   Co -"))
    return table(spark, d, "part").select("p_partkey", text.category(raw).alias("category"))


_HOST = "replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), 'www.', '')"
_PATH = "regexp_replace(regexp_replace('/' || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '')"


@query(f"""SELECT page_id, {_HOST} AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path,
 {_HOST} || lower(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END) || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || lower(regexp_extract(url, '\\?([^#]*)', 1)) ELSE '' END AS feed_key,
 {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS same_site FROM pages""")
def b5_url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", text.url_host(u).alias("host"), text.url_path(u).alias("path"), text.feed_key(u).alias("feed_key"), text.same_site(u, F.lit("http://www.example.com/x")).alias("same_site")
    )


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS r FROM pages),
 v AS (SELECT *, CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE h END AS root FROM u),
 w AS (SELECT *, split_part(root, '.', 1) AS l, substr(root, length(split_part(root, '.', 1)) + 2) AS x FROM v),
 z AS (SELECT *, CASE WHEN starts_with(l, 'the') AND length(l) > 3 THEN substr(l, 4) ELSE 'the' || l END AS o FROM w),
 a AS (SELECT page_id, s, r, unnest([h, CASE WHEN root <> h THEN root ELSE 'www.' || root END, l || '.' || x, 'www.' || l || '.' || x, o || '.' || x, 'www.' || o || '.' || x]) AS c, unnest([1, 2, 3, 4, 5, 6]) AS i FROM z),
 f AS (SELECT page_id, s, r, c, min(i) AS i FROM a GROUP BY ALL)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS nth, s || '://' || c || r AS variant FROM f""")
def b6_host_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.posexplode(text.host_variants(F.col("url"))).alias("nth", "variant"))
    return rows.select("page_id", F.col("nth").cast("long").alias("nth"), "variant")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def b7_flexible_dates(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shown = (
        F.when(k % 5 == 0, F.date_format(t, "yyyy-MM-dd"))
        .when(k % 5 == 1, F.date_format(t, "MM/dd/yyyy"))
        .when(k % 5 == 2, F.concat(F.lit("Saturday, "), F.date_format(t, "MMMM d, yyyy")))
        .when(k % 5 == 3, F.date_format(t, "yyyy-MM-dd h:mm a"))
        .otherwise("soon")
    )
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_flexible(shown), "yyyy-MM-dd").alias("day"))


@query("""SELECT l_orderkey, l_linenumber, strftime(CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate ELSE o_orderdate END, '%Y-%m-%d') AS day
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def b8_effective_date(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber")
    day = dates.effective_date(
        F.when(n % 3 == 0, F.col("l_shipdate")), F.when(n % 3 == 1, F.col("o_orderdate")), F.date_format("o_orderdate", "MM/dd/yyyy")
    )
    return j.select("l_orderkey", "l_linenumber", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("""SELECT event_id, event_type || '||' || user_id || '||' || '' || '||' || strftime(ts, '%Y-%m-%d') AS key,
 event_type || '||' || strftime(ts, '%Y-%m-%d') || '||feed||' || CASE WHEN event_id % 2 = 0 THEN 'link:https://x.example/' || event_id ELSE 'venue:user ' || user_id END AS dedupe_key FROM events""")
def b9_keys(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    link = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://X.example/"), F.col("event_id").cast("string")))
    return table(spark, d, "events").select(
        "event_id",
        keys.event_key(F.col("event_type"), F.col("user_id"), F.lit(None), day).alias("key"),
        keys.dedupe_key(F.col("event_type"), day, F.lit("Feed"), link, F.concat(F.lit("User  "), F.col("user_id").cast("string"))).alias("dedupe_key"),
    )


@query("""WITH r AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS k, sha1(coalesce(text, '')) AS h FROM documents),
 c AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM r),
 b AS (SELECT CAST('0x' || k[1:6] AS BIGINT) % n AS b, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM r, c GROUP BY 1)
 SELECT sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM b""")
def b10_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return keys.fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT DISTINCT l_partkey, l_suppkey, 'name: ' || p_name || chr(10) || 'type: ' || p_type || chr(10) || 'venue: ' || s_name || CASE WHEN s_nationkey % 2 = 0 THEN chr(10) || 'area: ' || s_nationkey ELSE '' END AS content
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def b11_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    j = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    area = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(" ")
    made = keys.embedding_text(("name", F.col("p_name")), ("type", F.col("p_type")), ("venue", F.col("s_name")), ("area", area))
    return j.select("l_partkey", "l_suppkey", made.alias("content"))


@query("""SELECT event_id, strftime(ts, '%a') AS weekday, strftime(ts, '%b %d') AS day, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') ELSE '' END AS clock, substr(props, 1, 6) AS short FROM events""")
def b12_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.date_format("ts", "EEE").alias("weekday"),
        F.date_format("ts", "MMM dd").alias("day"),
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm")).otherwise("").alias("clock"),
        F.substring("props", 1, 6).alias("short"),
    )


@query("""WITH w(key, first, last) AS (VALUES ('today', DATE '2024-01-07', DATE '2024-01-07'), ('tomorrow', DATE '2024-01-08', DATE '2024-01-08'),
 ('this_week', DATE '2024-01-07', DATE '2024-01-07'), ('next_week', DATE '2024-01-08', DATE '2024-01-14'), ('this_weekend', DATE '2024-01-13', DATE '2024-01-14'), ('next_30_days', DATE '2024-01-07', DATE '2024-02-06'))
 SELECT key, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last, count(event_id) AS n FROM w LEFT JOIN events ON CAST(ts AS DATE) BETWEEN first AND last GROUP BY ALL""")
def b13_relative_windows(spark: SparkSession, d: str) -> DataFrame:
    per_day = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).count()
    w = F.broadcast(dates.windows(spark, "2024-01-07"))  # six rows
    days = w.select("key", "first", "last", F.explode(F.sequence("first", "last")).alias("day"))
    n = days.join(per_day, "day", "left").groupBy("key", "first", "last").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    return n.select("key", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "n")


@query("""SELECT event_id, strftime(CASE event_id % 8 WHEN 0 THEN d WHEN 1 THEN DATE '2024-01-10' WHEN 2 THEN DATE '2024-01-15' WHEN 3 THEN DATE '2024-01-13' WHEN 4 THEN DATE '2024-01-10' WHEN 5 THEN d WHEN 6 THEN DATE '2024-01-11' END, '%Y-%m-%d') AS first,
 strftime(CASE event_id % 8 WHEN 0 THEN DATE '2024-03-01' WHEN 1 THEN DATE '2024-01-14' WHEN 2 THEN DATE '2024-01-21' WHEN 3 THEN DATE '2024-01-14' WHEN 4 THEN CAST(DATE '2024-01-10' + CAST(user_id % 5 + 1 AS INTEGER) AS DATE) WHEN 5 THEN d WHEN 6 THEN DATE '2024-01-11' END, '%Y-%m-%d') AS last
 FROM (SELECT *, CAST(ts AS DATE) AS d FROM events)""")
def b13_requested_window(spark: SparkSession, d: str) -> DataFrame:
    """Asked on Wednesday, 10 January 2024; stronger arguments stand beside weaker ones."""
    k, day = F.col("event_id") % 8, F.date_format("ts", "yyyy-MM-dd")
    asked = table(spark, d, "events").select(
        "event_id",
        F.when(k == 0, day).when(k == 5, F.concat(day, F.lit("T20:00:00"))).when(k == 6, "soon").otherwise("").alias("start_date"),
        F.when(k == 0, "2024-03-01").when(k == 6, "2024-01-11").alias("end_date"),
        F.when(k.isin(0, 1), "this_week").when(k == 2, " Next_Week").when(k == 3, "this_weekend").when(k == 4, "some_day").alias("relative_window"),
        F.when(k == 4, (F.col("user_id") % 5 + 1).cast("string")).when(k.isin(0, 1), "3").when(k == 5, "-2").when(k == 6, "x").alias("days_ahead"),
    )
    out = dates.requested(asked, "2024-01-10")
    return out.select("event_id", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM pages""")
def b14_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("""SELECT event_id, printf('%.5f,%.5f', 40.7, -74.0 + user_id / 1000) || '|' || printf('%.5f,%.5f', 40.0 + user_id / 1000, -73.5) || '|' || CASE WHEN event_id % 2 = 0 THEN 'driving|' || strftime(ts, '%Y-%m-%dT%H') ELSE 'walking|static' END AS key FROM events""")
def b15_travel_key(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id") / 1000
    mode = F.when(F.col("event_id") % 2 == 0, "driving").otherwise("walking")
    return table(spark, d, "events").select(
        "event_id", keys.travel_key(F.lit(40.7), F.lit(-74.0) + u, F.lit(40.0) + u, F.lit(-73.5), mode, F.col("ts")).alias("key")
    )
