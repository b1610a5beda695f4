"""Queries on extraction: payloads are composed from base tables, so the base tables are the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text
from ..operators import extract as x
from .registry import query, table


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("k", F.col("o_orderkey"))


@query("""SELECT o_orderkey AS k, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS start, CASE WHEN o_orderkey % 9 = 4 THEN '1 Main St' WHEN o_orderkey % 9 = 7 THEN NULL WHEN o_orderkey % 3 = 2 THEN 'Hall' ELSE 'Place ' || o_custkey END AS place, 'a ' || repeat('d', 198) AS description
 FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 7 > 1""")
def h1_json_ld(spark: SparkSession, d: str) -> DataFrame:
    place = (
        F.when(F.col("k") % 9 == 4, '{"name":"","address":"1 Main St"}')
        .when(F.col("k") % 9 == 7, '{"geo":1}')
        .when(F.col("k") % 3 == 0, F.concat(F.lit('{"name":"Place '), _s("o_custkey"), F.lit('"}')))
        .when(F.col("k") % 3 == 1, F.concat(F.lit('[{"name":"Place '), _s("o_custkey"), F.lit('"}]')))
        .otherwise('"Hall"')
    )
    # Of seven rows one has no name and one no start.
    name = F.when(F.col("k") % 7 == 0, " ").otherwise(F.col("o_orderpriority"))
    start = F.when(F.col("k") % 7 == 1, "").when(F.col("k") % 2 == 0, F.concat("day", F.lit("T19:30:00-05:00"))).otherwise(F.col("day"))
    one = F.concat(F.lit('{"@type":"MusicEvent","name":"'), name, F.lit('","startDate":"'), start, F.lit('","description":"<p>a</p>'), F.repeat(F.lit("d"), 300), F.lit('","location":'), place, F.lit("}"))
    org = F.lit('{"@type":"Organization","name":"x"}')
    form = (
        F.when(F.col("k") % 4 == 0, one)
        .when(F.col("k") % 4 == 1, F.concat(F.lit("["), org, F.lit(","), one, F.lit("]")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit('{"@graph":['), one, F.lit(","), org, F.lit("]}")))
        .otherwise(F.concat(F.lit("{bad"), one))
    )
    page = F.concat(F.lit('<html><script type="application/ld+json">'), form, F.lit("</script><script>var a=1</script></html>"))
    return x.json_ld(_orders(spark, d).select("k", page.alias("html")), "html")


@query("""WITH m AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\shref="[^"]*"')) AS t FROM pages),
 n AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o, regexp_extract(t, '"([^"]*)"$', 1) AS h FROM m)
 SELECT page_id, 'link' AS kind, CASE WHEN regexp_matches(h, '^https?://') THEN h ELSE o || h END AS url, count(*) AS n FROM n WHERE (starts_with(h, '/') OR regexp_matches(h, '^https?://')) AND NOT starts_with(h, '//') GROUP BY ALL
 UNION ALL SELECT page_id, 'frame', 'https://tickets.example/' || page_id, 1 FROM pages""")
def h2_links(spark: SparkSession, d: str) -> DataFrame:
    frames = F.concat(F.lit('<iframe width="1" src="https://tickets.example/'), _s("page_id"), F.lit('"></iframe><iframe src="https://www.youtube.com/embed/1"></iframe><a href="mailto:a@b">m</a><a href="#top">t</a>'))
    found = x.links(table(spark, d, "pages").select("page_id", "url", F.concat("html", frames).alias("html")).withColumnRenamed("url", "base"), "page_id", "html", "base")
    return found.groupBy("page_id", "kind", "url").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_matches(html, '(?i)<article') AS article, 0 AS tags FROM pages""")
def h3_html_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("t", html_text(F.col("html")))
    return p.select("page_id", (F.length("t") > 0).alias("article"), F.rlike("t", F.lit("(?i)</?(script|style|article|p)\\b|margin:0|track\\(")).cast("int").alias("tags"))


@query("""SELECT o_orderkey AS k, o_orderpriority || ', at ' || o_custkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS first, CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') END AS last, CASE WHEN o_orderkey % 2 = 0 THEN '19:30' END AS at FROM orders WHERE o_orderkey % 10 <> 0""")
def h4_ical(spark: SparkSession, d: str) -> DataFrame:
    date = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyyMMdd")
    end = F.when(F.col("k") % 4 == 1, date(3)).otherwise(date(1))
    timed = F.concat(F.lit("DTSTART:"), date(0), F.lit("T193000\r\nDTEND:"), date(0), F.lit("T220000\r\n"))
    span = F.when(F.col("k") % 2 == 0, timed).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), date(0), F.lit("\r\nDTEND;VALUE=DATE:"), end, F.lit("\r\n")))
    title = F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("SUMMARY:"), F.col("o_orderpriority"), F.lit("\\, a\r\n t "), _s("o_custkey"), F.lit("\r\n")))
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"), title, span, F.lit("END:VEVENT\r\nEND:VCALENDAR\r\n"))
    out = x.ical(_orders(spark, d).select("k", text.alias("text")), "k", "text")
    return out.select("k", "title", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "at")


@query("""SELECT o_orderkey AS k, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, 'https://x.example/' || o_orderkey AS url, 'a b' AS description FROM orders WHERE o_orderkey % 5 <> 0""")
def h5_rss(spark: SparkSession, d: str) -> DataFrame:
    date = F.when(F.col("k") % 5 == 0, "soon").when(F.col("k") % 2 == 0, F.concat(F.lit("Sat, "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" 08:00:00 GMT"))).otherwise(F.concat(F.col("day"), F.lit("T08:00:00")))
    item = F.concat(F.lit("<item><title>"), F.col("o_orderpriority"), F.lit("</title><pubDate>"), date, F.lit("</pubDate><link>https://x.example/"), _s("k"), F.lit("</link><description>&lt;b&gt;a&lt;/b&gt; b</description></item>"))
    entry = F.concat(F.lit("<entry><title>"), F.col("o_orderpriority"), F.lit("</title><updated>"), date, F.lit('</updated><link href="https://x.example/'), _s("k"), F.lit('"/><summary>&lt;i&gt;a&lt;/i&gt; b</summary></entry>'))
    xml = F.when(F.col("k") % 3 == 0, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry, F.lit("<entry><title>none</title></entry></feed>"))).otherwise(
        F.concat(F.lit("<rss><channel>"), item, F.lit("<item><title>none</title></item></channel></rss>"))
    )
    return x.rss(_orders(spark, d).select("k", xml.alias("xml")), "k", "xml").select("k", "title", F.date_format("day", "yyyy-MM-dd").alias("day"), "url", "description")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'rss' ELSE 'ical' END AS kind, CASE page_id % 3 WHEN 0 THEN '/feed' WHEN 1 THEN '/all.ics' ELSE 'https://calendar.example/ical/me@x' END AS url FROM pages""")
def h6_feeds(spark: SparkSession, d: str) -> DataFrame:
    extra = F.when(F.col("page_id") % 3 == 1, '<a class="c" href="/all.ics">c</a>').when(F.col("page_id") % 3 == 2, F.concat(F.lit('<iframe a="https://calendar.example/embed?src='), F.base64(F.encode(F.lit("me@x"), "UTF-8")), F.lit('">'))).otherwise("")
    html = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed">'), "html", extra)
    return x.feeds(table(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "html")


@query("""WITH p AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages)
 SELECT page_id, 'ical' AS kind, root || '/events/?ical=1' AS url FROM p WHERE k = 0 UNION ALL SELECT page_id, 'rss', root || '/events/feed/' FROM p WHERE k = 0
 UNION ALL SELECT page_id, 'ical', root || '/events?format=ical' FROM p WHERE k = 1 UNION ALL SELECT page_id, 'rss', root || '/feed/' FROM p WHERE k = 4""")
def h6_system_feeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 6
    marks = ["wp-content tribe_events", "cdn.squarespace.com wp-json", "wix.com", "x.webflow.com wp-json", "/wp-json/", "plain"]
    mark = F.get(F.array(*map(F.lit, marks)), k.cast("int"))
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit('<link href="'), mark, F.lit('">')).alias("html"))
    return x.system_feeds(pages.withColumnRenamed("url", "base"), "page_id", "html", "base").select("page_id", "kind", "url")


@query()
def h7_chunks(spark: SparkSession, d: str) -> DataFrame:
    return x.listing_chunks(table(spark, d, "documents"), "doc_id", "text", 2000, 200, 40)


@query("""SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 4 <> 3""")
def h8_loose_json(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit('{"v":'), _s("o_custkey"), F.lit("}"))
    text = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("Sure [1]:\n```json\n["), one, F.lit(", 5]\n```\nbye")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("Here: ["), one, F.lit("] done")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("It is "), one, F.lit(".")))
        .otherwise("nothing [broken")
    )
    v = _orders(spark, d).select("k", x.loose_json(text).alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return v.filter("v IS NOT NULL").select("k", F.explode(items).alias("i")).select("k", F.try_variant_get("i", "$.v", "bigint").alias("v")).filter("v IS NOT NULL")


@query("""SELECT o_orderkey AS k, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS start, 'V' || o_custkey AS venue, 'u' AS url FROM orders""")
def h9_api_records(spark: SparkSession, d: str) -> DataFrame:
    venue = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"name":"V'), _s("o_custkey"), F.lit('"}'))).otherwise(F.concat(F.lit('"V'), _s("o_custkey"), F.lit('"')))
    body = lambda a, b, c: F.concat(F.lit(f'{{"{a}":"'), F.col("o_orderpriority"), F.lit(f'","{b}":"'), F.col("day"), F.lit(f'","{c}":'), venue, F.lit(',"URL":"u"}'))
    doc = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"events":['), body("Event Name", "startDate", "venue"), F.lit("]}")))
        .when(F.col("k") % 3 == 1, F.concat(F.lit('{"data":['), body("title", "Date", "Location"), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"records":[{"fields":'), body("name", "start", "place"), F.lit("}]}")))
    )
    return x.api_records(_orders(spark, d).select("k", doc.alias("doc")), "k", "doc")


@query("""SELECT event_id % 1000 AS page, max(CASE event_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 0 ELSE 10 END) AS score FROM events GROUP BY 1""")
def h10_event_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    payload = F.when(k == 0, F.concat(F.lit('[{"title":"a","start":"2024-01-01","venue":"x"},'), F.col("props"), F.lit("]"))).when(k == 1, F.col("props")).otherwise("[1,2]")
    url = F.concat(F.when(k == 0, "https://x.example/events/").otherwise("https://x.example/a/"), _s("event_id"))
    rows = table(spark, d, "events").select((F.col("event_id") % 1000).alias("page"), payload.alias("p"), url.alias("url"))
    return x.best_payload(rows, "page", "p", "url").select("page", F.col("score").cast("long").alias("score"))


@query("""SELECT o_orderkey AS k, o_orderkey || 'x' AS id, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS date, c_name AS venue, 'A, B' AS artists, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 12.5 END AS DOUBLE) AS price_min, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS confidence
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 2""")
def h11_ticket_rows(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("k") % 3 == 0, ',"state":{"stateCode":"NY"}').when(F.col("k") % 3 == 2, ',"state":{"stateCode":"CA"}').otherwise("")
    price = F.when(F.col("k") % 2 == 0, '"priceRanges":[{"min":12.5,"max":20}],').otherwise("")
    doc = F.concat(
        F.lit('{"_embedded":{"events":[{"id":"'), _s("k"), F.lit('x","name":"'), F.col("o_orderpriority"), F.lit('","dates":{"start":{"localDate":"'), F.col("day"), F.lit('"}},'), price,
        F.lit('"_embedded":{"venues":[{"name":"'), F.col("c_name"), F.lit('"'), state, F.lit('}],"attractions":[{"name":"A"},{"name":"B"}]}}]}}'),
    )
    j = _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.ticket_rows(j.select("k", doc.alias("doc")), "k", "doc", ["NY", "NJ"])


@query("""SELECT site, '/events' AS best, 3 AS n FROM (SELECT 'https://' || host || '/' AS site FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages))""")
def h12_listing_candidates(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    site = table(spark, d, "pages").select(F.concat(F.lit("https://"), host, F.lit("/")).alias("site"))
    urls = site.select("site", F.explode(F.array(*(F.concat("site", F.lit(p)) for p in ("events", "events/12345", "login")), F.lit("https://other.example/events"))).alias("url"))
    c = x.listing_candidates(urls, "site", "url")
    return c.groupBy("site").agg(F.min_by(F.regexp_extract("url", "(/[^/]*)$", 1), "rank").alias("best"), F.count("*").alias("n"))


#: SQL of the links of `h12_listing_pages`: those in the pages, and four more on some of them.
_LINKS = r"""lk AS (SELECT 'http://' || host AS site, CASE WHEN starts_with(u, '/') THEN 'http://' || host || u ELSE u END AS url, page_id * 100000 + i AS pos FROM (SELECT host, page_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM
 (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, list_concat(regexp_extract_all(html, 'href="(/[^"]*)"', 1), CASE WHEN page_id % 2 = 0 THEN ['/shows/upcoming?month=5#top', '/events/' || page_id || '-night', '/calendar/archive', 'HTTPS://Cdn.Example.com/events.css'] ELSE ['/public-program', '/event/2024/5/6/x', '/happenings/12345', '/Events'] END) AS l FROM pages)))"""


@query(rf"""WITH {_LINKS},
 usual AS (SELECT * FROM (SELECT unnest({x.LISTING_PATHS}) AS p, unnest(range(20)) AS pos)),
 c0 AS (SELECT site, url, regexp_replace(url, '#.*$', '') AS u, pos, 0 AS kind FROM lk UNION ALL SELECT site, site, site || p, pos, 1 FROM usual, (SELECT DISTINCT site FROM lk) UNION ALL SELECT DISTINCT site, site, site, 20, 2 FROM lk),
 c AS (SELECT site, u, min((kind, pos)) AS o, bool_or(kind = 0) AS linked, bool_or(kind = 1) AS usual FROM c0 GROUP BY 1, 2),
 p AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1)) AS path, lower(regexp_extract(u, '[?](.*)$', 1)) AS q FROM c WHERE starts_with(u, site)),
 s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS pq FROM p),
 k AS (SELECT *, CASE WHEN linked THEN -3 ELSE 0 END + CASE WHEN usual THEN 3 ELSE 0 END + CASE WHEN q <> '' THEN 2 ELSE 0 END - CASE WHEN contains(pq, '/events') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(pq, '/program|public-program') THEN 3 ELSE 0 END
  - CASE WHEN regexp_matches(pq, '/calendar|/shows|/happenings') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(pq, 'exhibition|upcoming') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(pq, 'calendarid=|calendar=') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(pq, '/history|/archive|/past|/previous') THEN 4 ELSE 0 END AS score
  FROM s WHERE NOT regexp_matches(path, '[.](css|js|png|jpg|jpeg|gif|svg|pdf|woff|woff2)$|/20[0-9]{{2}}/[0-9]{{1,2}}/[0-9]{{1,2}}/')
  AND (usual OR NOT (regexp_matches(path, '/[0-9]{{4,}}$') OR (len(seg) >= 2 AND regexp_full_match(seg[1], 'exhibitions?|events|shows?|performances?|talks?|calendar|whats-?on|happenings') AND NOT regexp_full_match(seg[2], 'upcoming|current|past|history|archive|all|films?|programs|series|special|exhibitions|shows|performances')) OR len(seg) > 4 OR length(path) > 80))
  AND (usual OR u = site OR regexp_matches(pq, 'event|calendar|show|exhibition|upcoming|happenings|program|whats[-_]on|tickets'))),
 r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score, len(seg), o, u) AS rank, row_number() OVER (PARTITION BY site, usual ORDER BY score, len(seg), o, u) AS nth FROM k)
 SELECT site, u AS url, CAST(score AS INTEGER) AS score, rank FROM r WHERE rank <= 12 OR (usual AND nth <= 3)""")
def h12_listing_pages(spark: SparkSession, d: str) -> DataFrame:
    p, host, k = table(spark, d, "pages"), F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.col("page_id")
    more = F.when(k % 2 == 0, F.array(F.lit("/shows/upcoming?month=5#top"), F.concat(F.lit("/events/"), k.cast("string"), F.lit("-night")), F.lit("/calendar/archive"), F.lit("HTTPS://Cdn.Example.com/events.css")))
    more = more.otherwise(F.array(*map(F.lit, ("/public-program", "/event/2024/5/6/x", "/happenings/12345", "/Events"))))
    own = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    each = p.select(F.concat(F.lit("http://"), host).alias("site"), k, F.posexplode(F.concat(own, more)).alias("i", "u"))
    links = each.select("site", F.when(F.startswith("u", F.lit("/")), F.concat("site", "u")).otherwise(F.col("u")).alias("url"), (k * 100000 + F.col("i") + 1).alias("at"))
    return x.listing_pages(links, "site", "url", "at").withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN '09:05' END AS time, 'https://x.example/e/' || o_orderkey AS url, 'music' AS category, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence
 FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-01-01'""")
def h13_canonical(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.when(F.col("k") % 3 == 0, "https://x.example").otherwise(""), F.lit("/e/"), _s("k"))
    rows = _orders(spark, d).select("k", F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), F.when(F.col("k") % 2 == 0, "9:05").otherwise("evening").alias("time"), link.alias("url"), F.lit("music, talk").alias("category"))
    out = x.canonical(rows, "1998-01-01", F.lit("https://x.example"), "text")
    return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "time", "url", "category", "confidence")


@query("""SELECT o_custkey AS k, strftime(o_orderdate, '%B %Y') AS month, 'show ' || o_orderkey AS title, '19:30' AS at FROM orders""")
def h14_text_listing(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.date_format("o_orderdate", "MMMM yyyy"), F.lit("\nshow "), _s("o_orderkey"), F.lit("\n[new]\n19:30\n"))
    text = _orders(spark, d).groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.array_join(F.collect_list(part), ""), F.lit("PAST\nMay 1990\nold\n10:00")).alias("text"))
    return x.text_listing(text, "k", "text")


@query("""SELECT o_custkey AS k, 'show ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 2 = 0 AS sold_out FROM orders WHERE o_orderkey % 5 <> 0""")
def h15_sections(spark: SparkSession, d: str) -> DataFrame:
    date = F.when(F.col("k") % 5 == 0, "soon").otherwise(F.concat(F.lit("on "), F.col("day")))
    part = F.concat(F.lit("## \nshow "), _s("k"), F.lit("\n"), date, F.when(F.col("k") % 2 == 0, "\nSold out").otherwise(""))
    text = _orders(spark, d).withColumn("part", part).groupBy("o_custkey").agg(F.array_join(F.collect_list("part"), "\n").alias("text"))
    return x.sections(text.withColumnRenamed("o_custkey", "k"), "k", "text", "##").select("k", "title", "day", "sold_out")


@query(r"""WITH t AS (SELECT source, doc_id, lower(text || CASE doc_id % 40 WHEN 7 THEN ' Upcoming events: show 7:30 pm, May 5, Friday. Get tickets. What''s on: exhibitions. ticket rsvp reserve 2024 2025 2026' WHEN 9 THEN ' event calendar Jun. 12 8.00pm Sunday, 2024 shows' ELSE ' Shows on Monday, tickets 2024' END) AS t FROM documents WHERE text IS NOT NULL),
 s AS (SELECT source, doc_id, 2 * (least(len(regexp_extract_all(t, '\bupcoming events?\b')), 5) + least(len(regexp_extract_all(t, '\bupcoming exhibitions?\b')), 5) + least(len(regexp_extract_all(t, '\bexhibitions?\b')), 5)
  + least(len(regexp_extract_all(t, '\bevents? calendar\b')), 5) + least(len(regexp_extract_all(t, '\bwhat''?s on\b')), 5) + least(len(regexp_extract_all(t, '\bshows?\b')), 5) + least(len(regexp_extract_all(t, '\bget tickets?\b')), 5)
  + least(len(regexp_extract_all(t, '\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}')), 5) + least(len(regexp_extract_all(t, '\b\d{1,2}[:.]\d{2}\s?[ap]m\b')), 5)
  + least(len(regexp_extract_all(t, '\b(?:mon|tues|wednes|thurs|fri|satur|sun)day\b')), 5))
  + CASE WHEN len(regexp_extract_all(t, '\b20\d{2}\b')) >= 3 THEN 4 ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '\b(?:ticket|reserve|rsvp)\b')) >= 3 THEN 3 ELSE 0 END AS score FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score >= 18 DESC, CASE WHEN score >= 18 THEN 0 ELSE score END DESC, doc_id) AS r FROM s)
 SELECT source, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE r = 1 AND score >= 8""")
def h16_best_page(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 40
    rich = " Upcoming events: show 7:30 pm, May 5, Friday. Get tickets. What's on: exhibitions. ticket rsvp reserve 2024 2025 2026"
    t = F.concat("text", F.when(k == 7, rich).when(k == 9, " event calendar Jun. 12 8.00pm Sunday, 2024 shows").otherwise(" Shows on Monday, tickets 2024"))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("source", "doc_id", x.signal_score(t).cast("long").alias("score"))
    return x.best_page(docs, "source", "doc_id", "score")
