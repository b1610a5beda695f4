"""Extraction of event rows from text columns: JSON-LD, links, iCal, feeds, listings, API payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_flexible
from ..functions.text import strip_tags, url_host
from ..functions.udfs import chunks


def _get(item: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path, kind)


def _items(v: Column) -> Column:
    """A variant's elements: an array's own, an object's @graph, else itself alone."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))


def json_ld(df: DataFrame, html: str) -> DataFrame:
    """Events of the JSON-LD blocks with a name and a start: name, start (the day), place (a location's name, else its
    address, else the text), description (200 characters, no tags); broken blocks are skipped. Types that end in Event
    count as events."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    each = df.withColumn("_b", F.explode(blocks)).withColumn("_v", F.try_parse_json(F.trim("_b"))).filter("_v IS NOT NULL")
    each = each.withColumn("_i", F.explode(_items(F.col("_v")))).filter(F.endswith(_get("_i", "$['@type']"), F.lit("Event")))
    named = [F.nullif(_get("_i", p), F.lit("")) for p in ("$.location.name", "$.location[0].name", "$.location.address", "$.location[0].address")]
    text = F.when(F.startswith(F.schema_of_variant(F.try_variant_get("_i", "$.location", "variant")), F.lit("STRING")), _get("_i", "$.location"))
    start = F.trim(_get("_i", "$.startDate"))
    day = F.coalesce(F.date_format(parse_flexible(F.regexp_replace(start, r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})$", "")), "yyyy-MM-dd"), F.substr(start, F.lit(1), F.lit(10)))
    return each.select(
        *df.columns,
        F.trim(_get("_i", "$.name")).alias("name"),
        day.alias("start"),
        F.coalesce(*named, text).alias("place"),
        F.substr(strip_tags(F.coalesce(_get("_i", "$.description"), F.lit(""))), F.lit(1), F.lit(200)).alias("description"),
    ).drop(html).filter("name <> '' AND start <> ''")


MEDIA = "youtube\\.|vimeo\\.|soundcloud\\.|spotify\\."


def links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """key, nth, kind (link or frame), url: absolute addresses of href and of iframe src; mail, script and fragment
    schemes and media frames are skipped."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)(<a\b[^>]*\shref|<iframe\b[^>]*\ssrc)="([^"]*)"'), F.lit(0))
    each = df.select(key, F.col(base).alias("_base"), F.posexplode(found).alias("nth", "_t"))
    target = F.regexp_extract("_t", r'(?is)"([^"]*)"$', 1)
    origin = F.regexp_extract("_base", r"(?i)^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract("_base", r"(?i)^(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    url = (
        F.when(F.rlike(target, F.lit("(?i)^https?://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("https:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .otherwise(F.concat(F.rtrim(folder), F.when(F.endswith(folder, F.lit("/")), "").otherwise("/"), target))
    )
    kind = F.when(F.rlike("_t", F.lit("(?i)^<iframe")), "frame").otherwise("link")
    keep = ~F.rlike(target, F.lit("(?i)^(mailto:|tel:|javascript:|data:|#|$)")) & ~((kind == "frame") & F.rlike(target, F.lit(MEDIA)))
    return each.filter(keep).select(key, "nth", kind.alias("kind"), url.alias("url"))


def ical(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, title, first, last, at: VEVENT blocks after unfolding. An all-day end is exclusive; an end on the first day is
    blank; blocks without a title are skipped."""
    flat = F.regexp_replace(text, r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))
    each = df.select(key, F.explode(blocks).alias("_e"))
    field = lambda n: F.regexp_extract("_e", rf"(?m)^{n}[^:\n]*:(.*?)\r?$", 1)
    title = F.regexp_replace(F.regexp_replace(field("SUMMARY"), r"\\([,;])", "$1"), r"\\n", " ")
    first = F.to_date(F.try_to_timestamp(F.substr(field("DTSTART"), F.lit(1), F.lit(8)), F.lit("yyyyMMdd")))
    end = F.to_date(F.try_to_timestamp(F.substr(field("DTEND"), F.lit(1), F.lit(8)), F.lit("yyyyMMdd")))
    whole_day = F.length(field("DTSTART")) == 8
    last = F.when(whole_day, F.date_sub(end, 1)).otherwise(end)
    clock = F.regexp_extract(field("DTSTART"), r"T(\d{2})(\d{2})", 1)
    at = F.when(~whole_day, F.concat(clock, F.lit(":"), F.regexp_extract(field("DTSTART"), r"T(\d{2})(\d{2})", 2)))
    return each.filter(title != "").select(key, title.alias("title"), first.alias("first"), F.when(last > first, last).alias("last"), at.alias("at"))


_ITEM = "ARRAY<STRUCT<title: STRING, pubDate: STRING, date: STRING, link: STRING, guid: STRING, description: STRING>>"
_ENTRY = "ARRAY<STRUCT<title: STRING, published: STRING, updated: STRING, id: STRING, summary: STRING, content: STRING, link: ARRAY<STRUCT<_href: STRING>>>>"


def rss(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, title, day, url, description (500 characters) of the items of RSS and the entries of Atom that have a title and
    a date."""
    parsed = F.from_xml(F.col(text), f"channel STRUCT<item: {_ITEM}>, entry {_ENTRY}")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda *c: F.coalesce(*map(blank, c))
    row = lambda title, at, url, said: F.struct(title.alias("title"), at.alias("at"), url.alias("url"), said.alias("said"))
    items = F.transform(parsed["channel"]["item"], lambda i: row(i["title"], first(i["pubDate"], i["date"]), first(i["link"], i["guid"]), i["description"]))
    entries = F.transform(
        parsed["entry"], lambda e: row(e["title"], first(e["published"], e["updated"]), first(F.get(e["link"], F.lit(0))["_href"], e["id"]), first(e["summary"], e["content"]))
    )
    each = df.select(key, F.explode(F.coalesce(items, entries)).alias("i"))
    day = F.to_date(parse_flexible(F.regexp_replace("i.at", r"\s*(GMT|UTC|Z|[+-]\d{2}:?\d{2})$", ""), ["d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]))
    said = F.substr(strip_tags(F.coalesce("i.said", F.lit(""))), F.lit(1), F.lit(500))
    return each.select(key, F.trim("i.title").alias("title"), day.alias("day"), "i.url", said.alias("description")).filter("title <> '' AND day IS NOT NULL")


def feeds(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, kind, url: the preferred feed of a page: a calendar link or frame before RSS or Atom; the first of a kind."""
    tag = F.regexp_extract_all(html, F.lit(r'(?is)<link\b[^>]*rel="alternate"[^>]*>|<iframe\b[^>]*calendar\.[^>]*src=[^"&>]*"?>|<a\b[^>]*href="[^"]*\.ics"[^>]*>'), F.lit(0))
    each = df.select(key, F.posexplode(tag).alias("nth", "_t"))
    kind = F.when(F.rlike("_t", F.lit(r"(?i)text/calendar|\.ics|<iframe")), "ical").when(F.rlike("_t", F.lit("(?i)rss|atom")), "rss")
    src = F.regexp_extract("_t", r'src=([A-Za-z0-9+/=]+)"?>?$', 1)
    decoded = F.try_to_binary(F.concat(src, F.repeat(F.lit("="), F.pmod(-F.length(src), F.lit(4)))), F.lit("base64"))
    url = F.when(src != "", F.concat(F.lit("https://calendar.example/ical/"), F.decode(decoded, "UTF-8"))).otherwise(F.regexp_extract("_t", r'(?i)href="([^"]*)"', 1))
    ranked = each.select(key, "nth", kind.alias("kind"), url.alias("url")).filter("kind IS NOT NULL")
    return ranked.groupBy(key).agg(F.min_by(F.struct("kind", "url"), F.struct((F.col("kind") != "ical").cast("int"), "nth")).alias("r")).select(key, "r.*")


#: Marks of content systems in the order in which they are tried, and where these keep their feeds.
SYSTEMS = {
    "wordpress+tribe": ["tribe-bar-date", "tribe_events", "tribe_filterbar"],
    "squarespace": ["squarespace.com"],
    "wix": ["wix.com"],
    "webflow": ["webflow.com"],
    "wordpress": ["wp-content", "wp-json"],
}
SYSTEM_FEEDS = {
    "wordpress+tribe": [("/events/?ical=1", "ical"), ("/events/feed/", "rss")],
    "wordpress": [("/feed/", "rss")],
    "squarespace": [("/events?format=ical", "ical")],
}


def content_system(html: Column) -> Column:
    """The content system that made a page, or `unknown`."""
    marked = [(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(html, m)), name) for name, marks in SYSTEMS.items()]
    return F.coalesce(*(F.when(hit, name) for hit, name in marked), F.lit("unknown"))


def system_feeds(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, nth, kind, url: addresses at which a page's content system would offer feeds; none for other pages."""
    root = F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1)
    offered = {
        name: F.array(*(F.struct(F.lit(kind).alias("kind"), F.concat(root, F.lit(path)).alias("url")) for path, kind in feeds))
        for name, feeds in SYSTEM_FEEDS.items()
    }
    system = content_system(F.coalesce(html, F.lit("")))
    found = F.coalesce(*(F.when(system == name, feeds) for name, feeds in offered.items()))
    return df.select(key, F.posexplode(found).alias("nth", "_f")).select(key, "nth", "_f.kind", "_f.url")


def loose_json(c: Column) -> Column:
    """A variant from free text: a fenced block first, else from the first bracket to the last."""
    fence = F.try_parse_json(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))
    return F.coalesce(fence, F.try_parse_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1)), F.try_parse_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1)))


#: Spellings of the fields of API records, without case, spaces and underscores.
ALIASES = {"name": ["name", "title", "eventname"], "start": ["start", "startdate", "date", "datetime"], "venue": ["venue", "location", "place"], "url": ["url", "link", "href"]}


def api_records(df: DataFrame, key: str, document: str) -> DataFrame:
    """key and name, start, venue, url of the records under events, data, results or records[].fields, in any spelling;
    a venue may be an object with a name."""
    v = F.try_parse_json(document)
    arrays = [F.try_variant_get(v, p, "array<variant>") for p in ("$.events", "$.data", "$.results", "$.records", "$")]
    each = df.select(key, F.explode(F.coalesce(*arrays)).alias("_i"))
    inner = F.coalesce(_get("_i", "$.fields", "map<string,variant>"), _get("_i", "$", "map<string,variant>"))
    each = each.select(key, F.transform_keys(inner, lambda k, _: F.regexp_replace(F.lower(k), "[ _-]", "")).alias("r")).filter("r IS NOT NULL")

    def field(names: list[str]) -> Column:
        at = [F.try_element_at("r", F.lit(n)) for n in names]
        return F.coalesce(*(F.coalesce(F.try_variant_get(a, "$.name", "string"), F.try_variant_get(a, "$", "string")) for a in at))

    return each.select(key, *(field(a).alias(n) for n, a in ALIASES.items()))


#: Fixed values.
EVENT_WORDS = ["event", "date", "venue", "title", "start", "ticket", "location"]


def event_score(c: Column) -> Column:
    """0 to 100: how much a JSON text looks like a list of events."""
    low = F.lower(c)
    words = sum((F.contains(low, F.lit(w)).cast("int") for w in EVENT_WORDS), F.lit(0))
    array, objects = F.rlike(c, F.lit(r"^\s*\[")), F.rlike(c, F.lit(r"^\s*\[\s*\{"))
    dates = F.rlike(c, F.lit(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|T\d{2}:\d{2}"))
    first = F.regexp_extract(c, r"(?s)^\s*\[\s*(\{.*?\})", 1)
    return F.least(
        F.lit(100),
        F.when(words >= 3, 30).when(words >= 1, 15).otherwise(0)
        + F.when(objects, 25).when(array, 10).otherwise(0)
        + F.when(dates, 25).otherwise(0)
        + F.when(objects & F.rlike(first, F.lit('"(name|title|event)"')), 10).otherwise(0)
        + F.when(objects & F.rlike(first, F.lit('"(date|datetime|start|startDate)"')), 10).otherwise(0),
    )


def best_payload(df: DataFrame, page: str, payload: str, url: str) -> DataFrame:
    """page, url, score: the payload with the highest score of a page, event-like addresses first among near ones."""
    score = F.least(F.lit(100), event_score(F.col(payload)) + F.when(F.rlike(url, F.lit("(?i)/(events?|calendar)")), 10).otherwise(0))
    s = df.select(page, url, score.alias("score"))
    return s.groupBy(page).agg(F.max_by(url, F.struct("score", url)).alias(url), F.max("score").alias("score"))


TICKET = "struct<_embedded:struct<events:array<struct<id:string,name:string,dates:struct<start:struct<localDate:string>>,priceRanges:array<struct<min:double,max:double>>,_embedded:struct<venues:array<struct<name:string,state:struct<stateCode:string>>>,attractions:array<struct<name:string>>>>>>>"


def ticket_rows(df: DataFrame, key: str, document: str, states: list[str]) -> DataFrame:
    """key, id, name, date, venue, artists, price_min, confidence of nested ticketing JSON; rows of other states go, a
    blank state stays."""
    e = df.select(key, F.explode(F.from_json(document, TICKET)["_embedded"]["events"]).alias("e"))
    venue = F.try_element_at("e._embedded.venues", F.lit(1))
    state = venue["state"]["stateCode"]
    out = e.filter(F.coalesce(state, F.lit("")).isin([*states, ""]))
    return out.select(
        key,
        F.col("e.id").alias("id"),
        F.col("e.name").alias("name"),
        F.col("e.dates.start.localDate").alias("date"),
        venue["name"].alias("venue"),
        F.array_join(F.transform("e._embedded.attractions", lambda a: a["name"]), ", ").alias("artists"),
        F.try_element_at("e.priceRanges", F.lit(1))["min"].alias("price_min"),
        F.when(state.isNotNull(), 0.95).otherwise(0.8).alias("confidence"),
    )


#: Signed weights of words in addresses of listing pages.
LISTING_HINTS = {"events": 30, "calendar": 25, "whats-on": 25, "schedule": 20, "shows": 15, "blog": -15, "privacy": -30, "login": -30}


def listing_candidates(urls: DataFrame, site: str, url: str, n: int = 12) -> DataFrame:
    """site, url, score, rank: at most n addresses of the same site by hints; detail pages (numbers, dates) count less."""
    p = F.lower(url)
    score = sum((F.when(F.contains(p, F.lit(w)), s).otherwise(0) for w, s in LISTING_HINTS.items()), F.lit(0))
    score = score - F.when(F.rlike(p, F.lit(r"/\d{3,}|\d{4}-\d{2}-\d{2}")), 10).otherwise(0)
    host, own = url_host(F.col(url)), url_host(F.col(site))
    same = urls.filter((host == own) | F.endswith(host, F.concat(F.lit("."), own))).select(site, url).distinct().withColumn("score", score)
    w = Window.partitionBy(site).orderBy(F.desc("score"), url)
    return same.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Paths of listings that a site may have; words of such paths; first and second segments of item and listing pages.
LISTING_PATHS = [
    "/events", "/events.html", "/calendar", "/calendar.html", "/calendar/exhibitions", "/pages/calendar", "/shows", "/shows.html", "/exhibitions",
    "/exhibitions/upcoming", "/upcoming-exhibitions", "/upcoming", "/happenings", "/whatson", "/whats-on", "/program", "/programs", "/public-programs",
    "/public-programming", "/programming",
]
LISTING_WORDS = [
    "event", "events", "calendar", "shows", "show", "exhibition", "exhibitions", "upcoming", "upcoming-exhibitions", "shows.html", "calendar.html",
    "events.html", "happenings", "program", "programming", "public-program", "public-programs", "public_program", "public_programs", "whats-on",
    "whats_on", "tickets",
]
ITEM_PARENTS = ["exhibitions", "exhibition", "events", "shows", "show", "performances", "performance", "talks", "talk", "calendar", "whats-on", "whatson", "happenings"]
SUBLISTINGS = ["upcoming", "current", "past", "history", "archive", "all", "film", "films", "programs", "series", "special", "exhibitions", "shows", "performances"]
STATIC_FILES = r"\.(css|js|png|jpg|jpeg|gif|svg|pdf|woff|woff2)$"
#: What each of several groups of words adds to the rank of a listing page; less comes first.
LISTING_RANKS = [
    (-4, ["/events"]), (-3, ["/program", "/programs", "public-program"]), (-2, ["/calendar", "/shows", "/happenings"]),
    (-1, ["/exhibitions", "exhibition", "/upcoming", "upcoming"]), (-1, ["calendarid=", "calendar="]), (4, ["/history", "/archive", "/past", "/previous"]),
]


def listing_pages(links: DataFrame, site: str, url: str, order: str, n: int = 12, guaranteed: int = 3) -> DataFrame:
    """site, url, score, rank: the pages of each site that most likely list events. rank is the place among all its candidates.

    links has absolute addresses found on the site's pages; order tells which came first. Candidates are these, the usual
    paths and the site itself, if they are of the site (or one domain is above the other), no static file, no page of one
    item, and bear a listing's word. The n best stay, and the guaranteed best usual paths however many links precede them.
    A site is known by its own address; a null site or address takes no part, repeats count once.
    """
    base = F.rtrim(F.col("_home"), F.lit("/"))
    sites = links.select(site).filter(F.col(site).isNotNull()).distinct().withColumn("_home", _plain_url(F.col(site)))
    usual = F.array(*(F.concat(base, F.lit(p)) for p in LISTING_PATHS))
    found = links.filter(F.col(url).isNotNull()).groupBy(site, _plain_url(F.col(url)).alias("_u")).agg(F.min(order).cast("long").alias("_at"))
    found = found.filter("_u IS NOT NULL").join(sites, site).select(site, "_home", "_u", F.lit(0).alias("_kind"), "_at")
    made = sites.select(site, "_home", F.posexplode(F.concat(usual, F.array("_home"))).alias("_at", "_u"))
    made = made.select(site, "_home", "_u", F.when(F.col("_at") < len(LISTING_PATHS), 1).otherwise(2).alias("_kind"), F.col("_at").cast("long").alias("_at"))
    each = found.unionByName(made).groupBy(site, "_home", "_u").agg(
        F.min(F.struct("_kind", "_at")).alias("_first"), F.bool_or(F.col("_kind") == 0).alias("_linked"), F.bool_or(F.col("_kind") == 1).alias("_usual")
    )
    u = F.col("_u")
    path = F.lower(F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1))
    asked = F.lower(F.regexp_extract(u, r"\?([^#]*)", 1))
    each = each.withColumns({"_p": path, "_q": asked, "_s": F.filter(F.split(path, "/"), lambda x: x != "")}).withColumn("_pq", F.when(asked != "", F.concat("_p", F.lit("?"), "_q")).otherwise(F.col("_p")))
    some = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.col("_pq"), w))
    host, own = url_host(u), url_host(F.col("_home"))
    same = (host == own) | F.endswith(host, F.concat(F.lit("."), own)) | F.endswith(own, F.concat(F.lit("."), host))
    segment = lambda i: F.coalesce(F.get("_s", F.lit(i)), F.lit(""))
    item = F.rlike("_p", F.lit(r"/\d{4,}$")) | (segment(0).isin(ITEM_PARENTS) & (F.size("_s") >= 2) & ~segment(1).isin(SUBLISTINGS)) | (F.size("_s") > 4) | (F.length("_p") > 80)
    never = F.rlike("_p", F.lit(STATIC_FILES)) | F.rlike("_p", F.lit(r"/20\d{2}/\d{1,2}/\d{1,2}/"))
    home = F.rtrim(u, F.lit("/")) == base
    kept = each.filter(same & ~never & (F.col("_usual") | ~item) & (some(LISTING_WORDS) | F.col("_usual") | home))
    score = F.when(F.col("_linked"), -3).otherwise(0) + F.when(F.col("_usual"), 3).otherwise(0) + F.when(F.col("_q") != "", 2).otherwise(0)
    for weight, words in LISTING_RANKS:
        score = score + F.when(some(words), weight).otherwise(0)
    by = [F.col("score"), F.size("_s"), F.col("_first"), F.col("_u")]
    ranked = kept.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(site).orderBy(*by)))
    ranked = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(site, "_usual").orderBy(*by)))
    return ranked.filter((F.col("rank") <= n) | (F.col("_usual") & (F.col("_nth") <= guaranteed))).select(site, F.col("_u").alias(url), "score", "rank")


def _plain_url(u: Column) -> Column:
    """With scheme, scheme and host in lower case, without fragment or parameters of the last segment."""
    t = F.trim(u)
    t = F.when(F.rlike(t, F.lit("(?i)^https?://")), t).otherwise(F.concat(F.lit("https://"), t))
    head = F.lower(F.regexp_extract(t, r"(?i)^(https?://[^/?#]*)", 1))
    path, asked = F.regexp_extract(t, r"(?i)^https?://[^/?#]*([^?#]*)", 1), F.regexp_extract(t, r"^[^#?]*(\?[^#]+)", 1)
    return F.when(F.length(F.trim(u)) > 0, F.concat(head, path, asked))


def canonical(df: DataFrame, as_of: str, base: Column, method: str, ahead: int = 365) -> DataFrame:
    """Extracted rows (name, date, time, url, category) as events: past and too distant days go, links become absolute,
    the first category stays, method and confidence are set."""
    day = F.to_date(parse_flexible(F.col("date")))
    today = F.lit(as_of).cast("date")
    url = F.when(F.rlike("url", F.lit("^https?://")), F.col("url")).otherwise(F.concat(base, F.col("url")))
    out = df.withColumn("day", day).filter((F.col("day") >= today) & (F.col("day") <= F.date_add(today, ahead)))
    at = F.when(F.rlike("time", F.lit(r"^\d{1,2}:\d{2}$")), F.lpad("time", 5, "0"))
    return out.withColumns({"url": url, "time": at, "category": F.trim(F.get(F.split("category", ","), F.lit(0))), "extraction_method": F.lit(method), "confidence": F.when(at.isNotNull(), 0.9).otherwise(0.7)})


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, line: numbered lines."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def text_listing(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, month, title, at: a month header line holds for the lines below it; a title line is followed by a time line;
    badge lines (in brackets) are skipped; what follows a `PAST` line is ignored."""
    before = df.withColumn(text, F.regexp_extract(text, r"(?s)^(.*?)(?:\nPAST(?:\n.*)?)?$", 1))
    rows = lines(before, key, text).filter(~F.rlike("line", F.lit(r"^\[.*\]$|^\s*$")))
    w = Window.partitionBy(key).orderBy("n")
    month = F.when(F.rlike("line", F.lit(r"^[A-Z][a-z]+ \d{4}$")), F.col("line"))
    time = F.rlike("line", F.lit(r"^\d{2}:\d{2}$"))
    out = rows.withColumn("month", F.last(month, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("next", F.lead("line").over(w)).filter(~time & month.isNull() & F.rlike("next", F.lit(r"^\d{2}:\d{2}$")))
    return out.select(key, "month", F.col("line").alias("title"), F.col("next").alias("at"))


def sections(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """key, section, title, day, sold_out: a marker line opens a section; its first line is the title, its first date the
    day; sections without a date are dropped."""
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.startswith("line", F.lit(marker))
    rows = lines(df, key, text).withColumn("section", F.sum(opens.cast("int")).over(w)).filter(~opens & (F.col("section") > 0))
    date = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1)
    return (
        rows.groupBy(key, "section")
        .agg(
            F.min_by("line", "n").alias("title"),
            F.min_by(F.when(date != "", date), F.when(date != "", F.col("n"))).alias("day"),
            F.bool_or(F.contains(F.lower("line"), F.lit("sold out"))).alias("sold_out"),
        )
        .filter("day IS NOT NULL")
    )


#: Patterns of listings.
SIGNALS = [
    r"\bupcoming events?\b",
    r"\bupcoming exhibitions?\b",
    r"\bexhibitions?\b",
    r"\bevent(s)? calendar\b",
    r"\bwhat'?s on\b",
    r"\bshow(s)?\b",
    r"\bget tickets?\b",
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}",
    r"\b\d{1,2}[:.]\d{2}\s?(?:am|pm)\b",
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
]


def signal_score(c: Column) -> Column:
    """Listing signals: two for each of at most five hits of a pattern, four for three years, three for three tickets."""
    t = F.lower(c)
    hits = sum((F.least(F.regexp_count(t, F.lit(p)), F.lit(5)) * 2 for p in SIGNALS), F.lit(0))
    often = lambda p, n: F.when(F.regexp_count(t, F.lit(p)) >= 3, n).otherwise(0)
    return hits + often(r"\b20\d{2}\b", 4) + often(r"\b(?:ticket|reserve|rsvp)\b", 3)


def best_page(df: DataFrame, site: str, order: str, score: str, stop: int = 18, accept: int = 8) -> DataFrame:
    """site, order, score: the first page that reaches stop, else the best (first of equals) that reaches accept."""
    lead = F.struct((F.col(score) >= stop).cast("int"), F.when(F.col(score) >= stop, 0).otherwise(F.col(score)), -F.col(order))
    best = df.groupBy(site).agg(F.max_by(F.struct(order, score), lead).alias("r")).select(site, "r.*")
    return best.filter(F.col(score) >= accept)


#: What stands before a listing, and what a piece of a listing says; in lower and upper case.
LISTING_STARTS = [
    r"(?i)(upcoming events|event calendar|events calendar|what's on)",
    r"(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\s+202[4-6]",
    r"(?i)sort by",
    r"(?i)items \d+-\d+ of",
]
LISTING_SIGNS = [
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b",
    r"(?i)\b20\d{2}-\d{2}-\d{2}\b",
    r"(?i)\b\d{1,2}:\d{2}\s*(?:am|pm)\b",
    r"(?i)\b(rsvp|ticket|register|event|workshop|talk|lecture|reading)\b",
]


def listing_start(text: Column, before: int = 200, least: int = 1000) -> Column:
    """Where to begin reading, from 0: `before` characters ahead of the first match of a start pattern, each later pattern
    counting if it matches behind what was found so far; 0 if that is not beyond least."""
    best = F.lit(0)
    for pattern in LISTING_STARTS:
        at = F.regexp_instr(text, F.lit(pattern)) - 1
        best = F.when(at > best, F.greatest(F.lit(0), at - before)).otherwise(best)
    return F.when(best > least, best).otherwise(F.lit(0))


def listing_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, most: int) -> DataFrame:
    """key, nth, start (in the whole text), chunk, listing, chosen: all pieces of every text from where its listing
    starts. Chosen are the first `most` pieces that look like a listing, or of all pieces where none does. Null and empty
    texts have no pieces."""
    whole = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.length("_t") > 0).withColumn("_from", listing_start(F.col("_t")))
    cut = whole.select(F.col("_k").alias(key), F.col("_from"), F.expr("substring(_t, _from + 1)").alias("_t"))
    said = reduce(lambda a, b: a | b, (F.rlike("chunk", F.lit(p)) for p in LISTING_SIGNS))
    made = chunks(cut, key, "_t", size, overlap, ["_from"]).select(key, "nth", (F.col("_from") + F.col("start")).alias("start"), "chunk", said.alias("listing"))
    one = Window.partitionBy(key)  # the pieces of one text
    ranked = made.withColumns({"_any": F.max("listing").over(one), "_nth": F.row_number().over(one.orderBy(F.desc("listing"), "nth"))})
    chosen = (F.col("_nth") <= most) & (F.col("listing") | ~F.col("_any"))
    return ranked.select(key, "nth", "start", "chunk", "listing", chosen.alias("chosen"))
