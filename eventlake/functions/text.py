"""Column functions on text: permissive decoding, names, categories, URLs, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The one trailing word that a name normaliser cuts.
NAME_SUFFIX = r"\s+(nyc|ny|club|venue|theater|theatre)$"
ARTIST_SUFFIX = r"\s+(live|tour|concert|presents?)$"


def blank_to_null(c: Column) -> Column:
    """Null for null, white space only, and the text None."""
    return F.when((F.trim(c) != "") & (F.trim(c) != "None"), c)


def int_or_zero(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0))


def int_via_float(c: Column) -> Column:
    """Whole part of a number in text, else null."""
    return F.trim(c).try_cast("double").try_cast("bigint")


def float_or_null(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def bool_token(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def coordinate(c: Column) -> Column:
    """Seven decimals without trailing zeros; empty for null."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.7f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), "").otherwise(text)


def normalize_name(c: Column, variant: str) -> Column:
    """Name keys. Variants: cache (suffix, then the), venue (the, bracket, suffix, punctuation), search (no suffix),
    feed (spaces, suffix, the), lookup (punctuation to spaces), artist. Only one suffix is cut; venue, search and artist
    keep a space that punctuation leaves at the end."""
    rep = F.regexp_replace
    t = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    if variant == "cache":
        return rep(rep(t, NAME_SUFFIX, ""), r"^the\s+", "")
    if variant == "venue":
        t = rep(rep(rep(t, r"^the\s+", ""), r"^\(", ""), NAME_SUFFIX, "")
        return rep(rep(t, r"[^a-z0-9\s]", ""), r"\s+", " ")
    if variant == "search":
        return rep(rep(rep(t, r"^the\s+", ""), r"[^a-z0-9\s]", ""), r"\s+", " ")
    if variant == "feed":
        return F.trim(rep(rep(rep(t, r"\s+", " "), NAME_SUFFIX, ""), r"^the\s+", ""))
    if variant == "lookup":
        return F.trim(rep(rep(t, r"[^a-z0-9\s]", " "), r"\s+", " "))
    if variant == "artist":
        t = rep(rep(t, ARTIST_SUFFIX, ""), r"^the\s+", "")
        return rep(rep(t, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")
    raise ValueError(variant)


def category(c: Column) -> Column:
    """Category label in one spelling: entities, spaced separators, single spaces, lower case."""
    t = F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("&amp;"), F.lit("&")), F.lit("&#038;"), F.lit("&"))
    t = F.regexp_replace(F.regexp_replace(t, r"\s*([/|,])\s*", " $1 "), r"\s+", " ")
    return F.lower(F.regexp_replace(t, "^[ -]+|[ -]+$", ""))


def _schemed(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.rlike(t, F.lit("(?i)^https?://")), t).otherwise(F.concat(F.lit("https://"), t))


def url_host(c: Column) -> Column:
    """Lower-case host with every `www.` removed."""
    return F.replace(F.lower(F.regexp_extract(_schemed(c), r"(?i)^https?://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def url_path(c: Column) -> Column:
    """Path with single slashes and none at the end; at least `/`."""
    p = F.regexp_extract(_schemed(c), r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    p = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/"), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def url_query(c: Column) -> Column:
    return F.regexp_extract(_schemed(c), r"\?([^#]*)", 1)


def feed_key(c: Column) -> Column:
    """Host, lower-case path and query as one key."""
    p = F.regexp_replace(F.regexp_extract(_schemed(c), r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    q = F.lower(url_query(c))
    return F.concat(
        url_host(c), F.lower(F.when(p == "", "/").otherwise(p)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
    )


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    x, y = url_host(a), url_host(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def host_variants(c: Column) -> Column:
    """At most eight urls with the host, with or without `www.` and a leading `the`, in order."""
    s = _schemed(c)
    scheme = F.lower(F.regexp_extract(s, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(s, r"^[A-Za-z]+://([^/?#]*)", 1))
    rest = F.regexp_extract(s, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    root = F.when(F.startswith(host, F.lit("www.")), F.substr(host, F.lit(5))).otherwise(host)
    label, suffix = F.regexp_extract(root, r"^([^.]*)\.", 1), F.regexp_extract(root, r"^[^.]*\.(.*)$", 1)
    other = F.when(F.startswith(label, F.lit("the")) & (F.length(label) > 3), F.substr(label, F.lit(4))).otherwise(
        F.concat(F.lit("the"), label)
    )
    hosts = F.array(
        host,
        F.when(root != host, root).otherwise(F.concat(F.lit("www."), root)),
        F.concat(label, F.lit("."), suffix),
        F.concat(F.lit("www."), label, F.lit("."), suffix),
        F.concat(other, F.lit("."), suffix),
        F.concat(F.lit("www."), other, F.lit("."), suffix),
    )
    return F.slice(F.transform(F.array_distinct(hosts), lambda h: F.concat(scheme, F.lit("://"), h, rest)), 1, 8)


#: The named entities decoded without Python; html_unescape in udfs does all of them.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def strip_tags(c: Column) -> Column:
    """Text without tags, common entities decoded, white space squeezed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles and head dropped, block tags as breaks."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|head)\b.*?</(script|style|head)>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6])[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), "[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))
