"""Rule tables compiled to one projection: each row gets the result of the first rule whose conditions all hold."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A condition: column, test, value.
Condition = tuple[str, str, Any]


class Rule(NamedTuple):
    result: str
    conditions: tuple[Condition, ...] = ()


def _test(column: str, test: str, value: Any) -> Column:
    """A condition that is true or false for every row: texts are trimmed and lower-cased, null is blank, a null number 0."""
    t = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    n = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) if test in ("below", "zero") else None
    listed = [value] if isinstance(value, str) else list(value or []) if test in ("in", "not_in", "has", "has_not", "kin", "not_kin") else []
    some = lambda f: F.exists(F.array(*map(F.lit, listed)), f) if listed else F.lit(False)
    has, kin = some(lambda w: F.contains(t, w)), some(lambda w: F.contains(t, w) | F.contains(w, t))
    tests = {
        "in": lambda: t.isin(listed), "not_in": lambda: ~t.isin(listed), "blank": lambda: t == "", "filled": lambda: t != "",
        "has": lambda: has, "has_not": lambda: ~has, "kin": lambda: kin, "not_kin": lambda: ~kin, "true": lambda: t == "true",
        "below": lambda: n < F.lit(float(value)), "zero": lambda: n == 0,
    }
    if test not in tests:
        raise ValueError(f"unknown test {test}")
    return tests[test]()


def choose(rules: list[Rule]) -> Column:
    """result and nth (from 1) of the first rule that holds, as a struct; null where none does. A rule without conditions always holds.

    Tests: in, not_in (the whole text), has, has_not (part of the text), kin, not_kin (either is part of the other), blank,
    filled, true, below, zero. The table is part of the plan and bounded by it: longer lists are joined (see joins).
    """
    if not rules:
        raise ValueError("no rules")
    out = None
    for nth, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule.conditions:
            holds = holds & _test(*c)
        made = F.struct(F.lit(rule.result).alias("result"), F.lit(nth).alias("nth"))
        out = F.when(holds, made) if out is None else out.when(holds, made)
    return out


def queue_counts(df: DataFrame, tables: dict[str, list[Rule]]) -> DataFrame:
    """selector, queue, n for several rule tables in one pass over df."""
    each = F.array(*(F.struct(F.lit(name).alias("selector"), choose(rules)["result"].alias("queue")) for name, rules in tables.items()))
    return df.select(F.inline(each)).groupBy("selector", "queue").agg(F.count("*").alias("n"))


#: Categories that are read from sites, words of names that say so, places sold by ticketing, categories likely to be.
SITE_CATEGORIES = [
    "bookstores with author events", "libraries with public events", "museums", "history museums", "science museums",
    "art galleries chelsea", "art galleries brooklyn", "photography galleries", "cultural centers", "community centers with events",
    "lecture halls universities", "workshop class spaces", "podcast recording venues", "parks with events concerts",
    "nyc parks with free events", "outdoor movies parks nyc", "summer concerts parks nyc", "shakespeare in the park nyc",
    "parks with programming activities", "outdoor event spaces gardens", "public plazas with programming",
]
SITE_WORDS = ["library", "museum", "gallery", "bookstore", "books", "botanical garden", "public garden", "plaza", "cultural center", "community center", "university", "college"]
TICKETED_PLACES = [
    "madison square garden", "msg", "barclays center", "radio city music hall", "beacon theatre", "beacon theater", "carnegie hall", "terminal 5",
    "brooklyn steel", "webster hall", "irving plaza", "hammerstein ballroom", "forest hills stadium", "the rooftop at pier 17", "summerstage",
    "central park summerstage",
]
LIKELY_TICKETED = [
    "music venue", "concert halls", "rock music venues", "jazz clubs", "broadway theaters", "off broadway theaters", "comedy clubs",
    "dance venues ballet contemporary", "performing arts centers", "live music bars", "amphitheaters", "arenas stadiums",
]

_ID, _NO_ID = ("ticket_id", "not_in", ["", "not_found"]), ("ticket_id", "in", ["", "not_found"])
_SITE, _NO_SITE = ("site", "filled", None), ("site", "blank", None)
_EVENTS, _NO_EVENTS = ("events_url", "filled", None), ("events_url", "blank", None)
_OPEN = ("name", "not_kin", TICKETED_PLACES)
_STATUS = lambda *s: ("status", "in", s)

#: Which source a place is read from. Columns: name, category, site, preferred, ticket_id. Categories that ticketing sells
#: and mixed ones come to the same choice, so they need no rules of their own.
STRATEGY = [
    Rule("ticketing_only", (("preferred", "in", "ticketing"), _ID)),
    Rule("skip", (("preferred", "in", "ticketing"),)),
    Rule("scrape_only", (("preferred", "in", "scrape"), _SITE)),
    Rule("skip", (("preferred", "in", "scrape"),)),
    Rule("skip", (_NO_SITE, _NO_ID)),
    *(Rule(r, (_OPEN, c, s)) for c in (("category", "in", SITE_CATEGORIES), ("name", "has", SITE_WORDS)) for r, s in (("scrape_only", _SITE), ("skip", _NO_SITE))),
    Rule("both", (_ID, _SITE)),
    Rule("ticketing_only", (_ID,)),
    Rule("scrape_only"),
]


def work_queues(attempts: int, category: str = "", refresh: bool = True, zero_only: bool = False) -> dict[str, list[Rule]]:
    """The selectors of the jobs over places: validation, API scan, ticketing scan, listing pages, fetch, coordinates.

    Columns: status, site, aggregator, events_url, attempts, event_count, ticket_id, api, category, latitude, longitude,
    address, vague. attempts: so many searches at most; category: part of the categories to scan; refresh: look again
    where a listing had no event; zero_only: fetch only such places.
    """
    verified = _STATUS("verified")
    return {
        "validate": [
            Rule("ticketed", (_ID,)),
            Rule("validate", (_SITE, ("aggregator", "true", None))),
            Rule("validate", (verified, _SITE, _NO_EVENTS)),
            *([Rule("validate", (verified, _SITE, ("event_count", "zero", None)))] if refresh else []),
            Rule("verified", (verified,)),
            Rule("validate", (_STATUS("reachable_no_events_page"), _SITE, _NO_EVENTS)),
            Rule("validate", (_STATUS("search_failed"), ("attempts", "below", attempts))),
            *(Rule(s, (_STATUS(s),)) for s in ("reachable_no_events_page", "search_failed", "ambiguous", "closed", "dead_site", "unreachable")),
            Rule("validate"),
        ],
        "api": [
            Rule("has_api", (("api", "filled", None),)),
            Rule("not_ready", (_NO_SITE,)),
            Rule("not_ready", (("status", "not_in", "verified"),)),
            *([Rule("other_category", (("category", "has_not", category.lower()),))] if category else []),
            Rule("scan"),
        ],
        "ticketing": [
            Rule("checked", (("ticket_id", "filled", None),)),
            Rule("scan", (("category", "has", LIKELY_TICKETED),)),
            Rule("not_ticketed"),
        ],
        "listing": [
            Rule("has_listing", (_EVENTS,)),
            Rule("ticketed", (_ID,)),
            Rule("scan", (verified, _SITE)),
            Rule("not_ready"),
        ],
        "fetch": [
            Rule("fetch", (_STATUS("verified", "reachable_no_events_page"), *((_EVENTS, ("event_count", "zero", None)) if zero_only else ()))),
            Rule("leave"),
        ],
        "coordinates": [
            Rule("no_listing", (_NO_EVENTS,)),
            Rule("placed", (("latitude", "filled", None), ("longitude", "filled", None))),
            Rule("no_address", (("address", "blank", None),)),
            Rule("bad_address", (("vague", "true", None),)),
            Rule("fill"),
        ],
    }
