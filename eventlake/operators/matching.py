"""Which strings contain or resemble which, by equi joins on character grams instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the character grams that stand for a longer string.
GRAM = 3


def _grams(c: str, n: int | Column) -> Column:
    """Distinct substrings of n characters."""
    at = F.sequence(F.lit(1), F.length(c) - F.lit(n) + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(F.col(c), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained_pairs(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """needle, hay: all pairs of distinct, not empty strings where hay contains needle (equal ones too).

    A needle is looked up by its rarest gram among the hays, so that few pairs are left to verify; one with a gram that
    no hay has is out at once. Needles shorter than a gram meet the hays' substrings of their own length.
    """
    few = lambda d, c, as_: d.select(F.col(c).alias(as_)).filter(F.length(as_) > 0).distinct()
    n, h = few(needles, needle, "_n"), few(hays, hay, "_h")
    grams = h.select("_h", F.explode(_grams("_h", GRAM)).alias("_g"))
    known = grams.groupBy("_g").agg(F.count("*").alias("_f"))
    parts = n.filter(F.length("_n") >= GRAM).select("_n", F.explode(_grams("_n", GRAM)).alias("_g"))
    rarest = parts.join(known, "_g", "left").groupBy("_n").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "_g")).alias("_r"))
    anchors = rarest.filter(F.col("_r.f") > 0).select("_n", F.col("_r._g").alias("_g"))
    long = grams.join(anchors, "_g").filter(F.contains("_h", F.col("_n"))).select("_n", "_h")
    sizes = F.array(*map(F.lit, range(1, GRAM)))
    pieces = h.select("_h", F.explode(F.flatten(F.transform(sizes, lambda k: _grams("_h", k)))).alias("_n"))
    short = pieces.join(n.filter(F.length("_n") < GRAM), "_n").select("_n", "_h")
    return long.unionByName(short).select(F.col("_n").alias(needle), F.col("_h").alias(hay))


def _signs(c: str) -> Column:
    """A string's characters as a set: each with the number of its occurrence."""
    chars = F.split(F.col(c), "")
    each = lambda x: F.transform(F.sequence(F.lit(1), F.size(F.filter(chars, lambda y: y == x))), lambda k: F.concat(x, k.cast("string")))
    return F.flatten(F.transform(F.array_distinct(chars), each))


def alike_pairs(left: DataFrame, a: str, right: DataFrame, b: str, least: float) -> DataFrame:
    """a, b: pairs of distinct, not empty strings whose matching-blocks ratio can reach least (above 0, at most 100).

    Matching blocks hold at most the characters that both strings have, so 200 * common / (sum of lengths) bounds the
    ratio. If the bound reaches least, the strings share one of their rarest characters, as many of them as the length
    leaves over; these are joined, and the bound is tested on full counts. No pair that reaches least is lost.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be above 0 and at most 100")
    share = least / (200 - least)  # of a string's characters, in common with any partner
    few = lambda d, c, as_: d.select(F.col(c).alias(as_)).filter(F.length(as_) > 0).distinct().withColumn(f"{as_}s", _signs(as_))
    x, y = few(left, a, "_a"), few(right, b, "_b")
    seen = lambda d, c: d.select(F.explode(f"{c}s").alias("_s"))
    often = seen(x, "_a").unionByName(seen(y, "_b")).groupBy("_s").agg(F.count("*").alias("_f"))

    def rarest(d: DataFrame, c: str) -> DataFrame:
        rows = d.select(c, F.explode(f"{c}s").alias("_s")).join(often, "_s")
        ranked = rows.groupBy(c).agg(F.array_sort(F.collect_list(F.struct("_f", "_s"))).alias("_o"))  # one string's characters
        keep = F.size("_o") - F.ceil(F.size("_o") * F.lit(share) - 1e-9).cast("int") + 1
        return ranked.select(c, F.explode(F.slice("_o", F.lit(1), keep)).alias("_o")).select(c, F.col("_o._s").alias("_s"))

    met = rarest(x, "_a").join(rarest(y, "_b"), "_s").select("_a", "_b").distinct()
    full = met.join(x, "_a").join(y, "_b")
    common = F.size(F.array_intersect("_as", "_bs"))
    reach = common * 200 >= (F.size("_as") + F.size("_bs")) * F.lit(float(least)) - 1e-6
    return full.filter(reach).select(F.col("_a").alias(a), F.col("_b").alias(b))
