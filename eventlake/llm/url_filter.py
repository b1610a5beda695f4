"""URL verdicts: explicit rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained once on the small labelled table below (or one that the caller hands over) and its
coefficients become a constant array, so scoring is a plain projection over any number of pages.

A null url, or one without `://`, has an empty host and path; its verdict is the model's for the empty text
(allow). Repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import double_array, read

#: Rules (action, host + path prefix); a handful by design, as they become one CASE expression.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MAX_RULES = 1000
BUCKETS, NGRAMS, REGULARISATION = 4096, (3, 4), 2e-6

#: The small labelled table: fixed values. Words that mark unwanted hosts, and ordinary ones; hosts join two of a kind.
BLOCKED = """
casino poker slots roulette blackjack jackpot lottery gambling betting bets pills viagra cialis pharmacy steroids adult porn
xxx nude escort camgirls hentai spam clickbait linkfarm malware phishing trojan warez keygen torrent cracked popunder adserver
ads banners tracking payday loans replica counterfeit bitcoin-doubler giveaway
""".split()
ORDINARY = """
news library museum university school science weather garden recipes travel history music cinema health council archive
theatre bookshop kitchen village river mountain gazette review journal forum wiki maps house blog city data home reading
north south east west water stone bridge station market street letter paper winter summer island forest ocean theory method
table order number person people doctor lawyer software hotel flights camera football cycling painting poetry finance
""".split()
PATHS = ["", "/", "/index.html", "/about", "/en/1", "/de/20.html", "/fr/300?page=2", "/es/4/"]


def training_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block) for each word of the table, alone and joined to others, under a few prefixes, endings and
    paths."""
    rows = []
    for label, words in ((1.0, BLOCKED), (0.0, ORDINARY)):
        for i, word in enumerate(words):
            for k, path in enumerate(PATHS):  # every word has every path, so paths alone decide nothing
                name = word if k < 4 else f"{word}-{words[(i + 5 * k) % len(words)]}" if k < 6 else word + words[(i + 7 * k) % len(words)]
                prefix, end = ("", "www.", "m.", "blog.")[(i + k) % 4], ("com", "net", "org")[(i + k) % 3]
                rows.append((f"http://{prefix}{name}.example.{end}{path}", label))
    return spark.createDataFrame(rows, "url string, label double")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its action, else nulls. A rule fits its host and all subdomains by path prefix."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def grams(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of `^host$path`, path digits as 0."""
    text = F.concat(F.lit("^"), host, F.lit("$"), F.translate(path, "123456789", "000000000"))

    def of_length(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*map(of_length, NGRAMS))


@dataclass
class UrlModel:
    """Logistic regression over BUCKETS n-gram shares."""

    weights: list[float]
    bias: float

    def score(self, host: Column, path: Column) -> Column:
        """Log-odds that the url should be blocked."""
        w = double_array(self.weights)
        each = F.transform(grams(host, path), lambda b: F.get(w, b))
        # Sum and number in one fold, so that the n-grams are built once.
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
        step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1.0).alias("n"))
        return F.aggregate(each, zero, step, lambda a: a["s"] / F.greatest(a["n"], F.lit(1.0))) + F.lit(self.bias)


def fit(labelled: DataFrame) -> UrlModel:
    """Train on url, label; made for small tables of some thousand rows."""
    rows = labelled.select("label", grams(*host_path(F.col("url"))).cast("array<string>").alias("g")).filter(F.size("g") > 0)
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "g", "counts")
    shares = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counter.transform(rows))
    model = LogisticRegression(maxIter=60, regParam=REGULARISATION, standardization=False).fit(shares)
    return UrlModel([float(x) for x in model.coefficients], float(model.intercept))


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    host, path = host_path(F.col("url"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("rule", rule)
        .withColumn("action", action)
        .withColumn("score", F.when(F.col("host") == "", F.lit(-1.0)).otherwise(model.score(F.col("host"), F.col("path"))))
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("action", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
            "score",
        )
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES, fit(training_urls(spark)))
