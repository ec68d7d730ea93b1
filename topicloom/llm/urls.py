"""URL filters: pattern rules indexed by their rarest literal token.

A url's tokens fetch the rules that could fit it; only those run their regular
expressions. Rules are few beside urls, but nothing here relies on that: the
index is an ordinary table, which Spark broadcasts only below its threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over host + path, with the tokens that every url it
    fits must hold. Named rules win over unnamed ones, then the longest."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None


def prefix_rule(rule: str, verdict: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the path starts
    with the rule's."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    # a token counts only where the rule itself ends it: the last one of the path may go on in the url
    ended = re.findall(r"[a-z0-9]+(?![a-z0-9]|$)", path.lower())
    tokens = tuple(re.findall("[a-z0-9]+", host.lower()) + ended)
    return UrlRule(rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}" if path else rf"^(?:[^/]*\.)?{re.escape(host.lower())}(?:/|$)", tokens, verdict, rule)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """Fits urls of which the host or path holds the word as a whole token."""
    return UrlRule(rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", (word,), verdict)


#: Fixed rules of the contract.
CONTRACT_RULES = (prefix_rule("net/", "block"), prefix_rule("example.net/en/", "allow"), prefix_rule("example.com/de/", "block"), prefix_rule("org/fr/", "allow"))
#: Words whose presence in a host or path blocks a url that no named rule fits.
BLOCK_WORDS = ("adult", "casino", "porn", "xxx", "malware", "phishing", "spam", "ads", "pills", "bets")


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z folded) and path; both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def url_verdicts(pages: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict for every row.

    A rule stands in the index under that token of its own which the fewest
    distinct urls hold, counted over all urls; rules without tokens are tried on
    every url. Null and empty urls, and urls without ``://``, have empty host
    and path and get the default verdict unless a rule fits the empty text.
    Repeated urls are judged once and each row gets the result; an empty table
    gives an empty result. Columns that host, path, rule or verdict would clash
    with are replaced.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("__u_url"))
    urls = pages.select(F.col(url_col).alias("__u_url")).where(F.col("__u_url").isNotNull()).distinct().select("__u_url", F.concat(host, path).alias("_at"))
    table = spark.createDataFrame([(k, r.pattern, r.name, r.verdict, list(dict.fromkeys(r.tokens))) for k, r in enumerate(rules)], "_rule int, _pattern string, _name string, _verdict string, _tokens array<string>")

    terms = urls.select("__u_url", "_at", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("_at", UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))).alias("_token"))
    wanted = table.select("_rule", F.explode("_tokens").alias("_token"))
    counts = terms.join(wanted.select("_token").distinct(), "_token", "left_semi").groupBy("_token").count()
    rank = Window.partitionBy("_rule").orderBy(F.coalesce("count", F.lit(0)), "_token")
    index = wanted.join(counts, "_token", "left").withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select("_rule", "_token")

    keyed = terms.join(index, "_token").select("__u_url", "_at", "_rule")
    always = [k for k, r in enumerate(rules) if not r.tokens]
    if always:
        keyed = keyed.union(urls.select("__u_url", "_at", F.explode(F.array(*map(F.lit, always))).alias("_rule")))
    fits = keyed.join(table, "_rule").where(F.expr("_at rlike _pattern"))
    best = fits.groupBy("__u_url").agg(F.max(F.struct(F.col("_name").isNotNull().alias("named"), F.coalesce(F.length("_name"), F.lit(0)).alias("length"), F.coalesce("_name", F.lit("")).alias("by_name"), (-F.col("_rule")).alias("order"), F.col("_name").alias("rule"), F.col("_verdict").alias("verdict"))).alias("__u_best"))
    out = pages.drop("host", "path", "rule", "verdict").withColumn("__u_url", F.col(url_col)).join(best, "__u_url", "left")
    host, path = split_url(F.col("__u_url"))
    return out.select("*", host.alias("host"), path.alias("path"), F.col("__u_best.rule").alias("rule"), F.coalesce(F.col("__u_best.verdict"), F.lit(default)).alias("verdict")).drop("__u_url", "__u_best")
