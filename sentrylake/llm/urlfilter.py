"""URL filtering by hashed expressions.

Each URL is expanded into host suffixes times path prefixes. The expressions meet the rules in an
equi-join on a short hash prefix, the full digest confirms, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _SMALL)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host_col: Column, path_col: Column, lengths: Column) -> Column:
    """Every host suffix at a label border, each with every path prefix of the given lengths."""
    labels = F.split(host_col, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.transform(F.filter(lengths, lambda n: n <= F.length(path_col)), lambda n: F.substring(path_col, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda p: F.concat(h, F.lit("\n"), p)))))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge(urls: DataFrame, url: str, rules: DataFrame, otherwise: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """All columns of `urls` and url_host, url_path, url_rule, url_verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the
    rule's path. Of fitting rules the one with most characters in host and path together wins, then the
    one with the longer host, then `block` before `allow`. Without a rule the verdict is `otherwise`.

    Null URLs and URLs without :// have an empty host and path. A null host or path of a rule counts as
    empty. Only distinct (host, path) pairs are expanded, so a URL that fills a third of the table is
    judged once; the rules are joined by their hash prefix, and whether they are small enough to send to
    every task is left to the planner, which knows their size. Path prefixes are built for the lengths
    that occur in the rules (one number per length, bounded by the longest rule path), so any prefix
    fits, not only those that end at a slash. Columns of the input that clash with the four new names
    are replaced."""
    rules = rules.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
    full = F.concat("h", F.lit("\n"), "p")
    rules = rules.select("h", "p", "v", _digest(full).alias("digest"), F.substring(_digest(full), 1, prefix_digits).alias("prefix"))
    lengths = F.array(*[F.lit(r[0]) for r in rules.select(F.length("p")).distinct().collect()]).cast("array<int>")

    named = urls.withColumns({"url_host": host(F.col(url)), "url_path": path(F.col(url))}).drop("url_rule", "url_verdict")
    places = named.select("url_host", "url_path").distinct()
    exprs = places.withColumn("e", F.explode(expressions(F.col("url_host"), F.col("url_path"), lengths)))
    exprs = exprs.select("url_host", "url_path", _digest(F.col("e")).alias("e_digest")).withColumn("prefix", F.substring("e_digest", 1, prefix_digits))
    confirmed = exprs.join(rules, "prefix").where(F.col("e_digest") == F.col("digest"))
    best = confirmed.groupBy("url_host", "url_path").agg(F.max(F.struct(
        (F.length("h") + F.length("p")).alias("n"), F.length("h").alias("hn"), F.col("v").alias("v"), F.concat("h", "p").alias("rule"))).alias("b"))
    best = best.select("url_host", "url_path", F.col("b.rule").alias("url_rule"), F.col("b.v").alias("_v"))
    # `block` sorts after `allow`, so the maximum prefers it among equals.
    return named.join(best, ["url_host", "url_path"], "left").withColumn("url_verdict", F.coalesce("_v", F.lit(otherwise))).drop("_v").select(
        *[F.col(f"`{c}`") for c in named.columns], "url_rule", "url_verdict")
