"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with a verdict and the literal tokens that any URL it fits must hold.  Tokens of all URLs are counted; each rule
is filed under the token of its own that fewest URLs hold.  The tokens of a URL fetch the rules filed under them (an equi-join), and
only those run their regular expressions.  Of the rules that fit, the one with the highest weight wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Path rules weigh this and their length, so that they come before all word rules.
PATH_WEIGHT = 1_000_000
# What a token is, in rules and in URLs alike; anything else is a mark.
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in the subject ``host``, a line feed and ``path``; ``tokens`` are lower-case words of it."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int


def words_of(text: str) -> list[str]:
    """Tokens of a rule's text, cut as those of URLs are."""
    return re.findall(TOKEN, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def path_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits a host and its subdomains if the path starts with ``path``; longer rules weigh more.

    Its tokens are those of the host and the whole path segments (the last one may go on in a URL).
    """
    name = host + path
    segments = path.split("/")[1:-1]
    tokens = [t for part in [*host.split("."), *segments] for t in words_of(part)]
    return Rule(name, f"^(?:[^\\n]*\\.)?{re.escape(host)}\\n{re.escape(path)}", tuple(dict.fromkeys(tokens)), verdict, PATH_WEIGHT + len(name))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits URLs that hold a word between marks anywhere in host or path."""
    tokens = tuple(dict.fromkeys(words_of(word)))
    return Rule(word, f"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])", tokens, verdict, len(word))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, as patterns do: other letters stay marks."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) part after the first ``://`` up to ``/``, ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.name, r.pattern, list(r.tokens), r.verdict, r.weight) for r in rules]
    return spark.createDataFrame(rows, "rule string, pattern string, tokens array<string>, verdict string, weight int")


def apply_rules(pages: DataFrame, rules: DataFrame, id_cols: list[str], url_col: str = "url") -> DataFrame:
    """``id_cols, host, path, hit`` of every row; ``hit`` is a struct (weight, rule, verdict) of the winning rule, or null.

    ``rules`` is a table as :func:`rule_table` makes.  A rule without tokens is an error.  Equal weights: the greater rule name wins.  Distinct
    (host, path) pairs are judged once, so repeated URLs and a host with a third of the rows cost no more than their distinct paths.
    """
    keyed = pages.select(*id_cols, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    places = keyed.select("host", "path").distinct()
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat_ws("\n", "host", "path")), F.lit(TOKEN), F.lit(0)))
    spread = places.select("host", "path", F.explode(tokens).alias("token"))
    checked = rules.select("*", F.assert_true(F.size("tokens") > 0, "a rule has no token").alias("_ok")).where(F.col("_ok").isNull()).drop("_ok")
    filed = checked.withColumn("token", F.explode("tokens"))
    held = spread.groupBy("token").agg(F.count("*").alias("n")).join(filed.select("token").distinct(), "token", "left_semi")
    rarest = (
        filed.join(held, "token", "left").groupBy("rule", "pattern", "verdict", "weight")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("at")).select("rule", "pattern", "verdict", "weight", "at.token")
    )
    fits = spread.join(rarest, "token").where(F.expr("regexp_like(concat_ws('\n', host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("weight", "rule", "verdict")).alias("hit"))
    return keyed.join(best, ["host", "path"], "left").select(*id_cols, "host", "path", "hit")
