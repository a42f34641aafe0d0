"""Allow and block rules over hosts and paths, by a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

#: Beyond so many rules the trie isn't broadcast; the rules are joined instead.
MAX_TRIE_RULES = 1_000_000
RULE_TYPE = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("allow", T.BooleanType())]
)


class Rule(NamedTuple):
    """host: the host with all its subdomains. path: what the url's path must start with, "" for any. allow: else it blocks."""

    host: str
    path: str
    allow: bool


class _Node:
    __slots__ = ("below", "segments", "starts")

    def __init__(self):
        self.below: dict[str, _Node] = {}  # by the next host label to the left, or by a whole path segment
        self.segments: _Node | None = None  # the root of the paths of this host
        self.starts: dict[str, Rule] = {}  # the last segment of a rule, which may go on in the url


class RuleTrie:
    """Host labels from the right, then path segments. match() gives the rule with the most labels, then with the longest path; at a tie block wins."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.segments = node.segments or _Node()
            node = node.segments
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            if last not in node.starts or not rule.allow:
                node.starts[last] = rule

    def match(self, host: str, path: str) -> Rule | None:
        found, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                return found
            if node.segments is not None:
                found = self._longest(node.segments, segments) or found
        return found

    @staticmethod
    def _longest(node: _Node, segments: list[str]) -> Rule | None:
        found = None
        for segment in segments:
            fits = [start for start in node.starts if segment.startswith(start)]
            if fits:
                found = node.starts[max(fits, key=len)]
            node = node.below.get(segment)
            if node is None:
                return found
        return found


def split_url(url):
    """Columns of host and path: the host follows the first "://" up to "/", "?", "#" or the end and has A-Z in lower case, the path follows up to "?", "#" or
    the end. Without "://", and for null, both are empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """Adds host, path, rule (host and path of the rule that decides, or null) and verdict (allow or block) to every row, replacing columns of those names.

    rules: a list, or a DataFrame of host, path and allow. Up to max_trie_rules of them become one broadcast trie; more are joined on the url's host suffixes,
    with the same results. A null or empty url has an empty host, which no rule fits, and gets the default. Rows are neither dropped nor repeated, and
    the order of precedence is: most host labels, longest path, block before allow.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    if isinstance(rules, DataFrame):
        rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "allow").where("host is not null and allow is not null")
        few = rules.limit(max_trie_rules + 1).count() <= max_trie_rules
        if few:
            rules = [Rule(*row) for row in rules.collect()]
    elif few := len(rules) <= max_trie_rules:
        rules = [Rule(*r) for r in rules]
    else:
        rules = spark.createDataFrame(rules, RULE_TYPE)
    if few:
        trie = spark.sparkContext.broadcast(RuleTrie(rules))

        @F.pandas_udf(RULE_TYPE)
        def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            match = trie.value.match
            return pd.DataFrame([match(*x) or (None, None, None) for x in zip(hosts, paths)], columns=["host", "path", "allow"])

        found = _free("found", split.columns)
        split = split.withColumn(found, decide("host", "path"))
    else:
        split, found = _joined(split, rules)
    rule = F.concat(F.col(found)["host"], F.col(found)["path"])
    verdict = F.when(F.col(found)["allow"], "allow").when(~F.col(found)["allow"], "block").otherwise(default)
    return split.withColumns({"rule": rule, "verdict": verdict}).drop(found)


def _joined(split: DataFrame, rules: DataFrame) -> tuple[DataFrame, str]:
    """The same by a join: distinct (host, path) pairs, one row for each suffix of the host, and the best rule of each pair."""
    pairs = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "allow")
    best = (
        pairs.withColumn("suffix", F.explode(suffixes))
        .join(r, "suffix")
        .where(F.expr("startswith(path, start)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.col("suffix").alias("host"), F.col("start").alias("path"), "allow"), F.struct(F.size(F.split("suffix", r"\.")), F.length("start"), ~F.col("allow"))).alias("found"))
    )
    found = _free("found", split.columns)
    return split.join(best.withColumnRenamed("found", found), ["host", "path"], "left"), found
