"""URL rules by host-suffix and path-prefix expressions (DataFrame functions only).

A rule names a host (it fits all subdomains) and the start of a path. Each URL is
expanded into the expressions a rule could be stored under: every suffix of its host
at a dot, with every prefix of its path at a slash. The expressions are matched in
two steps: a semi-join on the first hex digits of their SHA-256, which very few
expressions survive, and a join of the survivors on the full digest. A rule whose
path does not end at a slash is stored under its last slash, and the rest of it is
compared on the match. Of the rules that fit, the longest wins (characters of host
and path; then the longer host; then block before allow).

URLs are expanded only as deep as the deepest rule: no deeper expression can match.

Edge cases: a null URL or one without ``://`` has an empty host and path and gets the
default verdict unless a rule has the empty host and path; a rule with a null host or
path counts as empty there, one with a null action gives the default; repeated rules
and pages are fine; no rules or no pages give the default or nothing. Input columns
named like an output are replaced, others carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.native import let

OUT = ("host", "path", "rule", "verdict")
#: Hex digits of the digest that the first join compares (32 bits).
PREFIX_HEX = 8
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.drop("host", "path").withColumns({"host": F.translate(host, ASCII_UPPER, ASCII_LOWER), "path": path})


def _key(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def rule_table(rules: DataFrame, default: str) -> DataFrame:
    """Rules (host, path, action) with what they are stored under, and how they rank."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = rules.select(F.translate(empty("host"), ASCII_UPPER, ASCII_LOWER).alias("r_host"), empty("path").alias("r_path"), F.coalesce(F.col("action"), F.lit(default)).alias("action"))
    r = r.dropDuplicates().withColumn("r_dir", F.regexp_extract("r_path", "^(.*/)?", 0))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("chars"), F.length("r_host").alias("host_chars"), (F.col("action") == "block").alias("blocks"),
                    F.concat("r_host", "r_path").alias("rule"), F.col("action"))
    r = r.withColumns({"rank": rank, "digest": _key(F.col("r_host"), F.col("r_dir"))})
    return r.withColumns({"prefix": F.substring("digest", 1, PREFIX_HEX), "labels": F.size(F.split("r_host", "\\.")), "slashes": F.length("r_dir") - F.length(F.replace(F.col("r_dir"), F.lit("/"), F.lit("")))})


def _expressions(labels: int, slashes: int) -> Column:
    """All (suffix, prefix) of host and path, at most that many labels and slashes deep."""
    host, path = F.col("host"), F.col("path")
    have = F.size(F.split(host, "\\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(have, F.lit(labels))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    have_slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(have_slashes, F.lit(slashes))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/"))))
    return let(prefixes, lambda p: F.flatten(F.transform(suffixes, lambda s: F.transform(p, lambda x: F.struct(s.alias("suffix"), x.alias("dir"))))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, the winning rule (null if none fits) and the verdict.

    ``rules``: host, path, action. ``default`` is the verdict where no rule fits.
    """
    parts = with_parts(pages.drop("rule", "verdict"), url)
    stored = cut(rule_table(rules, default))
    depth = stored.agg(F.max("labels").alias("l"), F.max("slashes").alias("s")).first()
    if depth["l"] is None:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # one row per distinct (host, path): repeated URLs are expanded once
    each = parts.select("host", "path").distinct()
    wide = each.select("host", "path", F.explode(_expressions(depth["l"], depth["s"])).alias("e"))
    wide = wide.select("host", "path", _key(F.col("e.suffix"), F.col("e.dir")).alias("digest"))
    near = wide.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).join(stored.select("prefix").distinct(), "prefix", "left_semi")
    hits = near.drop("prefix").join(stored.select("digest", "r_path", "rank"), "digest").filter(F.startswith(F.col("path"), F.col("r_path")))
    best = hits.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.max("rank").alias("__best"))
    out = parts.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return out.select(*parts.columns, F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict"))
