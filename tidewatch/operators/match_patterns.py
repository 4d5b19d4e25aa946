"""URL match patterns, compiled from their texts, met by pages through the suffixes of their hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import urls

from .profiles import host_suffixes

# Fixed values that results depend on: the pattern of all URLs, and the schemes that a star stands for.
ALL = "<all_urls>"
ANY_SCHEME = ["http", "https"]


def compiled(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """patterns with rule: struct of all, scheme (null: any of ANY_SCHEME), host, exact, path, prefix; null where the text is no pattern.

    scheme://host/path: host * is any host, *.x is x and what is below it; a path that ends in * is a prefix, and a
    missing one is /. host is '' for any host.
    """
    text = F.col(pattern)
    parts = F.split(text, "://")
    host = F.regexp_extract(F.get(parts, F.lit(1)), "^([^/]*)", 1)
    path = F.substring(F.get(parts, F.lit(1)), F.length(host) + 1, F.lit(1 << 30))
    path = F.when(path == "", "/").otherwise(path)
    below = host.startswith("*.")
    rule = F.struct(
        F.lit(False).alias("all"),
        F.nullif(F.get(parts, F.lit(0)), F.lit("*")).alias("scheme"),
        F.when(host == "*", "").when(below, F.substring(host, 3, 1 << 30)).otherwise(host).alias("host"),
        ((host != "*") & ~below).alias("exact"),
        F.when(path.endswith("*"), F.regexp_replace(path, r"\*$", "")).otherwise(path).alias("path"),
        path.endswith("*").alias("prefix"),
    )
    every = F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("scheme"), F.lit("").alias("host"), F.lit(False).alias("exact"), F.lit("").alias("path"), F.lit(True).alias("prefix"))
    return patterns.withColumn("rule", F.when(text == ALL, every).when((F.size(parts) == 2) & (host != ""), rule))


def _fits(rule: Column, scheme: Column, host: Column, path: Column) -> Column:
    schemes = F.when(rule["scheme"].isNull(), scheme.isin(ANY_SCHEME)).otherwise(rule["scheme"] == scheme)
    paths = F.when(rule["prefix"], path.startswith(rule["path"])).otherwise(path == rule["path"])
    return rule["all"] | (schemes & (~rule["exact"] | (rule["host"] == host)) & paths)


def matches(pages: DataFrame, patterns: DataFrame, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """pages with each pattern that their url matches, a row for each.

    A page meets patterns by an equi-join of its host's suffixes (a few) with the patterns' hosts; only patterns of any
    host meet every page, as they must. Pages without url match nothing.
    """
    rules = compiled(patterns.select(pattern).distinct(), pattern).filter("rule IS NOT NULL").select(F.col(pattern).alias("_pattern"), F.col("rule").alias("_rule"), F.col("rule.host").alias("_suffix"))
    u = F.col(url)
    parts = pages.filter(u.isNotNull()).withColumns({"_scheme": urls.scheme(u), "_host": urls.host(u), "_path": F.coalesce(F.nullif(urls.path(u), F.lit("")), F.lit("/"))})
    met = parts.withColumn("_suffix", F.explode(F.array_distinct(F.array_append(host_suffixes(F.col("_host")), "")))).join(rules, "_suffix")
    return met.filter(_fits(F.col("_rule"), F.col("_scheme"), F.col("_host"), F.col("_path"))).select(*pages.columns, F.col("_pattern").alias(pattern))
