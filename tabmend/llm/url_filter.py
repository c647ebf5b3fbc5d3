"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

A list of URLs may be long and most URLs are not on it.  The distinct canonical forms of the list set
bits in a table of blocks of 256 bits: a hash picks the block, and one bit in each of its eight
words.  The table is bounded, so it is broadcast; a URL that misses a bit is not listed and moves nowhere.
The possible hits are joined with the list itself by their canonical forms, which removes the false
positives, so the size of the filter changes the cost and never a verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.blocked_filter import BITS, MAX_BLOCKS, BlockedFilter
from tabmend.llm.common import UPPER, Workspace, named

#: Parameters that say where a reader came from, not what the page is.
TRACKING = r"(utm_[^=]*|gclid|fbclid|ref)(=.*)?"

ALLOW, BLOCK = "allow", "block"


def host_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/ ? #``, lower-cased, and then up to ``? #``; empty without one."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, UPPER.lower()), part(2)


def canonical(url: Column) -> Column:
    """One form for the addresses of a page; null where a URL has no ``://``.

    Host in lower case without user, ``www.``, default port or last dot; path with single slashes and
    none at its end; parameters sorted, without those of TRACKING; no scheme, no fragment."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:(80|443)?)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?s)^{TRACKING}$"))
    query = F.array_join(F.array_sort(pairs), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), whole)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one.

    A rule (host, path, verdict) fits its host and every host below it where the path starts with the
    rule's; an empty host fits all.  Of equal lengths the longer host wins, then the smaller text."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for at, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r), reverse=True):
        fits = F.startswith(path, F.lit(start))
        if at:
            fits = fits & F.endswith(F.concat(F.lit("."), host), F.lit(f".{at.lower()}"))
        told = F.struct(F.lit(at.lower() + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, told).otherwise(found)
    return found


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    url_col: str = "url",
    listed_col: str = "url",
    bits: int = BITS,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, listed (boolean) and verdict.

    The longest rule that fits decides (every URL is tested against every rule, so there should be
    hundreds at most); without one, URLs of the list are blocked and others allowed.  Null
    URLs and those without ``://`` have an empty host and path and are on no list; null or such entries
    of the list are ignored, repeated ones count once.  Rows that repeat stay.  An empty list blocks
    nothing.  Columns of ``pages`` named like new ones are replaced."""
    space = Workspace(pages.sparkSession)
    names = listed.select(canonical(named(listed_col).cast("string")).alias("canon"))
    names = space.stored(names.filter("canon IS NOT NULL").distinct(), "listed")
    url = named(url_col).cast("string")
    host, path = host_path(url)
    new = ("host", "path", "rule", "listed", "verdict")
    kept = [named(c) for c in pages.columns if c not in new]
    rows = pages.select(
        F.struct(*kept).alias("row_"), host.alias("host_"), path.alias("path_"), canonical(url).alias("canon_")
    ).withColumn("rule_", rule_of(F.col("host_"), F.col("path_"), rules))
    rows = BlockedFilter(names, "canon", bits, max_blocks).marked(rows, "canon_")
    hits = rows.filter("possible_").join(names, F.col("canon_") == F.col("canon"), "left")
    hits = hits.withColumn("listed_", F.col("canon").isNotNull()).drop("canon")
    rest = rows.filter("NOT possible_").withColumn("listed_", F.lit(False))
    own = F.when(F.col("listed_"), BLOCK).otherwise(ALLOW)
    return hits.unionByName(rest).select(
        "row_.*",
        F.col("host_").alias("host"),
        F.col("path_").alias("path"),
        F.col("rule_.rule").alias("rule"),
        F.col("listed_").alias("listed"),
        F.coalesce(F.col("rule_.verdict"), own).alias("verdict"),
    )
