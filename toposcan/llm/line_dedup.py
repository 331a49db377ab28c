"""Removal of boilerplate lines by their frequency on a site.

Documents are grouped by host. The share of a line is the number of the host's pages that contain it divided by all of the host's
pages; lines above ``ratio`` and on at least ``min_pages`` pages are dropped wherever they occur on the host. Pages with the same text
count once in both numbers, so that a group of exact copies does not turn its whole text into boilerplate. A line is compared
without blanks around it; lines without a word are never dropped, nor counted.

Few lines can pass: the shares of a host's lines add up to its mean number of distinct lines per page, so at most 1/ratio times
that many exceed the ratio. They travel to the documents as one array per host, and no line is shuffled twice.

A null host is a host of its own. A null text has no lines and stays null. Repeated rows count once and are cleaned alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.llm.common import SEPARATORS, stored

RATIO = 0.1
MIN_PAGES = 5
BROADCAST_LINES = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """A 64-bit name of a line; 0 for one without a word."""
    core = F.btrim(line, F.lit(SEPARATORS))
    return F.when(F.length(core) > 0, F.xxhash64(core)).otherwise(F.lit(0).cast("long"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: keys of the lines to drop on each host that has any."""
    pages = docs.filter(F.col(text).isNotNull()).select(F.col(host).cast("string").alias("host"), F.xxhash64(F.col(text)).alias("page"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(_lines(F.col("text")), _key))
    seen = pages.select("host", "page", F.explode(keys).alias("line"))
    # a page counts under the key 0 as well: that is the host's total
    seen = seen.unionByName(pages.select("host", "page", F.lit(None).cast("long").alias("line"))).filter("line is null or line <> 0")
    counts = seen.groupBy("host", "line", "page").count().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = counts.filter("line is null").select(F.col("host").alias("__host"), F.col("pages").alias("total"))
    frequent = counts.filter(F.col("line").isNotNull() & (F.col("pages") >= min_pages))
    over = frequent.join(totals, F.col("host").eqNullSafe(F.col("__host"))).filter(F.col("pages") > ratio * F.col("total"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def cleaned(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows of ``docs`` as ``__row`` with ``__lines`` and those of them ``__kept``."""
    whole = docs.select(F.struct("*").alias("__row"), F.col(host).cast("string").alias("__own"), F.col(text).alias("__text"))
    bad = stored(boilerplate(docs, host, text, ratio, min_pages), "boilerplate-lines")
    size = bad.agg(F.sum(F.size("lines"))).first()[0] or 0
    # up to 16 MB of keys go to every task, and no text is shuffled; beyond that hosts are joined by shuffle, a large one in parts
    joined = whole.join(F.broadcast(bad) if size <= BROADCAST_LINES else bad, F.col("__own").eqNullSafe(F.col("host")), "left").withColumn("__lines", _lines(F.col("__text")))
    clean = F.filter("__lines", lambda x: ~F.array_contains(F.col("lines"), _key(x)))
    return joined.withColumn("__kept", F.when(F.col("lines").isNull(), F.col("__lines")).otherwise(clean))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", **bounds) -> DataFrame:
    """All rows of ``docs`` with the lines dropped from ``text``; a page of nothing but boilerplate keeps an empty text."""
    out = cleaned(docs, host, text, **bounds)
    body = F.array_join("__kept", "\n")
    return out.withColumn("__text", F.when(F.size("__kept") < F.size("__lines"), body).otherwise(F.col("__text"))).select(
        *[(F.col("__text") if c == text else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
