"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from toposcan.session import scratch

SEPARATORS = " \t\n\x0b\f\r"
WORD_GAP = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a new shared folder and read again: later jobs start from the files, not from lost tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_process(key: tuple, make: Callable):
    """``make()``, called once per Python process: functions travel to tasks by value, so a module's globals do not outlive a task."""
    held = vars(sys.modules.setdefault("_toposcan_held", types.ModuleType("_toposcan_held")))
    if key not in held:
        held[key] = make()
    return held[key]


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (as long) and the text, under names of their own, so that other columns cannot clash."""
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], rank: str, per_bucket: int = 200_000) -> DataFrame:
    """Add ``rank``: gapless from 0 within every group of ``by``, however large a group is.

    Rows are dealt to buckets by a hash of ``order`` (a third of all rows may share a group), numbered inside their bucket, and
    shifted by the totals of the buckets before it. The number of buckets follows the row count, so that no task numbers more than
    about ``per_bucket`` rows; the totals are one row per group and bucket. Rows that agree in every ``order`` column are interchangeable.
    """
    from pyspark.sql import Window

    buckets = max(1, df.count() // per_bucket)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    totals = dealt.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    names = [f"__k{i}" for i in range(len(by))]
    before = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*names, "__bucket").orderBy(*order)
    out = dealt.withColumns({n: k for n, k in zip(names, keys)}).withColumn("__row", F.row_number().over(inside))
    out = out.join(totals, [*names, "__bucket"])
    return out.withColumn(rank, (F.col("__before") + F.col("__row") - 1).cast("long")).drop("__bucket", "__before", "__row", *names)
