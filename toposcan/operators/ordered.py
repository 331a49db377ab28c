"""Positions and running values over a whole table without one-task windows.

A window without ``PARTITION BY`` sends every row to one task. Here the order
column is cut at approximate quantiles. Every quantile value has a bucket of
its own, so a value that holds a large share of the rows is alone in it and can
be cut again by the tie-breaker. Rows are then numbered inside each bucket, and
bucket totals (a table bounded by ``splits``) supply the offsets. The result is
exact whatever the quantile error; only the balance depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.session import cut

SPLITS = 32
MAX_SPLITS = 1024
#: Rows that one bucket should not exceed by much; larger tables are cut into more buckets.
BUCKET_ROWS = 2_000_000


def _cuts(df: DataFrame, by: list[str], cols: dict[str, str], splits: int) -> DataFrame:
    """Quantiles of the columns, as arrays of at most ``splits - 1`` distinct values; without groups also the row count."""
    probs = [i / splits for i in range(1, splits)]
    aggs = [F.array_distinct(F.percentile_approx(F.col(c), probs, 20 * splits)).alias(out) for out, c in cols.items()]
    return df.groupBy(*by).agg(*aggs, *([] if by else [F.count(F.lit(1)).alias("_rows")]))


def _splits_for(rows: int) -> int:
    return min(MAX_SPLITS, max(SPLITS, -(-rows // BUCKET_ROWS)))


def position(c: Column, cuts: list) -> Column:
    """Number of cuts below ``c``, by binary search."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c > F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))


def ordered(
    df: DataFrame,
    order: str,
    tie: str,
    desc: bool = False,
    rank: str = "rank",
    sums: dict[str, str] | None = None,
    maxs: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    by: list[str] | None = None,
    splits: int | None = None,
) -> DataFrame:
    """Add ``rank`` (1..n by ``order``, then ``tie`` ascending; nulls last) and running columns.

    ``sums``, ``maxs`` and ``lags`` map an output name to a source column:
    inclusive running sum, inclusive running maximum, value of the row before.
    ``tie`` must be numeric and make the order unique. With ``by`` every group (null is a
    group of its own) is numbered on its own, large groups in parts. The number of cuts follows the number of rows
    (of the largest group) unless ``splits`` is given; ranks do not depend on it.
    """
    sums, maxs, lags, by = sums or {}, maxs or {}, lags or {}, by or []
    picked = {"_oc": order, "_tc": tie}
    if splits is None and by:
        splits = _splits_for(largest_group(df, by))
    cuts = _cuts(df, by, picked, splits or SPLITS)
    if by:
        d = null_safe_join(df, cuts, by)
        below = lambda k, c: sum(F.when(F.get(k, F.lit(i)) < F.col(c), 1).otherwise(0) for i in range(splits - 1))
        at_cut = F.array_contains("_oc", F.col(order))
    else:
        found = cuts.first().asDict()  # at most 2 * splits numbers and the row count
        if splits is None:
            splits = _splits_for(found["_rows"])
            found = _cuts(df, by, picked, splits).first().asDict() if splits > SPLITS else found
        d, known = df, {k: sorted(found[k] or []) for k in picked}
        below = lambda k, c: position(F.col(c), known[k])
        at_cut = F.col(order).isin(known["_oc"]) if known["_oc"] else F.lit(False)
    at_cut = F.coalesce(at_cut, F.lit(False))
    bucket = below("_oc", order) * 2 + F.when(at_cut, 1).otherwise(0)
    bucket = F.when(F.col(order).isNull(), 2 * splits + 2).otherwise(-bucket if desc else bucket)
    cut_again = at_cut | F.col(order).isNull()
    d = (
        d.withColumn("_b", bucket)
        .withColumn("_s", F.when(cut_again, below("_tc", tie)).otherwise(0))
        .drop("_oc", "_tc")
    )

    keys = [*by, "_b", "_s"]
    row_order = [F.col(order).desc_nulls_last() if desc else F.col(order).asc_nulls_last(), F.col(tie).asc()]
    last = F.struct((-F.col(order) if desc else F.col(order)).alias("o"), F.col(tie).alias("t"))
    totals = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_m_{o}") for o, c in maxs.items()],
        *[F.max_by(F.struct(F.col(c).alias("v")), last).alias(f"_l_{o}") for o, c in lags.items()],
    )
    buckets = Window.partitionBy(*by).orderBy("_b", "_s")  # over totals, not rows
    before = buckets.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.sum(f"_s_{o}").over(before).alias(f"_s0_{o}") for o in sums],
        *[F.max(f"_m_{o}").over(before).alias(f"_m0_{o}") for o in maxs],
        *[F.lag(f"_l_{o}").over(buckets).alias(f"_l0_{o}") for o in lags],
    )
    inside = Window.partitionBy(*keys).orderBy(*row_order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # without groups there are at most splits * splits + 2 * splits offsets
    # (a broadcast of at most a million small rows)
    out = null_safe_join(d, offsets, keys) if by else d.join(F.broadcast(offsets), keys)
    cols = [F.col(f"`{c}`") for c in df.columns]
    cols.append((F.row_number().over(inside) + F.col("_n0")).cast("bigint").alias(rank))
    for o, c in sums.items():
        cols.append((F.sum(c).over(upto) + F.coalesce(F.col(f"_s0_{o}"), F.lit(0))).alias(o))
    for o, c in maxs.items():
        cols.append(F.greatest(F.max(c).over(upto), F.col(f"_m0_{o}")).alias(o))
    for o, c in lags.items():
        prev = F.lag(F.struct(F.col(c).alias("v"))).over(inside)
        cols.append(F.coalesce(prev, F.col(f"_l0_{o}"))["v"].alias(o))
    return out.select(*cols)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of the left side stay."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys]
    return left.join(named, on).drop(*[f"__{k}" for k in keys])


MAX_GROUP = 2_000_000  # values of one group that may share a buffer


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group: one number."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).agg(F.max("_k")).first()[0] or 0


def quantiles(df: DataFrame, col: str, probs: dict[str, float], by: list[str] | None = None,
              max_group: int | None = None) -> DataFrame:
    """Exact interpolated quantiles, one row per group (one row without groups).

    Spark's ``percentile`` keeps the distinct values of a group in one buffer. That is used while
    the largest group has few rows, or few distinct values; beyond it the values are ranked in parts and the two
    neighbours of each position are picked.
    """
    by, max_group = by or [], MAX_GROUP if max_group is None else max_group
    d = df.filter(F.col(col).isNotNull())
    if largest_group(d, by) <= max_group:
        return d.groupBy(*by).agg(*[F.percentile(F.col(col), p).alias(o) for o, p in probs.items()])
    counts = cut(d.groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    if largest_group(counts, by) <= max_group:
        return counts.groupBy(*by).agg(*[F.percentile("_v", p, F.col("_n")).alias(o) for o, p in probs.items()])
    # distinct values with their counts: position of the first and last copy of each value
    run = ordered(counts, "_v", "_v", by=by, sums={"_hi": "_n"})
    size = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    run = null_safe_join(run, size, by) if by else run.withColumn("_size", size.scalar())
    aggs = []
    for o, p in probs.items():
        pos = F.lit(p) * (F.col("_size") - 1)
        at = lambda k: F.max(F.when((F.col("_hi") - F.col("_n") <= k) & (k < F.col("_hi")), F.col("_v")))
        aggs += [at(F.floor(pos)).alias(f"_a{o}"), at(F.ceil(pos)).alias(f"_b{o}"), F.max(pos - F.floor(pos)).alias(f"_w{o}")]
    out = run.groupBy(*by).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"_a{o}") + (F.col(f"_b{o}") - F.col(f"_a{o}")) * F.col(f"_w{o}")).alias(o) for o in probs])


def rank_by(df: DataFrame, score: str, tie: str, rank: str = "rank") -> DataFrame:
    """Rank 1..n by descending score; ties by ``tie``."""
    return ordered(df, score, tie, desc=True, rank=rank)


def running_precision(df: DataFrame, score: str, tie: str, hit: str) -> DataFrame:
    """Share of hits among the rows up to each rank."""
    d = df.withColumn("_hit", F.col(hit).cast("bigint"))
    return (
        ordered(d, score, tie, desc=True, sums={"hits": "_hit"})
        .withColumn("precision", F.col("hits") / F.col("rank"))
        .drop("_hit")
    )


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest ``col``; runs as one partial top-k per task."""
    return df.filter(F.col(col).isNotNull()).orderBy(F.desc(col), F.asc(tie)).limit(k)
