"""Dictionaries of names and roots: ids, upserts, merges, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from toposcan.functions import text
from toposcan.operators.ordered import ordered


def dedupe(df: DataFrame, keys: list[str], keep: str = "last", order: str = "ord") -> DataFrame:
    """One row per key: the last (or first) by ``order``. Partial aggregation, so a frequent key is reduced before the shuffle."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(rest, order).alias("r")).select("r.*")


def dense_ids(df: DataFrame, name: str, out: str, order: str = "ord") -> DataFrame:
    """``name, out``: ids 1..n of the distinct names by first appearance."""
    first = df.groupBy(name).agg(F.min(order).alias("_first"))
    return ordered(first, "_first", "_first", rank=out).drop("_first")


def assign_ids(df: DataFrame, order: str = "ord") -> DataFrame:
    """Renumber ``canonical_id`` and ``variant_id`` by first appearance of the names; ids are text."""
    d = df.drop("canonical_id", "variant_id")
    canon = dense_ids(d, "canonical_name", "canonical_id", order)
    variant = dense_ids(d, "variant_name", "variant_id", order)
    d = d.join(canon, "canonical_name").join(variant, "variant_name")
    return d.withColumns({c: F.col(c).cast("string") for c in ("canonical_id", "variant_id")})


def append(old: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of ``new`` behind those of ``old``; columns missing on one side are null."""
    start = old.agg(F.coalesce(F.max(order), F.lit(-1)) + 1).scalar()
    moved = new.withColumn(order, F.col(order) + start)
    return old.unionByName(moved, allowMissingColumns=True)


def upsert_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new entries together, renumbered; the newest row of each variant stays."""
    return dedupe(assign_ids(append(old, new)), ["variant_name"], "last")


def upsert_roots(old: DataFrame, new: DataFrame, scope: str = "water") -> DataFrame:
    """The newest row per root, or with ``scope='all'`` per root and category."""
    return dedupe(append(old, new), ["root", "category"] if scope == "all" else ["root"], "last")


def merge_roots(frames: dict[str, DataFrame]) -> DataFrame:
    """Category dictionaries as one table; of equal root and category the first stays."""
    labelled = [f.withColumn("category", F.lit(c)) for c, f in frames.items()]
    return dedupe(reduce(append, labelled), ["root", "category"], "first")


def new_roots_only(new: DataFrame, old: DataFrame) -> DataFrame:
    """Roots not yet known, ignoring case."""
    known = old.select(F.lower("root").alias("_k")).distinct()
    return new.join(known, F.lower(new["root"]) == F.col("_k"), "left_anti")


def merge_proposals(existing: DataFrame, proposals: DataFrame) -> DataFrame:
    """Dictionary plus accepted proposals with a water meaning; confidence becomes the weight."""
    water = proposals.filter(text.is_water_meaning(F.col("meaning_ja"), F.col("meaning_en")))
    rows = new_roots_only(water, existing).withColumns({
        "regex_token": F.col("root"), "weight": F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))})
    return append(existing, rows.select("ord", "root", "lang", "regex_token", "meaning_en", "meaning_ja", "weight"))


def add_new_names(index: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Index extended by the distinct names it lacks."""
    fresh = names.select(name).filter(F.col(name).isNotNull()).distinct().join(index.select(name), name, "left_anti")
    return index.select(name).unionByName(fresh)


def distinct_names(df: DataFrame, name: str = "name") -> DataFrame:
    return df.select(name).filter(F.col(name).isNotNull()).distinct()


def lookup_candidates(similar: DataFrame, entries: DataFrame) -> DataFrame:
    """Similar variants with the first dictionary row of each variant; variants without a row drop out."""
    return similar.join(dedupe(entries, ["variant_name"], "first"), "variant_name")


def attach_tags(df: DataFrame, tags: DataFrame, name: str = "name", variant: str = "variant_name") -> DataFrame:
    """Names with their dictionary columns; names without an entry keep nulls."""
    return df.join(tags.withColumnRenamed(variant, name), name, "left")


def rank_with_location(ranking: DataFrame, centers: DataFrame) -> DataFrame:
    return ranking.join(centers, "site_name", "left")


def representative_name(df: DataFrame, key: str = "site_name", name: str = "toponym_name", dist: str = "distance_km",
                        tie: str = "feature_id") -> DataFrame:
    """Nearest toponym per site; the site's own name where that is missing or ``Unknown``."""
    near = df.groupBy(key).agg(F.min_by(F.struct(F.col(name).alias("v")), F.struct(dist, tie)).alias("n"))
    good = F.when((F.col("n.v") != "") & (F.col("n.v") != "Unknown"), F.col("n.v"))
    return near.select(key, F.coalesce(good, F.col(key)).alias("representative"))


def examples(df: DataFrame, key: str, col: str = "name", k: int = 5, order: str = "ord") -> DataFrame:
    """The first k values per group in input order.

    A row number filtered to k becomes a partial top-k before the shuffle, so a large group shrinks first.
    """
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = df.select(key, order, col).withColumn("_rn", rn).filter(F.col("_rn") <= k)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(col).alias("v")))).alias("x"))
    return listed.select(key, F.transform("x", lambda s: s["v"]).alias("examples"))


def top_feature_diffs(cand: DataFrame, known: DataFrame, k: int = 10, key: str = "site_name") -> DataFrame:
    """Features in which a candidate differs most from the mean of the known sites."""
    names = [c for c in cand.columns if c != key and c in known.columns]
    as_double = lambda d, *keep: d.select(*keep, *[F.col(c).cast("double").alias(c) for c in names])
    means = known.agg(*[F.avg(c).alias(c) for c in names]).unpivot([], names, "feature", "known_mean")
    long = as_double(cand, key).unpivot([key], names, "feature", "value")
    d = long.join(F.broadcast(means), "feature")  # one row per feature
    d = d.withColumn("difference", F.col("value") - F.col("known_mean"))
    # rounded, so that the order of summation does not decide between equal differences
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("difference"), 9)), "feature")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
