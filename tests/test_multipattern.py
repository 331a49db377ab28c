"""Automata over many patterns against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from toposcan.operators import candidates, multipattern as M, textmine


def table(spark, rows, column):
    return spark.createDataFrame([(x,) for x in rows], f"{column} STRING").repartition(3)


def words(seed, n, alphabet="abcé日 ", longest=6):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 26), (150, 400)])
def test_equal_to_contains(spark, monkeypatch, sizes):
    monkeypatch.setattr(M, "PART_BYTES", sizes[0])
    monkeypatch.setattr(M, "BLOCK_BYTES", sizes[1])
    texts, patterns = [*words(1, 200, longest=14), None, "", "日é"], [*words(2, 80), None]
    numbers = {p: k * 7 % 80 for k, p in enumerate(dict.fromkeys(p for p in patterns if p is not None))}
    known = spark.createDataFrame([*numbers.items(), (None, 0)], "pattern STRING, number BIGINT")
    pairs = {(t, p) for t in set(texts) - {None} for p in numbers if p in t}
    got = M.contained_pairs(table(spark, texts, "text"), known).collect()
    assert len(got) == len(pairs) and set(map(tuple, got)) == pairs
    least = {}
    for t, p in pairs:
        least[t] = min(least.get(t, 99), numbers[p])
    assert dict(map(tuple, M.first_contained(table(spark, texts, "text"), known).collect())) == least
    full = {k: v for k, v in numbers.items() if k}
    assert set(map(tuple, M.contained_pairs(table(spark, texts, "text"), spark.createDataFrame(list(full.items()), "pattern STRING, number BIGINT")).collect())) == {
        x for x in pairs if x[1]}


def test_nothing_to_find(spark):
    t, none = table(spark, ["ab"], "text"), table(spark, ["ab"], "pattern").limit(0)
    assert M.contained_pairs(t, none).count() == 0
    assert M.contained_pairs(t.limit(0), table(spark, ["a"], "pattern")).count() == 0


def test_a_million_roots(spark):
    roots = spark.range(1_000_000).select(F.concat(F.lit("r"), F.lpad(F.conv("id", 10, 36), 5, "0")).alias("root"), F.col("id").alias("ord"), F.concat(F.lit("c"), F.col("id") % 9).alias("category"))
    names = spark.range(3_000).select(F.col("id").alias("n"), F.concat(F.lit("the r"), F.lpad(F.conv(F.col("id") * 397, 10, 36), 5, "0"), F.lit(" of a long name without others " * 20)).alias("normalized_name"))
    got = candidates.infer_type(names, roots)
    want = F.when(F.col("n") * 397 < 1_000_000, F.concat(F.lit("C"), (F.col("n") * 397) % 9))
    assert got.filter(~F.upper("type").eqNullSafe(want)).count() == 0 and got.count() == 3_000


def test_root_relations(spark):
    p = spark.createDataFrame([(x,) for x in ("rio", "rios", "ri", "serra", "x", "", None)], "pattern STRING")
    r = spark.createDataFrame([(x,) for x in ("rio", "rio grande", "serrado", "", None)], "root STRING")
    got = {(x.pattern, x.relation, x.n_roots) for x in textmine.compare_roots(p, r).collect()}
    assert got == {("rio", "exact", 2), ("rios", "partial", 1), ("ri", "partial", 2), ("serra", "partial", 1), ("x", "none", 0), ("", "none", 0), (None, "none", 0)}
