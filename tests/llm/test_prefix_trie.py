import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from toposcan.llm import prefix_trie as T
from toposcan.llm.queries import op13_prefix_trie


def brute(convs):
    """Node rows of {conv_id: ((role, text), ...)}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        leaves = saved = 0
        for q in kids[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        own = (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0
        return leaves or 1, saved + own

    for p, m in members.items():
        leaves, saved = below(p)
        told = ",".join(map(str, sorted(ends[p])))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(told.encode()).hexdigest()


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table_of(spark, convs, extra=()):
    rows = [(c, k, r, t, 1, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame([*rows, *extra], "conv_id long, turn long, role string, text string, path long, words string").repartition(5)


@pytest.mark.parametrize("block", [1, 3_000, 1 << 24])
def test_trie_equals_brute_force(spark, block):
    rng = random.Random(13)
    said = [("user", "a b"), ("user", "c"), ("assistant", "a b"), ("assistant", ""), ("", "long word " * 50)]
    convs = {c: tuple(rng.choices(said, [6, 3, 3, 1, 1], k=rng.choice([1, 2, 3, 5, 9]))) for c in range(150)}
    convs |= {10_000 + c: convs[0] for c in range(120)}  # many equal ones, in several blocks of ids
    convs |= {-5: (said[0],) * 40, 7_000_000: (said[0],) * 39}
    got = [tuple(r) for r in T.prefix_trie(T.keyed(table_of(spark, convs)), block).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(convs), key=str)


def test_query_rebuilds_and_defined_cases(spark, tmp_path):
    rng = random.Random(4)
    said = [("user", "hello there"), ("assistant", "yes"), ("user", "no no no")]
    convs = {c: tuple(rng.choices(said, k=rng.choice([1, 2, 4]))) for c in [*range(0, 60), 105, 121, 122, 123, 130]}
    extra = [(3, None, None, None, 0, None), (None, 0, "user", "lost", 0, None), (45, 1, *convs[45][0], 0, None)]
    table_of(spark, convs, extra).write.parquet(f"{tmp_path}/conversations.parquet")
    convs[3] = (("", ""), *convs[3])
    own = list(enumerate(convs[45]))
    convs[45] = tuple(t for _, t in sorted([*own, (1, convs[45][0])], key=lambda x: (x[0], hashlib.md5(f"{len(x[1][0])}:{x[1][0]}{x[1][1]}".encode()).hexdigest())))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = (*convs.get(c - c % 20, ())[:h], *turns[h:])
    assert any(not t for t in rebuilt.values())
    out = op13_prefix_trie(spark, str(tmp_path))
    assert out.columns == list(COLUMNS)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(rebuilt), key=str)


def test_empty_table_and_texts_of_nodes(spark):
    convs = {1: (("user", "a"), ("assistant", "b")), 2: (("user", "a"),)}
    rows = table_of(spark, convs)
    assert T.prefix_trie(T.keyed(rows.limit(0))).count() == 0
    got = T.node_texts(T.prefix_trie(T.keyed(rows)), rows).select("depth", "role", "text", "n_convs").collect()
    assert sorted(map(tuple, got), key=str) == [(0, None, None, 2), (1, "user", "a", 2), (2, "assistant", "b", 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.data())
def test_extents_by_range_minima(values, data):
    table, n = T.RangeMin(np.array(values)), len(values)
    at, bound = data.draw(st.integers(0, n - 1)), data.draw(st.integers(1, 5))
    right = at
    while right + 1 < n and values[right + 1] >= bound:
        right += 1
    left = at
    while left >= 0 and values[left] >= bound:
        left -= 1
    assert table.right(np.array([at]), np.array([bound]))[0] == right
    assert table.left(np.array([at]), np.array([bound]))[0] == left
    past = data.draw(st.integers(at + 1, n))
    assert table.least(np.array([at]), np.array([past]))[0] == min(values[at:past])
