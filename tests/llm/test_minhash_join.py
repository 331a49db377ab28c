import random
import re

import pytest

from toposcan.llm import minhash_join as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, width):
    w = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    own = [(d, sets(t, width)) for d, t, *_ in rows]
    label = {d: d for d, _ in own}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(own):
        for b, t in own[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((d, len(s), root(d)) for d, s in own)


def got(df):
    return sorted(tuple(r) for r in df.select("id", "n_shingles", "component_id").collect())


def corpus(seed, groups=25, vocabulary=300):
    """Families of copies with some words changed, so that similarities lie on both sides of the threshold."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            w = [x if rng.random() > rng.choice([0, 0.02, 0.08]) else f"W{rng.randrange(vocabulary)}" for x in base]
            rows.append(rng.choice([" ", "\n"]).join(w))
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 2), (3, 5)])
def test_against_brute_force(docs, seed, width):
    rows = corpus(seed)
    assert got(M.near_duplicates(docs(*rows).repartition(4), width)) == brute(rows, width)


def test_parts_agree(docs, monkeypatch):
    """Lists and blocks dealt to several tasks give the same groups."""
    rows = corpus(4, groups=12)
    monkeypatch.setattr(M, "LIST_PART", 4)
    monkeypatch.setattr(M, "BLOCK_PART", 300)
    assert got(M.near_duplicates(docs(*rows), 2)) == brute(rows, 2)


def test_edges(docs):
    long = " ".join(f"x{i % 5000}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, long), (8, long + " y"), (9, "é" * 60_000), (10, None), (11, "É b"), (12, "é b")]
    assert got(M.near_duplicates(docs(*rows), 2)) == brute(rows, 2)
    out = {(r.id, r.component_id) for r in M.near_duplicates(docs((1, "a b c"), (1, "a b c"), (None, "a b c"), (0, "a b c")), 2).collect()}
    assert out == {(1, 0), (None, None), (0, 0)}
    assert M.near_duplicates(docs().limit(0)).count() == 0


def test_one_of_each_group_stays(docs):
    text = " ".join(f"t{i}" for i in range(60))
    frame = docs((5, text), (3, text), (3, text), (9, text + " end"), (None, text), (8, None), (7, "other words here"))
    out = M.keep_one(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 3, 7, 8, None]
