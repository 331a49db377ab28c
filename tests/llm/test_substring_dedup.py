import hashlib
import random
import re

import pytest

from toposcan.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    """Every window against all earlier ones."""
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in words:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("n,vocabulary", [(4, 3), (6, 5), (20, 2), (20, 400)])
def test_against_brute_force(docs, n, vocabulary):
    rng = random.Random(n * vocabulary)
    base = [str(rng.randrange(vocabulary)) for _ in range(400)]
    rows = []
    for d in range(60):
        at = rng.randrange(300)
        own = [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(60))]
        rows.append((d * 3 % 61, rng.choice([" ", "\n", "  ", "\t"]).join(own + base[at : at + rng.randrange(80)] + own[:30])))
    assert got(remove_repeats(docs(*rows).repartition(5), n)) == brute(rows, n)


def test_edges(docs, spark):
    long = " ".join(str(i % 997) for i in range(60_000))
    word = "é" * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, long), (6, long), (7, word), (8, "x " * 40), (9, "a b")]
    assert got(remove_repeats(docs(*rows), 20)) == brute(rows, 20)
    assert remove_repeats(docs().limit(0), 20).count() == 0


def test_repeated_rows_and_null_ids(docs):
    text = " ".join(str(i) for i in range(50))
    out = remove_repeats(docs((1, text), (1, text), (None, text), (2, text))).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in out) == [(-1, 0), (1, 0), (1, 0), (2, 50)]


def test_block_combiner_agrees(docs, monkeypatch):
    """Hot passage: answers inside a block and across blocks are the same."""
    from toposcan.llm import substring_dedup as S

    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(i, f"{passage} own {i} " * 2) for i in range(80)]
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    assert got(remove_repeats(docs(*rows).repartition(3))) == brute(rows, 20)
