import random
import zlib

import numpy as np
import pytest

from toposcan.llm import toxicity as T


def world(seed, n=1_500):
    """Texts of two languages; toxic ones hold insults of the list, or words of a stem that only labels tell."""
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([20, 60, 300]))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(["Idiot", "moron,", "stupid"]) if d % 2 else f"gromb{rng.randrange(40)}"
        elif rng.random() < 0.02:
            words[0] = "clown"
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_held_out_rows_are_found_and_never_used(docs, spark):
    rows, labels = world(1)
    table = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    out = {r.id: r for r in T.score(docs(*rows), table(labels)).collect()}
    truth = {d: t for d, _, t in labels}
    held = [d for d in out if out[d].held_out]
    assert set(held) == {d for d in out if zlib.crc32(str(d).encode()) % 4 == 2}
    wrong = sum((out[d].score >= 0.3) != truth[d] for d in held)
    assert wrong <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    # other labels on held-out rows change nothing
    flipped = [(d, q, 1 - t if out[d].held_out else t) for d, q, t in labels]
    again = {r.id: r.score for r in T.score(docs(*rows), table(flipped)).collect()}
    assert all(abs(again[d] - out[d].score) < 1e-9 for d in out)


def test_edges(docs, spark):
    rows, labels = world(2, 400)
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, "idiot moron scum " * 5), (9004, "idiot stupid trash " * 30_000), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (9001, 1, None), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    out = T.score(docs(*rows), table).collect()
    assert len(out) == len(rows)
    score = {r.id: r.score for r in out}
    assert score[9001] == score[9002] == score[9003] < 0.3 < score[9004] and score[None] > 0.3
    none = T.score(docs((1, "a b"), (2, None)), table.limit(0)).collect()
    assert len(none) == 2 and T.score(docs().limit(0), table).count() == 0


def test_label_model_recovers_classes_of_correlated_voters():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    good = lambda p: np.where(rng.random(len(y)) < p, np.where(y, 1, -1), np.where(y, -1, 1))
    a, b, c = good(0.85), good(0.8), good(0.9)
    copy = np.where(rng.random(len(y)) < 0.97, a, -a)  # votes as its neighbour does
    abstain = np.where(rng.random(len(y)) < 0.5, 0, good(0.8))
    table, where, counts = np.unique(np.stack([a, copy, b, c, abstain], 1), axis=0, return_inverse=True, return_counts=True)
    post = T.label_model(table, counts.astype(float))[where.ravel()]
    assert ((post > 0.5) == y).mean() > 0.93
    assert post.mean() == pytest.approx(0.2, abs=0.05)
