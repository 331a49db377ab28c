import random

import numpy as np
import pytest

from toposcan.llm import decontaminate as D


@pytest.fixture
def items(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")

    return make


def sentence(rng, n, vocabulary=2_000):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def test_wand_equals_scoring_everything():
    rng = random.Random(1)
    _, shards = D.build([(i, sentence(rng, rng.choice([5, 30, 120]), 120)) for i in range(60)])
    for shard in shards:
        dense = np.zeros((len(shard.terms), len(shard.item)))
        for t, own in enumerate(shard.postings):
            for u, w in own.values():
                dense[t, u] = w
        for _ in range(150):
            terms = np.array(sorted(rng.sample(range(len(shard.terms)), min(len(shard.terms), rng.choice([1, 10, 40])))))
            for threshold in (0.05, 0.2, 0.5):
                score = dense[terms].sum(0)
                got = dict(shard.search(terms, threshold))
                assert sorted(got) == np.flatnonzero(score >= threshold - 1e-9).tolist()
                assert all(abs(got[u] - score[u]) < 1e-9 for u in got)


def test_planted_items_are_found_and_clean_documents_left(docs, items):
    rng = random.Random(2)
    tests = [(i, f"{sentence(rng, rng.choice([6, 20, 55, 200]))}. {sentence(rng, rng.choice([2, 8]))}.") for i in range(40)]
    rows, want = [], set()
    for d in range(120):
        body = sentence(rng, rng.choice([0, 30, 400]))
        if d % 3 == 0:
            i = rng.randrange(40)
            body, want = f"{body} {tests[i][1].upper() if d % 2 else tests[i][1]} {sentence(rng, 40)}", want | {(d, i)}
        elif d % 3 == 1:
            body += " " + tests[d % 40][1].rsplit(". ", 1)[0]  # the question alone
        rows.append((d, body))
    frame = docs(*rows)
    found = {(r.doc_id, r.item_id) for r in D.leaks(frame, items(*tests)).collect()}
    assert found == want
    clean = D.keep_clean(frame, items(*tests))
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == set(range(120)) - {d for d, _ in want}


def test_edges(docs, items, monkeypatch):
    text = "one two three four five six seven eight. nine ten eleven."
    long = "z " * 60_000 + text + " y" * 30_000
    frame = docs((1, None), (2, ""), (3, text), (3, text), (4, long), (None, "x"), (5, "one two three"))
    tests = items((1, text), (1, text), (2, None), (3, ""), (None, text), (4, "uno"))
    pairs = sorted(((r.doc_id, r.item_id) for r in D.leaks(frame, tests).collect()), key=str)
    assert pairs == [(3, 1), (3, None), (4, 1), (4, None)]
    assert sorted((r.doc_id for r in D.keep_clean(frame, tests).collect()), key=str) == [1, 2, 5, None]
    monkeypatch.setattr(D, "PASS_ITEMS", 2)
    assert sorted(((r.doc_id, r.item_id) for r in D.leaks(frame, tests).collect()), key=str) == pairs
    assert D.leaks(docs().limit(0), tests).count() == 0 and D.leaks(frame, items().limit(0)).count() == 0


def test_signs_at_word_ends_and_case_do_not_hide_an_item(docs, items):
    rng = random.Random(5)
    text = f"Où était la {sentence(rng, 40)}? Élan éaux."
    changed = text.upper().replace(" ", ", ").replace("ÉAUX.", "(_ÉAUX_.###")
    other = f"{sentence(rng, 40)}. Der kurze Weg nach Hause."
    one_differs, none = other.replace("kurze", "lange"), other.replace("Der kurze Weg nach Hause", "Ein ganz anderer Ort hier")
    signs = "∀ ∃ → ⊢ ∧ ∨ ¬ ≡"
    rows = [(1, changed), (2, f"x y {one_differs} z"), (3, none), (4, f"a {signs} b"), (5, text.replace("Élan éaux", "Autre chose")), (6, text.replace("éaux.", "for.&&&"))]
    found = {(r.doc_id, r.item_id) for r in D.leaks(docs(*rows), items((1, text), (2, other), (3, signs), (4, "Wer war es? Der."))).collect()}
    assert found == {(1, 1), (2, 2), (4, 3), (6, 1)}


def test_an_answer_of_one_word_must_be_there(docs, items):
    rng = random.Random(6)
    question = sentence(rng, 30)
    rows = [(1, f"{question}? DER.###"), (2, f"{question}? Die."), (3, f"{question}?")]
    assert [r.doc_id for r in D.leaks(docs(*rows), items((1, f"{question}? Der."))).collect()] == [1]
