import random
from collections import Counter, defaultdict

import pytest

from toposcan.llm import line_dedup
from toposcan.llm.line_dedup import drop_boilerplate

BLANKS = " \t\n\x0b\f\r"


def brute(rows, ratio, least):
    pages = defaultdict(set)
    for _, t, s in rows:
        if t is not None:
            pages[s].add(t)
    bad = {}
    for s, texts in pages.items():
        count = Counter(x for t in texts for x in {line.strip(BLANKS) for line in t.split("\n")} if x)
        bad[s] = {x for x, n in count.items() if n >= least and n > ratio * len(texts)}
    return sorted(((d, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(BLANKS) not in bad[s] or not x.strip(BLANKS))) for d, t, s in rows), key=str)


@pytest.mark.parametrize("lines", [0, 1_000])
def test_against_brute_force(docs, monkeypatch, lines):
    """Both ways of joining: by shuffle and by broadcast."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", lines)
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(200)] + ["", "  ", " é"]
    rows = []
    for d in range(300):
        parts = rng.choices(pool, k=rng.randrange(12))
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(["Footer", " Footer\t", "Home | About"]))
        rows.append((d, "\n".join(parts), rng.choice(["hot", "hot", "a", "b", None])))
    rows += [(900 + i, "copy\nof one text", "a") for i in range(200)] + [(2000, None, "a"), (2001, "", "b"), (5, rows[5][1], rows[5][2]), (None, "Footer\nx", "hot")]
    rows += [(3000, "y " * 100_000, "c"), (3001, "Footer", "hot")]
    frame = docs(*rows)
    out = drop_boilerplate(frame.repartition(4), ratio=0.1, min_pages=3)
    assert out.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute(rows, 0.1, 3)


def test_small_hosts_and_empty_tables(docs):
    rows = [(1, "a\nb", "x"), (2, "a\nc", "x"), (3, None, None)]
    assert sorted((r.doc_id, r.text) for r in drop_boilerplate(docs(*rows)).collect()) == [(1, "a\nb"), (2, "a\nc"), (3, None)]
    assert drop_boilerplate(docs().limit(0)).count() == 0
