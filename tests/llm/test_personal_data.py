import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from toposcan.llm import personal_data as D
from toposcan.llm.queries import op11_personal_data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            double = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
            ok = (True, max(map(int, re.findall("[0-9]+", m.group())), default=0) <= 255, 14 <= len(digits) <= 19 and sum(double) % 10 == 0, 10 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def network(spark):
    return D.fitted(spark)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(11)
    alphabet = "aB9.0@+-_% ()12345678é\n"
    for k in range(4_000):
        text = "".join(rng.choices(alphabet, k=rng.choice([5, 30, 120]))) if k % 2 else D.labelled_line(rng)[0]
        assert D.base_spans(text) == plain(text), repr(text)
    for text in (None, "", "a@b", "a@b.c@d.e", "@x.y", "x@@y.z", "1.2.3.4.5.6.7.8", "01.02.003.0255", "+1 (509) 555-6973", "4111 1111 1111 1111"):
        assert D.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    n = 2_000_000
    for text in ("9" * n, "a" * n, "@" * n, "1.1.1" * (n // 5), "+1" * (n // 2), "a@" * (n // 2), "+" + " " * n):
        D.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    steps, rows, k = 5, 3, 4
    s, t, y = rng.normal(size=(steps, rows, k)), rng.normal(size=(k + 1, k)), rng.integers(0, k, (steps, rows))
    total, gs, gt = D.crf_gradient(s, t, y)
    paths = list(itertools.product(range(k), repeat=steps))
    score = lambda r, path: t[k, path[0]] + sum(s[i, r, path[i]] for i in range(steps)) + sum(t[path[i - 1], path[i]] for i in range(1, steps))
    want = sum(np.log(sum(np.exp(score(r, p)) for p in paths)) - score(r, tuple(y[:, r])) for r in range(rows))
    assert total == pytest.approx(want)
    for a, g in ((s, gs), (t, gt)):
        for at in [tuple(rng.integers(0, x) for x in a.shape) for _ in range(12)]:
            old = a[at]
            a[at] = old + 1e-5
            up = D.crf_gradient(s, t, y)[0]
            a[at] = old - 1e-5
            down = D.crf_gradient(s, t, y)[0]
            a[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    best = D.viterbi(s, t)
    for r in range(rows):
        assert tuple(best[r]) == max(paths, key=lambda p: score(r, p))


def test_gradient_of_the_lstm():
    rng = np.random.default_rng(1)
    n, x, weight = 3, rng.integers(0, 6, (4, 2)), rng.normal(size=(4, 2, 3))
    e, u = rng.normal(size=(6, 4 * n)), rng.normal(size=(n, 4 * n))
    loss = lambda: float((D._lstm(x, e, u, False)[0].astype(float) * weight).sum())
    ge, gu = np.zeros_like(e), np.zeros_like(u)
    D._lstm_back(x, u, D._lstm(x, e, u, True)[1], weight, ge, gu)
    for a, g in ((e, ge), (u, gu)):
        for at in [tuple(rng.integers(0, k) for k in a.shape) for _ in range(10)]:
            old = a[at]
            a[at] = old + 1e-2
            up = loss()
            a[at] = old - 1e-2
            down = loss()
            a[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_rows_without_a_span_are_proven_empty(network):
    text = "Thtion be, esaned that. Ünd was nicht; " * 20
    x = np.stack([D.classes(text)[i : i + D.WINDOW] for i in range(0, 400, 7)])
    s = D.scores(network, x)
    empty = D.surely_empty(s, network["t"])
    assert not D.viterbi(s, network["t"])[empty].any()


def test_held_out_lines(network):
    rng = random.Random(2024)
    lines = [D.labelled_line(rng) for _ in range(400)]
    base = hits = wrong = total = 0
    for (_, want), (b, found) in zip(lines, D.spans(network, [t for t, _ in lines])):
        assert set(b) <= set(found)
        total, base, hits = total + len(want), base + len(set(want) & set(b)), hits + len(set(want) & set(found))
        wrong += len(set(found) - set(want) - set(b))
    assert hits / total > 0.9 and hits - base > 0.5 * (total - base) and wrong <= 0.01 * total


def test_side_by_side(network):
    cards = "4111111111111111", "5500005555555559"
    text = f"Hean. Esanwh {cards[0]} {cards[1]} thheed hand. " + "on the way " * 30 + "unan +1 (826) 555-4081 190.137.223.204 du anviou"
    base, found = D.spans(network, [text])[0]
    assert [text[s:e] for s, _, e in base] == ["190.137.223.204"]
    assert [text[s:e] for s, _, e in found] == [*cards, "+1 (826) 555-4081", "190.137.223.204"]
    clean = 'Licensed under Version 2.0, January 2004. token = "7f5790b897549d620aedfc0705a565f96e3741e8" 1234567890123456 12:30 2020-01-02 1,234 @home'
    assert D.spans(network, [clean])[0] == ([], [])


def test_reconcile_keeps_disjoint_spans_of_the_largest_weight():
    text = "x 4111111111111111 y (509) 555-6973 z"
    card, phone = (2, 2, 18), (21, 3, 35)
    found = [(2, 2, 18, 3.0), (2, 2, 10, 9.0), (10, 2, 18, 1.0), (22, 3, 35, 1.0), (21, 3, 35, 2.0), (3, 2, 18, 8.0)]
    assert D.reconcile(text, found, []) == [card, phone]
    assert D.reconcile(text, found, [(20, 1, 24)]) == [card, (20, 1, 24)]
    assert D.reconcile(text, [(2, 2, 9, 1.0), (8, 2, 18, 1.0)], []) == [card]  # two halves of one


def test_query(spark, docs, network, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(D.labelled_line(rng)[0] for _ in range(rng.choice([1, 3, 9])))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "no data at all"), (None, "a.b@c.de"), (5, rows[5][1]), (103, "word 1 " * 50_000 + "x@y.com")]
    docs(*rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_personal_data(spark, str(tmp_path)).collect()), key=str)
    text = lambda found: ",".join(f"{D.KINDS[k]}:{s}:{e}" for s, k, e in found)
    want = []
    for (key, body), (base, found) in zip(rows, D.spans(network, [t for _, t in rows])):
        assert base == plain(body)
        want.append((key, *[sum(k == kind for _, k, _ in base) for kind in range(4)], hashlib.sha256(text(base).encode()).hexdigest(), text(found)))
    assert got == sorted(want, key=str)
    docs().limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert op11_personal_data(spark, f"{tmp_path}/empty").count() == 0
