import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from toposcan.llm import token_align as A

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "日本 héllo 😀 x", "a\tb \n c", "①②③ ﬁ", "<s> <|endoftext|> <unk>", "👨‍👩‍👧 é é", "\x00\x01", "    four", "x" * 300, "Ωμέγα Привет",
    "🏳️‍🌈" * 5, "𝔘𝔫𝔦", "　wide", "a b", "<0x41>",
]


@pytest.fixture(scope="module")
def p():
    return A.pair(FILES)


def plain(p, text):
    """(ids, byte ends) of both sides by decoded bytes alone, or None."""
    if not text:
        return None
    data, out = b" " + text.encode(), []
    for ids, table in ((p.a.encode(" " + text, add_special_tokens=False).ids, p.bytes_a), (p.b.encode(text), p.bytes_b)):
        if b"".join(table[i] for i in ids) != data:
            return None
        out += [ids, np.cumsum([len(table[i]) for i in ids]).tolist()]
    return out


def brute(p, rows):
    docs = []
    for key, text in rows:
        x, groups = plain(p, text), []
        if x:
            ia, ea, ib, eb = x
            cuts = sorted(set(ea) & set(eb))
            for lo, hi in zip([0, *cuts], cuts):
                groups.append(([i for i, e in zip(ia, ea) if lo < e <= hi], [i for i, e in zip(ib, eb) if lo < e <= hi]))
        docs.append((key, groups, Counter((a, b) for u, v in groups for a in u for b in v)))
    held = Counter(k for *_, c in docs for k in c)
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for key, groups, c in docs:
        line = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        yield (
            key, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), sum(c.values()),
            sum(n for (a, b), n in c.items() if held[a, b] == top[a]), sum(n * held[k] for k, n in c.items()),
            hashlib.sha256(line.encode()).hexdigest() if groups else "",
        )


def test_spans_are_refined_to_the_decoded_bytes(p):
    rng = random.Random(12)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x391, 0x3C9), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640), 0x200D, 9, 10]]
    assert p.cuts_at_spaces
    spaced = [*pool[:95], *" " * 90, *"  \u3000\u180e\u200b\n\t\xa0'", "'s", " a", "."]
    texts = [*ODD, *("".join(rng.choices(pool, k=60)) for _ in range(400)), *("".join(rng.choices(spaced, k=60)) for _ in range(600)), " ", "  ", " a", "a ", "a  b"]
    for text in texts:
        got, want = A.align(p, text), plain(p, text)
        assert (got is None) == (want is None), repr(text)
        if got:
            assert [got[k].tolist() for k in ("ids_a", "ends_a", "ids_b", "ends_b")] == want, repr(text)


def test_texts_that_do_not_decode_to_themselves(p):
    assert A.align(p, None) is None and A.align(p, "") is None
    assert A.align(p, "a▁b") is None  # read as a space
    assert A.align(p, "a") is not None


def test_aligned_equals_brute_force(spark, docs, p):
    rng = random.Random(1)
    vocabulary = ["of", "the", "thention", "élevé", "日本", "x1", "2.0", "<s>", "naïve,", "!!", "Ünß"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 200])))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(3, rows[3][1]), (200, None), (201, ""), (202, "a▁b"), (None, "of the"), (203, "long text, " * 4_000)]
    for size in (200, 1 << 20):  # many batches or one
        out = A.aligned(docs(*rows).repartition(3), FILES, batch_chars=size)
        got = [tuple(r) for r in out.collect()]
        assert sorted(got, key=str) == sorted(brute(p, rows), key=str)
    assert A.aligned(docs().limit(0), FILES).count() == 0


def test_a_large_group_is_held_by_distinct_ids():
    n = 30_000
    group, pair, times = A.links(np.zeros(n, np.int64), np.arange(n) % 7, np.zeros(n, np.int64), np.arange(n) % 5, (10, 10))
    assert len(pair) == 35 and times.sum() == n * n and not group.any()


def test_alignments_give_the_groups(docs, p):
    found = {r.id: r.groups for r in A.alignments(docs((1, "héllo 😀 x"), (2, None)), FILES).collect()}
    assert found[2] == []
    data = b" " + "héllo 😀 x".encode()
    assert [g.first for g in found[1]] == [0, *[g.past for g in found[1]][:-1]] and found[1][-1].past == len(data)
    for g in found[1]:
        part = data[g.first : g.past]
        assert b"".join(p.bytes_a[i] for i in g.a) == part == b"".join(p.bytes_b[i] for i in g.b)


def test_a_segment_is_cut_once_for_all_batches(monkeypatch):
    fresh, seen, learned = A.TokenizerPair(*FILES), [], A._learned
    monkeypatch.setattr(A, "_learned", lambda p, parts: seen.extend(parts) or learned(p, parts))
    for text in ("of the thention", "the élevé of", "of 日本 the"):
        A._batch(fresh, 0, [1], [text])
    assert sorted(seen) == sorted(["of", "the", "thention", "élevé", "日本"])


def test_forgotten_segments_change_no_result(p, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["of", "the", "naïve,", "日本", "thention", "a▁b", "Ünß", "x" * 30], [9, 9, 5, 5, 2, 1, 1, 1], k=8)) for _ in range(40)]
    for segments, chars in ((5, 1 << 20), (300, 12), (0, 0)):
        fresh = A.TokenizerPair(*FILES)
        monkeypatch.setattr(A, "KNOWN_SEGMENTS", 1 << 20)
        want = [A._batch(p, i, [i, 100 + i], [t, texts[0]]) for i, t in enumerate(texts)]
        monkeypatch.setattr(A, "KNOWN_SEGMENTS", segments)
        monkeypatch.setattr(A, "KNOWN_CHARS", chars)
        for i, t in enumerate(texts):
            assert A._batch(fresh, i, [i, 100 + i], [t, texts[0]]).equals(want[i])
            assert len(fresh.known.lines) == len(fresh.known.places) == len(fresh.known.good) <= segments
        monkeypatch.undo()
