import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from toposcan.llm import packing as K
from toposcan.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()[0])


def test_encoder_gives_the_ids_of_the_file(tokenizer):
    fast = K.Encoder(*vocabulary())
    rng = random.Random(6)
    usual = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC]]
    texts = ["", " \n", "a\tb \t c", "  a  b\n\n c \n", "don't  I'LL 12 3½", "<|endoftext|> a", "日本 語", "a　b", "é" * 30_000, "😀 x"]
    texts += ["".join(rng.choices(usual, k=40)) for _ in range(3_000)]
    texts += [a + b + " " + a for a in usual for b in " \n'x9."]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:50])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = K.pack_histogram(histogram, 64)
    held = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 64 and count > 0
        for x in lengths:
            held[x] += count
    assert held == Counter(histogram)
    ranges = defaultdict(list)
    for length, first, past, *_ in K.slots(patterns):
        ranges[length].append((first, past))
    for length, parts in ranges.items():
        assert [0, *sorted(p for _, p in parts)] == [*sorted(f for f, _ in parts), histogram[length]]


def test_pieces_and_sequences(docs, tokenizer):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 5, 40, 300, 900])))) for i in range(80)]
    rows += [(100, None), (101, ""), (5, rows[5][1]), (None, "x y"), (102, "long text " * 3_000)]
    size = 256
    out = K.pack_documents(docs(*rows).repartition(3), vocabulary(), size=size).collect()
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), size):
            part = ids[s : s + size]
            want[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    packs = defaultdict(list)
    for r in out:
        packs[r.sequence_id].append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    filled = sum(r.length for r in out) / (size * len(packs))
    assert filled > 0.97
    assert K.pack_documents(docs().limit(0), vocabulary()).count() == 0


def test_sequences_hold_the_ids(docs, tokenizer):
    rows = [(i, f"some words {i} " * (i % 9)) for i in range(30)]
    out = K.sequences(docs(*rows), vocabulary(), size=64, pad_id=0).collect()
    assert all(len(r.ids) == 64 for r in out)
    want = sum(sum(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(sum(r.ids) for r in out) == want
