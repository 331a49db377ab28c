"""Removal of passages that repeat earlier text, by a one-pass join of windows on their minimizers.

Every distinct window of ``window`` words of a block is posted once, under the smallest hash of the windows of ``window // 2`` words
inside it (its minimizer): equal long windows hold equal minimizers, so no repeat is missed. The half-length windows only deal the
long ones to tasks; they are not counted first, and no level removes candidates before the next. What is removed is
defined by windows of ``window`` words, and every longer repeat is a run of them.

Before the shuffle every block of a few megabytes compares its own documents: of equal windows only that of the smallest
document is posted, the others learn their answer at once. A passage found in a third of all documents therefore costs one
row per block. Behind the shuffle rows are sorted by anchor and document and streamed; only the windows of one anchor are held.

Rows without ``doc_id`` are neither cut nor used as an earlier source. Rows sharing a ``doc_id`` are one document for the
comparison, each cut on its own. A null text has no words. Texts below ``window`` words stay whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from toposcan.llm import words as W
from toposcan.llm.common import texts

#: A little below a power of two, up to which tables of powers are kept.
BLOCK_BYTES = (2 << 20) - (64 << 10)
POSTS = "anchor long, id long, known boolean, windows binary"
#: Bytes of a window's hash that travel; beside its anchor's eight.
WIDTH = 6
LOW = np.uint64((1 << 8 * WIDTH) - 1)


def _rows(groups: np.ndarray, ids: np.ndarray, known: bool, anchors: np.ndarray, values: np.ndarray, width: int = 8) -> pa.RecordBatch:
    """One row per run of equal ``groups`` with the low ``width`` bytes of its ``values``, little-endian."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
    offsets = np.r_[first, len(groups)].astype(np.int32) * width
    data = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(W.signed(anchors[first])), pa.array(ids[first]), pa.array(np.full(len(first), known)), blobs], ["anchor", "id", "known", "windows"])


def _code(anchor: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The name under which a document learns of a window: its anchor and the posted bytes of its hash."""
    return W.mix(anchor + (value & LOW) * np.uint64(0x9E3779B97F4A7C15))


def _levels(chunk: W.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, anchor) of every window of ``n`` words; the anchor is the smallest hash of the half-length windows inside."""
    at, value = chunk.windows(n)
    half = n // 2
    inner, small = chunk.windows(half)
    full = np.full(len(chunk.hash) + 1, np.iinfo(np.uint64).max, np.uint64)
    full[inner] = small
    anchor = full[at]
    for k in range(1, n - half + 1):
        np.minimum(anchor, full[at + k], out=anchor)
    return at, value, anchor


def _post(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in W.chunks(batch.column(1).to_pylist(), size=BLOCK_BYTES):
                at, value, anchor = _levels(chunk, n)
                if not len(at):
                    continue
                id_of = ids[chunk.first + chunk.doc[at]]
                order = np.lexsort((id_of, value))
                v, d, a = value[order], id_of[order], anchor[order]
                fresh = np.r_[True, v[1:] != v[:-1]]
                lead = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0))
                known = d > d[lead]
                once = np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])]
                a_, d_, v_ = a[fresh], d[fresh], v[fresh]
                o = np.lexsort((d_, a_))
                a_, d_, v_ = a_[o], d_[o], v_[o]
                yield _rows(a_ ^ W.mix(d_.view(np.uint64)), d_, False, a_, v_, WIDTH)
                d_, v_ = d[known & once], _code(a, v)[known & once]
                o = np.argsort(d_, kind="stable")
                d_, v_ = d_[o], v_[o]
                if len(d_):  # answers only pass through the exchange, dealt by document
                    yield _rows(d_, d_, True, W.mix(d_.view(np.uint64)), v_)

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and document; gives the windows of a document that a smaller one has under the same anchor."""
    current, seen = None, None  # the last anchor; its windows and the smallest document of each
    for batch in batches:
        answered = batch.column(2)
        yield batch.filter(answered).select(["id", "windows"])
        batch = batch.filter(pc.invert(answered))
        if not batch.num_rows:
            continue
        anchors, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        offsets = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: len(anchors) + 1]
        packed = np.frombuffer(batch.column(3).buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH)
        values = np.zeros((len(packed), 8), np.uint8)
        values[:, :WIDTH] = packed
        values = values.view(np.uint64).ravel()
        row = np.repeat(np.arange(len(anchors)), np.diff(offsets) // WIDTH)
        group = np.cumsum(np.r_[False, anchors[1:] != anchors[:-1]])
        hit = np.zeros(len(row), bool)
        # other rows of this batch
        many = np.flatnonzero((np.bincount(group) > 1)[group[row]])
        if len(many):
            order = many[np.lexsort((ids[row[many]], values[many], group[row[many]]))]
            g, v, d = group[row[order]], values[order], ids[row[order]]
            new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            hit[order] = d > d[lead]
        # rows of earlier batches with the anchor that this one begins with
        if current == anchors[0]:
            head = np.flatnonzero(group[row] == 0)
            at = np.minimum(np.searchsorted(seen[0], values[head]), len(seen[0]) - 1)
            hit[head] |= (seen[0][at] == values[head]) & (ids[row[head]] > seen[1][at])
        tail = np.flatnonzero(group[row] == group[-1])
        v, d = values[tail], ids[row[tail]]
        if current == anchors[-1]:
            v, d = np.r_[seen[0], v], np.r_[seen[1], d]
        order = np.lexsort((d, v))
        v, d = v[order], d[order]
        keep = np.r_[True, v[1:] != v[:-1]]
        current, seen = anchors[-1], (v[keep], d[keep])
        if hit.any():
            r = row[hit]
            codes = _code(anchors[r].view(np.uint64), values[hit])
            yield _rows(r, ids[r], True, codes, codes).select(["id", "windows"])


def earlier_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """``id, windows``: codes (8 bytes each) of the windows of a document that a document with a smaller id has too."""
    posts = texts(docs).filter("id is not null and text is not null").mapInArrow(_post(window), POSTS)
    # the sort makes rows of one anchor neighbours, in the order of their documents
    dealt = posts.repartition(F.col("anchor")).sortWithinPartitions("anchor", "id")
    found = dealt.mapInArrow(_match, "id long, windows binary")
    return found.groupBy("id").agg(F.collect_list("windows").alias("windows"))


def _finish(n: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts_, lists = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cut = np.array([b"" if x is None else b"".join(x) for x in lists], object)
            n_words, n_removed, sha, kept_text = [], [], [], []
            for chunk in W.chunks(texts_):
                at, value, anchor = _levels(chunk, n)
                code, doc = _code(anchor, value), chunk.doc
                gone = np.zeros(len(doc) + 1, np.int64)
                if len(at):
                    order = np.lexsort((at, value, doc[at]))
                    v, d = value[order], doc[at][order]
                    again = np.zeros(len(at), bool)
                    again[order] = np.r_[False, (v[1:] == v[:-1]) & (d[1:] == d[:-1])]
                    starts = np.searchsorted(doc[at], np.arange(chunk.count + 1))
                    for k in range(chunk.count):
                        if cut[chunk.first + k]:
                            part = slice(starts[k], starts[k + 1])
                            again[part] |= np.isin(code[part], np.frombuffer(cut[chunk.first + k], np.uint64))
                    bad = at[again]
                    np.add.at(gone, bad, 1)
                    np.add.at(gone, bad + n, -1)
                gone = np.cumsum(gone)[:-1] > 0
                sums = np.r_[0, np.cumsum(gone)]
                removed = sums[chunk.bounds[1:]] - sums[chunk.bounds[:-1]]
                for k in range(chunk.count):
                    text = texts_[chunk.first + k]
                    parts = b"" if text is None else text.encode("utf-8", "surrogatepass").split()
                    if removed[k]:
                        parts = compress(parts, (~gone[chunk.bounds[k] : chunk.bounds[k + 1]]).tolist())
                    joined = b" ".join(parts) if text is not None else b""
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if spans:
                        kept_text.append(joined.decode("utf-8", "surrogatepass"))
                n_words += np.diff(chunk.bounds).tolist()
                n_removed += removed.tolist()
            cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if spans:
                cols, names = [*cols, pa.array(kept_text, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``with_text``, ``kept_text`` for every row of ``docs``.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id or earlier in its own.
    """
    joined = texts(docs).join(earlier_windows(docs, window), "id", "left").select("id", "text", "windows")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(_finish(window, with_text), schema)
