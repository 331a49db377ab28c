"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents are tokenized, closed with an end id and cut into pieces of at most ``size`` ids. Only the histogram of piece lengths (at
most ``size`` rows, whatever the number of documents) comes to the driver. There lengths are placed longest first; each goes to
the shortest pack that still has room. Packs with equal contents are one pattern with a count, so the work depends on the
number of lengths alone. Every slot of a pattern takes a range of ranks of its length; pieces are ranked within their length by a
distributed count and joined to the slots by length and rank.

A null text is empty: a document of one end id. Repeated rows are pieces of their own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from toposcan.llm.common import numbered, stored, texts

SIZE = 2048
END_ID = 1
PAD_ID = 0
#: Characters for which the second library was checked to cut words alike; other texts take the first.
UNUSUAL = re.compile("[^\\x00-\u024f\u2000-\u206f\u20ac]")
_ENCODERS: dict[tuple, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian bytes, as ``tokenizers`` gives them for the file ``path``.

    With ``ranks``, a file of the same vocabulary as byte ranks, texts of usual characters and without special tokens are
    encoded by ``tiktoken``, several times faster and with equal ids.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or UNUSUAL.search(text) or any(x in text for x in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def encoder(vocabulary: tuple) -> Encoder:
    """One encoder per worker and vocabulary: (path,) or (path, ranks, pattern)."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(*vocabulary)
    return _ENCODERS[vocabulary]


def _pieces(vocabulary: tuple, size: int, end_id: int, with_ids: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    kinds = [*[pa.int64()] * 5, *([pa.binary()] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = encode(text or "") + end
                total = len(raw) // 4
                for start in range(0, total, size):
                    piece = raw[4 * start : 4 * (start + size)]
                    rows.append((key, start, len(piece) // 4, zlib.crc32(piece), total, piece)[: len(names)])
                held += len(raw)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def tokenized(docs: DataFrame, vocabulary: tuple, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids`` as bytes) of every piece of every document.

    ``vocabulary`` is (path,) of a ``tokenizers`` file, or (path, ranks, pattern) with the same vocabulary as byte ranks.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return texts(docs).mapInArrow(_pieces(vocabulary, size, end_id, with_ids), schema)


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that hold every length as often as ``histogram`` says."""
    open_packs: dict[int, list[list]] = {}  # fill -> [count, lengths]
    fills: list[int] = []

    def put(count: int, lengths: tuple, fill: int) -> None:
        if fill not in open_packs:
            open_packs[fill] = []
            heapq.heappush(fills, fill)
        open_packs[fill].append([count, lengths])

    done = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while fills and not open_packs[fills[0]]:
                del open_packs[heapq.heappop(fills)]
            if not fills or fills[0] + length > size:
                put(left, (length,), length)  # no pack has room
                break
            fill = fills[0]
            pack = open_packs[fill][-1]
            take = min(left, pack[0])
            pack[0] -= take
            if not pack[0]:
                open_packs[fill].pop()
            put(take, (*pack[1], length), fill + length)
            left -= take
    for packs in open_packs.values():
        done += [(count, lengths) for count, lengths in packs]
    return sorted(done, key=lambda x: (-len(x[1]), x[1]))


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, past rank, first sequence, offset)`` of every slot; ranks and sequences are gapless."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            used[length] = first + count
            out.append((length, first, first + count, sequence, offset))
            offset += length
        sequence += count
    return out


def place(pieces: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``; ``pieces`` should be stored."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    table = slots(pack_histogram(histogram, size))
    spark = pieces.sparkSession
    plan = spark.createDataFrame(table, "__length long, __first long, __past long, __sequence long, offset long")
    ranked = numbered(pieces, ["length"], list(order), "__rank")
    # a slot table has some thousand rows, as many as there are lengths and patterns, whatever the number of pieces
    on = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__past"))
    placed = ranked.join(F.broadcast(plan) if len(table) <= 500_000 else plan, on)
    return placed.withColumn("sequence_id", F.col("__sequence") + F.col("__rank") - F.col("__first")).drop("__rank", "__length", "__first", "__past", "__sequence")


def pack_documents(docs: DataFrame, vocabulary: tuple, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    pieces = stored(tokenized(docs, vocabulary, size, end_id), "packing-pieces")
    return place(pieces, size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _joined(size: int, pad_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                out.append(np.r_[ids, np.full(size - len(ids), pad_id, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return run


def sequences(docs: DataFrame, vocabulary: tuple, size: int = SIZE, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, padded to ``size``."""
    pieces = place(stored(tokenized(docs, vocabulary, size, end_id, with_ids=True), "packing-ids"), size)
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(_joined(size, pad_id), "sequence_id long, ids array<int>")
