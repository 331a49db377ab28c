"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

Long items are indexed as overlapping segments, so that a passage can hold a whole unit. The weight of a term in a unit is
its BM25 part divided by the unit's score for its own text: a passage that holds the unit whole scores 1, and one threshold serves
all units. Units are grouped in blocks of neighbours; for every term the index keeps its largest weight per block. The block bounds
of all passages of a chunk are summed at once, passages without a block that can reach the threshold are done, and the others
are searched by block-max WAND, which returns exactly the units at or above it.

Index and verification see words as they are read: case is folded (all of Unicode), signs at the ends of a word and words of signs
alone do not count. Items made of signs alone have an index of their own, over the words as they stand.

What is found is verified on the words around the passage: the share of the item's words that lie in a run of ``run``
words also found there, apart for the question (all but the last sentence) and the answer (the rest). Runs miss much of a
short answer of which one word differs, so its words also count where they stand at their place behind a run of the question, and one of two
to four words may differ. A document leaks an item if both shares reach their bounds.

Items are read in passes of ``PASS_ITEMS``; an index in memory never grows beyond that. Null or
wordless items and texts match nothing. Items equal in text are found alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from toposcan.llm import words as W
from toposcan.llm.common import texts

K1, B = 1.2, 0.75
THRESHOLD = 0.4
SEGMENT, PASSAGE, STRIDE = 48, 64, 32
BLOCK, SHARD_UNITS, PASS_ITEMS = 8, 512, 50_000
PASSAGES_AT_ONCE = 4_096
TEXTS_AT_ONCE = 500
#: Block bounds are sums of up to PASSAGE single-precision maxima.
SLACK = 1e-4
RUN, QUESTION_SHARE, ANSWER_SHARE = 5, 0.8, 0.8
SENTENCE_END = re.compile(r"[.!?]+[\s\"')]+(?=\S)")
#: From the first letter or digit of a word to its last.
CORE = re.compile(r"[^\W_](?:\S*[^\W_])?")


def plain(text: str) -> str:
    """The words of a text with case folded and without the signs at their ends."""
    return " ".join(CORE.findall(text.casefold()))


def same(text: str) -> str:
    return text


class Item:
    """An item's words and the windows by which it is verified."""

    def __init__(self, item_id: int, text: str, run: int = RUN, form=plain) -> None:
        ends = [m.end() for m in SENTENCE_END.finditer(text)]
        chunk = next(W.chunks([form(text)]))
        self.item_id, self.hash, self.size = item_id, chunk.hash, len(chunk.hash)
        self.run = max(1, min(run, self.size))
        self.windows = chunk.windows(self.run)[1]
        at = len(next(W.chunks([form(text[: ends[-1]])])).hash) if ends else 0
        # without a second sentence the last quarter stands for the answer
        self.answer = at if 0 < at < self.size else self.size - max(1, self.size // 4)

    def overlap(self, around: W.Words, low: int, high: int) -> tuple[float, float]:
        """Shares of question and answer words in runs that the words ``low:high`` have too."""
        part = W.Words(0, b"", around.start[low:high], around.end[low:high], np.array([0, high - low]), around.hash[low:high])
        at, value = part.windows(self.run)
        hits = np.flatnonzero(np.isin(self.windows, value))
        covered = np.zeros(self.size, bool)
        for k in range(self.run):
            covered[hits + k] = True
        question, answer = covered[: self.answer], covered[self.answer :]
        return (float(question.mean()) if len(question) else 1.0), self._answer_share(answer, part.hash, at, value)

    def _answer_share(self, covered: np.ndarray, words: np.ndarray, at: np.ndarray, value: np.ndarray) -> float:
        """Share of the answer's words that are covered or at their place behind a run of the question; see above for short answers."""
        size = len(covered)
        wanted, most = self.hash[self.answer :], int(covered.sum())
        for k in range(max(0, self.answer - 2 * self.run + 1), self.answer - self.run + 1):
            for begin in at[value == self.windows[k]] + (self.answer - k) if most < size else ():
                got = words[begin : begin + size]
                most = max(most, int((covered[: len(got)] | (got == wanted[: len(got)])).sum()))
        return 1.0 if 1 < size < RUN and most == size - 1 else most / size


class Shard:
    """Inverted index of up to ``SHARD_UNITS`` units with list and block maxima."""

    def __init__(self, units: list[tuple[int, np.ndarray]], df: dict[int, int], total: int, mean: float) -> None:
        self.item = np.array([i for i, _ in units])
        rows: dict[int, list[tuple[int, float]]] = {}
        for u, (_, words) in enumerate(units):
            terms, tf = np.unique(words, return_counts=True)
            idf = np.log1p([(total - df[int(t)] + 0.5) / (df[int(t)] + 0.5) for t in terms])
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            for t, w in zip(terms, weight / weight.sum()):
                rows.setdefault(int(t), []).append((u, float(w)))
        self.terms = np.array(sorted(rows), np.uint64)
        self.blocks = -(-len(units) // BLOCK)
        #: postings of a term by block: (units, weights), both in the order of the units
        self.postings: list[dict[int, tuple[list[int], list[float]]]] = []
        self.block_top = np.zeros((len(self.terms), self.blocks), np.float32)
        for t, term in enumerate(self.terms):
            own: dict[int, tuple[list[int], list[float]]] = {}
            for u, w in rows[int(term)]:
                us, ws = own.setdefault(u // BLOCK, ([], []))
                us.append(u)
                ws.append(w)
                self.block_top[t, u // BLOCK] = max(self.block_top[t, u // BLOCK], w)
            self.postings.append(own)

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term number) of the words that the index knows."""
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == words)
        return known, at[known]

    def promising(self, chunk: W.Words, low: np.ndarray, high: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(passage, distinct terms, block bounds) of the passages with a block that can reach the threshold."""
        at, term = self.lookup(chunk.hash)
        first, past = np.searchsorted(at, low), np.searchsorted(at, high)
        count = past - first
        passage = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(passage)) + np.repeat(first - (np.cumsum(count) - count), count)
        pairs = np.unique(passage * len(self.terms) + term[place])
        if not len(pairs):
            return
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        end = np.r_[begin[1:], len(passage)]
        for part in range(0, len(begin), PASSAGES_AT_ONCE):
            b, e = begin[part : part + PASSAGES_AT_ONCE], end[part : part + PASSAGES_AT_ONCE]
            bounds = np.add.reduceat(self.block_top[term[b[0] : e[-1]]], b - b[0], axis=0)
            for k in np.flatnonzero(bounds.max(axis=1) >= threshold - SLACK):
                yield int(passage[b[k]]), term[b[k] : e[k]], bounds[k]

    def search(self, terms: np.ndarray, threshold: float, bounds: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(unit, score) of all units that score at least ``threshold`` for the distinct ``terms``: block-max WAND.

        Blocks whose maxima cannot reach the threshold are skipped whole; ``bounds`` are the sums of these maxima, if known.
        """
        bounds = self.block_top[terms].sum(0) if bounds is None else bounds
        found: list[tuple[int, float]] = []
        for block in np.flatnonzero(bounds >= threshold - SLACK):
            found += self._in_block(terms, int(block), threshold - 1e-9)
        return found

    def _in_block(self, terms: np.ndarray, block: int, bound: float) -> list[tuple[int, float]]:
        """WAND inside a block: the unit at which the maxima of the lists in front add up to ``bound`` is the next to look at."""
        lists = [(*self.postings[t][block], float(self.block_top[t, block]) + 1e-7) for t in terms if block in self.postings[t]]
        at, found = [0] * len(lists), []
        while True:
            heads = sorted((us[at[k]], k) for k, (us, _, _) in enumerate(lists) if at[k] < len(us))
            reach, pivot = 0.0, None
            for unit, k in heads:
                reach += lists[k][2]
                if reach >= bound:
                    pivot = unit
                    break
            if pivot is None:
                return found
            if heads[0][0] == pivot:
                score = 0.0
                for unit, k in heads:
                    if unit != pivot:
                        break
                    score += lists[k][1][at[k]]
                    at[k] += 1
                if score >= bound:
                    found.append((pivot, score))
            else:  # nothing before the pivot can reach the bound
                for unit, k in heads:
                    if unit >= pivot:
                        break
                    at[k] = bisect_left(lists[k][0], pivot, at[k])


def build(items: list[tuple[int, str]], form=plain) -> tuple[list[Item], list[Shard]]:
    """Items with words, and the shards of their units; ``Shard.item`` points into the items."""
    kept = [x for x in (Item(i, t, form=form) for i, t in items if t is not None) if x.size]
    units = []
    for k, item in enumerate(kept):
        starts = range(0, max(1, item.size - SEGMENT + 1), SEGMENT // 2)
        starts = [*starts, item.size - SEGMENT] if item.size > SEGMENT and starts[-1] != item.size - SEGMENT else starts
        units += [(k, item.hash[s : s + SEGMENT]) for s in starts]
    df: dict[int, int] = {}
    for _, words in units:
        for t in np.unique(words):
            df[int(t)] = df.get(int(t), 0) + 1
    mean = float(np.mean([len(w) for _, w in units])) if units else 1.0
    return kept, [Shard(units[s : s + SHARD_UNITS], df, len(units), mean) for s in range(0, len(units), SHARD_UNITS)]


def passages(chunk: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, past word) of the overlapping passages that cover every text with words."""
    size = np.diff(chunk.bounds)
    count = np.where(size > 0, np.maximum(1, -(-(size - PASSAGE) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(chunk.count), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    low = chunk.bounds[:-1][text] + np.minimum(number * STRIDE, np.maximum(size[text] - PASSAGE, 0))
    return text, low, np.minimum(low + PASSAGE, chunk.bounds[1:][text])


def indexes(items: list[tuple[int, str]]) -> list[tuple]:
    """(form of the words, items, shards): one index of the items with letters or digits, one of those without, if there are any."""
    signs = [(i, t) for i, t in items if t is not None and not plain(t)]
    made = [(plain, *build(items)), (same, *build(signs, same))]
    return [x for x in made if x[1]]


def _leaks(shared, threshold: float, question_share: float, answer_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in shared.value:
                yield from search(batch, *index)

    def search(batch: pa.RecordBatch, form, items: list[Item], shards: list[Shard]) -> Iterator[pa.RecordBatch]:
        for part in range(0, batch.num_rows, TEXTS_AT_ONCE):
            ids = batch.column(0)[part : part + TEXTS_AT_ONCE].to_pylist()
            texts_ = batch.column(1)[part : part + TEXTS_AT_ONCE].to_pylist()
            for chunk in W.chunks([None if t is None else form(t) for t in texts_]):
                text, low, high = passages(chunk)
                best: dict[tuple[int, int], list] = {}
                for shard in shards:
                    for p, terms, bounds in shard.promising(chunk, low, high, threshold):
                        for unit, score in shard.search(terms, threshold, bounds):
                            k = shard.item[unit]
                            item, begin, end = items[k], chunk.bounds[text[p]], chunk.bounds[text[p] + 1]
                            shares = item.overlap(chunk, max(begin, low[p] - item.size), min(end, high[p] + item.size))
                            old = best.setdefault((text[p], k), [0, 0.0, (0.0, 0.0)])
                            best[text[p], k] = [old[0] + 1, max(old[1], score), max(old[2], shares, key=min)]
                rows = [(ids[chunk.first + d], items[k].item_id, n, score, q, a) for (d, k), (n, score, (q, a)) in best.items() if q >= question_share and a >= answer_share]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)

    return run


NAMES = ["doc_id", "item_id", "passages", "score", "question_share", "answer_share"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE) -> DataFrame:
    """``doc_id, item_id, passages, score, question_share, answer_share`` of every document that holds an item."""
    spark, body, out = docs.sparkSession, texts(docs), None
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    passes = max(1, -(-rows.count() // PASS_ITEMS))
    rows = rows.withColumn("__pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    for k in range(passes):  # one pass over the documents for every PASS_ITEMS items
        part = [(r["item_id"], r["text"]) for r in rows.filter(F.col("__pass") == k).collect()]
        shared = spark.sparkContext.broadcast(indexes(sorted(part, key=str)))
        found = body.mapInArrow(_leaks(shared, threshold, question_share, answer_share), "doc_id long, item_id long, passages long, score double, question_share double, answer_share double")
        out = found if out is None else out.unionByName(found)
    # rows repeating a document or an item give one line
    shares = {c: F.max(c).alias(c) for c in NAMES[2:]}
    return out.groupBy("doc_id", "item_id").agg(*shares.values())


def keep_clean(docs: DataFrame, items: DataFrame, **bounds) -> DataFrame:
    """Rows of ``docs`` that hold no item, with their columns unchanged; rows without ``doc_id`` stay only if no such row leaks."""
    gone = leaks(docs, items, **bounds).select(F.col("doc_id").alias("__gone")).distinct()
    whole = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"))
    return whole.join(gone, F.col("__id").eqNullSafe(F.col("__gone")), "left_anti").select("__row.*")
