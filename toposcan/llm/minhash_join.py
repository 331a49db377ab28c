"""Near-duplicates by an inverted join over MinHash signature coordinates.

1. A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets form one class; everything below
   works on one member of each class, so exact copies cost one row.
2. A class is posted under each (coordinate, value) of its signature of ``COORDINATES`` minima. Two sets of similarity 0.8 agree in at
   least ``MATCHES`` coordinates but for a chance below 1e-4, so they share one of the ``COORDINATES - MATCHES + 1`` rarest ones: the
   prefix. Values that occur once are never posted again, frequent ones are skipped and only counted.
3. Within a posting list coordinates are compared whole signature against signature; the classes that reach the match threshold
   among themselves are linked by a star, never by all pairs, so the list's output is as long as the list.
4. Connected stars are blocks that hold every pair above the threshold. The full sets of a block travel once, and exact similarity decides:
   from each unvisited set its linked sets are found, then theirs, so sets already joined are not compared again.

Lists and blocks beyond a fixed weight are dealt in parts, every pair of parts to a task of its own, so no group of copies has to fit
one task. Repeated rows of a document are in one class. Rows without id and null or wordless texts, whose set is empty, are linked
with nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from toposcan.llm import words as W
from toposcan.llm.common import stored, texts
from toposcan.operators.components import components

COORDINATES = 48
MATCHES = 27
#: Classes of a posting list, and shingles of a block, that one task compares among themselves.
LIST_PART = 20_000
BLOCK_PART = 1_000_000
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(chunk: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct ``n``-word shingles, by text; a shorter text with words is one shingle."""
    at, value = chunk.windows(n)
    doc = chunk.doc[at] if len(at) else at
    size = np.diff(chunk.bounds)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = np.array([W.mix(np.add.reduce(chunk.hash[chunk.bounds[k] : chunk.bounds[k + 1]] * (np.arange(size[k], dtype=np.uint64) * np.uint64(2) + np.uint64(3)), keepdims=True) + np.uint64(size[k]))[0] for k in short], np.uint64)
        doc, value = np.r_[doc, short], np.r_[value, whole]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.empty(0, bool)
    return doc[keep], value[keep]


def signatures(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each text, minima) of shingles sorted by text."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out = np.empty((len(first), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((value * _MULTIPLY[k] + _SHIFT[k]) >> np.uint64(32)).astype(np.uint32), first)
    return first, out


def _sign(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(1).to_pylist(), lower=True):
                doc, value = shingles(chunk, n)
                size, low, high = np.zeros(chunk.count, np.int64), np.zeros(chunk.count, np.uint64), np.zeros(chunk.count, np.uint64)
                sig = [None] * chunk.count
                if len(doc):
                    first, minima = signatures(doc, value)
                    which = doc[first]
                    size[which] = np.diff(np.r_[first, len(doc)])
                    low[which] = np.add.reduceat(W.mix(value * np.uint64(0x9FB21C651E98DF25)), first)
                    high[which] = np.add.reduceat(W.mix(value ^ np.uint64(0xA0761D6478BD642F)), first)
                    for k, m in zip(which, minima.view(np.int32)):
                        sig[k] = m
                ids = batch.column(0).slice(chunk.first, chunk.count)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size), pa.array(W.signed(low)), pa.array(W.signed(high)), pa.array(sig, pa.list_(pa.int32()))], ["id", "n", "low", "high", "sig"])

    return run


def _stars(same: Callable[[int, np.ndarray], np.ndarray], count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(seed, members) of the components of an implicit graph; ``same(x, rest)`` tells which of ``rest`` are linked with ``x``."""
    rest = np.arange(count)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue, members = [seed], []
        while queue and len(rest):
            linked = same(queue.pop(), rest)
            found = rest[linked]
            if len(found):
                members.append(found)
                queue.extend(found)
                rest = rest[~linked]
        if members:
            yield seed, np.concatenate(members)


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables holding whole groups of rows sorted by the first ``keys`` columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        change = np.zeros(held.num_rows, bool)
        for k in range(keys):
            x = held.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield held.slice(0, cuts[-1])
            held = held.slice(cuts[-1])
    if held is not None:
        yield held


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows + 1, bool)
    change[[0, -1]] = True
    for k in range(keys):
        x = table.column(k).to_numpy()
        change[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _match_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, p, q, rep, sig`` sorted by the first three: stars of the classes that agree in enough coordinates."""
    for table in _groups(batches, 3):
        reps = table.column("rep").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        bounds = _bounds(table, 3)
        pairs = []
        two = bounds[:-1][np.diff(bounds) == 2]
        good = two[(sig[two] == sig[two + 1]).sum(1) >= MATCHES]
        pairs.append((reps[good], reps[good + 1]))
        for k in np.flatnonzero(np.diff(bounds) > 2):
            part, own = sig[bounds[k] : bounds[k + 1]], reps[bounds[k] : bounds[k + 1]]
            for seed, members in _stars(lambda x, rest: (part[rest] == part[x]).sum(1) >= MATCHES, len(own)):
                pairs.append((np.full(len(members), own[seed]), own[members]))
        yield _edges(pairs)


def _shingle_sets(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column("text").to_pylist(), lower=True):
                doc, value = shingles(chunk, n)
                ends = np.searchsorted(doc, np.arange(chunk.count + 1)).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), chunk.count, [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(value.tobytes())])
                rest = [batch.column(c).slice(chunk.first, chunk.count) for c in ("block", "p", "q", "rep")]
                yield pa.RecordBatch.from_arrays([*rest, sets], ["block", "p", "q", "rep", "set"])

    return run


def _confirm(percent: int) -> Callable:
    """Rows ``block, p, q, rep, set`` sorted by the first three: stars of the sets that are linked exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            bounds, pairs = _bounds(table, 3), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            reps = table.column("rep").to_numpy()
            for k in range(len(bounds) - 1):
                own = reps[bounds[k] : bounds[k + 1]]
                if len(own) < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in table.column("set").slice(bounds[k], len(own)).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                known, flat = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.r_[0, np.cumsum(sizes)]
                mine = np.zeros(len(known), bool)
                cache: dict = {"rest": None}

                def same(x: int, rest: np.ndarray) -> np.ndarray:
                    if cache["rest"] is None or 2 * len(rest) < len(cache["rest"]):  # rows of sets that were found are left out by and by
                        span = sizes[rest]
                        begin = np.cumsum(span) - span
                        cache.update(rest=rest, begin=begin, flat=flat[np.repeat(starts[rest] - begin, span) + np.arange(span.sum())])
                    mine[:] = False
                    mine[flat[starts[x] : starts[x + 1]]] = True
                    common = np.add.reduceat(mine[cache["flat"]].astype(np.int64), cache["begin"])
                    common = common[np.searchsorted(cache["rest"], rest)]
                    return 100 * common >= percent * (sizes[x] + sizes[rest] - common)

                for seed, members in _stars(same, len(own)):
                    pairs.append((np.full(len(members), own[seed]), own[members]))
            yield _edges(pairs)

    return run


def _parts(df: DataFrame, group: str, parts: str) -> DataFrame:
    """Deal the rows of ``group`` to ``parts`` parts and every pair of parts to a place ``p, q`` of its own."""
    df = df.withColumn("__own", F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int"))
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    return df.withColumns({"p": F.least("__own", "__other"), "q": F.greatest("__own", "__other")}).drop("__own", "__other", parts)


def signed_documents(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``id, n, low, high, sig`` of every row: set size, 128-bit hash of the set, signature (null for an empty set)."""
    return texts(docs, text=text).mapInArrow(_sign(width), "id long, n long, low long, high long, sig array<int>")


def candidate_blocks(classes: DataFrame) -> DataFrame:
    """``rep, block`` of the classes ``rep, sig`` that agree with another in enough coordinates, directly or over others."""
    posted = classes.select("rep", F.posexplode("sig").alias("c", "v"))
    posted = posted.select("rep", ((F.col("c").cast("long") * F.lit(1 << 32)) + F.col("v").cast("long") + F.lit(1 << 31)).alias("key"))
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    # the rarest coordinates of each class; those that occur once come first and need no posting
    ranked = posted.join(often, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("keys"))
    prefix = F.greatest(F.lit(0), F.size("keys") - F.lit(MATCHES - 1))
    lists = stored(ranked.select("rep", F.explode(F.slice("keys", F.lit(1), prefix)).alias("k")).select("rep", "k.key"), "minhash-lists")
    parts = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / LIST_PART).alias("parts"))
    dealt = _parts(lists.join(parts, "key"), "key", "parts").join(classes.select("rep", "sig"), "rep")
    dealt = dealt.select("key", "p", "q", "rep", "sig").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return components(dealt.mapInArrow(_match_lists, "a long, b long")).select(F.col("node").alias("rep"), F.col("label").alias("block"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row: the smallest id reachable over links of at least ``percent`` similarity."""
    rows = stored(signed_documents(docs, width, text), "minhash-signatures")
    whole = rows.filter("n > 0 and id is not null")
    classes = stored(whole.groupBy("low", "high", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "minhash-classes")
    blocks = stored(candidate_blocks(classes), "minhash-blocks")
    # one row per class of a block, with the weight of the block
    weights = blocks.join(classes.select("rep", "n"), "rep").groupBy("block").agg(F.sum("n").alias("weight"))
    members = blocks.join(weights, "block").select("rep", "block", F.ceil(F.col("weight") / BLOCK_PART).alias("parts"))
    ids = texts(docs, text=text)
    holders = members.join(ids, members["rep"] == ids["id"]).select("block", "parts", "rep", "text")
    sets = holders.select("block", F.col("parts").alias("p"), F.col("parts").alias("q"), "rep", "text").mapInArrow(
        _shingle_sets(width), "block long, p long, q long, rep long, set binary")
    sets = _parts(sets.select("block", "rep", "set", F.col("p").alias("parts")), "block", "parts").select("block", "p", "q", "rep", "set")
    linked = sets.repartition("block", "p", "q").sortWithinPartitions("block", "p", "q").mapInArrow(_confirm(percent), "a long, b long")
    labels = stored(components(linked), "minhash-labels")
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("low", "high", "n", F.coalesce("label", "rep").alias("label"))
    # an empty set has no class and keeps its own id
    label = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("label", "id")).otherwise(F.col("id"))
    return rows.join(named, ["low", "high", "n"], "left").select("id", F.col("n").alias("n_shingles"), label.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose document is the first of its group; repeated rows of it and rows without id stay."""
    gone = near_duplicates(docs, width, percent).filter("component_id <> id").select(F.col("id").alias("__gone")).distinct()
    whole = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"))
    return whole.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
