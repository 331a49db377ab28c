"""Prefix trie of conversations from sorted paths.

A turn is known by 128 bits of its role and text, a conversation by its path: the keys of its turns one after another. Paths are
sorted over the whole table; the lengths of common prefixes (LCPs) of neighbours then hold the trie:

- every depth of a path beyond its LCP with the path before begins a node;
- a node's members are an interval of the sorted paths. A sparse table of range minima over the LCPs lets each prefix search its left and its
  right extent on its own, by halving steps, all prefixes at once and without a stack;
- nodes in the order (first path, depth) are in preorder, so a subtree is an interval of nodes: sums come from running totals, the smallest
  member from a second sparse table.

Distribution. Equal paths are collapsed first, in blocks of ``ID_BLOCK`` ids, so that a conversation that a third of all repeat is a few rows. The
paths are dealt by ranges and read in sorted blocks of at most ``BLOCK_BYTES``, whatever the size of a partition. A block finishes all its nodes but the
prefixes of its first and last path, which may go on in other blocks; of these it hands up two rows (``chains``) with what
lies below each prefix. Chains are paths with values at every depth and go through the same step again, until one block holds all.
A level leaves two rows per block, so the last one is small; a hot first turn is just one of those prefixes.

The list of ids that end at a node is hashed as a stream of the blocks of ids, in one task per list and in bounded memory, as SHA-256
runs from front to back.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), equal turns by their key; rows with a null id belong to no
conversation; a conversation is one row of some 40 bytes a turn. Repeated rows are turns of their own. Other columns are ignored. An empty table has no
node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from toposcan.llm.common import WORD_GAP, stored

KEY_BYTES = 16
ID_BLOCK_BITS = 12
BLOCK_BYTES = 16 << 20
NONE = np.iinfo(np.int64).max

#: A path with values at its depths: direct members, smallest of them, and what finished nodes below left behind.
CHAIN_SCHEMA = (
    "path binary, words array<long>, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"
)
NODE_SCHEMA = (
    "node_id string, parent_id string, depth long, turn_key string, conv_id long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string"
)
VALUES = ("n", "least", "children", "leaves", "saved")


def keyed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, its turns in order as ``(key, words)``: the key as hexadecimal digits, the number of words of the text."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    words = F.regexp_count(said, F.lit(WORD_GAP.replace("[", "[^"))).cast("long")
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), key.alias("key"), words.alias("words")).alias("x"))
    ordered = F.sort_array(F.collect_list("x"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["key"], x["words"])).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """``path, words, id_block, n, least, ids`` of ``(conv_id, turns)``: equal paths in blocks of ids, the ids in order and joined by commas."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), ""))
    rows = conversations.select(path.alias("path"), F.transform("turns", lambda x: x["words"]).alias("words"), "conv_id")
    block = F.shiftright("conv_id", ID_BLOCK_BITS)
    ids = F.sort_array(F.collect_list("conv_id"))
    return rows.groupBy("path", block.alias("id_block")).agg(
        F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(ids.cast("array<string>"), ",").alias("ids")
    )


class RangeMin:
    """Sparse table: minima of all runs of a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 * (half := 1 << (len(self.rows) - 1)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Last position reached from ``at`` while the values behind it are ``bound`` or more."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = at + 1 < len(row)
            ok = fits & (row[np.where(fits, at + 1, 0)] >= bound)
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First position from which all values up to that of ``at`` are ``bound`` or more; ``at`` itself where its own is less."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            first = at - (1 << k) + 1
            ok = (first >= 0) & (self.rows[k][np.maximum(first, 0)] >= bound)
            at[ok] -= 1 << k
        return at

    def least(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        k = np.frexp((past - first).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for size in np.unique(k):
            own = np.flatnonzero(k == size)
            row = self.rows[size]
            out[own] = np.minimum(row[first[own]], row[past[own] - (1 << size)])
        return out


def _lcps(found: list[bytes]) -> np.ndarray:
    """Common keys of each path with the one before; -1 for the first, so that even the root begins there."""
    out = np.empty(len(found), np.int64)
    out[0] = -1
    for k in range(1, len(found)):
        a, b = found[k - 1], found[k]
        lo, hi = 0, min(len(a), len(b)) // KEY_BYTES
        if a[: KEY_BYTES * hi] == b[: KEY_BYTES * hi]:
            lo = hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[KEY_BYTES * lo : KEY_BYTES * mid] == b[KEY_BYTES * lo : KEY_BYTES * mid]:
                lo = mid
            else:
                hi = mid
        out[k] = lo
    return out


def _ids(path: bytes, first: int, past: int) -> list[str]:
    """Ids of the prefixes of ``first`` to ``past - 1`` turns."""
    state, out = hashlib.blake2b(path[: KEY_BYTES * first], digest_size=16), []
    for d in range(first, past):
        if d > first:
            state.update(path[KEY_BYTES * (d - 1) : KEY_BYTES * d])
        out.append(state.copy().hexdigest())
    return out


def solve(block: dict, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """(finished nodes, chains) of sorted distinct paths with values at their depths.

    ``block``: ``path`` (list), ``words``, ``ends`` and the VALUES (lists of one array per path with a value for the depths 0 to its length).
    With ``last``, the block holds the whole trie and leaves no chain.
    """
    found = block["path"]
    rows, length = len(found), np.array([len(p) // KEY_BYTES for p in found])
    lcp = _lcps(found)
    table = RangeMin(lcp)
    # nodes: every path's depths beyond its LCP, in preorder
    new = length - lcp
    offset = np.append(0, np.cumsum(new))
    row = np.repeat(np.arange(rows), new)
    depth = np.arange(offset[-1]) - offset[row] + lcp[row] + 1
    right = table.right(row, depth)
    past = offset[right + 1]  # first node behind the subtree
    top = depth == lcp[row] + 1  # its parent begins in another path, or is the one of which the root has none
    parent = np.arange(len(row)) - 1
    asked = np.flatnonzero(top & (depth > 0))
    begin = table.left(row[asked], depth[asked] - 1)
    parent[asked] = offset[begin] + (depth[asked] - 1) - (lcp[begin] + 1)
    parent[depth == 0] = -1

    # what the rows hold at their depths, brought to the nodes
    held = length + 1
    of_row = np.repeat(np.arange(rows), held)
    at_depth = np.arange(len(of_row)) - np.repeat(np.cumsum(held) - held, held)
    start = table.left(of_row, at_depth)
    node = offset[start] + at_depth - (lcp[start] + 1)
    value = {c: np.concatenate(block[c]) for c in VALUES}
    direct = {c: np.zeros(len(row), np.int64) for c in VALUES}
    for c in ("n", "children", "leaves", "saved"):
        np.add.at(direct[c], node, value[c])
    direct["least"][:] = NONE
    np.minimum.at(direct["least"], node, value["least"])
    ends = np.full(len(row), None, object)
    flat = np.concatenate([np.array(x, object) for x in block["ends"]])
    told = np.flatnonzero(flat != None)  # noqa: E711
    ends[node[told]] = flat[told]

    # subtrees as intervals of nodes
    here = np.arange(len(row))
    run = lambda x: np.append(0, np.cumsum(x))
    over = lambda x: (lambda s: s[past] - s[here])(run(x))
    n = over(direct["n"])
    least = RangeMin(direct["least"]).least(here, past)
    words = np.array([block["words"][r][d - 1] if d else 0 for r, d in zip(row.tolist(), depth.tolist())], np.int64)
    children = direct["children"] + np.bincount(parent[parent >= 0], minlength=len(row))
    # prefixes of the first and the last path may go on outside
    open_ = np.zeros(len(row), bool)
    chains = [] if last else ([0] if rows == 1 else [0, rows - 1])
    if not last:
        open_[: offset[1]] = True
        every = np.arange(length[-1] + 1)
        where = table.left(np.full(len(every), rows - 1), every)
        open_[offset[where] + every - (lcp[where] + 1)] = True
    done = ~open_
    own_leaf = np.where(done & (children == 0), 1, 0)
    own_saved = np.where(done, (n - 1) * words, 0)
    leaves, saved = over(direct["leaves"] + own_leaf), over(direct["saved"] + own_saved)

    ids = [x for r in range(rows) for x in _ids(found[r], lcp[r] + 1, length[r] + 1)]
    keep = np.flatnonzero(done)
    empty = hashlib.sha256(b"").hexdigest()
    known = (parent[keep] >= 0) & done[parent[keep]]
    nodes = pa.RecordBatch.from_arrays(
        [
            pa.array([ids[k] for k in keep], pa.string()),
            pa.array([ids[p] if p >= 0 else None for p in parent[keep]], pa.string()),
            pa.array(depth[keep]),
            pa.array([found[row[k]][KEY_BYTES * (depth[k] - 1) : KEY_BYTES * depth[k]].hex() if depth[k] else None for k in keep], pa.string()),
            pa.array(least[keep]),
            pa.array(np.where(known, least[parent[keep]], 0), mask=~known),
            *[pa.array(x[keep]) for x in (n, children, leaves, saved)],
            pa.array([e or empty for e in ends[keep]], pa.string()),
        ],
        [c.strip().split()[0] for c in NODE_SCHEMA.split(",")],
    )
    # a chain has, for every depth, what lies below its prefix and below no longer open prefix
    if not last:
        k = np.flatnonzero(done & open_[parent])  # roots of finished subtrees; the root of all is open
        for c, x in zip(VALUES, (n, least, np.ones(len(row), np.int64), leaves, saved)):
            (np.minimum if c == "least" else np.add).at(direct[c], parent[k], x[k])
    out: dict[str, list] = {c: [] for c in ("path", "words", *VALUES, "ends")}
    for r in chains:
        # of the last path only the prefixes that it does not share with the first
        every = np.arange(length[r] + 1)
        where = table.left(np.full(len(every), r), every)
        at = offset[where] + every - (lcp[where] + 1)
        mine = (where > 0) | (r == 0)
        out["path"].append(found[r])
        out["words"].append(block["words"][r])
        for c in VALUES:
            out[c].append(np.where(mine, direct[c][at], NONE if c == "least" else 0))
        out["ends"].append([e if m else None for e, m in zip(ends[at], mine)])
    return nodes, _chain_batch(out)


def _chain_batch(out: dict[str, list]) -> pa.RecordBatch:
    longs, names = pa.list_(pa.int64()), ("path", "words", *VALUES, "ends")
    kinds = [pa.binary(), longs, *[longs] * len(VALUES), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds)], list(names))


def _add(block: dict, path: bytes, words: list, values: list, ends: list) -> None:
    block["path"].append(path)
    block["words"].append(words)
    for c, v in zip(VALUES, values):
        block[c].append(np.asarray(v, np.int64))
    block["ends"].append(ends)


def _from_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows of ``paths`` as (path, words, values, ends): equal paths as one, their ids hashed as they come."""
    path = None
    for batch in batches:
        for p, words, n, least, ids in zip(*[batch.column(c).to_pylist() for c in ("path", "words", "n", "least", "ids")]):
            if p != path:
                if path is not None:
                    yield _leaf(path, held, total, first, state)
                path, held, total, first, state = p, words, 0, least, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
            total, first = total + n, min(first, least)
    if path is not None:
        yield _leaf(path, held, total, first, state)


def _leaf(path: bytes, words: list, total: int, first: int, state) -> tuple:
    zeros = [0] * len(words)
    return path, words, [[*zeros, total], [*[NONE] * len(words), first], [0, *zeros], [0, *zeros], [0, *zeros]], [*[None] * len(words), state.hexdigest()]


def _from_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("path", "words", *VALUES, "ends")]
        for path, words, *values, ends in zip(*columns):
            yield path, words, values, ends


def _level(read: Callable, last: bool, block_bytes: int) -> Callable:
    """Rows ``kind`` 0 (nodes) and 1 (chains) in one schema."""
    node_names = [c.strip().split()[0] for c in NODE_SCHEMA.split(",")]
    chain_names = [c.strip().split()[0] for c in CHAIN_SCHEMA.split(",")]
    kinds = {c.strip().split()[0]: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[c.strip().split()[1]] for c in f"{NODE_SCHEMA},{CHAIN_SCHEMA}".split(",")}

    def told(block: dict) -> Iterator[pa.RecordBatch]:
        for kind, part in enumerate(solve(block, last)):
            if part.num_rows:
                columns = [part.column(c) if c in part.schema.names else pa.nulls(part.num_rows, kinds[c]) for c in (*node_names, *chain_names)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * part.num_rows, pa.int64()), *columns], ["kind", *node_names, *chain_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: {c: [] for c in ("path", "words", *VALUES, "ends")}
        block, held = new(), 0
        for path, words, values, ends in read(batches):
            if held > block_bytes and not last:
                yield from told(block)
                block, held = new(), 0
            _add(block, path, words, values, ends)
            held += 160 + 8 * len(path)  # what a path and its nodes take, about
        if block["path"]:
            yield from told(block)

    return run


def prefix_trie(conversations: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The nodes (``NODE_SCHEMA``) of ``(conv_id, turns)``, see ``keyed``: ``conv_id`` is the smallest member, ``saved_tokens`` the words that a
    shared prefix saves below the node, ``ends_sha256`` the hash of the ids that end there, ascending and joined by commas."""
    names = [[c.strip().split()[0] for c in x.split(",")] for x in (NODE_SCHEMA, CHAIN_SCHEMA)]
    dealt = stored(paths(conversations), "trie-paths").repartitionByRange("path").sortWithinPartitions("path", "id_block")
    parts, read, last, before = [], _from_paths, False, None
    while True:
        level = stored(dealt.mapInArrow(_level(read, last, block_bytes), f"kind long, {NODE_SCHEMA}, {CHAIN_SCHEMA}"), "trie-level")
        parts.append(level.filter("kind = 0").select(*names[0]))
        if last:
            return _with_parents(parts)
        chains, read = level.filter("kind = 1").select(*names[1]), _from_chains
        count, size = chains.agg(F.count(F.lit(1)), F.coalesce(F.sum(160 + 8 * F.length("path")), F.lit(0))).first()
        # one block, or chains so long that another level would not make them fewer
        last = size <= block_bytes or (before is not None and 2 * count > before)
        before = count
        dealt = (chains.coalesce(1) if last else chains.repartitionByRange(1 + size // (8 * block_bytes), "path")).sortWithinPartitions("path")


def _with_parents(parts: list[DataFrame], broadcast_rows: int = 200_000) -> DataFrame:
    """All levels, with ``parent_conv_id`` of nodes whose parent was finished on a later level: those are the prefixes of two paths per block."""
    nodes, late = parts[0], parts[1]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    for part in parts[2:]:
        late = late.unionByName(part)
    late = late.select(F.col("node_id").alias("__id"), F.col("conv_id").alias("__least"))
    small = late.limit(broadcast_rows + 1).count() <= broadcast_rows
    waiting = nodes.filter("parent_conv_id IS NULL AND parent_id IS NOT NULL")
    found = waiting.join(F.broadcast(late) if small else late, F.col("parent_id") == F.col("__id"), "left")
    filled = found.withColumn("parent_conv_id", F.col("__least")).select(*nodes.columns)
    return nodes.filter("parent_conv_id IS NOT NULL OR parent_id IS NULL").unionByName(filled)


def node_texts(nodes: DataFrame, turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn (null for the root); ``turns`` are the conversations' rows."""
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    key = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    known = turns.select(key.alias("__key"), by.alias("role"), said.alias("text")).dropDuplicates(["__key"])
    return nodes.join(known, F.col("turn_key") == F.col("__key"), "left").drop("__key")


def share_heads(conversations: DataFrame, every: int, heads: Column, most: int) -> DataFrame:
    """``(conv_id, turns)`` where conversation c begins with the first ``heads`` (``most`` at most) turns of conversation c - c % ``every`` instead of its
    own first ``heads``; without that conversation it loses them."""
    own = conversations.withColumns({"__base": F.col("conv_id") - F.col("conv_id") % every, "__heads": heads.cast("int")})
    base = conversations.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__first"))
    first = F.coalesce(F.slice("__first", F.lit(1), F.col("__heads")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("__heads") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(base, "__base", "left").select("conv_id", F.concat(first, rest).alias("turns"))
