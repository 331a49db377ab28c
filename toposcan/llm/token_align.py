"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the bytes of a space and the text. Their own spans give coarse cuts: character offsets of ``tokenizers``, turned into
byte offsets, and the spans that sentencepiece returns (``offset_mapping`` in bytes; the installed release has this and a slower ``proto`` of the same
spans in place of the immutable proto). A span that is as long as the decoded bytes of its token is exact. Tokens that share one
multibyte character, byte-fallback tokens and the first piece with its added space are not; they are refined by their decoded bytes, counted
on from the last exact cut. Offsets where both sides end a token close a group; the tokens of a group are linked.

1. ``cut``: one pass over the texts; per document its groups and its distinct linked id pairs with multiplicities, and per batch of
   documents (about ``BATCH_CHARS`` of whole texts) the distinct pairs with the number of documents that hold them. A batch tells a pair once, however
   many documents repeat it, so no pair has more rows than there are batches and the most frequent pair is a small share of all.
2. ``pair_counts``: documents per pair and the highest count of each first id, by two aggregates.
3. ``aligned``: the counts go back to the batches by one join on the pair and meet their documents batch by batch.

A text is cut into segments before single spaces where neither tokenizer can hold a token across (checked on the vocabularies; otherwise a text is one
segment): a segment's tokens, groups and links depend on it alone, so the equal segments of a batch are cut once, and a worker remembers the
segments that most of its batches hold (``Segments``).

A large group is held by its distinct ids with counts, never as all its links.

Defined cases: a null or empty text, or one whose decoded bytes differ from space and text on either side (the second tokenizer reads U+2581
as a space), has no tokens: zeros and ''. Every row is a document of its own, so repeated rows count once each; a null id stays null. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from toposcan.llm.common import per_process, stored, texts

BATCH_CHARS = 3 << 20
DOCS_AT_ONCE = 256
#: Segments and characters that a worker remembers between batches, some 300 bytes a segment.
KNOWN_SEGMENTS = 300_000
KNOWN_CHARS = 4 << 20
LEARNED_AT_ONCE = 16_384  # segments
RUN_PARTS = 256
CUT_SCHEMA = (
    "batch long, id long, is_batch boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " keys array<long>, times array<long>"
)


_SOLVED = ("part_a", "ids_a", "ends_a", "group_a", "part_b", "ids_b", "ends_b", "group_b", "part_of_group")
#: Characters that may count as space somewhere; no text is cut beside them.
_BLANK = "\\s\u180e\u200b-\u200f\u2060\ufeff"
_BLANKS = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{_BLANK}]", c))
_ODD_SPACE = re.compile(f" [{_BLANK}]|[{_BLANK}] ")
_SPACE = re.compile(f"(?<=[^{_BLANK}])(?= [^{_BLANK}])")


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class TokenizerPair:
    """A byte-level file of ``tokenizers`` (side a) and a sentencepiece model (side b)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = byte_of_symbol()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        names = [self.a.id_to_token(i) or "" for i in range(self.size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_a = [bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t in names]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.known = Segments()
        # every id as text with the mark that follows it inside and at the end of its group's side
        self.text_a = [f"{i}{mark}" for i in range(self.size_a) for mark in ",|"]
        self.text_b = [f"{i}{mark}" for i in range(self.size_b) for mark in ",;"]
        # side a cuts words by itself before it merges; side b merges into no piece with a space behind another character
        inside = any(not self.b.is_byte(i) and "▁" in t.lstrip("▁") for i, t in enumerate(pieces))
        self.cuts_at_spaces = not inside and type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None

    def segments(self, text: str) -> list[str]:
        """``text`` cut at single spaces between two characters that are none; each segment stands for a space and itself.

        Both sides cut there too, whatever is around.
        """
        if not self.cuts_at_spaces:
            return [text]
        if text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text):
            return [t[1:] for t in _SPACE.split(" " + text)]
        return text.split(" ")

    def runs(self, parts: list[str]) -> list[str]:
        """``parts`` joined to a few longer strings where they stay cut from one another: many calls on short strings cost more than the tokens."""
        alone = [k for k, t in enumerate(parts) if not t or t[0] in _BLANKS or t[-1] in _BLANKS] if self.cuts_at_spaces else range(len(parts))
        ends = sorted({*range(0, len(parts), RUN_PARTS), *alone, *(k + 1 for k in alone), len(parts)})
        return [" " + " ".join(parts[lo:hi]) for lo, hi in zip(ends, ends[1:])]

    def tokens_a(self, runs: list[str]) -> tuple[np.ndarray, ...]:
        """(id, first byte, past byte) of every token; bytes count through all runs, as the tokenizer's character offsets have it."""
        found = []
        for run, begin in zip(runs, _begins([len(x) for x in runs])):  # one at a time: what the library returns is large
            x = self.a.encode(run, add_special_tokens=False)
            n = len(x.ids)
            found.append(np.column_stack([np.array(x.ids), np.fromiter(chain.from_iterable(x.offsets), np.int64, 2 * n).reshape(-1, 2) + begin]))
        ids, *spans = np.concatenate(found).T
        spans = np.column_stack(spans)
        raw = np.frombuffer("".join(runs).encode("utf-8", "surrogatepass"), np.uint8)
        spans = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[spans]  # characters to bytes
        return ids, spans[:, 0], spans[:, 1]

    def tokens_b(self, runs: list[str]) -> tuple[np.ndarray, ...]:
        """As ``tokens_a``; the tokenizer adds the space that every run begins with, and a span begins where the one before ends."""
        found = []
        for run, begin in zip(runs, _begins([_bytes(x) for x in runs])):
            x = self.b.encode(run[1:], return_type="offset_mapping", return_bytes=True)
            ids = np.array(x["ids"], np.int64)
            end = np.fromiter(chain.from_iterable(x["offsets"]), np.int64, 2 * len(ids))[1::2]
            found.append((ids, np.append(0, end[:-1]) + begin + 1, end + begin + 1))
        return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _begins(sizes: list[int]) -> np.ndarray:
    return np.cumsum([0, *sizes[:-1]])


def refined(first: np.ndarray, end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans and decoded lengths: a span of its token's length is exact, others count on from the one before."""
    total = np.cumsum(length)
    exact = np.flatnonzero(end - first == length)
    shift = np.zeros(len(end), np.int64)
    shift[exact] = end[exact] - total[exact]
    last = np.zeros(len(end), np.int64)
    last[exact] = exact
    np.maximum.accumulate(last, out=last)
    return total + shift[last]


def pair(paths: tuple[str, str]) -> TokenizerPair:
    """One pair per worker and files."""
    return per_process(("tokenizers", *paths), lambda: TokenizerPair(*paths))


def _counted(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of the distinct ids of every group, by group."""
    value, times = np.unique(group * size + ids, return_counts=True)
    return value // size, value % size, times


def links(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(group, id pair as a * size_b + b, times) of the distinct linked ids of every group."""
    ga, a, na = _counted(group_a, ids_a, sizes[0])
    gb, b, nb = _counted(group_b, ids_b, sizes[1])
    n = int(ga[-1]) + 1 if len(ga) else 0
    first, many = np.searchsorted(gb, np.arange(n)), np.bincount(gb, minlength=n)
    each = many[ga]
    left = np.repeat(np.arange(len(ga)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[ga], each)
    return ga[left], a[left] * sizes[1] + b[right], na[left] * nb[right]


def written(p: TokenizerPair, group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The pieces of ``a1,a2|b1;a3|b2,b3;``, one per token in the order of the text, and the group of each."""
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    parts = [p.text_a[i] for i in (ids_a * 2 + last_a).tolist()] + [p.text_b[i] for i in (ids_b * 2 + last_b).tolist()]
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    return [parts[k] for k in order.tolist()], np.concatenate([group_a, group_b])[order]


def _decodes(parts: list[str], part: np.ndarray, ids: np.ndarray, table: list[bytes], data: bytes, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which parts are what their tokens decode to."""
    decoded = [table[i] for i in ids.tolist()]
    if (np.bincount(part, lengths[ids], len(parts)) == sizes).all() and b"".join(decoded) == data:
        return np.ones(len(parts), bool)
    bound = np.searchsorted(part, np.arange(len(parts) + 1)).tolist()
    return np.array([b"".join(decoded[lo:hi]) == b" " + t.encode("utf-8", "surrogatepass") for t, lo, hi in zip(parts, bound, bound[1:])], bool)


def solve(p: TokenizerPair, parts: list[str]) -> dict:
    """Tokens and groups of ``parts``, each a segment that is cut for itself with a space before it.

    ``good`` tells the parts that both sides decode to. Of these: ``part_a, ids_a, ends_a, group_a`` (and ``_b``) per token, in order, and
    ``part_of_group``; byte ends and groups count through all good parts.
    """
    runs = p.runs(parts)
    data = "".join(runs).encode("utf-8", "surrogatepass")
    sizes = np.array([_bytes(t) + 1 for t in parts])
    begins = np.cumsum(sizes) - sizes
    sides, good = [], np.ones(len(parts), bool)
    for tokens, table, lengths in ((p.tokens_a, p.bytes_a, p.length_a), (p.tokens_b, p.bytes_b, p.length_b)):
        ids, first, end = tokens(runs)
        part = np.searchsorted(begins, first, side="right") - 1
        good &= _decodes(parts, part, ids, table, data, sizes, lengths)
        sides.append((part, ids, first, end))
    if not good.all():
        out = solve(p, [t for t, g in zip(parts, good) if g]) if good.any() else {k: np.empty(0, np.int64) for k in _SOLVED}
        where = np.flatnonzero(good)
        return out | {k: where[out[k]] for k in ("part_a", "part_b", "part_of_group")} | {"good": good}
    (part_a, ids_a, *spans_a), (part_b, ids_b, *spans_b) = sides
    ends_a, ends_b = refined(*spans_a, p.length_a[ids_a]), refined(*spans_b, p.length_b[ids_b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    of_group = part_a[np.searchsorted(ends_a, cuts)]
    return dict(zip(_SOLVED, (part_a, ids_a, ends_a, group_a, part_b, ids_b, ends_b, group_b, of_group)), good=good)


def align(p: TokenizerPair, text: str | None) -> dict | None:
    """Ids, byte ends and group numbers of both sides of one text, or None where it has no tokens."""
    x = solve(p, p.segments(text)) if text else None
    return x if x and x["good"].all() else None


def _learned(p: TokenizerPair, parts: list[str]) -> tuple:
    """Of every part: whether it is good, its four counts, the text of its groups, and where its linked pairs begin among ``key`` and ``times``."""
    x = solve(p, parts) if parts else {k: np.empty(0, np.int64) for k in _SOLVED} | {"good": np.empty(0, bool)}
    seen, groups, of_group = len(parts), len(x["part_of_group"]), x["part_of_group"]
    size = np.bincount(x["group_a"], minlength=groups) * np.bincount(x["group_b"], minlength=groups)
    each = np.array([np.bincount(v, minlength=seen) for v in (x["part_a"], x["part_b"], of_group, of_group)])
    each[3] = 0
    np.add.at(each[3], of_group, size)
    texts_, group = written(p, x["group_a"], x["ids_a"], x["group_b"], x["ids_b"])
    bound = np.searchsorted(of_group[group] if groups else group, np.arange(seen + 1)).tolist()
    lines = ["".join(texts_[lo:hi]) for lo, hi in zip(bound, bound[1:])]
    group, key, times = links(x["group_a"], x["ids_a"], x["group_b"], x["ids_b"], (p.size_a, p.size_b))
    return x["good"], each, lines, np.searchsorted(of_group[group] if groups else group, np.arange(seen + 1)), key, times


class _Places(dict):
    """The place of every segment, numbered as they come."""

    def __missing__(self, part: str) -> int:
        place = self[part] = len(self)
        return place


class Segments:
    """What a worker knows of segments, by their place; ``uses`` counts the batches that held them, older ones less."""

    def __init__(self) -> None:
        self.places, self.lines = _Places(), []
        self.good, self.uses, self.each = np.empty(0, bool), np.empty(0, np.int64), np.empty((4, 0), np.int64)
        self.first, self.key, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def look_up(self, p: TokenizerPair, parts: Iterator[str], n: int) -> np.ndarray:
        """The places of ``n`` segments; new ones are learned."""
        which = np.fromiter(map(self.places.__getitem__, parts), np.int64, n)
        new = list(islice(self.places, len(self.lines), None))
        found = [_learned(p, new[lo : lo + LEARNED_AT_ONCE]) for lo in range(0, len(new), LEARNED_AT_ONCE)]
        if found:
            good, each, lines, first, key, times = zip(*found)
            begins = self.first[-1] + np.cumsum([0, *map(len, key)])
            self.good = np.concatenate([self.good, *good])
            self.each = np.concatenate([self.each, *each], 1)
            self.lines += chain.from_iterable(lines)
            self.first = np.concatenate([self.first, *[at[1:] + begin for at, begin in zip(first, begins)]])
            self.key, self.times = np.concatenate([self.key, *key]), np.concatenate([self.times, *times])
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[np.unique(which)] += 1
        return which

    def forget(self) -> None:
        """Above the limits, all but the most used half; of those that one batch held none is kept."""
        size = np.fromiter(map(len, self.places), np.int64, len(self.places))
        if len(size) <= KNOWN_SEGMENTS and size.sum() <= KNOWN_CHARS:
            return
        order = np.argsort(-self.uses, kind="stable")
        order = order[(self.uses[order] > 1) & (np.cumsum(size[order]) <= KNOWN_CHARS // 2)][: KNOWN_SEGMENTS // 2]
        kept = np.zeros(len(size), bool)
        kept[order] = True
        places = kept.tolist()
        self.places = _Places(zip(compress(self.places, places), range(len(order))))
        self.lines = list(compress(self.lines, places))
        wide = np.diff(self.first)
        own = np.repeat(kept, wide)
        self.key, self.times, self.first = self.key[own], self.times[own], np.append(0, np.cumsum(wide[kept]))
        self.good, self.each, self.uses = self.good[kept], self.each[:, kept], (self.uses[kept] + 1) // 2


def _batch(p: TokenizerPair, name: int, keys: list, bodies: list[str | None]) -> pa.RecordBatch:
    """Rows of one batch of documents, its own row last. Equal segments are cut once, those that are remembered not again."""
    cut_ = [p.segments(text) if text else [] for text in bodies]
    known = p.known
    which = known.look_up(p, chain.from_iterable(cut_), sum(map(len, cut_)))
    held = np.split(which, np.cumsum([len(c) for c in cut_])[:-1])
    del cut_
    good, each, lines, first, key, times = known.good, known.each, known.lines, known.first, known.key, known.times
    held = [h if good[h].all() else h[:0] for h in held]
    seen, width, many = len(lines), np.diff(first), np.array([len(h) for h in held], np.int64)
    flat = np.concatenate([*held, np.empty(0, np.int64)])
    doc = np.repeat(np.arange(len(keys)), many)
    counts = np.zeros((4, len(keys)), np.int64)
    for row, value in zip(counts, each):
        np.add.at(row, doc, value[flat])
    shas = [hashlib.sha256("".join([lines[k] for k in h.tolist()])[:-1].encode()).hexdigest() if len(h) else "" for h in held]
    # linked pairs of the documents
    space, found = p.size_a * p.size_b, []
    bounds = np.cumsum([0, *many])
    for lo in range(0, len(keys), DOCS_AT_ONCE):
        own = slice(bounds[lo], bounds[min(lo + DOCS_AT_ONCE, len(keys))])
        value, repeats = np.unique(doc[own] * max(seen, 1) + flat[own], return_counts=True)
        at, which = value // max(seen, 1), value % max(seen, 1)
        wide = width[which]
        take = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first[which], wide)
        value, where = np.unique(np.repeat(at, wide) * space + key[take], return_inverse=True)
        found.append((value // space, value % space, np.bincount(where, times[take] * np.repeat(repeats, wide), len(value)).astype(np.int64)))
    known.forget()
    doc, key, times = (np.concatenate(x) for x in zip(*found))
    whole, docs = np.unique(key, return_counts=True)
    offsets = np.append(np.searchsorted(doc, np.arange(len(keys) + 1)), len(key) + len(whole)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(v))) for v in ((key, whole), (times, docs))]
    columns = [
        pa.array([name] * (len(keys) + 1), pa.int64()),
        pa.array([*keys, None], pa.int64()),
        pa.array([False] * len(keys) + [True]),
        *[pa.array(np.append(c, 0)) for c in counts],
        pa.array([*shas, ""]),
        *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, [c.strip().split()[0] for c in CUT_SCHEMA.split(",")])


def _cut(paths: tuple[str, str], batch_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, name = pair(paths), TaskContext.get().partitionId() << 32
        keys, bodies, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                bodies.append(text.as_py())
                held += len(bodies[-1] or "")
                if held >= batch_chars:
                    yield _batch(p, name, keys, bodies)
                    name, keys, bodies, held = name + 1, [], [], 0
        if keys:
            yield _batch(p, name, keys, bodies)

    return run


def cut(docs: DataFrame, paths: tuple[str, str], batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per document and one per batch (``is_batch``), see ``CUT_SCHEMA``. The batch numbers hold for one evaluation: store the result."""
    return texts(docs).mapInArrow(_cut(paths, batch_chars), CUT_SCHEMA)


def pair_counts(cuts: DataFrame, size_b: int) -> DataFrame:
    """``key, docs, best``: the documents of every linked id pair, and whether no pair of the same first id has more.

    The window over a first id holds at most as many rows as the second vocabulary has ids.
    """
    each = cuts.filter("is_batch").select(F.explode(F.arrays_zip("keys", "times")).alias("x")).select("x.keys", "x.times")
    total = each.groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("docs"))
    first = Window.partitionBy(F.floor(F.col("key") / size_b))
    return total.withColumn("best", F.col("docs") == F.max("docs").over(first))


def _totals(docs: pa.Table, known: pa.Table) -> pa.Table:
    key, n, best = (known.column(c).to_numpy() for c in ("key", "docs", "best"))
    order = np.argsort(key)
    lists, times = docs.column("keys").combine_chunks(), docs.column("times").combine_chunks()
    at = order[np.searchsorted(key, lists.flatten().to_numpy(), sorter=order)] if len(key) else np.empty(0, np.int64)
    weight = times.flatten().to_numpy()
    many = lists.value_lengths().fill_null(0).to_numpy()
    doc = np.repeat(np.arange(len(many)), many)
    sums = np.zeros((2, len(many)), np.int64)
    for row, value in zip(sums, (weight * best[at].astype(np.int64), weight * n[at]) if len(at) else ()):
        np.add.at(row, doc, value)
    kept = ("id", "n_a", "n_b", "n_groups", "n_links")
    return pa.Table.from_arrays(
        [*[docs.column(c) for c in kept], pa.array(sums[0]), pa.array(sums[1]), docs.column("groups_sha256")],
        [*kept, "n_best", "count_sum", "groups_sha256"],
    )


def aligned(docs: DataFrame, paths: tuple[str, str], batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    size_b = pair(paths).size_b
    cuts = stored(cut(docs, paths, batch_chars), "align-cuts")
    asked = cuts.filter("is_batch").select(F.col("batch").alias("asked_by"), F.explode("keys").alias("key"))
    known = asked.join(pair_counts(cuts, size_b), "key").select("asked_by", "key", "docs", "best")
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return cuts.filter("NOT is_batch").groupBy("batch").cogroup(known.groupBy("asked_by")).applyInArrow(_totals, schema)


def alignments(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``id, groups``: the groups themselves, an array of (first byte, past byte, a ids, b ids) per document; bytes count the added space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(paths)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                x, rows = align(p, text.as_py()), []
                if x is not None:
                    past = np.intersect1d(x["ends_a"], x["ends_b"], assume_unique=True)
                    a = np.split(x["ids_a"], np.flatnonzero(np.diff(x["group_a"])) + 1)
                    b = np.split(x["ids_b"], np.flatnonzero(np.diff(x["group_b"])) + 1)
                    rows = [{"first": f, "past": e, "a": u, "b": v} for f, e, u, v in zip([0, *past[:-1].tolist()], past.tolist(), a, b)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), pa.array([rows], kind)], ["id", "groups"])

    return texts(docs).mapInArrow(run, "id long, groups array<struct<first:bigint,past:bigint,a:array<bigint>,b:array<bigint>>>")
