"""Toxicity by weak supervision.

1. Lexicon: a short list of insults, and word beginnings that are typical of documents labelled toxic. They are counted on a
   bounded sample of labelled documents (``SAMPLE_ROWS``, the smallest by a hash of the id); documents that share a MinHash value weigh as
   one, so that a group of copies does not make its words suspicious.
2. Voters: several tests over the hits of a document (number, distinct, density, closeness, lists) vote toxic, clean or abstain.
3. Label model: the counts of all vote patterns over the corpus (a few hundred rows) fit a generative model by EM: per class the accuracy of
   each voter, and its dependence on the one voter it is most correlated with given the class (a tree). It gives each
   pattern the probability of being toxic.
4. A linear classifier on the hit counts is fitted to these probabilities on the sample and scores every document.

Rows held out (``held``) take no part in any of the four fits. Scores depend on the text alone. A null or empty text has no
hits and gets the score of such a text. Rows with a null id are scored and never learned from. Repeated rows score alike. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from toposcan.llm import words as W
from toposcan.llm.common import stored, texts

# Common English insults.
INSULTS = "idiot moron stupid loser clown pathetic worthless disgusting scum trash dumb imbecile filthy vermin bastard cretin".split()
SAMPLE_ROWS = 20_000
PREFIX_BYTES = (4, 5, 6, 7)
MIN_PRECISION, MIN_SURPRISE, MAX_ENTRIES = 0.4, 5.0, 5_000
NEAR_WORDS = 50
COUNTS = ("listed", "learned", "kinds", "near", "words")


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id, text, toxic`` of at most ``rows`` labelled documents that are not held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    body = texts(docs)
    return body.join(F.broadcast(known), body["id"] == known["__id"]).select("id", "text", "toxic").limit(4 * rows)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two MinHash values of word pairs per document."""
    for batch in batches:
        for chunk in W.chunks(batch.column(1).to_pylist(), lower=True):
            at, value = chunk.windows(2)
            doc = chunk.doc[at] if len(at) else at
            marks = np.zeros((2, chunk.count), np.uint64)
            marks[:] = W.mix(np.arange(chunk.count, dtype=np.uint64) + np.uint64(chunk.first << 20))  # texts below two words are of their own kind
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else at
            for k, salt in enumerate((0x51ED270B0B5E1F4D, 0xC2B2AE3D27D4EB4F)):
                if len(doc):
                    marks[k, doc[first]] = np.minimum.reduceat(W.mix(value ^ np.uint64(salt)), first)
            part = batch.slice(chunk.first, chunk.count)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(W.signed(marks[0])), pa.array(W.signed(marks[1]))], ["id", "text", "toxic", "m1", "m2"])


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weight of the documents, and of the toxic ones, that have a word with a given beginning."""
    for batch in batches:
        toxic, weight = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for chunk in W.chunks(batch.column(1).to_pylist(), lower=True, size=4 << 20):
            for size in PREFIX_BYTES:
                at, value = chunk.prefixes(size)
                if not len(at):
                    continue
                doc = chunk.doc[at]
                order = np.lexsort((doc, value))
                doc, value = doc[order], value[order]
                keep = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
                doc, value = doc[keep] + chunk.first, value[keep]
                first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
                n, t = np.add.reduceat(weight[doc], first), np.add.reduceat(weight[doc] * toxic[doc], first)
                good = t > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(good.sum(), size, np.int32)), pa.array(W.signed(value[first][good])), pa.array(n[good]), pa.array(t[good])], ["size", "prefix", "n", "t"])
                rest = ~good
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rest.sum(), size, np.int32)), pa.array(W.signed(value[first][rest])), pa.array(n[rest]), pa.array(t[rest])], ["size", "prefix", "n", "t"])


def learn_prefixes(rows: DataFrame) -> list[tuple[int, int]]:
    """(bytes, hash) of word beginnings that are typical of the toxic rows of a stored sample."""
    from pyspark.sql import Window

    marked = rows.mapInArrow(_marks, "id long, text string, toxic int, m1 long, m2 long")
    size = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))  # noqa: E731  the sample is bounded
    weighed = stored(marked.select("id", "text", "toxic", (1.0 / F.greatest(size("m1"), size("m2"))).alias("weight")), "toxicity-weights")
    total, toxic = weighed.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("toxic"))).first()
    if not toxic:
        return []
    base = toxic / total
    counts = weighed.mapInArrow(_prefix_counts, "size int, prefix long, n double, t double").groupBy("size", "prefix").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    surprise = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    best = counts.filter((F.col("t") >= MIN_PRECISION * F.col("n")) & (surprise >= MIN_SURPRISE)).orderBy(surprise.desc(), "size", "prefix").limit(MAX_ENTRIES)
    return [(r["size"], r["prefix"]) for r in best.collect()]


def _lexicon(learned: list[tuple[int, int]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: sorted hashes and whether each is from the list of insults."""
    table: dict[int, dict[int, bool]] = {}
    for size, prefix in learned:
        table.setdefault(size, {})[prefix] = False
    for word in INSULTS:
        chunk = next(W.chunks([word]))
        table.setdefault(len(word), {})[int(W.signed(chunk.prefixes(len(word))[1])[0])] = True
    out = []
    for size, entries in sorted(table.items()):
        hashes = np.array(sorted(entries), np.int64)
        out.append((size, hashes, np.array([entries[int(h)] for h in hashes])))
    return out


def _hits(lexicon) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(1).to_pylist(), lower=True):
                listed, learned = np.zeros(len(chunk.hash), bool), np.zeros(len(chunk.hash), bool)
                for size, hashes, fixed in lexicon:
                    at, value = chunk.prefixes(size)
                    value = W.signed(value)
                    k = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                    hit = hashes[k] == value
                    listed[at[hit & fixed[k]]] = True
                    learned[at[hit & ~fixed[k]]] = True
                any_hit = np.flatnonzero(listed | learned)
                doc = chunk.doc
                own = doc[any_hit]
                count = lambda x: np.bincount(x, minlength=chunk.count)
                pairs = np.unique(np.stack([own.astype(np.uint64), chunk.hash[any_hit]]), axis=1) if len(own) else np.empty((2, 0), np.uint64)
                close = (own[1:] == own[:-1]) & (np.diff(any_hit) <= NEAR_WORDS) if len(own) > 1 else np.empty(0, bool)
                cols = [count(doc[listed]), count(doc[learned & ~listed]), count(pairs[0].astype(np.int64)), count(own[1:][close]) if len(close) else count(own[:0]), np.diff(chunk.bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.count), *(pa.array(c.astype(np.int64)) for c in cols)], ["id", *COUNTS])

    return run


def hits(docs: DataFrame, learned: list[tuple[int, int]]) -> DataFrame:
    """``id`` and ``COUNTS`` of every row: hits of the list, further hits, distinct words hit, hits close to another, words."""
    return texts(docs).mapInArrow(_hits(_lexicon(learned)), "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def votes() -> list[Column]:
    """1 toxic, -1 clean, 0 abstain, per voter."""
    listed, learned, kinds, near, words = (F.col(c) for c in COUNTS)
    total = listed + learned

    def vote(toxic: Column, clean: Column | None = None) -> Column:
        out = F.when(toxic, 1)
        return (out if clean is None else out.when(clean, -1)).otherwise(0)

    return [
        vote(listed >= 2), vote(learned >= 2), vote(kinds >= 2, total == 0), vote(total >= 3, total <= 1),
        vote((total >= 2) & (total * 300 >= words), total * 1000 <= words), vote(near >= 1, total <= 1)]


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of class toxic for each vote pattern (rows of -1, 0, 1), from how often the patterns occur.

    Latent-class model with a tree of dependences among the voters given the class: the maximum spanning tree by mutual
    information given the majority of votes, then EM with it. Voters taken as independent would make the class of those that agree.
    """
    value = patterns + 1
    voters = patterns.shape[1]
    # start: more toxic than clean votes
    post = 1 / (1 + np.exp(-2.0 * (patterns.sum(1) - 0.5)))
    parent = [-1] * voters

    def fit(post: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            weight = np.stack([counts * (1 - post), counts * post])
            log = np.log(weight.sum(1) + 1.0)[:, None] + np.zeros((2, len(counts)))
            for j in range(voters):
                up = value[:, parent[j]] if parent[j] >= 0 else np.zeros(len(value), int)
                for y in (0, 1):
                    table = np.full((3, 3), 0.5)
                    np.add.at(table, (up, value[:, j]), weight[y])
                    table /= table.sum(1, keepdims=True)
                    log[y] += np.log(table[up, value[:, j]])
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        return post

    gain = np.zeros((voters, voters))
    for y in (0, 1):
        w = counts * (post if y else 1 - post)
        for a in range(voters):
            for b in range(a):
                joint = np.full((3, 3), 1e-9)
                np.add.at(joint, (value[:, a], value[:, b]), w)
                share = joint / joint.sum()
                gain[a, b] += w.sum() * (share * np.log(share / np.outer(share.sum(1), share.sum(0)))).sum()
    gain += gain.T
    reached = [0]
    while len(reached) < voters:  # maximum spanning tree from the first voter
        a, b = max(((a, b) for a in reached for b in range(voters) if b not in reached), key=lambda e: (gain[e], -e[1]))
        parent[b] = a
        reached.append(b)
    return fit(post)


def design(listed, learned, kinds, near, words) -> list:
    """Inputs of the linear classifier, for columns or arrays."""
    log = F.log1p if isinstance(listed, Column) else np.log1p
    total = listed + learned
    return [log(listed), log(learned), log(total), log(kinds), log(near), log(100.0 * total / (words + 20.0))]


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), grad)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id, held_out, score`` of every row of ``docs``; labels are read only where the row is not held out."""
    picked = stored(sample(docs, labels, rows), "toxicity-sample")
    learned = learn_prefixes(picked)
    counted = stored(hits(docs, learned), "toxicity-hits")
    own = [f"v{k}" for k in range(len(votes()))]
    free = counted.filter(~held_out(F.col("id")))
    table = free.select(*[v.alias(n) for v, n in zip(votes(), own)]).groupBy(*own).agg(F.count(F.lit(1)).alias("n")).collect()
    weights = np.r_[np.zeros(6), -3.0]
    if table:
        patterns = np.array([[r[c] for c in own] for r in table])
        post = label_model(patterns, np.array([r["n"] for r in table], float))
        by_pattern = {tuple(p): float(q) for p, q in zip(patterns, post)}
        # rows of the sample with equal counts are one row with a weight
        seen = hits(picked.select(F.col("id").alias("doc_id"), "text"), learned)
        seen = seen.select(*COUNTS, *[v.alias(n) for v, n in zip(votes(), own)]).groupBy(*COUNTS, *own).agg(F.count(F.lit(1)).alias("n")).collect()
        if seen:
            x = np.array([[r[c] for c in COUNTS] for r in seen], float)
            target = np.array([by_pattern.get(tuple(r[c] for c in own), 0.0) for r in seen])
            weights = fit_linear(np.stack(design(*x.T), 1), target, np.array([r["n"] for r in seen], float))
    linear = F.lit(float(weights[-1]))
    for w, c in zip(weights, design(*(F.col(c).cast("double") for c in COUNTS))):
        linear = linear + F.lit(float(w)) * c
    return counted.select("id", held_out(F.col("id")).alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"))
