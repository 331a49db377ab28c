"""Which of many patterns a text contains, by Aho-Corasick automata over parts of the patterns.

Distinct patterns are dealt by a hash to parts of about ``PART_BYTES``, so the size of an automaton is bounded whatever the dictionary; distinct texts are dealt
to blocks. A part and a block meet in one task, which builds the automaton of the part once and reads each text of the block once. Nothing is cut into
substrings, and no row is made but for a match. One part (the usual dictionary) travels with the job instead, and the texts stay where they are.

A text contains the empty pattern. Null texts and null patterns match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

PART_BYTES = 1 << 20
BLOCK_BYTES = 64 << 20


class Automaton:
    """Patterns with a number each; ``found(text)`` are the numbers of those that it contains, with repeats."""

    def __init__(self, patterns: list[str], numbers: list[int]) -> None:
        import ahocorasick

        self.tree, self.always = ahocorasick.Automaton(), []
        for p, n in zip(patterns, numbers):
            if p:
                self.tree.add_word(p, n)
            else:
                self.always.append(n)
        self.any = len(self.tree) > 0
        self.tree.make_automaton()

    def found(self, text: str) -> Iterator[int]:
        yield from self.always
        if self.any:
            for _, n in self.tree.iter(text):
                yield n


def _first(automaton: Automaton, texts: list[str]) -> Iterator[tuple]:
    """The least number of each text that has one."""
    for t in texts:
        if (n := min(automaton.found(t), default=None)) is not None:
            yield t, n


def _all(automaton: Automaton, texts: list[str]) -> Iterator[tuple]:
    for t in texts:
        for n in set(automaton.found(t)):
            yield t, n


def _bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 8), F.lit(0))).first()[0]


def _matched(texts: DataFrame, patterns: DataFrame, find: Callable) -> DataFrame:
    """``text, number`` of the distinct ``text`` and of ``pattern, number``, by ``find`` in every part of the patterns."""
    schema = "text STRING, number BIGINT"
    texts = texts.select("text").filter(F.col("text").isNotNull()).distinct()
    patterns = patterns.filter(F.col("pattern").isNotNull()).select("pattern", F.col("number").cast("bigint").alias("number"))
    parts = max(1, -(-_bytes(patterns, "pattern") // PART_BYTES))
    if parts == 1:
        known = patterns.toPandas()  # PART_BYTES at most

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = Automaton(known["pattern"].tolist(), known["number"].tolist())
            for b in batches:
                yield pd.DataFrame(list(find(automaton, b["text"].tolist())), columns=["text", "number"])

        return texts.mapInPandas(own, schema)
    blocks = max(1, -(-_bytes(texts, "text") // BLOCK_BYTES))

    def meet(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(t):
            return pd.DataFrame(columns=["text", "number"])
        return pd.DataFrame(list(find(Automaton(p["pattern"].tolist(), p["number"].tolist()), t["text"].tolist())), columns=["text", "number"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = patterns.select("*", F.pmod(F.xxhash64("pattern"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    right = texts.select("*", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, schema)


def first_contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text, number``: of every distinct ``text`` that contains a pattern, the least ``number`` of ``pattern, number``."""
    return _matched(texts, patterns, _first).groupBy("text").agg(F.min("number").alias("number"))


def contained_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text, pattern``: every distinct ``pattern`` that a distinct ``text`` contains."""
    known = patterns.select("pattern").filter(F.col("pattern").isNotNull()).distinct().select("pattern", F.xxhash64("pattern").alias("number"))
    found = _matched(texts, known, _all)
    # two patterns of one hash are told apart by looking again
    return found.join(known, "number").filter(F.col("text").contains(F.col("pattern"))).select("text", "pattern").distinct()
