"""Word statistics over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.functions import text
from toposcan.operators import multipattern
from toposcan.session import cut

# Beginnings of words that are no root candidates.
STOP_PREFIXES = ["de", "da", "do", "das", "dos", "rua", "avenida", "travessa", "estrada"]


def _n() -> Column:
    return F.count(F.lit(1))


def _counts_as_word(w: Column) -> Column:
    """At least three characters, not only digits."""
    return (F.length(w) >= 3) & (F.translate(w, "0123456789", "") != "")


def _has_stem(w: Column) -> Column:
    return (F.length(w) > 3) & F.right(w, F.lit(1)).isin("s", "a", "o", "e")


def _stem(w: Column) -> Column:
    return F.left(w, F.length(w) - 1)


def stem_names(df: DataFrame, name: str = "name") -> DataFrame:
    """``pattern, name_key, n``: words of at least three characters and their stems, per distinct name.

    Names are carried as a 128-bit key, so long texts are not copied once per word.
    """
    w = F.col("word")
    stem = F.when(_has_stem(w), _stem(w))
    # the key is made before the explode; beside it, it would be computed again for every word
    texts = df.select(F.unhex(F.md5(name)).alias("name_key"), F.split(F.lower(name), r"\s+").alias("ws"))
    words = texts.select("name_key", F.explode("ws").alias("word")).filter(_counts_as_word(w))
    stems = words.select("name_key", F.explode(F.array_compact(F.array(w, stem))).alias("pattern"))
    return stems.groupBy("pattern", "name_key").agg(_n().alias("n"))


def pattern_counts(df: DataFrame, name: str = "name") -> DataFrame:
    """``pattern, n_occurrences, n_names`` of the rows of :func:`stem_names`, without making them.

    Copies of a name become one row with their number. Its words are counted as they stand (stems are made of the vocabulary
    afterwards), its distinct patterns once each; both counts are summed up before the shuffle.
    """
    names = df.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).groupBy("name").agg(_n().alias("m"))
    names = names.select("m", F.split(F.lower("name"), r"\s+").alias("ws"))
    names = names.withColumn("ds", F.filter(F.array_distinct("ws"), _counts_as_word))
    names = names.withColumn("ps", F.array_distinct(F.concat("ds", F.transform(F.filter("ds", _has_stem), _stem))))
    lists = F.inline(F.array(*[F.struct(F.lit(once).alias("once"), F.col(c).alias("xs")) for once, c in ((False, "ws"), (True, "ps"))]))
    listed = names.select("m", lists).select("once", F.when(F.col("once"), F.lit(1)).otherwise(F.col("m")).alias("m"), F.explode("xs").alias("pattern"))
    counts = cut(listed.groupBy("once", "pattern").agg(F.sum("m").alias("n")))
    w = F.col("pattern")
    words = counts.filter(~F.col("once") & _counts_as_word(w))
    stems = words.select(F.explode(F.array_compact(F.array(w, F.when(_has_stem(w), _stem(w))))).alias("pattern"), "n")
    occurrences = stems.groupBy("pattern").agg(F.sum("n").alias("n_occurrences"))
    return occurrences.join(counts.filter("once").select("pattern", F.col("n").alias("n_names")), "pattern")


def root_candidates(df: DataFrame, roots: DataFrame, name: str = "name") -> DataFrame:
    """Patterns seen at least twice: ``pattern, status, n_occurrences, n_names``.

    ``known`` patterns are in the dictionary; ``unknown`` ones have three characters or more and no stop
    prefix. The names behind a pattern are the rows of :func:`stem_names`.
    """
    counts = pattern_counts(df, name)
    known = roots.select(F.lower("root").alias("pattern")).dropna().distinct().withColumn("_known", F.lit(True))
    d = counts.filter(F.col("n_occurrences") >= 2).join(known, "pattern", "left")
    stop = text.any_of([F.startswith(F.col("pattern"), F.lit(p)) for p in STOP_PREFIXES])
    d = d.withColumn("status", F.when(F.col("_known"), "known").when((F.length("pattern") >= 3) & ~stop, "unknown"))
    return d.filter(F.col("status").isNotNull()).select("pattern", "status", "n_occurrences", "n_names")


def word_counts(df: DataFrame, name: str = "name") -> DataFrame:
    words = df.select(F.explode(F.split(F.lower(name), r"\s+")).alias("word"))
    return words.filter(F.col("word") != "").groupBy("word").agg(_n().alias("n"))


def common_word(df: DataFrame, name: str = "name") -> DataFrame:
    """The most frequent word, if it occurs twice."""
    return word_counts(df, name).filter(F.col("n") >= 2).orderBy(F.desc("n"), "word").limit(1)


def shared_affixes(df: DataFrame, name: str = "name") -> DataFrame:
    """First words that begin, and last words that end, at least two names: ``kind, affix, n``.

    A name begins with a first word exactly when that word is a prefix of its own first word, so the
    prefixes of distinct first words are matched by equality.
    """
    # only the ends of a name are looked at: the first word, and the first one of the name read backwards
    first = lambda c: F.regexp_extract(c, r"^\s*(\S+)", 1)
    back = F.reverse(F.col(name))
    ends = df.select(F.lower(first(F.col(name))).alias("first"), F.left(F.col(name), F.lit(1)).rlike(r"\s").alias("first_blank"),
                     F.lower(F.reverse(first(back))).alias("last"), F.left(back, F.lit(1)).rlike(r"\s").alias("last_blank"))
    base = cut(ends.filter(F.col("first") != "").groupBy(*ends.columns).agg(_n().alias("c")))
    parts = []
    for kind, word in (("prefix", "first"), ("suffix", "last")):
        # a name with white space at that end begins (ends) with no word
        words = base.groupBy(F.col(word).alias("w")).agg(F.sum(F.when(F.col(f"{word}_blank"), 0).otherwise(F.col("c"))).alias("m"))
        piece = (lambda i: F.left(F.col("w"), i)) if kind == "prefix" else (lambda i: F.right(F.col("w"), i))
        pieces = words.select("m", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), piece)).alias("affix"))
        counts = pieces.groupBy("affix").agg(F.sum("m").alias("n")).filter(F.col("n") >= 2)
        hits = counts.join(words.select(F.col("w").alias("affix")), "affix", "left_semi")
        parts.append(hits.select(F.lit(kind).alias("kind"), "affix", "n"))
    return parts[0].unionByName(parts[1])


def root_matches(patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``pattern, root`` where one contains the other, by automata over either side."""
    p = patterns.select("pattern").filter(F.length("pattern") > 0).distinct()
    r = roots.select("root").filter(F.length("root") > 0).distinct()
    inside = multipattern.contained_pairs(p.select(F.col("pattern").alias("text")), r.select(F.col("root").alias("pattern")))
    around = multipattern.contained_pairs(r.select(F.col("root").alias("text")), p)
    return inside.select(F.col("text").alias("pattern"), F.col("pattern").alias("root")).unionByName(
        around.select("pattern", F.col("text").alias("root"))).distinct()


def compare_roots(patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """Relation of each pattern to the dictionary: ``exact``, ``partial`` (with the number of roots) or ``none``."""
    m = root_matches(patterns, roots).groupBy("pattern").agg(
        F.max(F.col("pattern") == F.col("root")).alias("_exact"), _n().alias("n_roots"))
    d = patterns.select("pattern").distinct().join(m, "pattern", "left")
    return d.select("pattern", F.when(F.col("_exact"), "exact").when(F.col("n_roots") > 0, "partial").otherwise("none").alias("relation"),
                    F.coalesce("n_roots", F.lit(0)).alias("n_roots"))


def cluster_first_word(df: DataFrame, cluster: str = "cluster", name: str = "name") -> DataFrame:
    """Most frequent first word per cluster."""
    word = text.first_word(F.col(name))
    c = df.select(cluster, word.alias("word")).filter(F.col("word") != "").groupBy(cluster, "word").agg(_n().alias("n"))
    return c.groupBy(cluster).agg(F.min_by(F.struct("word", "n"), F.struct((-F.col("n")).alias("m"), "word")).alias("b")).select(
        cluster, F.col("b.word").alias("first_word"), F.col("b.n").alias("n"))
