"""Quality rules as one projection: a table of thresholds over length, symbol, stop-word and line ratios.

Everything is a built-in expression. A text becomes an array of words once; the measures are computed from it, and the rows of
the table (measure, bound kind, bound) become one boolean each. A rule holds where its measure is undefined (nothing to
divide by). A null text counts as empty: no words, so it fails the base rule. Repeated rows are judged alike; other columns are
kept as they are by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.llm.common import SEPARATORS, WORD_GAP

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was with as are on be this by from at or an not have which but they you all we can had has there been "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de du des et en un une que est pour dans qui par sur pas plus au avec il ce sont ne se son ou "
    "el los las y que en un una por con para del se no su al lo como más es sus le o pero"
).split()
SYMBOLS = r"[#*$%&|<>]"


class Rule(NamedTuple):
    name: str
    measure: str
    kind: str  # "min" or "max", both inclusive
    bound: float


#: Measures are named in ``measures``; a document is kept if it passes the base rule and all of these.
RULES = (
    Rule("word_length_low", "mean_word_chars", "min", 2.0),
    Rule("word_length_high", "mean_word_chars", "max", 20.0),
    Rule("symbol_ratio", "symbols_per_word", "max", 0.3),
    Rule("exclamation_ratio", "exclamations_per_word", "max", 0.3),
    Rule("stop_word_ratio", "stop_word_share", "min", 0.02),
    Rule("duplicate_line_ratio", "duplicate_line_share", "max", 0.5),
    Rule("bullet_line_ratio", "bullet_line_share", "max", 0.9),
    Rule("ellipsis_line_ratio", "ellipsis_line_share", "max", 0.3),
)
MIN_WORDS = 10
#: Shorter texts may lack stop words by chance, so the share is undefined for them.
STOP_WORDS_FROM = 30
WINDOW = 5
REPEAT_PERCENT = 20


def _repeated(words: str, n: int, df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside a window of ``n`` words that occurs more than once in the text."""
    window = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + F.lit(k)) for k in range(1, n)]),
    )
    df = df.withColumn("__h", window)
    df = df.withColumn("__again", F.size(F.array_distinct("__h")) < F.size("__h"))
    # only texts with a repeat are sorted: equal windows become neighbours
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.col("__again"), pairs))
    twice = F.filter("__p", lambda p, k: (p["h"] == F.get(F.col("__p"), k - 1)["h"]).eqNullSafe(F.lit(True)) | (p["h"] == F.get(F.col("__p"), k + 1)["h"]).eqNullSafe(F.lit(True)))
    df = df.withColumn("__s", F.when(F.col("__again"), F.sort_array(F.transform(twice, lambda p: p["i"]))))
    covered = F.aggregate(
        F.transform("__s", lambda s, k: F.least(F.lit(n), F.coalesce(F.get(F.col("__s"), k + 1) - s, F.lit(n)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(F.col("__again"), covered).otherwise(0).cast("long")).drop("__h", "__again", "__p", "__s")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that the rules test."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    core = F.btrim(body, F.lit(SEPARATORS))
    df = df.withColumn("__body", body)
    df = df.withColumns({
        "__words": F.when(F.length(core) > 0, F.split(core, WORD_GAP)).otherwise(F.array().cast("array<string>")),
        "__lines": F.filter(F.split("__body", "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0),
        "n_symbols": (F.length("__body") - F.length(F.regexp_replace("__body", SYMBOLS, ""))).cast("long"),
        "__bangs": F.length("__body") - F.length(F.replace(F.col("__body"), F.lit("!"), F.lit(""))),
    })
    df = _repeated("__words", WINDOW, df)
    known = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_lines": F.size("__lines"),
        "__stops": F.size(F.filter("__words", lambda w: w.isin(known))),
        "__bullets": F.size(F.filter("__lines", lambda x: F.btrim(x).rlike("^[-*•‣]\\s"))),
        "__dots": F.size(F.filter("__lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))),
    })

    def share(part: str, whole: str) -> Column:
        return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))

    return df.withColumns({
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "exclamations_per_word": share("__bangs", "n_words"),
        "stop_word_share": F.when(F.col("n_words") >= STOP_WORDS_FROM, share("__stops", "n_words")),
        "duplicate_line_share": share("n_dup_lines", "__n_lines"),
        "bullet_line_share": share("__bullets", "__n_lines"),
        "ellipsis_line_share": share("__dots", "__n_lines"),
    }).drop("__body", "__words", "__lines", "__bangs", "__n_lines", "__stops", "__bullets", "__dots")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """A boolean column per rule: true where the document passes."""
    out = {}
    for rule in rules:
        if rule.kind not in ("min", "max"):
            raise ValueError(f"rule {rule.name}: kind {rule.kind}")
        value = F.col(rule.measure)
        out[rule.name] = F.coalesce(value >= rule.bound if rule.kind == "min" else value <= rule.bound, F.lit(True))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the counts and ratios, one boolean per rule, ``base_failed`` and ``kept``."""
    df = measures(docs.select(F.col(key), F.col(text).alias("__text")), "__text").drop("__text")
    tests = compiled(rules)
    df = df.withColumns({**tests, "base_failed": base_failed()})
    passed = ~F.col("base_failed")
    for name in tests:
        passed = passed & F.col(name)
    return df.withColumn("kept", passed)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass, with their columns unchanged."""
    df = measures(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), "__text")
    passed = ~base_failed()
    for test in compiled(rules).values():
        passed = passed & test
    # The row number keeps the filter above the measures. Pushed below them it would repeat each measure inside the
    # next one, down to the text.
    df = df.select("__row", passed.alias("__passed"), F.monotonically_increasing_id().alias("__number"))
    return df.filter(F.col("__passed") & (F.col("__number") >= 0)).select("__row.*")
