import collections
import random
import re

from toposcan.llm.quality_rules import RULES, Rule, judge, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def test_counts_against_brute_force(docs):
    rng = random.Random(9)
    texts = [None, "", " \n\t\x0b", "a", "é" * 9, "one\n\none\n one\none", "a b c d e a b c d e", "x " * 500, "\n".join(["the # of"] * 30), "w w   z"]
    texts += [rng.choice([" ", "\n", "\x0b "]).join(rng.choice("abc#|é") for _ in range(rng.randrange(80))) for _ in range(80)]
    texts += [" ".join(str(i) for i in range(30_000)), "y" * 100_000]
    got = {r.doc_id: r for r in judge(docs(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (*[r[c] for c in COUNTS], r.base_failed) == brute(t), t


def test_verdicts(docs):
    clean = "The house of the old man stood by the river and it was not far from the road that led to the town. " + " ".join(f"word{i} the" for i in range(20))
    cases = {
        1: clean, 2: " ".join(f"w{i}%%%" for i in range(40)), 3: " ".join(f"W{i}!!" for i in range(40)), 4: " ".join(f"cell{i} |" for i in range(60)),
        5: clean, 6: None, 7: "too few words", 8: " ".join(f"zzz{i}" for i in range(60)),
    }
    frame = docs(*cases.items())
    kept = {r.doc_id for r in judge(frame).filter("kept").collect()}
    assert kept == {1, 5}
    out = keep_good(frame)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == {1, 5}
    assert keep_good(frame.limit(0)).count() == 0


def test_rules_are_a_table(docs):
    rules = (*RULES, Rule("few", "n_words", "max", 12))
    row = judge(docs((1, "the of and to in is that for it was with as are")), rules).first()
    assert row.few is False and row.kept is False and row.n_words == 13


def test_native(docs):
    plan = judge(docs((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
