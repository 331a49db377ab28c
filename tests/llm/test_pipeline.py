"""The pipeline against a brute-force version of each stage, on a small corpus with planted cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from toposcan.llm import quality_rules
from toposcan.llm.queries import vocabulary

from .test_line_dedup import brute as brute_lines
from .test_minhash_join import brute as brute_groups
from .test_quality_rules import brute as brute_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    n, chars, symbols, again, _, failed = brute_counts(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    words = WORD.findall(text)
    stops = set(quality_rules.STOP_WORDS) | {w.capitalize() for w in quality_rules.STOP_WORDS}
    share = {
        "mean_word_chars": chars / n, "symbols_per_word": symbols / n, "exclamations_per_word": text.count("!") / n,
        "stop_word_share": sum(w in stops for w in words) / n if n >= 30 else None, "duplicate_line_share": again / len(lines),
        "bullet_line_share": sum(bool(re.match(r"[-*•‣]\s", x.strip(" "))) for x in lines) / len(lines), "ellipsis_line_share": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) / len(lines),
    } if n else {}
    return not failed and all(share.get(r.measure) is None or (share[r.measure] >= r.bound if r.kind == "min" else share[r.measure] <= r.bound) for r in quality_rules.RULES)


def corpus():
    rng = random.Random(11)
    vocabulary_ = [f"word{i}" for i in range(900)] + ["the", "of", "and", "to", "in"] * 60
    items = [(i, " ".join(rng.choices(vocabulary_, k=30)) + ". " + " ".join(rng.choices(vocabulary_, k=6)) + ".") for i in range(6)]
    rows = []
    for d in range(160):
        body = "\n".join(" ".join(rng.choices(vocabulary_, k=rng.randrange(8, 30))) + "." for _ in range(rng.randrange(1, 8)))
        kind = d % 8
        if kind == 0:
            body += "\nSite footer of all pages"
        elif kind == 1 and rows:
            body = (rows[rng.randrange(len(rows))][1] or "") + rng.choice(["", " end"])
        elif kind == 2:
            body += " " + items[d % 6][1]
        elif kind == 3:
            body = " ".join(f"{w}%%%" for w in body.split())
        elif kind == 4 and d % 3 == 0:
            body = rng.choice(["", None, "few words", "same five words again now " * 9])
        rows.append((d, body, rng.choice(["hot", "hot", "cold"])))
    return rows, items


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    table = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if r[1] is not None and good(r[1])]
    source = {d: s for d, _, s in rows}
    kept = [(d, t, source[d]) for d, t in brute_lines(kept, 0.1, 5)]
    first = {d for d, _, c in brute_groups(kept, 5) if d == c}
    kept = [r for r in kept if r[0] in first]
    clean = [r for r in kept if not any(" ".join(WORD.findall(t)) in " ".join(WORD.findall(r[1])) for _, t in items)]
    assert 20 < len(clean) < len(kept) < len(rows)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()[0])
    want = Counter()
    for d, t, _ in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == want
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))


def test_stages_keep_the_columns(spark, docs):
    rows = [(1, None), (2, ""), (3, "the of and to in " * 3), (None, "x")]
    frame = docs(*rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, frame, "")
        assert out.dtypes == frame.dtypes, name
        assert stage(spark, frame.limit(0), "").count() == 0
