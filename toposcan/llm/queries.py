"""Registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from toposcan.llm import decontaminate, html_blocks, line_dedup, minhash_join, packing, personal_data, prefix_trie, quality_rules, sharding, substring_dedup, token_align, toxicity, warc
from toposcan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# words of DuckDB's SQL that the oracles share
BLANK = "[ \\t\\n\\x0B\\f\\r]"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '')"


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20, with_text=False)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``source`` as their host."""
    found = line_dedup.cleaned(table(spark, sf_dir, "documents"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long")
    digest = F.sha2(F.encode(F.coalesce(F.array_join("__kept", "\n"), F.lit("")), "UTF-8"), 256)
    return found.select("__row.doc_id", size("__lines").alias("n_lines"), (size("__lines") - size("__kept")).alias("n_removed"), digest.alias("kept_sha256"))


def vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), size=2048, end_id=1)


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_join.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_share", "answer_share")})


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in personal_data.KINDS], F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans")
    )


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_align.aligned(table(spark, sf_dir, "documents"), files).withColumnRenamed("id", "doc_id")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4
    rebuilt = prefix_trie.share_heads(prefix_trie.keyed(table(spark, sf_dir, "conversations")), every=20, heads=heads, most=3)
    return prefix_trie.prefix_trie(rebuilt).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


ORACLES["op5_line_dedup"] = f"""
    WITH d AS (SELECT doc_id, source, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')) AS cores,
                      string_split(text, chr(10)) AS lines FROM documents),
    seen AS (SELECT DISTINCT source, text, unnest(cores) AS core FROM d WHERE text IS NOT NULL),
    totals AS (SELECT source, count(DISTINCT text) AS total FROM documents GROUP BY source),
    bad AS (SELECT s.source, list(core) AS cores FROM (SELECT source, core, count(*) AS pages FROM seen WHERE core <> '' GROUP BY source, core) s
            JOIN totals t ON s.source IS NOT DISTINCT FROM t.source WHERE pages >= {line_dedup.MIN_PAGES} AND pages > {line_dedup.RATIO} * total GROUP BY s.source),
    kept AS (SELECT d.doc_id, d.lines, list_filter(d.lines, lambda x, i: NOT coalesce(list_contains(bad.cores, d.cores[i]), false)) AS kept
             FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
    SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM kept"""

ORACLES["op1_substring_dedup"] = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
    spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d),
    windows AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS w FROM spots),
    marked AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY w) OR i > min(i) OVER (PARTITION BY w, doc_id) AS later FROM windows),
    gone AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM marked WHERE later) GROUP BY doc_id)
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
    FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id"""

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLES["op7_minhash_near_dedup"] = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')")} AS words FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE
                    list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS grams FROM d),
    grams AS (SELECT doc_id, unnest(grams) AS g FROM sets WHERE len(grams) > 0),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.grams) + len(y.grams) - n)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS node, a AS label FROM both_ways UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node),
    labels AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
    SELECT doc_id, len(grams)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id, doc_id = coalesce(label, doc_id) AS kept
    FROM sets LEFT JOIN labels ON node = doc_id"""

_STOPS = ", ".join(f"'{w}'" for x in quality_rules.STOP_WORDS for w in {x, x.capitalize()})
_MEASURES = {
    "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "exclamations_per_word": "bangs / n_words",
    "stop_word_share": f"CASE WHEN n_words >= {quality_rules.STOP_WORDS_FROM} THEN stops / n_words END",
    "duplicate_line_share": "n_dup_lines / n_lines", "bullet_line_share": "bullets / n_lines", "ellipsis_line_share": "dots / n_lines",
}
_PASSED = " AND ".join(f"coalesce({_MEASURES[r.measure]} {'>=' if r.kind == 'min' else '<='} {r.bound}, true)" for r in quality_rules.RULES)
ORACLES["op9_quality_rules"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body, {WORDS} AS words,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                 (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, length(body) - length(replace(body, '!', '')) AS bangs,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(words, lambda x: x IN ({_STOPS}))) AS stops, len(list_filter(lines, lambda x: regexp_matches(trim(x, ' '), '^[-*•‣]\\s'))) AS bullets,
                 len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS dots
          FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id),
    judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_PASSED} AS kept FROM judged"""

# CRC-32 of the decimal digits, bit by bit (polynomial 0xEDB88320)
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda d: list_transform(range(8), lambda k: (ascii(d)::BIGINT >> k) & 1)))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))"""
ORACLES["op13_prefix_trie"] = f"""
    WITH said AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn,
                         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT conv_id AS c, xor({_CRC}, 4294967295) % 4 AS heads FROM (SELECT DISTINCT conv_id FROM said)),
    rebuilt AS (SELECT c, 0 AS part, pos, turn FROM ids JOIN said ON conv_id = c - c % 20 AND pos <= heads
                UNION ALL SELECT c, 1, pos, turn FROM ids JOIN said ON conv_id = c AND pos > heads),
    convs AS (SELECT ids.c, coalesce(list(turn ORDER BY part, pos) FILTER (turn IS NOT NULL), []) AS turns FROM ids LEFT JOIN rebuilt ON rebuilt.c = ids.c GROUP BY ids.c),
    prefixes AS (SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM convs)),
    nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ended FROM prefixes GROUP BY d, path),
    families AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
    valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children,
                      CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(nodes.path[-1].text, '{BLANK}+'), lambda x: x <> '')) END AS own
               FROM nodes LEFT JOIN families ON families.d = nodes.d AND families.path = nodes.path),
    above AS (SELECT e AS d, path[1:e] AS path, sum((n_children = 0)::INT) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM valued) GROUP BY ALL)
    SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
           sha256(coalesce(v.ended, '')) AS ends_sha256
    FROM valued v JOIN above a ON a.d = v.d AND a.path = v.path LEFT JOIN nodes p ON p.d = v.d - 1 AND p.path = v.path[1:v.d - 1]"""
