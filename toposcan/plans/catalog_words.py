"""Text mining, dictionaries, set operations, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.operators import aggregates as agg, dictionary as dic, sampling, spatial, textmine
from toposcan.plans.catalog_metrics import FEATURES, INT_COLS, feature_sql
from toposcan.plans.catalog_names import contains_sql
from toposcan.plans.catalog_space import AROUND
from toposcan.functions import text
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.sqltext import merc_x, merc_y
from toposcan.plans.views import d

WORDS = r"SELECT ord, md5(name) AS nk, unnest(list_filter(regexp_split_to_array(lower(name), '\s+'), lambda x: x <> '')) AS word FROM {v_name}"
STEMS = f"""
    SELECT nk, unnest(CASE WHEN length(word) > 3 AND regexp_matches(word, '[saoe]$') THEN [word, left(word, length(word) - 1)] ELSE [word] END) AS pattern
    FROM ({WORDS}) WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+')"""
STOP = " OR ".join(f"starts_with(pattern, '{p}')" for p in textmine.STOP_PREFIXES)


@query("txt1_root_candidates", f"""
    WITH c AS (SELECT pattern, count(*) AS n_occurrences, count(DISTINCT nk) AS n_names FROM ({STEMS}) GROUP BY pattern HAVING count(*) >= 2),
    k AS (SELECT DISTINCT left(lower(word), 5) AS pattern FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM {{benchmark}})),
    s AS (SELECT c.*, CASE WHEN k.pattern IS NOT NULL THEN 'known' WHEN length(c.pattern) >= 3 AND NOT ({STOP.replace("pattern", "c.pattern")}) THEN 'unknown' END AS status
          FROM c LEFT JOIN k ON c.pattern = k.pattern)
    SELECT pattern, status, CAST(n_occurrences AS BIGINT) AS n_occurrences, n_names FROM s WHERE status IS NOT NULL""")
def _(v):
    roots = v("benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select(F.left("w", F.lit(5)).alias("root")).distinct()
    return textmine.root_candidates(v("v_name"), roots)


@query("txt2_common_word", f"SELECT word, count(*) AS n FROM ({WORDS}) GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 1")
def _(v):
    return textmine.common_word(v("v_name"))


@query("txt3_shared_affixes", r"""
    WITH n AS (SELECT lower(name) AS low, list_filter(regexp_split_to_array(lower(name), '\s+'), lambda x: x <> '') AS ws FROM {v_name}),
    f AS (SELECT DISTINCT ws[1] AS a FROM n WHERE len(ws) > 0), l AS (SELECT DISTINCT ws[-1] AS a FROM n WHERE len(ws) > 0)
    SELECT 'prefix' AS kind, a AS affix, count(*) AS n FROM f JOIN n ON starts_with(low, a) GROUP BY a HAVING count(*) >= 2
    UNION ALL SELECT 'suffix', a, count(*) FROM l JOIN n ON ends_with(low, a) GROUP BY a HAVING count(*) >= 2""")
def _(v):
    return textmine.shared_affixes(v("v_name"))


PATTERNS = "SELECT DISTINCT word AS pattern FROM (SELECT unnest(string_split(lower(name) || ' ' || left(brand, 3), ' ')) AS word FROM {v_word})"


@query("txt4_compare_roots", f"""
    WITH p AS ({PATTERNS}), r AS (SELECT DISTINCT left(root, 3) AS root FROM {{v_root}} UNION SELECT DISTINCT root FROM {{v_root}}),
    m AS (SELECT pattern, count(*) AS n_roots, bool_or(pattern = root) AS e FROM p JOIN r ON contains(pattern, root) OR contains(root, pattern) GROUP BY pattern)
    SELECT p.pattern, CASE WHEN e THEN 'exact' WHEN n_roots > 0 THEN 'partial' ELSE 'none' END AS relation, coalesce(n_roots, 0) AS n_roots
    FROM p LEFT JOIN m ON p.pattern = m.pattern""")
def _(v):
    words = F.split(F.concat(F.lower("name"), F.lit(" "), F.left("brand", F.lit(3))), " ")
    r = v("v_root").select(F.explode(F.array("root", F.left("root", F.lit(3)))).alias("root"))
    return textmine.compare_roots(v("v_word").select(F.explode(words).alias("pattern")), r)


@query("txt7_cluster_first_word", """
    WITH c AS (SELECT source AS cluster, regexp_extract(lower(trim(name)), '^[^\\s]+') AS w, count(*) AS n FROM {v_name} GROUP BY 1, 2)
    SELECT cluster, w AS first_word, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, w) AS rn FROM c WHERE w <> '') WHERE rn = 1""")
def _(v):
    return textmine.cluster_first_word(v("v_name").withColumnRenamed("source", "cluster"))


# ---- dictionaries --------------------------------------------------------------------------------

IDS = """
    SELECT *, dense_rank() OVER (ORDER BY cf) AS cid, dense_rank() OVER (ORDER BY vf) AS vid FROM (
      SELECT *, min(ord) OVER (PARTITION BY canonical_name) AS cf, min(ord) OVER (PARTITION BY variant_name) AS vf FROM {})"""


@query("win10_assign_ids", f"SELECT ord, CAST(cid AS VARCHAR) AS canonical_id, CAST(vid AS VARCHAR) AS variant_id FROM ({IDS.format('{v_dict}')})")
def _(v):
    return dic.assign_ids(v("v_dict")).select("ord", "canonical_id", "variant_id")


@query("win11_dedupe_last", "SELECT root, max(ord) AS ord FROM {v_root} GROUP BY root")
def _(v):
    return dic.dedupe(v("v_root"), ["root"], "last").select("root", "ord")


@query("win11_dedupe_first", "SELECT arg_min(cand_id, cand_id) AS cand_id FROM {v_cand} GROUP BY name, round_even(lat / 3 + 0.00013e0, 1), round_even(lon / 3 + 0.00013e0, 1)")
def _(v):
    """Toponyms of the same name at the same rounded place; the first stays."""
    c = v("v_cand").withColumns({"_a": F.bround(F.col("lat") / 3 + 0.00013, 1), "_o": F.bround(F.col("lon") / 3 + 0.00013, 1)})
    return dic.dedupe(c, ["name", "_a", "_o"], "first", "cand_id").select("cand_id")


@query("win12_representative_name", f"""
    SELECT 'Site_' || CAST(site_id AS VARCHAR) AS site_name, arg_min(name, km) AS representative
    FROM ({AROUND}) JOIN {{v_feature}} USING (feature_id) WHERE km <= 20 GROUP BY site_id""")
def _(v):
    near = spatial.nearest_toponym(v("v_site").select("site_name", "lon", "lat"),
                                   v("v_feature").select("feature_id", F.col("name").alias("toponym_name"), "lon", "lat"), 20.0, "feature_id")
    return dic.representative_name(near)


OLD, NEW = "(SELECT * FROM {v_dict} WHERE root <> 'user')", "(SELECT * FROM {v_dict} WHERE root = 'user')"


@query("set2_upsert_dictionary", f"""
    WITH a AS (SELECT * FROM {OLD} UNION ALL SELECT * REPLACE (ord + (SELECT max(ord) + 1 FROM {OLD}) AS ord) FROM {NEW})
    SELECT variant_name, CAST(cid AS VARCHAR) AS canonical_id, CAST(vid AS VARCHAR) AS variant_id, root FROM (
      SELECT *, row_number() OVER (PARTITION BY variant_name ORDER BY ord DESC) AS rn FROM ({IDS.format('a')})) WHERE rn = 1""")
def _(v):
    e = v("v_dict")
    return dic.upsert_dictionary(e.filter("root <> 'user'"), e.filter("root = 'user'")).select("variant_name", "canonical_id", "variant_id", "root")


R_OLD, R_NEW = "(SELECT * FROM {v_root} WHERE lang <> 'tup')", "(SELECT * FROM {v_root} WHERE lang = 'tup')"


@query("set3_upsert_roots", f"""
    WITH a AS (SELECT * FROM {R_OLD} UNION ALL SELECT * REPLACE (ord + (SELECT max(ord) + 1 FROM {R_OLD}) AS ord) FROM {R_NEW})
    SELECT root, category, lang, regex_token FROM (SELECT *, row_number() OVER (PARTITION BY root, category ORDER BY ord DESC) AS rn FROM a) WHERE rn = 1""")
def _(v):
    r = v("v_root")
    return dic.upsert_roots(r.filter("lang <> 'tup'"), r.filter("lang = 'tup'"), "all").select("root", "category", "lang", "regex_token")


@query("set4_merge_roots", """
    WITH a AS (SELECT root, CASE WHEN lang = 'tup' THEN 'water' ELSE 'terrain' END AS category, lang, ord,
                      row_number() OVER (PARTITION BY root, lang = 'tup' ORDER BY ord) AS rn FROM {v_root})
    SELECT root, category, lang FROM a WHERE rn = 1""")
def _(v):
    r = v("v_root").drop("category")
    return dic.merge_roots({"water": r.filter("lang = 'tup'"), "terrain": r.filter("lang <> 'tup'")}).select("root", "category", "lang")


PROPOSED = "SELECT ord, concat(CASE WHEN ord % 2 = 0 THEN upper(root) ELSE 'new' || CAST(ord AS VARCHAR) END) AS root, lang, meaning_en, meaning_ja, CASE WHEN ord % 5 = 0 THEN NULL ELSE '0.7' END AS confidence FROM {v_root}"


def proposed(v):
    o = F.col("ord")
    return v("v_root").select(
        "ord", F.when(o % 2 == 0, F.upper("root")).otherwise(F.concat(F.lit("new"), o.cast("string"))).alias("root"), "lang", "meaning_en",
        "meaning_ja", F.when(o % 5 != 0, "0.7").alias("confidence"))


@query("set5_merge_proposals", f"""
    SELECT root, regex_token, {d("1")} AS weight FROM {{v_root}} UNION ALL
    SELECT root, root, coalesce(TRY_CAST(confidence AS DOUBLE), 0.5e0) FROM ({PROPOSED}) WHERE lower(root) NOT IN (SELECT lower(root) FROM {{v_root}})
      AND ({contains_sql('meaning_ja', text.WATER_MEANING_JA)} OR {contains_sql('lower(meaning_en)', text.WATER_MEANING_EN)})""")
def _(v):
    return dic.merge_proposals(v("v_root").withColumn("weight", F.lit(1.0)), proposed(v)).select("root", "regex_token", "weight")


@query("jn13_new_roots_only", f"SELECT root FROM ({PROPOSED}) WHERE lower(root) NOT IN (SELECT lower(root) FROM {{v_root}})")
def _(v):
    return dic.new_roots_only(proposed(v), v("v_root")).select("root")


@query("set6_add_new_names", "SELECT DISTINCT name FROM {v_word} WHERE brand = 'Brand#1' UNION SELECT DISTINCT name FROM {v_word}")
def _(v):
    w = v("v_word")
    return dic.add_new_names(w.filter("brand = 'Brand#1'").select("name").distinct(), w)


@query("set7_distinct_names", "SELECT DISTINCT name FROM {v_name}")
def _(v):
    return dic.distinct_names(v("v_name"))


@query("jn10_lookup_candidates", """
    WITH f AS (SELECT variant_name, arg_min(canonical_name, ord) AS canonical_name, min(ord) AS first_ord FROM {v_dict} GROUP BY variant_name)
    SELECT conv_id, turn, canonical_name, first_ord FROM {conversations} c JOIN f ON c.text = f.variant_name""")
def _(v):
    similar = v("conversations").select("conv_id", "turn", F.col("text").alias("variant_name"))
    e = v("v_dict").withColumn("first_ord", F.col("ord"))
    return dic.lookup_candidates(similar, e).select("conv_id", "turn", "canonical_name", "first_ord")


TAGS = "SELECT p_name AS variant_name, count(*) AS n_parts FROM {part} GROUP BY p_name"


@query("jn11_attach_tags", f"SELECT ord, n_parts FROM {{v_word}} w LEFT JOIN ({TAGS}) t ON w.name = t.variant_name")
def _(v):
    tags = v("part").groupBy(F.col("p_name").alias("variant_name")).agg(F.count(F.lit(1)).alias("n_parts"))
    return dic.attach_tags(v("v_word"), tags).select("ord", "n_parts")


@query("jn12_rank_with_location", f"""
    SELECT s.site_name, c.n, {q6("c.center_lat")} AS center_lat FROM (SELECT 'Site_' || CAST(s_suppkey AS VARCHAR) AS site_name FROM {{supplier}}) s
    LEFT JOIN (SELECT site_name, count(*) AS n, avg(site_lat) AS center_lat FROM {{v_site_toponym}} GROUP BY 1) c USING (site_name)""")
def _(v):
    ranking = v("supplier").select(F.concat(F.lit("Site_"), F.col("s_suppkey").cast("string")).alias("site_name"))
    centers = agg.site_centers(v("v_site_toponym"))
    return rounded(dic.rank_with_location(ranking, centers), "center_lat").select("site_name", F.col("n_toponyms").alias("n"), "center_lat")


NUMERIC = {k: e for k, e in FEATURES.items()}


@query("jn17_top_feature_diffs", f"""
    WITH f AS ({feature_sql(NUMERIC)}),
    l AS (SELECT site_name, feature, value FROM (UNPIVOT (SELECT site_name, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)} FROM f)
          ON {", ".join(NUMERIC)} INTO NAME feature VALUE value)),
    m AS (SELECT feature, avg(value) AS known_mean FROM l GROUP BY feature),
    x AS (SELECT site_name, feature, {q6("value - known_mean", 4)} AS difference, row_number() OVER (PARTITION BY site_name ORDER BY round(abs(value - known_mean), 9) DESC, feature) AS rank
          FROM l JOIN m USING (feature))
    SELECT site_name, feature, difference FROM x WHERE rank <= 10""")
def _(v):
    f = agg.engineer_features(v("v_site_toponym"))
    f = f.select("site_name", *[F.col(c) if c in INT_COLS else r6(c).alias(c) for c in NUMERIC])
    return dic.top_feature_diffs(f, f, 10).select("site_name", "feature", r6("difference", 4).alias("difference"))


@query("top2_examples", """
    SELECT lang, array_to_string(list(left(md5(name), 8) ORDER BY ord)[1:5], ',') AS examples FROM {v_name} GROUP BY lang""")
def _(v):
    n = v("v_name").withColumn("name", F.left(F.md5("name"), F.lit(8)))
    return dic.examples(n, "lang").select("lang", F.array_join("examples", ",").alias("examples"))


# ---- sampling ------------------------------------------------------------------------------------

def unit(seed, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / {d(str(16**13))})"


SPLIT = f"""
    SELECT site_id, discovery_year, CASE WHEN r <= floor(n * 0.6e0) THEN 'train' WHEN r <= floor(n * 0.6e0) + floor(n * 0.2e0) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {unit(42, 'site_id')}, site_id) AS r, count(*) OVER () AS n FROM {{v_site}})"""


@query("smp1_ratio_split", f"SELECT site_id, split FROM ({SPLIT}) WHERE split <> 'test' OR discovery_year >= 2000")
def _(v):
    return sampling.ratio_split(v("v_site"), {"train": 0.6, "val": 0.2, "test": 0.2}, years={"test": (2000, None)}).select("site_id", "split")


def strat(where: str = "") -> str:
    """30 % for validation, rounded up over all rows; train parts rounded down, what is missing goes to the largest remainders."""
    return f"""
    SELECT site_id, culture_tag, discovery_year, CASE WHEN r <= c - t THEN 'val' ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY culture_tag ORDER BY {unit(42, 'site_id')}, site_id) AS r FROM {{v_site}} {where}) JOIN (
      SELECT culture_tag, c, f + CASE WHEN row_number() OVER (ORDER BY share - f DESC, culture_tag) <= train - sum(f) OVER () THEN 1 ELSE 0 END AS t FROM (
        SELECT *, floor(share) AS f FROM (SELECT *, n - ceil(n * 0.3e0) AS train, c * ((n - ceil(n * 0.3e0)) / n) AS share FROM (
          SELECT culture_tag, count(*) AS c, sum(count(*)) OVER () AS n FROM {{v_site}} {where} GROUP BY culture_tag HAVING count(*) > 1)))) USING (culture_tag)"""


STRAT, STRAT_EARLY = strat(), strat("WHERE discovery_year < 2012")


@query("smp2_stratified_split", f"SELECT site_id, split FROM ({STRAT})")
def _(v):
    return sampling.stratified_split(v("v_site"), 0.3).select("site_id", "split")


@query("smp3_time_split", f"""
    SELECT site_id, split FROM ({STRAT_EARLY}) UNION ALL SELECT site_id, 'test_time' FROM {{v_site}} WHERE discovery_year >= 2012""")
def _(v):
    return sampling.time_split(v("v_site"), 2012, 0.3).select("site_id", "split")


@query("smp4_region_split", """
    SELECT site_id, culture_tag AS region FROM {v_site} WHERE culture_tag = 'acre' OR (culture_tag = 'marajo' AND site_name IN ('Site_1', 'Site_4', 'Site_40'))""")
def _(v):
    return sampling.region_split(v("v_site"), {"acre": None, "marajo": ["Site_1", "Site_4", "Site_40"]}).select("site_id", "region")


NEG_BOX = (-74.0, -15.0, -60.0, -5.0)
NEGATIVE = f"""
    WITH a AS (SELECT i AS attempt, -74 + 14 * {unit('42x', 'i')} AS lon, -15 + 10 * {unit('42y', 'i')} AS lat
               FROM range((SELECT greatest(10000, 3 * 2 * count(*)) FROM {{customer}})) t(i)),
    p AS (SELECT {merc_x('lon')} AS sx, {merc_y('lat')} AS sy FROM {{v_site}}),
    f AS (SELECT attempt, lon, lat, min(sqrt(pow({merc_x('lon')} - sx, 2) + pow({merc_y('lat')} - sy, 2))) AS m FROM a, p GROUP BY ALL HAVING m >= 5000),
    n AS (SELECT *, row_number() OVER (ORDER BY attempt) AS r FROM f)
    SELECT 'negative_' || lpad(CAST(r - 1 AS VARCHAR), CAST(greatest(4, length(CAST(r - 1 AS VARCHAR))) AS INT), '0') AS site_name, {q6("lon")} AS lon, {q6("lat")} AS lat,
           {q6("m / 1000")} AS min_distance_to_positive_km FROM n WHERE r <= 2 * (SELECT count(*) FROM {{customer}})"""


@query("smp5_negative_samples", NEGATIVE)
def _(v):
    return rounded(sampling.negative_samples(v("v_site"), NEG_BOX, 2.0, 5.0), "lon", "lat", "min_distance_to_positive_km").select(
        "site_name", "lon", "lat", "min_distance_to_positive_km")


@query("smp6_sample_n", f"SELECT cand_id FROM {{v_cand}} ORDER BY {unit(7, 'cand_id')}, cand_id LIMIT 200")
def _(v):
    return sampling.sample_n(v("v_cand"), 200, seed=7).select("cand_id")


@query("set1_merge_labeled", """
    SELECT site_name, lat, lon, culture_tag, discovery_year, true AS is_positive FROM {v_site} UNION ALL
    SELECT 'f' || CAST(feature_id AS VARCHAR), lat, lon, NULL, NULL, false FROM {v_feature}""")
def _(v):
    neg = v("v_feature").select(F.concat(F.lit("f"), F.col("feature_id").cast("string")).alias("site_name"), "lat", "lon")
    return sampling.merge_labeled(v("v_site"), neg)
