"""Sources, sinks, names, scores and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.functions import geo, text
from toposcan.operators import candidates as cand, validate
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.views import d
from toposcan.session import scratch
from toposcan.sources import placemarks, readers, sinks

NORM = ("trim(regexp_replace(regexp_replace(replace(strip_accents(lower({})), 'ß', 'ss'), "
        "'[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))")
WEIGHTS = {"rio": 0.9, "igarape": 0.8, "lagoa": 0.7, "porto": 0.3, "parana": 0.6}
BOX = (-72.0, -13.0, -64.0, -7.0)
PATTERNS = {
    "water": text.vocabulary_pattern(["rio", "igarap[eé]", "lag[oô]a", "paran[aá]"]),
    "terrain": text.vocabulary_pattern(["ramal", "porto"]),
    "culture": text.vocabulary_pattern(["fazenda", "rua", "igarap[eé]"]),
}


def when_chain(col: str, table: dict, default) -> str:
    cases = " ".join(f"WHEN {col} = '{k}' THEN {d(str(v))}" for k, v in table.items())
    return f"CASE {cases} ELSE {d(str(default))} END"


def contains_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


# ---- sources -------------------------------------------------------------------------------------

@query("src1_sites", f"""
    SELECT c_name AS site_name, {d("c_nationkey - 12")} AS lat, {d("c_acctbal / 100 - 120")} AS lon
    FROM {{customer}} WHERE c_custkey % 9 <> 4""")
def _(v):
    raw = v("customer").select(
        F.col("c_name").alias("name"), (F.col("c_nationkey") - 12).cast("string").alias("Latitude"),
        F.when(F.col("c_custkey") % 9 != 4, F.col("c_acctbal") / 100 - 120).alias("LNG"))
    return readers.normalize_sites(raw).select("site_name", "lat", "lon")


@query("src2_placemarks", """
    SELECT site_name, lon, lat, CASE culture_tag WHEN 'casarabe' THEN 'casarabe' WHEN 'acre' THEN 'acre' ELSE 'marajo' END
           AS culture_tag, CAST(2015 AS INT) AS discovery_year
    FROM {v_site}""")
def _(v):
    kml = F.concat(
        F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>'), F.col("site_name"),
        F.lit("</name><Point><coordinates>"), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"),
        F.lit(",0</coordinates></Point></Placemark></Document></kml>"))
    files = v("v_site").select(F.concat(F.lit("/in/"), "culture_tag", F.lit(".kml")).alias("path"),
                               F.encode(kml, "UTF-8").alias("content"))
    return placemarks.parse_placemarks(files).select("site_name", "lon", "lat", "culture_tag", "discovery_year")


@query("src3_culture_from_path", """
    SELECT page_id, CASE WHEN contains(f, 'th') THEN 'th' WHEN contains(f, 'acre') THEN 'acre'
           WHEN contains(f, 'xingu') THEN 'kuhikugu' ELSE 'unknown' END AS culture_tag,
           CAST(2015 AS INT) AS discovery_year
    FROM (SELECT page_id, lower(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')) AS f FROM {pages})""")
def _(v):
    return readers.with_culture_from_path(v("pages").select("page_id", "url"), F.col("url"), ["th"]).select(
        "page_id", "culture_tag", "discovery_year")


@query("src4_features", """
    SELECT feature_id, k AS key_class FROM (
      SELECT feature_id, lon, lat, unnest(list_concat(CASE WHEN feature_id % 2 = 0 THEN ['place'] ELSE [] END,
             CASE WHEN feature_id % 3 = 0 THEN ['highway'] ELSE [] END)) AS k FROM {v_feature})
    WHERE lon BETWEEN -72 AND -64 AND lat BETWEEN -13 AND -7""")
def _(v):
    f = v("v_feature")
    tags = F.map_filter(
        F.create_map(F.lit("place"), F.when(F.col("feature_id") % 2 == 0, F.lit("village")),
                     F.lit("highway"), F.when(F.col("feature_id") % 3 == 0, F.lit("track")), F.lit("name"), F.col("name")),
        lambda _, x: x.isNotNull())
    return readers.select_features(f.withColumn("tags", tags), BOX).select("feature_id", "key_class")


@query("src5_rivers", """
    SELECT river_id, ord_stra, main_riv, x1, y1, x2, y2 FROM {v_river}
    WHERE least(x1, x2) <= -64 AND greatest(x1, x2) >= -72 AND least(y1, y2) <= -7 AND greatest(y1, y2) >= -13""")
def _(v):
    return readers.select_rivers(v("v_river"), BOX)


@query("src6_cells", "SELECT tile, row, col, nullif(value, 255) AS value FROM {v_cell}")
def _(v):
    return readers.mask_nodata(v("v_cell"))


def _trial_json(v):
    t = v("v_trial")
    root = F.concat(F.lit("root"), F.col("root_no").cast("string"))
    return t.select(
        F.col("trial_id").alias("id"), F.col("distance_km").alias("D"), F.col("occ_pct").alias("O"), "score",
        F.create_map(root, F.col("weight"), F.lit("agua"), F.lit(1.0) - F.col("weight")).alias("weights"),
        F.create_map(root, F.col("n_candidates").cast("bigint")).alias("fp_roots"))


TRIALS_SQL = f"""SELECT trial_id AS id, distance_km AS "D", occ_pct AS "O", {q6("score")} AS score,
    CAST(2 AS INT) AS n_weights, CAST(n_candidates AS BIGINT) AS fp_total FROM {{v_trial}}"""


def _trial_out(t):
    return t.select("id", "D", "O", r6("score").alias("score"), F.size("weights").alias("n_weights"),
                    F.aggregate(F.map_values("fp_roots"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("fp_total"))


@query("src7_trials", TRIALS_SQL)
def _(v):
    """Trial log written as JSON lines and read with its schema."""
    t = _trial_json(v)
    path = scratch(t.sparkSession, "trials")
    sinks.append_trials(t, path)
    return _trial_out(readers.read_trials(t.sparkSession, path))


@query("src8_trial_log", """
    SELECT line_no, kind, CASE WHEN kind = 'trial' THEN CAST(regexp_extract(line, 'Trial ([0-9]+) f', 1) AS BIGINT) END
           AS trial_number, CASE WHEN kind = 'trial' THEN CAST(rtrim(regexp_extract(line, 'value: (\\S+)', 1), '.') AS DOUBLE)
           END AS score
    FROM (SELECT *, CASE WHEN contains(line, 'finished with value') THEN 'trial' WHEN contains(line, 'ERROR') THEN 'error'
                 WHEN contains(line, 'WARNING') THEN 'warning' WHEN contains(line, 'distance_km') THEN 'params' END AS kind
          FROM {v_log})""")
def _(v):
    return readers.parse_trial_log(v("v_log")).select("line_no", "kind", "trial_number", "score")


@query("src9_regions", f"""
    SELECT c_custkey, w >= -180 AND w <= 180 AND e >= -180 AND e <= 180 AND s BETWEEN -90 AND 90 AND n BETWEEN -90 AND 90
           AND w < e AND s < n AND n_coord = 4 AS bbox_valid
    FROM (SELECT c_custkey, c_acctbal / 50 - 20 AS w, -10.0 AS s, {d("c_custkey % 400 - 200")} AS e,
                 {d("c_custkey % 210 - 105")} AS n, CASE WHEN c_custkey % 13 = 0 THEN 3 ELSE 4 END AS n_coord
          FROM {{customer}})""")
def _(v):
    c = v("customer")
    k = F.col("c_custkey")
    box = F.array(F.col("c_acctbal") / 50 - 20, F.lit(-10.0), (k % 400 - 200).cast("double"),
                  (k % 210 - 105).cast("double"))
    box = F.when(k % 13 == 0, F.slice(box, 1, 3)).otherwise(box)
    return readers.validate_regions(c.select("c_custkey", box.alias("bbox"))).select("c_custkey", "bbox_valid")


@query("src9_region_box", f"SELECT s_suppkey, {d('n_nationkey')} AS west, {d('n_nationkey + 5')} AS north FROM {{supplier}} LEFT JOIN (SELECT * FROM {{nation}} WHERE n_regionkey <> 1) ON s_nationkey = n_nationkey")
def _(v):
    """Suppliers with the box of their nation; nations of one region are not in the catalogue."""
    k = F.col("n_nationkey").cast("double")
    regions = v("nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("region"), F.array(k, k - 1.0, k + 2.0, k + 5.0).alias("bbox"))
    found = readers.region_box(v("supplier").withColumn("region", F.col("s_nationkey")), regions)
    return found.select("s_suppkey", F.get("bbox", F.lit(0)).alias("west"), F.get("bbox", F.lit(3)).alias("north"))


# ---- sinks ---------------------------------------------------------------------------------------

@query("snk1_export", f"""
    SELECT name AS site_name, coalesce(waterway, '') AS region, round_even({d("feature_id")} / 7, 2) AS angle,
           lon AS toponym_lon, lat AS toponym_lat FROM {{v_feature}}""")
def _(v):
    f = v("v_feature").select(
        F.col("waterway").alias("region"), F.col("name").alias("site_name"), F.col("lat").alias("toponym_lat"),
        F.col("lon").alias("toponym_lon"), (F.col("feature_id") / 7.0).alias("angle"), "ord")
    return sinks.prepare_export(f, ["angle", "site_name", "region"])


CAND_WKT = """SELECT cand_id, name, root, 'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS geometry
    FROM {v_cand}"""


@query("snk2_candidates", CAND_WKT)
def _(v):
    c = v("v_cand").select("cand_id", "name", "root", "lon", "lat")
    path = scratch(c.sparkSession, "candidates")
    sinks.write_candidates(c, path)
    return c.sparkSession.read.parquet(path)


@query("snk3_placemark_rows", f"""
    SELECT cand_id, '候補地 (スコア: ' || printf('%.3f', score) || ')' AS title,
           CASE WHEN score > 0.6 THEN '#candidate_high_style' WHEN score >= 0.5 THEN '#candidate_mid_style'
                ELSE '#candidate_low_style' END AS style_url,
           CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ',0' AS coordinates
    FROM (SELECT cand_id, lon, lat, {d("cand_id % 1000")} / 1000 AS score FROM {{v_cand}})""")
def _(v):
    c = v("v_cand").withColumns({"score": (F.col("cand_id") % 1000) / 1000.0, "water_type": F.col("root")})
    return sinks.placemark_rows(c).select("cand_id", "title", "style_url", "coordinates")


@query("snk4_append_trials", TRIALS_SQL.replace("FROM {v_trial}", "FROM {v_trial} UNION ALL " + TRIALS_SQL))
def _(v):
    """Two appends, then the whole log."""
    t = _trial_json(v)
    path = scratch(t.sparkSession, "log")
    sinks.append_trials(t, path)
    sinks.append_trials(t, path)
    return _trial_out(readers.read_trials(t.sparkSession, path))


@query("snk5_write_splits", """
    SELECT CASE WHEN discovery_year < 2010 THEN 'train' ELSE 'test_time' END AS split, culture_tag AS region,
           count(*) AS n FROM {v_site} GROUP BY 1, 2""")
def _(v):
    s = v("v_site").withColumns({
        "split": F.when(F.col("discovery_year") < 2010, "train").otherwise("test_time"), "region": F.col("culture_tag")})
    path = scratch(s.sparkSession, "splits")
    sinks.write_splits(s, path)
    return s.sparkSession.read.parquet(path).groupBy("split", "region").agg(F.count(F.lit(1)).alias("n"))


@query("snk6_feature_cache", "SELECT root, count(*) AS n, " + q6("avg(dist_km)") + " AS mean_km FROM {v_cand} GROUP BY root")
def _(v):
    c = v("v_cand")
    spark = c.sparkSession
    root = scratch(spark, "cache")
    build = lambda: c.groupBy("root").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dist_km")).alias("mean_km"))
    sinks.precompute_cached(spark, root, {"table": "v_cand", "by": "root"}, build, [c])
    return sinks.precompute_cached(spark, root, {"by": "root", "table": "v_cand"}, build, [c])


# ---- names ---------------------------------------------------------------------------------------

@query("prj1_normalize_name", f"SELECT ord, {NORM.format('name')} AS normalized FROM {{v_name}}")
def _(v):
    return v("v_name").select("ord", text.normalize_name(F.col("name")).alias("normalized"))


@query("prj2_infer_type", f"""
    WITH r AS (SELECT root, arg_min(category, ord) AS category, min(ord) AS ord FROM {{v_root}} GROUP BY root),
         n AS (SELECT ord AS doc, {NORM.format('name')} AS normalized_name FROM {{v_name}})
    SELECT doc AS ord, arg_min(r.category, r.ord) AS type
    FROM n LEFT JOIN r ON contains(normalized_name, substr(r.root, 1, 3)) GROUP BY doc""")
def _(v):
    roots = v("v_root").groupBy(F.col("root")).agg(F.min_by("category", "ord").alias("category"), F.min("ord").alias("ord"))
    roots = roots.select(F.substring("root", 1, 3).alias("root"), "category", "ord")
    names = v("v_name").select("ord", text.normalize_name(F.col("name")).alias("normalized_name"))
    return cand.infer_type(names, roots).select("ord", "type")


@query("prj3_simple_root", """
    SELECT feature_id, CASE WHEN contains(lower(name), 'rio') THEN 'rio' WHEN contains(lower(name), 'igarape')
           OR contains(lower(name), 'igarapé') THEN 'igarape' WHEN contains(lower(name), 'lago') THEN 'lago' ELSE 'agua' END
           AS root, replace(lower(name), ' ', '_') AS normalized_name FROM {v_feature}""")
def _(v):
    n = F.col("name")
    return v("v_feature").select("feature_id", text.simple_root(n).alias("root"), text.underscored(n).alias("normalized_name"))


@query("prj4_best_name", """
    SELECT * FROM (SELECT event_id, coalesce(
        CASE WHEN event_type = 'click' THEN 'Rio ' || CAST(user_id AS VARCHAR) END,
        CASE WHEN event_type = 'view' THEN 'old ' || CAST(user_id AS VARCHAR) END,
        CASE WHEN event_type = 'error' AND user_id % 3 <> 0 AND length(trim(props)) BETWEEN 2 AND 9 THEN trim(props) END,
        CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'pt name' END) AS best_name FROM {events})
    WHERE best_name IS NOT NULL""")
def _(v):
    e = v("events")
    kind, uid = F.col("event_type"), F.col("user_id")
    feats = e.select(
        "event_id", F.when(kind == "click", F.concat(F.lit("Rio "), uid.cast("string"))).alias("name"),
        F.when(kind == "view", F.concat(F.lit("old "), uid.cast("string"))).alias("old_name"),
        F.when((kind == "error") & (uid % 3 != 0), F.when(F.length("props") <= 9, F.col("props"))).alias("ref"),
        F.when(kind == "signup", F.create_map(F.lit("name:ja"), F.lit("no"), F.lit("name:pt"),
                                              F.when(uid % 2 == 0, F.lit("pt name")))).alias("tags"))
    out = feats.withColumn("best_name", text.best_name(F.col("tags"), feats.columns))
    return out.filter(F.col("best_name").isNotNull()).select("event_id", "best_name")


@query("prj5_root_patterns", """
    SELECT category, min(ord) AS ord, regex_token AS token FROM {v_root} WHERE regex_token IS NOT NULL GROUP BY category, regex_token""")
def _(v):
    return cand.root_token_table(v("v_root"))


CATS_SQL = """
    SELECT feature_id, concat_ws(',', w, t, c) AS root_categories, coalesce(w, t, c) AS root_category
    FROM (SELECT feature_id,
                 CASE WHEN regexp_matches(n, '(^| )(rio|igarap[eé]|lag[oô]a|paran[aá])( |$)') THEN 'water' END AS w,
                 CASE WHEN regexp_matches(n, '(^| )(ramal|porto)( |$)') THEN 'terrain' END AS t,
                 CASE WHEN regexp_matches(n, '(^| )(fazenda|rua|igarap[eé])( |$)') THEN 'culture' END AS c
          FROM (SELECT feature_id, lower(name) AS n FROM {v_feature}))
    WHERE coalesce(w, t, c) IS NOT NULL"""


@query("prj6_tag_categories", CATS_SQL)
def _(v):
    return cand.tag_categories(v("v_feature"), PATTERNS).select(
        "feature_id", F.array_join("root_categories", ",").alias("root_categories"), "root_category")


@query("prj7_toponym_category", "SELECT ord, CASE " + " ".join(
    f"WHEN {contains_sql('lower(name)', w)} THEN '{c}'" for c, w in text.TOPONYM_CLASSES)
    + " ELSE 'other' END AS category FROM {v_name}")
def _(v):
    return v("v_name").select("ord", text.toponym_category(F.col("name")).alias("category"))


@query("prj8_seed_water_flag", f"""
    SELECT feature_id, {contains_sql('lower(name)', text.WATER_SEEDS)} OR coalesce(waterway = 'stream', false) AS is_water,
           CASE WHEN {contains_sql('lower(name)', text.WATER_SEEDS)} OR waterway = 'stream' THEN {d('1')} ELSE {d('0.1')} END
           AS water_score FROM {{v_feature}}""")
def _(v):
    return cand.seed_water_flag(v("v_feature"), feature_type="waterway").select("feature_id", "is_water", "water_score")


@query("prj8_water_ratio", f"""
    SELECT count(*) FILTER (WHERE w) AS n_water, {q6("avg(CASE WHEN w THEN 1.0 ELSE 0.0 END)")} AS water_ratio FROM (
        SELECT {contains_sql('lower(name)', text.WATER_SEEDS)} OR coalesce(waterway = 'stream', false) AS w FROM {{v_feature}})""")
def _(v):
    return rounded(cand.water_ratio(cand.seed_water_flag(v("v_feature"), feature_type="waterway")), "water_ratio")


@query("prj15_wkt_point", """
    SELECT cand_id, lon, lat, 'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS geometry
    FROM {v_cand}""")
def _(v):
    c = sinks.candidate_rows(v("v_cand").select("cand_id", "lon", "lat"))
    g = F.col("geometry")
    return c.select("cand_id", geo.wkt_lon(g).alias("lon"), geo.wkt_lat(g).alias("lat"), "geometry")


# ---- scores and classes --------------------------------------------------------------------------

@query("prj17_score_linear", f"""
    SELECT cand_id, {q6("least(dist_km, 10) / 10")} AS dist_score, {q6("1 - least(occ_pct, 100) / 100")} AS occ_score,
           {q6("0.6e0 * least(dist_km, 10) / 10 + 0.4e0 * (1 - least(occ_pct, 100) / 100)")} AS total_score FROM {{v_cand}}""")
def _(v):
    return rounded(cand.score_linear(v("v_cand")), "dist_score", "occ_score", "total_score").select(
        "cand_id", "dist_score", "occ_score", "total_score")


WEIGHTED = (f"0.6e0 * ({when_chain('root', WEIGHTS, 0.1)}) + 0.3e0 * least(greatest(20 - dist_km, 0), 20) / 20"
            " + 0.1e0 * least(greatest(20 - occ_pct, 0), 20) / 20")


@query("prj18_score_weighted", f"SELECT cand_id, {q6(WEIGHTED)} AS total_score FROM {{v_cand}}")
def _(v):
    return rounded(cand.score_weighted(v("v_cand"), WEIGHTS), "total_score").select("cand_id", "total_score")


@query("prj19_estimate_occurrence", f"""
    SELECT cand_id, {q6(f"CASE WHEN d IS NULL THEN {when_chain('root', cand.OCCURRENCE_BASE, 20)} ELSE greatest(0, 100 * (1 - least(d, 10) / 10)) * {when_chain('root', cand.OCCURRENCE_SHARE, 0.5)} END")} AS occ_pct
    FROM (SELECT cand_id, root, CASE WHEN cand_id % 6 <> 0 THEN dist_km END AS d FROM {{v_cand}})""")
def _(v):
    c = v("v_cand").withColumn("dist_km", F.when(F.col("cand_id") % 6 != 0, F.col("dist_km")))
    return rounded(cand.estimate_occurrence(c, "root"), "occ_pct").select("cand_id", "occ_pct")


@query("prj20_review_flags", f"""
    SELECT event_id, {q6("least(1, greatest(0, 1.2e0 * value / 490))")} AS confidence,
           least(1, greatest(0, 1.2e0 * value / 490)) < 0.85e0 AS needs_review FROM {{events}}""")
def _(v):
    e = v("events").select("event_id", (F.col("value") / 490).alias("water_score"))
    return rounded(cand.review_flags(e), "confidence").select("event_id", "confidence", "needs_review")


@query("prj21_classes", """
    SELECT cand_id, CASE WHEN dist_km >= 3 THEN 'far' ELSE 'near' END AS dist_class,
           CASE WHEN occ_pct < 5 THEN 'dry' ELSE 'wet' END AS occ_class FROM {v_cand}""")
def _(v):
    return cand.classify_occurrence(cand.classify_distance(v("v_cand"))).select("cand_id", "dist_class", "occ_class")


DIST_EDGES = [0.0, 1.0, 2.0, 3.0, 5.0, 10.0, float("inf")]
DIST_LABELS = ["0-1km", "1-2km", "2-3km", "3-5km", "5-10km", "10km+"]
OCC_EDGES = [0.0, 1.0, 5.0, 10.0, 20.0, 50.0, float("inf")]
OCC_LABELS = ["0-1%", "1-5%", "5-10%", "10-20%", "20-50%", "50%+"]


def bucket_sql(col: str, edges, labels) -> str:
    parts = [f"WHEN {col} > {lo}" + ("" if hi == float("inf") else f" AND {col} <= {hi}") + f" THEN '{lab}'"
             for lo, hi, lab in zip(edges, edges[1:], labels)]
    return "CASE " + " ".join(parts) + " END"


@query("prj22_buckets", f"""
    SELECT cand_id, {bucket_sql('dist_km', DIST_EDGES, DIST_LABELS)} AS dist_bucket,
           {bucket_sql('occ_pct', OCC_EDGES, OCC_LABELS)} AS occ_bucket FROM {{v_cand}}""")
def _(v):
    b = cand.bucketize(v("v_cand"), "dist_km", DIST_EDGES, DIST_LABELS, "dist_bucket")
    return cand.bucketize(b, "occ_pct", OCC_EDGES, OCC_LABELS, "occ_bucket").select("cand_id", "dist_bucket", "occ_bucket")


@query("prj23_parse_weights", f"""
    SELECT event_id, 'k' AS root, least(1, greatest(0.1e0, value / 300)) AS weight FROM {{events}} WHERE event_id % 4 < 3
    UNION ALL
    SELECT event_id, 'low' AS root, {d("0.1")} AS weight FROM {{events}} WHERE event_id % 4 < 3""")
def _(v):
    """Plain, fenced and embedded JSON; quoted numbers and responses without weights give nothing."""
    e, k = v("events"), F.col("event_id") % 4
    doc = F.concat(F.lit('{"weights": {"k": '), (F.col("value") / 300).cast("string"),
                   F.lit(', "low": 0.01, "bad": "0.7"}, "why": "{x}"}'))
    body = (F.when(k == 0, doc).when(k == 1, F.concat(F.lit("Here:\n```json\n"), doc, F.lit("\n```\nend")))
            .when(k == 2, F.concat(F.lit("result "), doc, F.lit(" ok"))).otherwise(F.lit('{"other": 1}')))
    return validate.parse_weights(e.select("event_id", body.alias("response")), "response", ["event_id"])


@query("prj24_validate_responses", """
    SELECT ord, concat_ws(';',
        CASE WHEN canonical_id IS NULL THEN 'canonical_id' END, CASE WHEN conf IS NULL OR NOT conf BETWEEN 0 AND 1 THEN
        'confidence' END, CASE WHEN lang NOT IN ('por', 'tup', 'mixed', 'unknown') THEN 'lang' END,
        CASE WHEN relation NOT IN ('same', 'similar', 'different') THEN 'relation' END) AS bad_fields
    FROM (SELECT ord, canonical_id, TRY_CAST(confidence AS DOUBLE) AS conf,
                 CASE WHEN root = 'system' THEN 'araw' ELSE lang END AS lang,
                 CASE WHEN root = 'user' THEN 'same' WHEN root = 'assistant' THEN 'similar' ELSE 'equal' END AS relation
          FROM {v_dict})""")
def _(v):
    r = F.col("root")
    resp = v("v_dict").withColumns({
        "relation": F.when(r == "user", "same").when(r == "assistant", "similar").otherwise("equal"),
        "lang": F.when(r == "system", "araw").otherwise(F.col("lang")), "reasoning": F.lit("text")})
    errors = F.array_sort(F.map_keys("errors"))
    return validate.validate_responses(resp).select("ord", F.array_join(errors, ";").alias("bad_fields"))


@query("prj24_validate_proposals", """
    SELECT ord, concat_ws(';', CASE WHEN size % 5 = 0 THEN 'example_toponyms' END,
           CASE WHEN size < 10 THEN 'frequency' END, CASE WHEN brand = 'Brand#1' THEN 'lang' END) AS bad_fields
    FROM {v_word}""")
def _(v):
    w = v("v_word").select(
        "ord", F.col("name").alias("root"), F.when(F.col("brand") == "Brand#1", "xx").otherwise("macro-je").alias("lang"),
        F.lit("m").alias("meaning_en"), F.lit("m").alias("meaning_ja"), F.lit("0.5").alias("confidence"),
        F.when(F.col("size") < 10, "0").otherwise(F.col("size").cast("string")).alias("frequency"),
        F.when(F.col("size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("name")).alias("example_toponyms"),
        F.lit("r").alias("reasoning"))
    return validate.validate_proposals(w).select("ord", F.array_join(F.array_sort(F.map_keys("errors")), ";").alias("bad_fields"))


@query("prj24_validate_actions", """
    SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN event_id % 2 = 0 ELSE false END AS params_valid
    FROM {events}""")
def _(v):
    kind = F.col("event_type")
    action = F.when(kind == "click", "set_param").when(kind == "view", "add_root_weight").otherwise("other")
    params = F.when(kind == "click", F.create_map(F.lit("param_name"), F.lit("D"), F.lit("param_value"), F.lit("3"))).otherwise(
        F.map_filter(F.create_map(F.lit("root"), F.lit("rio"), F.lit("weight"), F.when(F.col("event_id") % 2 == 0, F.lit("1"))),
                     lambda _, x: x.isNotNull()))
    e = v("events").select("event_id", action.alias("action"), params.alias("params"))
    return validate.validate_actions(e).select("event_id", "params_valid")


@query("prj25_validate_roots", """
    SELECT ord, CAST((CASE WHEN regex_token IS NULL THEN 1 ELSE 0 END) + (CASE WHEN lang = 'xx' THEN 1 ELSE 0 END)
           + (CASE WHEN ord % 7 = 0 AND regex_token IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS n_errors FROM {v_root}""")
def _(v):
    token = F.when(F.col("ord") % 7 == 0, F.concat(F.lit("["), "regex_token")).otherwise(F.col("regex_token"))
    return validate.validate_roots(v("v_root").withColumn("regex_token", token)).select("ord", F.size("errors").alias("n_errors"))


@query("prj25_format_roots", """
    SELECT ord, root, coalesce(nullif(lang, 'xx'), 'unknown') AS lang, regex_token, nullif(trim(CASE WHEN ord % 3 = 1 THEN ' '
           ELSE ' ' || meaning_en END), '') AS meaning_en, meaning_ja FROM {v_root}""")
def _(v):
    r = v("v_root").withColumns({
        "lang": F.nullif("lang", F.lit("xx")),
        "meaning_en": F.when(F.col("ord") % 3 == 1, " ").otherwise(F.concat(F.lit(" "), "meaning_en"))})
    return validate.format_roots(r).select("ord", "root", "lang", "regex_token", "meaning_en", "meaning_ja")


@query("prj26_numeric_change", f"""
    SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value ELSE {d('0')} END AS change FROM {{events}}""")
def _(v):
    kind, val = F.col("event_type"), F.col("value").cast("string")
    effect = (F.when(kind == "click", F.concat(F.lit("+"), val, F.lit("%"))).when(kind == "view", F.concat(F.lit(" -"), val))
              .otherwise("none"))
    return v("events").select("event_id", text.numeric_change(effect).alias("change"))


@query("prj27_water_meaning", f"""
    SELECT ord, {contains_sql('meaning_ja', text.WATER_MEANING_JA)} OR {contains_sql('lower(meaning_en)', text.WATER_MEANING_EN)}
           AS is_water FROM {{v_root}}""")
def _(v):
    return v("v_root").select("ord", text.is_water_meaning(F.col("meaning_ja"), F.col("meaning_en")).alias("is_water"))


# ---- filters -------------------------------------------------------------------------------------

@query("flt1_bbox", "SELECT feature_id, lon, lat FROM {v_feature} WHERE lon BETWEEN -72 AND -64 AND lat BETWEEN -13 AND -7")
def _(v):
    return cand.in_bbox(v("v_feature"), BOX).select("feature_id", "lon", "lat")


@query("flt2_vocabulary", """
    SELECT feature_id, name FROM {v_feature}
    WHERE regexp_matches(lower(name), '(^| )(rio|igarap[eé]|lag[oô]a|paran[aá])( |$)')""")
def _(v):
    return cand.filter_by_vocab(v("v_feature"), PATTERNS["water"]).select("feature_id", "name")


@query("flt3_drop_water", "SELECT feature_id FROM {v_feature} WHERE waterway IS NULL AND feature_id % 5 <> 0")
def _(v):
    f = v("v_feature").withColumn(
        "tags", F.when(F.col("feature_id") % 5 == 0, F.create_map(F.lit("wetland"), F.lit("yes"))))
    return cand.drop_water_features(f, "tags").select("feature_id")


@query("flt4_paleo_candidates", "SELECT cand_id, true AS is_candidate FROM {v_cand} WHERE dist_km >= 3 AND occ_pct < 5")
def _(v):
    return cand.paleo_candidates(v("v_cand")).select("cand_id", "is_candidate")


@query("flt5_threshold_top", f"""
    SELECT cand_id, {q6("s")} AS total_score FROM (SELECT cand_id, {WEIGHTED} AS s FROM {{v_cand}}
    WHERE dist_km >= 2.5 AND occ_pct <= 5) ORDER BY s DESC, cand_id LIMIT 20""")
def _(v):
    return rounded(cand.threshold_top(v("v_cand"), 2.5, 5.0, WEIGHTS), "total_score").select("cand_id", "total_score")


@query("flt6_year_window", "SELECT site_id, discovery_year FROM {v_site} WHERE discovery_year BETWEEN 1995 AND 2010")
def _(v):
    return cand.year_window(v("v_site"), 1995, 2010).select("site_id", "discovery_year")


@query("flt7_by_culture", "SELECT site_id, site_name FROM {v_site} WHERE culture_tag = 'acre'")
def _(v):
    return cand.by_culture(v("v_site"), "acre").select("site_id", "site_name")


@query("flt8_top_quantile", "SELECT cand_id, dist_km FROM {v_cand} WHERE dist_km >= (SELECT quantile_cont(dist_km, 0.7) FROM {v_cand})")
def _(v):
    return cand.top_quantile(v("v_cand"), "dist_km", 0.7).select("cand_id", "dist_km")


@query("flt9_search_exact", "SELECT ord FROM {v_word} WHERE lower(name) = 'red widget'")
def _(v):
    w = v("v_word").select("ord", F.col("name").alias("variant_name"), F.col("brand").alias("canonical_name"))
    return validate.search_variants(w, "Red Widget").select("ord")


@query("flt9_search_fuzzy", "SELECT ord FROM {v_word} WHERE regexp_matches(lower(name), 'w.dg') OR regexp_matches(lower(brand), 'w.dg')")
def _(v):
    w = v("v_word").select("ord", F.col("name").alias("variant_name"), F.col("brand").alias("canonical_name"))
    return validate.search_variants(w, "w.dg", fuzzy=True).select("ord")


@query("flt10_validate_entries", """
    SELECT ord, TRY_CAST(confidence AS DOUBLE) AS confidence FROM {v_dict} WHERE canonical_id IS NOT NULL
    AND (TRY_CAST(confidence AS DOUBLE) IS NULL OR TRY_CAST(confidence AS DOUBLE) BETWEEN 0 AND 1)""")
def _(v):
    return validate.validate_entries(v("v_dict")).select("ord", "confidence")
