"""Vectors, similarity, clustering and the composed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.functions import text
from toposcan.functions.geodesic import geodesic_m
from toposcan.operators import aggregates as agg, similarity as sim, trials as tr, vectors
from toposcan.operators.textmine import stem_names
from toposcan.plans import flows
from toposcan.plans.catalog_grid import CLEAN, NORTH, SIZE, WEST, clean
from toposcan.plans.catalog_metrics import ALL_METRICS, DISTANCE, feature_sql, round_all, scored
from toposcan.plans.catalog_names import NORM, PATTERNS, WEIGHTED, WEIGHTS
from toposcan.plans.catalog_space import KNOWN_CAND, PLANAR_PAIRS
from toposcan.plans.catalog_trials import ALL_FAILURES, OK_RUN, RECENT, RUN, grid, shifted, space, with_params
from toposcan.plans.catalog_words import NEG_BOX, STRAT_EARLY
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.views import d
from toposcan.session import scratch


def vec(v):
    return v("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def centroids(v):
    """Mean vector per label."""
    parts = v("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a"))
    return rows.select(F.col("label").cast("bigint").alias("id"), F.transform("a", lambda s: s["m"]).alias("v"))


VEC = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM {embeddings}"
CENTROIDS = f"""SELECT label AS id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM ({VEC}))
                GROUP BY label, i) GROUP BY label"""


@query("jn9_cosine_topk", f"""
    SELECT query_id, id, similarity FROM (SELECT q.id AS query_id, x.id, round(list_cosine_similarity(q.v, x.v), 9) AS s, {q6("list_cosine_similarity(q.v, x.v)")} AS similarity,
           row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, x.v), 9) DESC, x.id) AS rn FROM ({CENTROIDS}) q, ({VEC}) x)
    WHERE rn <= 5 AND s >= 0.1""")
def _(v):
    out = vectors.cosine_topk(centroids(v), vec(v).select("id", "v"), 5, 0.1)
    return rounded(out, "similarity").select(F.col("query_id").cast("int").alias("query_id"), "id", "similarity")


@query("ml13_water_scores", f"""
    SELECT id, {q6("avg(s)")} AS water_score FROM (SELECT x.id, list_cosine_similarity(q.v, x.v) AS s, row_number() OVER (PARTITION BY x.id ORDER BY
           round(list_cosine_similarity(q.v, x.v), 9) DESC, q.id) AS rn FROM ({CENTROIDS}) q, ({VEC}) x) WHERE rn <= 3 GROUP BY id""")
def _(v):
    return rounded(vectors.water_scores(vec(v).select("id", "v"), centroids(v), 3), "water_score")


@query("ml6_knn_score", f"""
    SELECT id, {q6("exp(-avg(dist))")} AS knn_score FROM (SELECT x.id, list_distance(q.v, x.v) AS dist, row_number() OVER (PARTITION BY x.id ORDER BY
           round(list_distance(q.v, x.v), 9), q.id) AS rn FROM ({VEC}) q, ({VEC}) x WHERE q.id <> x.id) WHERE rn <= 3 GROUP BY id""")
def _(v):
    """Leave-one-out over all vectors."""
    x = vec(v).select("id", "v")
    return rounded(vectors.knn_score(x, x, 3, leave_one_out=True), "knn_score")


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def digits_sql(name: str, dim: int = 64) -> str:
    """Twin of ``vectors.digits_vector`` before scaling, as a list."""
    hexes = " || ".join(f"md5('42:{b}:' || {name})" for b in range(dim // 8))
    return f"list_transform(range(0, {dim}), lambda i: CAST('0x' || substr({hexes}, CAST(i * 4 + 1 AS INT), 4) AS INT) / 65535e0 * 2 - 1)"


NUDGES = ", ".join(f"('{w}', {g}e0)" for g, words in vectors.WORD_GROUPS for w in words)
EMBEDDED = f"""
    n AS (SELECT feature_id, {NORM.format("name")} AS n FROM {{v_feature}}),
    u AS (SELECT DISTINCT n FROM n UNION SELECT unnest({list(text.WATER_SEEDS)})),
    raw AS (SELECT n, {digits_sql("n")} AS r FROM u), base AS (SELECT n, {unit_sql("r")} AS v FROM raw),
    word AS (SELECT w, g, {digits_sql("w")} AS r FROM (VALUES {NUDGES}) t(w, g)), nudge AS (SELECT w, list_transform({unit_sql("r")}, lambda x: x * g) AS v FROM word),
    hit AS (SELECT n, v FROM (SELECT n, unnest(string_split(n, ' ')) AS w FROM u) JOIN nudge USING (w)),
    comp AS (SELECT n, i, sum(v[i]) AS x FROM hit, range(1, 65) t(i) GROUP BY n, i), shift AS (SELECT n, list(x ORDER BY i) AS s FROM comp GROUP BY n),
    mixed AS (SELECT n, v, s, {unit_sql("s")} AS us FROM base LEFT JOIN shift USING (n)),
    added AS (SELECT n, v, s, list_transform(v, lambda x, i: 0.7e0 * x + 0.3e0 * us[i]) AS m FROM mixed),
    e AS (SELECT n, CASE WHEN s IS NULL THEN v ELSE {unit_sql("m")} END AS e FROM added)"""


@query("prj29_hash_embedding", f"WITH {EMBEDDED} SELECT feature_id, 64 AS dim, {q6('list_sum(list_transform(e, lambda x: x * x))')} AS norm, {q6('e[1]')} AS first FROM n JOIN e USING (n)")
def _(v):
    names = v("v_feature").select("feature_id", text.normalize_name(F.col("name")).alias("n"))
    e = names.withColumn("e", vectors.hash_embedding(64)("n"))
    return e.select("feature_id", F.size("e").alias("dim"),
                    r6(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"), r6(F.get("e", F.lit(0))).alias("first"))


def vincenty(rows: str, steps: int = 12) -> str:
    """SQL twin of the geodesic: ``river_id, metres`` of rows with ``y1, x1, y2, x2`` after a fixed number of iterations."""
    a, f = "6378137.0e0", "(1 / 298.257223563e0)"
    b = f"({a} * (1 - {f}))"
    q = (f"SELECT river_id, atan((1 - {f}) * tan(radians(y1))) AS u1, atan((1 - {f}) * tan(radians(y2))) AS u2, radians(CAST(x2 AS DOUBLE) - CAST(x1 AS DOUBLE)) AS el, "
         f"radians(CAST(x2 AS DOUBLE) - CAST(x1 AS DOUBLE)) AS lam FROM {rows}")
    for _ in range(steps):
        q = f"""SELECT river_id, u1, u2, el,
            sqrt(pow(cos(u2) * sin(q.lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(q.lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(q.lam) AS cs,
            atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(q.lam) / ss END AS sa, 1 - sa * sa AS c2a,
            CASE WHEN c2a = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / c2a END AS c2m, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS c,
            el + (1 - c) * {f} * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam FROM ({q}) q"""
    return f"""SELECT river_id, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka,
        uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb,
        kb * ss * (c2m + kb / 4 * (cs * (2 * c2m * c2m - 1) - kb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3))) AS ds, round({b} * ka * (sig - ds), 3) AS metres FROM ({q})"""


@query("prj12_geodesic", f"SELECT river_id, metres FROM ({vincenty('{v_river}')})")
def _(v):
    return v("v_river").select("river_id", F.round(geodesic_m("y1", "x1", "y2", "x2"), 3).alias("metres"))


# ---- scaling and correlation ---------------------------------------------------------------------

COLS = ["score", "n_candidates", "duration", "weight", "distance_km"]
SCALERS = {
    "standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}
NUM = "(SELECT trial_id, status, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in COLS) + " FROM {v_trial})"


def scale_sql(kind: str, fit: str = "", use: str = "") -> str:
    mid, width = SCALERS[kind]
    model = ", ".join(f"{mid.format(c=c)} AS a_{c}, {width.format(c=c)} AS b_{c}" for c in COLS)
    out = ", ".join(q6(f"({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END") + f" AS {c}" for c in COLS)
    return f"SELECT trial_id, {out} FROM {NUM}, (SELECT {model} FROM {NUM} {fit}) {use}"


for kind in SCALERS:
    query(f"ml2_scale_{kind}", scale_sql(kind))(
        lambda v, kind=kind: rounded(sim.scale(v("v_trial"), COLS, kind), *COLS).select("trial_id", *COLS))


@query("ml3_transform_like", scale_sql("standard", "WHERE status = 'completed'", "WHERE status = 'failed'"))
def _(v):
    t = v("v_trial")
    model = sim.fit_scaler(t.filter("status = 'completed'"), COLS)
    return rounded(sim.transform_like(t.filter("status = 'failed'"), model, COLS, "trial_id"), *COLS)


def pairs_sql(cols, src: str) -> str:
    return " UNION ALL ".join(f"SELECT {j} AS j, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {src}"
                              for j, b in enumerate(cols) for a in cols[:j])


FEATS = [c for c in DISTANCE]
FEATURE_ROWS = f"({feature_sql(DISTANCE)})"


@query("ml4_high_corr_pairs", f"WITH f AS {FEATURE_ROWS} SELECT a, b, {q6('r')} AS r FROM ({pairs_sql(FEATS, 'f')}) WHERE abs(r) > 0.8")
def _(v):
    f = round_all(agg.distance_features(v("v_site_toponym")))
    return rounded(sim.high_corr_pairs(f, FEATS, 0.8), "r")


@query("ml5_drop_correlated", f"""
    WITH f AS {FEATURE_ROWS}, p AS ({pairs_sql(FEATS, 'f')})
    SELECT site_name, feature, value FROM (UNPIVOT f ON {", ".join(FEATS)} INTO NAME feature VALUE value) WHERE feature NOT IN (SELECT b FROM p WHERE abs(r) > 0.6)""")
def _(v):
    f = round_all(agg.distance_features(v("v_site_toponym"))).select("site_name", *FEATS)
    kept = sim.drop_correlated(f, FEATS, 0.6)
    return kept.unpivot(["site_name"], [c for c in kept.columns if c != "site_name"], "feature", "value")


# ---- models --------------------------------------------------------------------------------------

@query("ml7_cluster_score")
def _(v):
    x = vec(v)
    return rounded(sim.cluster_score(x, x, 3), "cluster_score")


@query("ml7_center_score", f"""
    WITH x AS (SELECT vec_id AS id, embedding AS v, label FROM {{embeddings}}),
    c AS (SELECT label, i, avg(v[i]) AS m FROM x, (SELECT unnest(range(1, len(v) + 1)) AS i FROM (SELECT v FROM x LIMIT 1)) GROUP BY label, i),
    k AS (SELECT label, list(m ORDER BY i) AS c FROM c GROUP BY label)
    SELECT id, {q6("exp(-min(sqrt(list_sum(list_transform(v, lambda y, i: pow(y - k.c[i], 2))))))")} AS cluster_score FROM x, k GROUP BY id""")
def _(v):
    """The score alone, against the mean vector of every label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    e = v("embeddings").select("label", F.transform("embedding", lambda y: y.cast("double")).alias("v"), F.col("vec_id").alias("id"))
    means = e.select("label", array_to_vector("v").alias("f")).groupBy("label").agg(Summarizer.mean(F.col("f")).alias("m"))
    centers = [r["c"] for r in means.select(vector_to_array("m").alias("c")).collect()]  # a row per label
    return rounded(sim.center_score(e, centers), "cluster_score")


@query("ml8_gmm_score")
def _(v):
    x = vec(v)
    return rounded(sim.gmm_score(x, x, 3), "log_likelihood")


@query("ml9_isolation_score")
def _(v):
    x = vec(v)
    return rounded(sim.isolation_score(x, x), "anomaly_score")


@query("ml10_composite_similarity", f"SELECT trial_id, {q6('0.35e0 * score + 0.25e0 * weight + 0.25e0 * duration + 0.15e0 * distance_km')} AS composite_score FROM {{v_trial}}")
def _(v):
    t = v("v_trial").withColumnsRenamed({"score": "knn_score", "weight": "cluster_score", "duration": "gaussian_score", "distance_km": "anomaly_score"})
    return rounded(sim.composite_similarity(t), "composite_score").select("trial_id", "composite_score")


@query("ml11_cluster_quality", f"""
    WITH x AS ({VEC}), c AS ({CENTROIDS}), n AS (SELECT label, count(*) AS n FROM x GROUP BY label),
    p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS t FROM x a, x b GROUP BY ALL),
    s AS (SELECT p.id, max(t / nullif(n - 1, 0)) FILTER (WHERE p.label = other) AS a, min(t / n) FILTER (WHERE p.label <> other) AS b FROM p JOIN n ON n.label = other GROUP BY p.id),
    g AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(v[i]) AS m FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM x) GROUP BY i)),
    w AS (SELECT x.label, sum(pow(list_distance(x.v, c.v), 2)) AS w, avg(list_distance(x.v, c.v)) AS s FROM x JOIN c ON x.label = c.id GROUP BY 1),
    b AS (SELECT sum(n * pow(list_distance(c.v, g.v), 2)) AS b, sum(n) AS n, count(*) AS k FROM c JOIN n ON n.label = c.id, g),
    r AS (SELECT w1.label, max((w1.s + w2.s) / list_distance(c1.v, c2.v)) AS r FROM w w1 JOIN c c1 ON c1.id = w1.label, w w2 JOIN c c2 ON c2.id = w2.label WHERE w1.label <> w2.label GROUP BY 1)
    SELECT {q6("(SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM s)")} AS silhouette, {q6("(b / (k - 1)) / ((SELECT sum(w) FROM w) / (n - k))")} AS calinski_harabasz,
           {q6("(SELECT avg(r) FROM r)")} AS davies_bouldin FROM b""")
def _(v):
    return round_all(sim.cluster_quality(vec(v)))


@query("ml12_pca2")
def _(v):
    return rounded(sim.pca2(vec(v))[0], "pc1", "pc2")


@query("ml14_cluster_vectors")
def _(v):
    return sim.cluster_vectors(vec(v), k_range=(2, 5))[0].select("id", "label")


def clustered_names(v):
    """Texts with the label of the vector of the same number as their cluster; those without a vector are cluster -1."""
    e = v("embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("cluster"))
    n = v("v_name").select("ord", "name").join(e, "ord", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return n.withColumn("water_score", (F.col("ord") % 7) / 6.0)


NAMED = "(SELECT n.ord, name, coalesce(label, -1) AS cluster, (n.ord % 7) / 6.0e0 AS water_score FROM {v_name} n LEFT JOIN {embeddings} e ON e.vec_id = n.ord)"


@query("ml15_cluster_types", f"""
    SELECT cluster, count(*) AS n, {q6("avg(water_score)")} AS mean_score, CASE WHEN avg(water_score) >= 0.5 THEN 'water' ELSE 'non-water' END AS cluster_type
    FROM {NAMED} GROUP BY cluster""")
def _(v):
    return round_all(sim.cluster_types(clustered_names(v)))


@query("ml15_cluster_summary", f"""
    WITH w AS (SELECT cluster, regexp_extract(lower(trim(name)), '^[^\\s]+') AS w, count(*) AS n FROM {NAMED} GROUP BY 1, 2),
    f AS (SELECT cluster, w AS first_word FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, w) AS rn FROM w WHERE w <> '') WHERE rn = 1)
    SELECT cluster, count(*) AS n, CASE WHEN avg(water_score) >= 0.5 THEN 'water' ELSE 'non-water' END AS cluster_type,
           md5(array_to_string(list(name ORDER BY ord)[1:5], '|')) AS examples, any_value(first_word) AS first_word FROM {NAMED} JOIN f USING (cluster) GROUP BY cluster""")
def _(v):
    return sim.cluster_summary(clustered_names(v)).select("cluster", "n", "cluster_type", F.md5(F.array_join("examples", "|")).alias("examples"), "first_word")


@query("ml16_process_names", f"""
    WITH {EMBEDDED},
    sim AS (SELECT a.n, list_sum(list_transform(a.e, lambda x, i: x * b.e[i])) AS c FROM e a, e b WHERE b.n IN {tuple(text.WATER_SEEDS)}),
    top AS (SELECT n, avg(round(c, 9)) AS w FROM (SELECT n, c, row_number() OVER (PARTITION BY n ORDER BY round(c, 9) DESC) AS k FROM sim) WHERE k <= 3 GROUP BY n)
    SELECT feature_id, n AS normalized_name, {q6("w")} AS water_score, {q6("greatest(0, least(1, 1.2e0 * w))")} AS confidence, greatest(0, least(1, 1.2e0 * w)) < 0.6 AS needs_review
    FROM n JOIN top USING (n)""")
def _(v):
    return rounded(flows.process_names(v("v_feature"), dim=64, key="feature_id"), "water_score", "confidence")


# ---- flows ---------------------------------------------------------------------------------------

ROOTS = [(1, "rio", "water"), (2, "igarape", "water"), (3, "lagoa", "water"), (4, "parana", "water"), (5, "porto", "transport"), (6, "ramal", "terrain")]
PIP_BOX = (-73.0, -14.0, -61.0, -6.0)
MIN_KM, MAX_OCC = 60.0, 30.0


def precandidates(v):
    f = v("v_feature")
    roots = f.sparkSession.createDataFrame(ROOTS, "ord INT, root STRING, category STRING")
    return flows.precandidates(f, v("v_river"), roots, PATTERNS, PIP_BOX, clean(v), (WEST, NORTH, SIZE))


TYPE = "CASE " + " ".join(f"WHEN contains(nn, '{r}') THEN '{c}'" for _, r, c in ROOTS) + " END"
PRE = f"""
    SELECT f.feature_id, f.name, nn AS normalized_name, {TYPE} AS type, k.km AS dist_km, coalesce(o.occ, 0) AS occ_pct, CASE WHEN contains(low, 'fazenda') OR contains(low, 'rua')
           THEN 'culture' WHEN contains(low, 'ramal') OR contains(low, 'porto') THEN 'terrain' ELSE 'water' END AS root_category
    FROM (SELECT *, {NORM.format('name')} AS nn, lower(name) AS low FROM {{v_feature}}) f
    JOIN (SELECT feature_id, min(km) AS km FROM ({PLANAR_PAIRS}) GROUP BY 1) k USING (feature_id)
    LEFT JOIN (SELECT row, col, avg(value) AS occ FROM {CLEAN} GROUP BY 1, 2) o
      ON o.row = CAST(floor((-5 - lat) / 0.1e0) AS INT) AND o.col = CAST(floor((lon + 74) / 0.1e0) AS INT)
    WHERE lon BETWEEN -73 AND -61 AND lat BETWEEN -14 AND -6 AND waterway IS NULL"""


@query("pip1_candidates", f"""
    SELECT feature_id, normalized_name, root_category, type, {q6("dist_km")} AS dist_km, {q6("occ_pct")} AS occ_pct,
           {q6("0.6e0 * least(dist_km, 10) / 10 + 0.4e0 * (1 - least(occ_pct, 100) / 100)")} AS total_score FROM ({PRE}) WHERE dist_km >= {MIN_KM} AND occ_pct < {MAX_OCC}""")
def _(v):
    c = flows.identify_candidates(precandidates(v), MIN_KM, MAX_OCC)
    return rounded(c, "dist_km", "occ_pct", "total_score").select(
        "feature_id", "normalized_name", "root_category", "type", "dist_km", "occ_pct", "total_score").orderBy(F.desc("total_score"), "feature_id")


@query("pip2_precompute_then_threshold", f"""
    WITH p AS ({PRE}), g AS (SELECT DISTINCT distance_km * 4 AS d, occ_pct AS o FROM {{v_trial}})
    SELECT d AS "D", o AS "O", count(feature_id) AS n FROM g LEFT JOIN p ON dist_km >= d AND occ_pct <= o GROUP BY 1, 2""")
def _(v):
    """The table before thresholds is written once; every threshold pair reads that."""
    spark = v("v_feature").sparkSession
    pre = flows.precompute(scratch(spark, "pre"), {"bbox": PIP_BOX, "roots": [r[1] for r in ROOTS]}, lambda: precandidates(v), spark, [v("v_feature"), v("v_river")])
    return tr.sweep(pre, grid(v).select((F.col("D") * 4).alias("D"), "O").distinct())


@query("pip3_site_neighbourhood")
def _(v):
    t = v("v_feature").select("feature_id", F.col("name").alias("toponym_name"), "lon", "lat")
    return flows.site_neighbourhood(v("v_site"), t, v("v_river"), 15.0)


def half(v, odd: int):
    """Known sites and candidates: two halves of the suppliers' rows."""
    return v("v_site_toponym").filter(F.col("culture") % 2 == odd)


@query("pip4_similarity_ranking")
def _(v):
    out = flows.similarity_ranking(half(v, 1), half(v, 0))
    return out.select("site_name", "rank", *[F.round(c, 6).alias(c) for c in ("knn_score", "cluster_score", "gaussian_score", "anomaly_score",
                                                                             "composite_score", "above_known", "center_lat", "center_lon")])


@query("ml17_rank_candidates")
def _(v):
    return sim.rank_candidates(half(v, 1), half(v, 0)).select("site_name", "rank", F.round("composite_score", 6).alias("composite_score"))


@query("ml7_leave_one_out")
def _(v):
    """Every known site by cluster, mixture and forest models without it, and by its neighbours."""
    f = agg.engineer_features(v("v_site_toponym"))
    cols = [c for c in f.columns if c != "site_name"]
    x = sim.to_vectors(sim.scale(f, cols), cols)
    return sim.loo_scores(x, trees=50).select("name", *[F.round(c, 6).alias(c) for c in ("knn_score", "cluster_score", "anomaly_score", "composite_score")])


@query("pip5_inspection", f"""
    WITH a AS ({ALL_METRICS.strip()})
    SELECT metric, value, CASE WHEN metric LIKE 'recall@%' THEN CASE WHEN value >= 0.5 THEN 'good' WHEN value >= 0.3 THEN 'fair' ELSE 'poor' END
        WHEN metric = 'map' THEN CASE WHEN value >= 0.4 THEN 'good' WHEN value >= 0.2 THEN 'fair' ELSE 'poor' END
        WHEN metric = 'workload' THEN CASE WHEN value <= 500 THEN 'good' WHEN value <= 1000 THEN 'fair' ELSE 'poor' END
        ELSE CASE WHEN value >= 2 THEN 'good' WHEN value >= 1 THEN 'fair' ELSE 'poor' END END AS status FROM a""")
def _(v):
    return rounded(flows.inspect(scored(v), v("v_site")), "value", places=9)


WORD_STEMS = """
    SELECT nk, unnest(CASE WHEN length(word) > 3 AND regexp_matches(word, '[saoe]$') THEN [word, left(word, length(word) - 1)] ELSE [word] END) AS pattern FROM (
      SELECT md5(name) AS nk, unnest(string_split(lower(name), ' ')) AS word FROM {v_word}) WHERE length(word) >= 3"""


@query("pip6_grow_dictionary", f"""
    WITH r AS (SELECT * FROM {{v_root}}),
    a AS (SELECT pattern FROM ({WORD_STEMS}) GROUP BY pattern HAVING count(*) >= 2 AND pattern NOT IN (SELECT lower(root) FROM r)
          AND NOT (starts_with(pattern, 'de') OR starts_with(pattern, 'da') OR starts_with(pattern, 'do') OR starts_with(pattern, 'rua') OR starts_with(pattern, 'avenida')
                   OR starts_with(pattern, 'travessa') OR starts_with(pattern, 'estrada'))),
    p AS (SELECT DISTINCT pattern AS root FROM ({WORD_STEMS}) WHERE length(pattern) % 2 = 0)
    SELECT root, {d("1")} AS weight FROM r UNION ALL
    SELECT root, 0.6e0 FROM p WHERE root IN (SELECT pattern FROM a) AND lower(root) NOT IN (SELECT lower(root) FROM r)""")
def _(v):
    """Patterns of the part names; the answers call those of even length small rivers and leave out a field otherwise."""
    roots = v("v_root").withColumn("weight", F.lit(1.0))
    words = v("v_word")
    asked = flows.propose_roots(words, roots)
    answers = stem_names(words).select("pattern").distinct().select(
        F.col("pattern").alias("root"), F.length("pattern").cast("bigint").alias("ord"), F.lit("tup").alias("lang"), F.lit("a small river").alias("meaning_en"),
        F.lit("川").alias("meaning_ja"), F.lit("0.6").alias("confidence"), F.lit("3").alias("frequency"), F.array("pattern").alias("example_toponyms"),
        F.when(F.length("pattern") % 2 == 0, "often seen").alias("reasoning"))
    return flows.grow_dictionary(roots, asked, answers).select("root", "weight")


@query("pip7_split_dataset", f"""
    WITH s AS (SELECT site_id, split FROM ({STRAT_EARLY}) UNION ALL SELECT site_id, 'test_time' FROM {{v_site}} WHERE discovery_year >= 2012)
    SELECT split, true AS is_positive, count(*) AS n FROM s GROUP BY 1
    UNION ALL SELECT 'negative', false, 2 * count(*) FROM {{v_site}}""")
def _(v):
    out = flows.split_dataset(v("v_site"), NEG_BOX, 2012, 0.3, 2.0, 5.0)
    return out.groupBy("split", "is_positive").agg(F.count(F.lit(1)).alias("n"))


@query("pip8_diagnosis", f"""
    SELECT 'candidates' AS area, type AS kind, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity, {d("sum(count)")} AS value FROM ({ALL_FAILURES}) GROUP BY type
    UNION ALL SELECT 'trials', 'convergence_stagnation', 'medium', {q6("max(score)")} FROM {{v_trial}} WHERE status = 'completed'
      HAVING (SELECT recent_best <= earlier_best FROM ({RECENT} {RUN})) AND (SELECT recent_best <= earlier_best FROM ({RECENT} {OK_RUN}))""")
def _(v):
    return rounded(flows.diagnose(shifted(v), with_params(v), space(v)), "value")


HOLD = f"""
    WITH c AS (SELECT cand_id, row_number() OVER (ORDER BY s DESC, cand_id) AS rank FROM (SELECT cand_id, {WEIGHTED} AS s FROM {{v_cand}} WHERE dist_km >= 2 AND occ_pct <= 20) ORDER BY rank LIMIT 500),
    k AS (SELECT site_id, CASE WHEN discovery_year < 2010 THEN 'val' ELSE 'test_time' END AS split, 'all' AS region FROM {{v_site}}
          UNION ALL SELECT site_id, 'test_region', culture_tag FROM {{v_site}}),
    g AS (SELECT split, region, count(*) AS n_sites FROM k GROUP BY 1, 2),
    p AS (SELECT split, region, site_id, cand_id, rank, m, min(m) OVER (PARTITION BY split, region, site_id) AS best FROM k JOIN ({KNOWN_CAND}) h USING (site_id) JOIN c USING (cand_id) WHERE m <= 500),
    a AS (SELECT split, region, count(*) AS matched FROM p WHERE m <= best + 1e-6 GROUP BY 1, 2),
    r AS (SELECT g.split, g.region, c.rank, sum(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.split = g.split AND p.region = g.region AND p.cand_id = c.cand_id) THEN 1 ELSE 0 END)
          OVER (PARTITION BY g.split, g.region ORDER BY c.rank ROWS UNBOUNDED PRECEDING) AS hits FROM g, c),
    m AS (SELECT split, region, avg(hits / rank) AS map, count(*) AS n FROM r GROUP BY 1, 2),
    x AS (SELECT g.*, coalesce(matched, 0) / n_sites AS recall, map, n FROM g LEFT JOIN a USING (split, region) JOIN m USING (split, region)),
    y AS (SELECT *, 0.6e0 * recall + 0.2e0 * map - 0.1e0 * log10(n + 1) / log10(1001) AS score FROM x)
    SELECT split, region, n_sites, {q6("recall")} AS recall, {q6("map")} AS map, {q6("score")} AS score, {q6("score - (SELECT score FROM y WHERE split = 'val')")} AS gap,
           abs(score - (SELECT score FROM y WHERE split = 'val')) > 0.1 AS large_gap FROM y"""


@query("pip9_holdout_evaluation", HOLD)
def _(v):
    s = v("v_site")
    known = s.withColumns({"split": F.when(F.col("discovery_year") < 2010, "val").otherwise("test_time"), "region": F.lit("all")}).unionByName(
        s.withColumns({"split": F.lit("test_region"), "region": F.col("culture_tag")}))
    return round_all(flows.holdout_evaluation(v("v_cand"), known, WEIGHTS, 2.0, 20.0, 500))
