"""Operators on small hand-written tables with hand-computed results."""

import io
import json
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcan.functions import geo, text
from toposcan.operators import (aggregates, candidates as cand, components, dictionary, failures, grid, metrics, ordered, sampling, similarity, spatial,
                                textmine, trials, validate, vectors)
from toposcan.plans import flows
from toposcan.session import scratch
from toposcan.sources import placemarks, readers, sinks
from toposcan.streaming import trials as stream

SITES = [("Site_A", "acre", 2015), ("Site_B", "acre", 2018), ("Site_C", "casarabe", 2019), ("Site_D", "casarabe", 2021), ("Site_E", "santarem", 2022),
         ("Site_F", "marajo", 2016)]


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([(i, n, -10.0 - i, -60.0 - i, c, y) for i, (n, c, y) in enumerate(SITES)],
                                 "site_id BIGINT, site_name STRING, lat DOUBLE, lon DOUBLE, culture_tag STRING, discovery_year INT")


@pytest.fixture
def ranked(spark):
    return spark.createDataFrame([(1, "a", -67.0, -10.0, 0.9, "rio"), (2, "b", -67.1, -10.1, 0.7, "lagoa"), (3, "c", -67.2, -10.2, 0.5, "igarape")],
                                 "cand_id BIGINT, name STRING, lon DOUBLE, lat DOUBLE, total_score DOUBLE, root STRING")


@pytest.fixture
def known(spark):
    return spark.createDataFrame([(1, -67.001, -10.001), (2, -67.5, -10.5), (3, -67.201, -10.201)], "site_id BIGINT, lon DOUBLE, lat DOUBLE")


def one(spark, expr_df):
    return expr_df.first()


def names(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord BIGINT, name STRING")


def test_normalize_name_keeps_hyphen(spark):
    df = names(spark, "Igarapé do Paxiúba", "Lagôa Grande", "Porto-Velho  (AM)", None, "Straße Æble Łódź", "São João—Norte")
    got = [r[0] for r in df.orderBy("ord").select(text.normalize_name(F.col("name"))).collect()]
    assert got == ["igarape do paxiuba", "lagoa grande", "porto-velho am", "", "strasse aeble lodz", "sao joao-norte"]


def test_toponym_category_order(spark):
    df = names(spark, "Território", "Rua da Mata", "Fazenda X", "Torre", "zzz")
    got = [r[0] for r in df.orderBy("ord").select(text.toponym_category(F.col("name"))).collect()]
    assert got == ["waterway", "natural", "landuse", "man_made", "other"]


def test_vocabulary_uses_unicode_word_borders(spark):
    df = names(spark, "IGARAPÉ fundo", "riozinho", "o rio", "trio")
    pattern = text.vocabulary_pattern(["rio", "igarap[eé]", "rio"])
    assert [r[0] for r in cand.filter_by_vocab(df, pattern).orderBy("ord").select("ord").collect()] == [0, 2]


def test_numeric_change(spark):
    df = names(spark, "+5%", "-200", "about 1.5 more", "none", None)
    assert [r[0] for r in df.orderBy("ord").select(text.numeric_change(F.col("name"))).collect()] == [5.0, -200.0, 1.5, 0.0, 0.0]


def test_wkt_accepts_no_space(spark):
    df = names(spark, "POINT(-69 -8)", "POINT (-67.5 -10.25)", "LINE")
    got = [tuple(r) for r in df.orderBy("ord").select(geo.wkt_lon(F.col("name")), geo.wkt_lat(F.col("name"))).collect()]
    assert got == [(-69.0, -8.0), (-67.5, -10.25), (None, None)]


def test_utm_known_values(spark):
    df = spark.createDataFrame([(-57.0, 0.0), (-54.0, 0.0), (-57.0, -10.0)], "lon DOUBLE, lat DOUBLE")
    rows = geo.with_utm(df, "lon", "lat", zone=21, south=True).collect()
    assert (rows[0].e, rows[0].n) == (pytest.approx(500000, abs=1e-6), pytest.approx(10000000, abs=1e-6))
    assert rows[1].e == pytest.approx(833978.557, abs=1e-2)  # three degrees east on the equator
    assert rows[2].n == pytest.approx(10000000 - 0.9996 * 1105854.833, abs=1e-2)  # meridian arc to ten degrees


def test_polar_angle_quirk_and_true_bearing(spark):
    east = [F.lit(1.0), F.lit(0.0)]
    row = spark.range(1).select(geo.polar_angle(*east), geo.polar_angle(*east, true_bearing=True), geo.bearing_deg(*east)).first()
    assert list(row) == pytest.approx([270.0, 90.0, 90.0])


def test_point_in_ring_open_and_closed(spark):
    for ring in ([(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]):
        arr = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
        df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (-1.0, 2.0)], "x DOUBLE, y DOUBLE")
        assert [r[0] for r in df.select(geo.point_in_ring(F.col("x"), F.col("y"), arr)).collect()] == [True, False, False]


def test_classes_and_paleo(spark):
    df = spark.createDataFrame([(1.5, 2.3), (2.8, 4.8), (3.2, 7.2), (5.7, 12.5)], "dist_km DOUBLE, occ_pct DOUBLE")
    got = cand.classify_occurrence(cand.classify_distance(df)).orderBy("dist_km").collect()
    assert [r.dist_class for r in got] == ["near", "near", "far", "far"]
    assert [r.occ_class for r in got] == ["dry", "dry", "wet", "wet"]
    assert cand.paleo_candidates(df).count() == 0


def test_threshold_edges(spark):
    df = spark.createDataFrame([(1, 3.0, 5.0, "rio")], "cand_id BIGINT, dist_km DOUBLE, occ_pct DOUBLE, root STRING")
    assert cand.paleo_candidates(df).count() == 0  # strict
    assert cand.threshold_top(df, 3.0, 5.0, {"rio": 1.0}).first().total_score == pytest.approx(0.6 + 0.3 * 17 / 20 + 0.1 * 15 / 20)


def test_buckets_leave_zero_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (99.0,)], "d DOUBLE")
    got = cand.bucketize(df, "d", [0, 1, 2, float("inf")], ["a", "b", "c"], "b").orderBy("d").collect()
    assert [r.b for r in got] == [None, "a", "b", "c"]


def test_drop_water_features_by_column_and_map(spark):
    df = spark.createDataFrame([(1, "stream", None), (2, None, {"natural": "wood"}), (3, None, {"place": "x"}), (4, None, None)],
                               "id INT, waterway STRING, tags MAP<STRING,STRING>")
    assert sorted(r.id for r in cand.drop_water_features(df, "tags").collect()) == [3, 4]


def test_weights_from_responses(spark):
    good = json.dumps({"weights": {"rio": 0.8, "lago": 5, "igarape": -1, "bad": "0.4", "flag": True}})
    df = names(spark, good, f"text\n```json\n{good}\n```", "no json", '{"other": 1}', '{"weights": {"rio": 0.3}')
    got = {(r.ord, r.root): r.weight for r in validate.parse_weights(df, "name", ["ord"]).collect()}
    one_doc = {"rio": 0.8, "lago": 1.0, "igarape": 0.1}
    assert {k: v for k, v in got.items() if k[0] in (0, 1)} == {(i, r): w for i in (0, 1) for r, w in one_doc.items()}
    assert not any(k[0] in (2, 3) for k in got)


def test_root_validation(spark):
    df = spark.createDataFrame([("", "x", "por"), ("rio", None, "por"), ("rio", "[invalid", "por"), ("rio", "rio", "xx"), ("rio", "r.o", "tup")],
                               "root STRING, regex_token STRING, lang STRING")
    assert [len(r.errors) for r in validate.validate_roots(df).collect()] == [1, 1, 1, 1, 0]


def test_recall_and_map(spark, ranked, known):
    got = {r.k: r.recall for r in metrics.recall_at_k(ranked, known, [2, 3]).collect()}
    assert got == {2: pytest.approx(1 / 3), 3: pytest.approx(2 / 3)}
    # hits at ranks 1 and 3: (1 + 1/2 + 2/3) / 3
    assert metrics.map_score(ranked, known).first()[0] == pytest.approx((1 + 0.5 + 2 / 3) / 3)
    assert metrics.map_score(ranked, known, average_precision=True).first()[0] == pytest.approx((1 + 2 / 3) / 2)


def test_recall_ties_can_exceed_one(spark):
    k = spark.createDataFrame([(1, -67.0, -10.0)], "site_id BIGINT, lon DOUBLE, lat DOUBLE")
    c = spark.createDataFrame([(i, -67.0, -10.001, 1.0 - i / 10) for i in range(3)], "cand_id BIGINT, lon DOUBLE, lat DOUBLE, total_score DOUBLE")
    assert metrics.recall_at_k(c, k, [5]).first().recall == 3.0
    assert metrics.recall_at_k(c, k, [5], distinct_known=True).first().recall == 1.0


def test_sweep_metrics_equal_single_evaluations(spark, ranked, known):
    c = ranked.withColumns({"dist_km": F.col("cand_id").cast("double"), "occ_pct": 4.0 - F.col("cand_id")})
    g = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0), (0.0, 2.5), (9.0, 5.0)], "D DOUBLE, O DOUBLE")
    w = {"rio": 1.0, "lagoa": 0.5}
    for r in trials.sweep_metrics(c, known, g, w).collect():
        kept = cand.score_weighted(c.filter((F.col("dist_km") >= r.D) & (F.col("occ_pct") <= r.O)), w)
        assert r.n_candidates == kept.count()
        assert r.recall == pytest.approx(metrics.recall_at_k(kept, known, [100]).first().recall)
        assert r.map == pytest.approx(metrics.map_score(kept, known).first()[0])


def test_sweep_counts_by_dominance(spark):
    rng = random.Random(6)
    pick = lambda: rng.choice([None, *range(-2, 30), 3.5, 3.5])
    rows = [(pick(), pick()) for _ in range(600)]
    grid = [(rng.choice([-5, 0, 3.5, *range(40)]), rng.choice([-9, 2, 3.5, *range(40)])) for _ in range(400)] + [(None, 3.0)]
    frame = lambda data, cols: spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in data], cols)
    got = sorted(map(tuple, trials.sweep(frame(rows, "dist_km DOUBLE, occ_pct DOUBLE"), frame(grid, "D DOUBLE, O DOUBLE")).collect()), key=str)
    want = {(d, o): sum(1 for x, y in rows if None not in (x, y, d) and x >= d and y <= o) for d, o in grid}
    assert got == sorted(((d if d is None else float(d), float(o), n) for (d, o), n in want.items()), key=str)


def test_sweep_of_five_thousand_trials_reads_the_candidates_once(spark):
    c = spark.range(20_000).select((F.col("id") * 7919 % 1009).cast("double").alias("dist_km"), (F.col("id") * 104729 % 997).cast("double").alias("occ_pct"))
    g = spark.range(5_000).select((F.col("id") * 37 % 1200 - 50.5).alias("D"), (F.col("id") * 91 % 1100 - 20.5).alias("O"))
    out = trials.sweep(c, g)
    assert "Range (0, 20000" not in out._jdf.queryExecution().optimizedPlan().toString()  # counted once, into cells
    x = np.array(c.collect())
    for r in out.filter("pmod(cast(D as int), 97) = 3").collect():
        assert r.n == int(((x[:, 0] >= r.D) & (x[:, 1] <= r.O)).sum())
    assert out.count() == g.distinct().count()


def test_sweep_metrics_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["rio", "lagoa", None]), rng.uniform(-67.02, -66.98), rng.uniform(-10.02, -9.98), rng.uniform(0, 9), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(300)]
    c = spark.createDataFrame(rows, "cand_id BIGINT, root STRING, lon DOUBLE, lat DOUBLE, dist_km DOUBLE, occ_pct DOUBLE")
    known = spark.createDataFrame([(i, rng.uniform(-67.02, -66.98), rng.uniform(-10.02, -9.98)) for i in range(12)], "site_id BIGINT, lon DOUBLE, lat DOUBLE")
    g = spark.createDataFrame([(d / 2, float(o)) for d in range(20) for o in range(4)], "D DOUBLE, O DOUBLE")
    run = lambda: [[round(x, 9) for x in r] for r in sorted(map(tuple, trials.sweep_metrics(c, known, g, {"rio": 1.0, "lagoa": 0.5}, k=20).collect()))]
    one = run()
    monkeypatch.setattr(trials, "BLOCK_ROWS", 17)
    monkeypatch.setattr(trials, "TRIALS_PER_ROW", 7)
    assert run() == one and len(one) == 80 and any(r[4] > 0 for r in one)


def test_composite_score_of_zero_candidates(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (1.0, 0.5, 47)], "recall DOUBLE, map DOUBLE, workload BIGINT")
    got = [r.composite_score for r in metrics.composite_score(df).orderBy("workload").collect()]
    assert got == [pytest.approx(-0.05), pytest.approx(0.64397, abs=1e-5)]


def test_splits(spark, sites):
    got = sampling.ratio_split(sites, {"train": 0.5, "val": 0.2, "test": 0.3})
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 3, "val": 1, "test": 2}
    assert {r.split for r in sampling.ratio_split(sites, {"train": 0, "val": 1, "test": 1}).collect()} == {"val", "test"}
    t = {r.site_name: r.split for r in sampling.time_split(sites, 2020, 0.3).collect()}
    assert t["Site_D"] == t["Site_E"] == "test_time" and set(t.values()) == {"train", "val", "test_time"} or "Site_F" in t
    region = sampling.region_split(sites, {"acre": ["Site_A"], "casarabe": None})
    assert sorted(r.site_name for r in region.collect()) == ["Site_A", "Site_C", "Site_D"]


def test_negative_samples_keep_their_distance(spark, sites):
    neg = sampling.negative_samples(sites, (-66.0, -16.0, -59.0, -9.0), 4.0, 50.0).collect()
    assert len(neg) == 24 and len({r.site_name for r in neg}) == 24
    assert all(r.min_distance_to_positive_km >= 50.0 and r.discovery_year == -1 for r in neg)
    again = sampling.negative_samples(sites.repartition(3), (-66.0, -16.0, -59.0, -9.0), 4.0, 50.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, neg))


def test_dictionary_upsert_renumbers_and_keeps_last(spark):
    schema = "ord BIGINT, canonical_id STRING, canonical_name STRING, variant_name STRING, confidence DOUBLE"
    old = spark.createDataFrame([(0, "9", "Rio Branco", "rio branco", 0.9), (1, "4", "Lagoa", "lagoa", 0.8)], schema)
    new = spark.createDataFrame([(0, None, "Rio Branco", "R. Branco", 0.7), (1, None, "Lago", "lagoa", 0.6)], schema)
    got = {r.variant_name: r for r in dictionary.upsert_dictionary(old, new).collect()}
    assert got["R. Branco"].canonical_id == got["rio branco"].canonical_id == "1"
    assert (got["lagoa"].canonical_name, got["lagoa"].canonical_id, got["lagoa"].variant_id) == ("Lago", "3", "2")
    assert len(got) == 3


def test_root_upsert(spark):
    schema = "ord BIGINT, root STRING, regex_token STRING"
    old = spark.createDataFrame([(0, "igarape", "igarap[eé]"), (1, "lagoa", "lagoa")], schema)
    new = spark.createDataFrame([(0, "igarape", "igara?"), (1, "rio", "rio")], schema)
    assert sorted((r.root, r.regex_token) for r in dictionary.upsert_roots(old, new).collect()) == [("igarape", "igara?"), ("lagoa", "lagoa"), ("rio", "rio")]


def test_root_candidates(spark):
    df = names(spark, "Rio Verde", "rio verdes", "Rua Verde", "rua nova", "123 123 x", "rio rio")
    roots = spark.createDataFrame([("RIO",)], "root STRING")
    got = {r.pattern: (r.status, r.n_occurrences, r.n_names) for r in textmine.root_candidates(df, roots).collect()}
    assert got["rio"] == ("known", 4, 3)
    assert got["verde"] == ("unknown", 3, 3) and got["verd"] == ("unknown", 2, 2)
    assert "rua" not in got and "123" not in got


def test_shared_affixes_with_leading_space(spark):
    df = names(spark, "rio a", "rionegro b", " rio c", "porto c", "lago porto")
    got = sorted((r.kind, r.affix, r.n) for r in textmine.shared_affixes(df).collect())
    assert got == [("prefix", "rio", 2), ("suffix", "c", 2)]


def test_history_and_stream_agree(spark):
    data = [(1, 3.0, 5.0, 0.5, {"rio": 0.9, "lago": 0.5}, {"rio": 2, "igarape": 4}), (2, 2.0, 4.0, 0.7, {"rio": 0.8}, {"rio": 3, "lago": 1})]
    df = spark.createDataFrame(data, readers.TRIAL_SCHEMA)
    log, out = scratch(spark, "log"), scratch(spark, "out")
    for row in data:  # one file per append
        sinks.append_trials(spark.createDataFrame([row], readers.TRIAL_SCHEMA), log)
    batch = readers.read_trials(spark, log)
    assert [tuple(r) for r in trials.fp_root_ranking(batch).collect()] == [("rio", 5), ("igarape", 4), ("lago", 1)]
    stats = trials.history_stats(batch).first()
    assert (stats.n_trials, stats.best_score, stats.unique_roots) == (2, 0.7, 2)
    gain = {r.root: r.avg_gain for r in trials.weight_gain(df.withColumnRenamed("id", "trial_id")).collect()}
    assert gain == {"rio": pytest.approx(0.05), "lago": pytest.approx(0.5)}
    stream.run_to_table(stream.stream_trials(spark, log, max_files=1), out, scratch(spark, "ckpt"))
    assert sorted((r.root, r.n_fp) for r in spark.read.parquet(out).collect()) == [("igarape", 4), ("lago", 1), ("rio", 5)]


def test_kmz_files(spark, tmp_path):
    ns = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{}</Document></kml>'
    mark = "<Placemark>{}<Point><coordinates>{}</coordinates></Point></Placemark>"
    docs = {"acre_sites.kmz": ns.format(mark.format("<name>A</name>", "-67.5,-10.5,0") + mark.format("", "-67.6,-10.6")),
            "xingu.kml": f"<kml>{mark.format('<name>X</name>', ' -53.1,-12.1 ')}</kml>",
            "bad.kmz": ns.format(mark.format("<name>B</name>", "east,north"))}
    for name, doc in docs.items():
        if name.endswith(".kmz"):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr("doc.kml", doc)
            (tmp_path / name).write_bytes(buf.getvalue())
        else:
            (tmp_path / name).write_text(doc)
    got = sorted((r.site_name, r.lon, r.lat, r.culture_tag, r.discovery_year) for r in placemarks.read_placemarks(spark, str(tmp_path)).collect())
    assert got == [("A", -67.5, -10.5, "acre", 2015), ("X", -53.1, -12.1, "kuhikugu", 2015), ("site_001", -67.6, -10.6, "acre", 2015)]


def test_sites_csv_without_names(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Latitude,LNG,year\n-10.5,-67.0,1\n,-60,2\n-9.0,-66.0,3\n")
    got = sorted((r.site_name, r.lat, r.lon) for r in readers.read_sites(spark, str(tmp_path / "s.csv")).collect())
    assert got == [("Site_0", -10.5, -67.0), ("Site_1", -9.0, -66.0)]


def test_feature_cache_builds_once(spark):
    root, built = scratch(spark, "cache"), []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.precompute_cached(spark, root, {"a": 1}, build).count() == 3
    assert len(built) == 1


def test_merge_sites(spark):
    df = spark.createDataFrame([(1, "A", -10.0, -60.0, "acre"), (2, "B", -10.0010, -60.0, "acre"), (3, "C", -10.0021, -60.0, "x"), (4, "D", -11.0, -60.0, "y")],
                               "site_id BIGINT, site_name STRING, lat DOUBLE, lon DOUBLE, culture_tag STRING")
    got = components.merge_sites(components.cluster_sites(df)).orderBy("cluster_id").collect()
    assert [(r.site_name, r.n_merged_sites) for r in got] == [("A_cluster0", 3), ("D", 1)]
    members = components.cluster_members(components.cluster_sites(df)).orderBy("ord").collect()
    assert [(r.cluster_id, r.ord, r.original_name) for r in members] == [(0, 1, "A"), (0, 2, "B"), (0, 3, "C"), (1, 4, "D")]
    assert aggregates.merge_summary(components.merge_sites(components.cluster_sites(df))).first().reduction_count == 2


def test_failures_need_enough_candidates(spark, ranked):
    c = ranked.withColumns({"dist_km": F.lit(9.0)})
    assert failures.dense_cells(c).count() == 0
    assert [tuple(r) for r in failures.fragmentation(c).collect()] == [("root_fragmentation", "unique_patterns", 3, "medium")]


def test_diversity_of_equal_and_empty_sets(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["c"]), (4, []), (5, [])], "prop_id BIGINT, actions ARRAY<STRING>")
    got = {r.prop_id: r.diversity_score for r in failures.jaccard_diversity(df).collect()}
    assert got == {1: pytest.approx(0.75), 2: pytest.approx(0.75), 3: 1.0, 4: 1.0, 5: 1.0}


def test_embeddings_are_unit_vectors_fixed_by_text(spark):
    df = names(spark, "rio branco", "serra", "rio branco", "")
    e = [r.e for r in df.withColumn("e", vectors.hash_embedding(32)("name")).orderBy("ord").collect()]
    assert e[0] == e[2] and e[0] != e[1]
    assert all(math.isclose(sum(x * x for x in v), 1.0) for v in e)


def test_leave_one_out_excludes_the_row(spark):
    pts = [(i, f"s{i}", [float(i % 3), float(i // 3)]) for i in range(9)] + [(9, "far", [50.0, 50.0])]
    df = spark.createDataFrame(pts, "id BIGINT, name STRING, v ARRAY<DOUBLE>")
    got = {r.name: r for r in similarity.loo_scores(df, trees=20).collect()}
    assert got["far"].knn_score < 1e-20 and got["far"].cluster_score < 1e-20
    assert got["s4"].knn_score == pytest.approx(math.exp(-1.0))
    assert all(0 <= r.anomaly_score <= 1 for r in got.values())


def test_scores_against_known_sites(spark):
    train = spark.createDataFrame([(i, "k", [float(i % 4), float(i // 4)]) for i in range(16)], "id BIGINT, name STRING, v ARRAY<DOUBLE>")
    test = spark.createDataFrame([(100, "near", [1.5, 1.5]), (101, "off", [30.0, -30.0])], "id BIGINT, name STRING, v ARRAY<DOUBLE>")
    got = {r.name: r for r in similarity.similarity_scores(test, train).collect()}
    for s in ("knn_score", "cluster_score", "log_likelihood", "anomaly_score", "composite_score"):
        assert got["near"][s] > got["off"][s]


def test_scale_does_what_leads_to_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(50).select(F.col("id").cast("double").alias("a")).mapInPandas(run, "a DOUBLE")
    assert similarity.scale(df, ["a"]).count() == 50
    assert seen.value == 50


def test_scaler_of_constant_column(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "a DOUBLE, b DOUBLE")
    got = similarity.scale(df, ["a", "b"]).collect()
    assert [r.b for r in got] == [0.0, 0.0, 0.0]
    assert sum(r.a for r in got) == pytest.approx(0.0)


def test_rank_is_distributed_and_total(spark):
    df = spark.range(1000).withColumn("s", F.lit(1.0))
    got = ordered.rank_by(df, "s", "id").collect()
    assert sorted((r["rank"], r.id) for r in got) == [(i + 1, i) for i in range(1000)]


def test_process_names_flags(spark):
    out = flows.process_names(names(spark, "Rio Branco", "Serra Alta"), dim=64).collect()
    assert len(out) == 2 and all(0.0 <= r.confidence <= 1.0 and r.needs_review == (r.confidence < 0.85) for r in out)


def test_river_polar_picks_by_haversine(spark):
    p = spark.createDataFrame([(1, 0.0, 60.0), (2, 0.0, -80.0)], "id INT, lon DOUBLE, lat DOUBLE")
    # at 60 degrees north 0.30 degrees east is nearer on the ground than 0.25 degrees north
    r = spark.createDataFrame([(1, 10, 0.3, 60.0, 0.3, 60.0), (2, 20, 0.0, 60.25, 0.0, 60.25)],
                              "river_id INT, main_riv INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {x.id: x for x in spatial.river_polar(p, r, 50.0).collect()}
    assert got[1].nearest_river == 10 and got[1].river_angle == pytest.approx(90.0)
    assert got[2].river_radius is None


def test_ranks_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    from toposcan.operators import ordered as o

    df = spark.range(3_000).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("g"))
    few = {r.id: r["rank"] for r in o.ordered(df, "x", "id").collect()}
    grouped = {r.id: r["rank"] for r in o.ordered(df, "x", "id", by=["g"]).collect()}
    assert len(grouped) == 3_000 and sorted(grouped[i] for i in grouped if i % 3 == 0) == list(range(1, 1_001))
    monkeypatch.setattr(o, "BUCKET_ROWS", 40)
    assert o._splits_for(3_000) == 75 > o.SPLITS
    many = o.ordered(df, "x", "id")
    assert {r.id: r["rank"] for r in many.collect()} == few
    assert {r.id: r["rank"] for r in o.ordered(df, "x", "id", by=["g"]).collect()} == grouped
    small, large = (sorted(map(tuple, o.quantiles(df, "x", {"q": 0.3}, ["g"], max_group=m).collect()), key=str) for m in (10_000, 0))
    assert small == large and len(small) == 6


def test_quality_of_any_labels(spark):
    pts = [(i, [0.0, float(i)]) for i in range(4)] + [(i, [9.0, float(i)]) for i in range(4, 8)]
    make = lambda a, b: spark.createDataFrame([(i, a if i < 4 else b, v) for i, v in pts], "id BIGINT, label INT, v ARRAY<DOUBLE>")
    first, second = (similarity.cluster_quality(make(*x)).first() for x in ((0, 1), (-1, 70_000)))
    assert first.silhouette > 0.6 and tuple(first) == pytest.approx(tuple(second))


def test_splits_round_the_validation_part_up(spark):
    one = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4)], "site_id BIGINT, culture_tag STRING")
    assert sampling.stratified_split(one, 0.3).filter("split = 'val'").count() == 2
    skew = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "site_id BIGINT, culture_tag STRING")
    assert sorted(map(tuple, sampling.stratified_split(skew, 0.25).groupBy("culture_tag", "split").count().collect())) == [("a", "train", 5), ("a", "val", 2), ("b", "train", 2), ("b", "val", 1)]


def test_negative_samples_are_as_many_as_wanted(spark):
    one = spark.createDataFrame([(-60.0, -10.0)], "lon DOUBLE, lat DOUBLE")
    box = (-60.02, -10.02, -59.98, -9.98)
    assert sampling.negative_samples(one, box, ratio=6, min_km=2.0, max_attempts=2).count() == 6


def test_trial_patterns_without_a_completed_trial(spark):
    df = spark.createDataFrame([(1, "failed", None, 3)], "trial_id BIGINT, status STRING, score DOUBLE, n_candidates BIGINT")
    assert trials.trial_patterns(df).first().convergence_issues is True


def test_weights_need_a_closed_fence_and_tokens_the_engines_dialect(spark):
    df = spark.createDataFrame([(1, '```json\n{"weights": {"rio": 0.5}}'), (2, '```json\n{"weights": {"rio": 0.5, "x": "0.3"}}\n```')], "k BIGINT, t STRING")
    assert [tuple(r) for r in validate.parse_weights(df, "t", ["k"]).collect()] == [(2, "rio", 0.5)]
    roots = spark.createDataFrame([("a", "(?P<n>rio)", "por"), ("b", "rio|igarap[eé]", "por"), ("c", "(rio", "por"), ("d", "r{,3}", "por")], "root STRING, regex_token STRING, lang STRING")
    assert {r.root: bool(r.errors) for r in validate.validate_roots(roots).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_pairs_across_the_date_line(spark):
    a = spark.createDataFrame([(1, 179.99, 5.0), (2, -179.99, 5.0), (3, 0.0, 5.0)], "site_id BIGINT, lon DOUBLE, lat DOUBLE")
    assert [(r.a, r.b) for r in spatial.close_pairs(a, 3_000.0).collect()] == [(1, 2)]
    t = a.withColumnRenamed("site_id", "feature_id").filter("feature_id = 2")
    near = spatial.toponyms_around(a.filter("site_id = 1"), t, 3.0).collect()
    assert len(near) == 1 and near[0].distance_km == pytest.approx(2.22, abs=0.02)


def test_unreadable_files_are_named(spark):
    files = spark.createDataFrame([("a.kml", bytearray(b"<kml></kml>")), ("b.kmz", bytearray(b"PK\x03\x04 broken")), ("c.kml", bytearray(b"<kml>"))], "path STRING, content BINARY")
    assert {r.path for r in placemarks.unreadable_files(files).collect()} == {"b.kmz", "c.kml"}


def test_recent_trials_with_and_without_scores(spark):
    rows = [(i, None if i > 10 else float(i)) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "trial_id BIGINT, score DOUBLE")
    scored, every = trials.recent_vs_earlier(df).first(), trials.recent_vs_earlier(df, scored_only=False).first()
    assert (scored.recent_best, scored.earlier_best, every.recent_best, every.earlier_best) == (10.0, 5.0, 10.0, 7.0)


def test_tokens_are_checked_in_the_engines_dialect(spark):
    tokens = ["rio", "(?<name>rio)", r"\\p{L}+", "(?a)rio", "(?P<n>rio)", "a{,3}", "[", "(", "x*+", "(?i)rio", r"\\Qa[\\E", "(?(1)a|b)", "(?<=a+)b", r"\\h", "a**", "[[:alpha:]]", r"\\z", r"\\Z", "日+"]
    tokens = [t.replace("\\\\", "\\") for t in tokens]
    df = spark.createDataFrame([(t, t, "tupi") for t in tokens], "root STRING, regex_token STRING, lang STRING")
    got = {r.root: not any("regular expression" in e for e in r.errors) for r in validate.validate_roots(df).collect()}
    for t in tokens:
        try:
            spark.range(1).select(F.lit("a rio").rlike(t)).collect()
            runs = True
        except Exception:
            runs = False
        assert got[t] == runs, t
    assert got["(?<name>rio)"] and not got["(?a)rio"] and not got["["]


def test_feature_cache_sees_changed_rows(spark):
    root, built = scratch(spark, "cache"), []
    make = lambda *rows: spark.createDataFrame(rows, "id BIGINT, m MAP<STRING, INT>").repartition(3)

    def total(df):
        return sinks.precompute_cached(spark, root, {"a": 1}, lambda: built.append(1) or df.agg(F.sum("id").alias("s")), [df]).first().s

    first = [(1, {"x": 1, "y": 2}), (2, None)]
    assert total(make(*first)) == 3 and total(make(*reversed(first))) == 3 and len(built) == 1
    assert total(make((1, {"y": 2, "x": 1}), (2, None))) == 3 and len(built) == 1
    assert total(make((1, {"x": 1, "y": 2}), (4, None))) == 5 and total(make(*first, first[1])) == 5 and len(built) == 3


def test_names_in_other_scripts(spark):
    told = {"Москва Река": "moskva reka", "Αθήνα": "athena", "Щука-ручей": "shchuka-ruchei", "Ёлка": "iolka", "Больше": "bol she", "Ψαράς Θ": "psaras th", "São ß": "sao ss", "日本": ""}
    df = spark.createDataFrame([(k,) for k in told], "name STRING")
    got = {r.name: r.n for r in df.select("name", text.normalize_name(F.col("name")).alias("n")).collect()}
    assert got == told


def test_river_polar_at_all_latitudes(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(-60, -50), rng.choice([rng.uniform(-12, -8), rng.uniform(55, 62), rng.uniform(80, 84)])) for i in range(120)]
    segs = []
    for j in range(160):
        x, y = rng.uniform(-60, -50), rng.choice([rng.uniform(-12, -8), rng.uniform(55, 62), rng.uniform(80, 84)])
        segs.append((j, j * 10, x, y, x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3)))
    p = spark.createDataFrame(pts, "id INT, lon DOUBLE, lat DOUBLE")
    r = spark.createDataFrame(segs, "river_id INT, main_riv INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {x.id: (x.nearest_river, x.river_radius) for x in spatial.river_polar(p, r, 50.0).collect()}
    hav = lambda a, b, c, d: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    for i, lon, lat in pts:
        best = None
        for j, main, x1, y1, x2, y2 in segs:
            n = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = min(1.0, max(0.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / n))
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            if math.hypot(lon - x, lat - y) <= 50 / 111.0 and (km := hav(lat, lon, y, x)) <= 50 and (best is None or km < best[1]):
                best = (main, km)
        assert got[i] == (pytest.approx(best) if best else (None, None)), i


# ---- copies of a place ---------------------------------------------------------------------------

SQUARE = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0D, 'y', 4D), named_struct('x', 4D, 'y', 4D), named_struct('x', 4D, 'y', 0D))"


@pytest.fixture
def tiles(spark):
    """Three tiles over the same four centres, one of them outside the square; one value is missing."""
    return spark.sql("SELECT tile, row, 0 AS col, 1.0D AS cx, row * 1.5D + 0.5D AS cy, IF(tile = 2 AND row = 1, NULL, 1e6D + tile * 10D + row) AS value "
                     "FROM range(3) t(tile), range(4) r(row)")


@pytest.fixture
def looked_up(monkeypatch):
    """Numbers of points and polygons that each call of points_within gets."""
    seen, kernel = [], spatial.points_within

    def counted(points, polys, *rest):
        seen.append((points.count(), polys.count()))
        return kernel(points, polys, *rest)

    monkeypatch.setattr(spatial, "points_within", counted)
    return seen


def test_clip_looks_up_a_centre_once(spark, rows, tiles, looked_up):
    polys = spark.sql(f"SELECT {SQUARE} AS ring FROM range(5)")
    got = rows(grid.clip_cells(tiles, polys, 2.0), "tile", "row", "value")
    assert got == rows(tiles.withColumn("value", F.expr("IF(row = 3, 0D, value)")), "tile", "row", "value")
    assert looked_up == [(4, 1)]


def test_zonal_stats_look_up_a_centre_once(spark, tiles, looked_up):
    polys = spark.sql(f"SELECT 7 AS id, {SQUARE} AS ring")
    got = grid.zonal_stats(tiles, polys, "id", 2.0).first()
    inside = [1e6 + t * 10 + r for t in range(3) for r in range(3) if (t, r) != (2, 1)]
    assert (got.id, got.min, got.max, got["sum"], got["count"]) == (7, min(inside), max(inside), sum(inside), 8)
    assert (got["mean"], got["std"]) == pytest.approx((np.mean(inside), np.std(inside)), rel=1e-12)
    assert looked_up == [(4, 1)]


@pytest.fixture
def met(monkeypatch):
    """Pairs of packs that each join of places forms; packs of three rows, tasks of four pairs."""
    seen, kernel = [], spatial.meet

    def counted(left, right):
        seen.append(kernel(left, right).count())
        return kernel(left, right)

    monkeypatch.setattr(spatial, "meet", counted)
    monkeypatch.setattr(spatial, "PACK_ROWS", 3)
    monkeypatch.setattr(spatial, "TASK_PAIRS", 4)
    return seen


@pytest.fixture
def crowd(spark):
    """Forty rows at one place, two at another 1.1 km off and one far away; one without a place."""
    at = [(i, -60.0, -10.0) for i in range(40)] + [(40, -60.0, -10.01), (41, -60.0, -10.01), (42, -61.0, -10.0), (43, None, -10.0)]
    return spark.createDataFrame(at, "id BIGINT, lon DOUBLE, lat DOUBLE")


def test_points_within_polygons_by_place(crowd, met):
    rings = crowd.sparkSession.sql("SELECT k, array(named_struct('x', -60.5D, 'y', -10.5D), named_struct('x', -60.5D, 'y', -9.5D), named_struct('x', -59.5D, 'y', -9.5D), "
                                   "named_struct('x', -59.5D, 'y', -10.5D)) AS ring FROM range(2) t(k)")
    got = sorted((r.id, r.k) for r in spatial.points_within(crowd, rings, 0.4).collect())
    assert got == [(i, k) for i in range(42) for k in range(2)]
    assert met[0] <= 30  # of 84 pairs of rows


def test_points_within_boxes_by_place(crowd, met):
    boxes = crowd.sparkSession.sql("SELECT k, -60.5D AS minx, -10.01D AS miny, -59.5D AS maxx, -9.5D AS maxy FROM range(3) t(k)")
    got = spatial.points_within_boxes(crowd, boxes, 0.4)
    assert got.columns == ["id", "lon", "lat", "k", "minx", "miny", "maxx", "maxy"]
    assert sorted((r.id, r.k) for r in got.collect()) == [(i, k) for i in range(40) for k in range(3)]
    assert met[0] <= 30


def test_toponyms_around_by_place(crowd, met):
    sites = crowd.filter("id IN (0, 1, 42, 43)").withColumnRenamed("id", "site_id")
    got = spatial.toponyms_around(sites, crowd, 5.0)
    assert got.columns == ["site_id", "site_lon", "site_lat", "id", "toponym_lon", "toponym_lat", "distance_km"]
    assert sorted((r.site_id, r.id) for r in got.collect()) == [(s, i) for s in (0, 1) for i in range(42)] + [(42, 42)]
    assert all((r.distance_km > 1.0) == (r.id in (40, 41)) for r in got.collect())
    assert met[0] <= 30


def test_close_pairs_by_place(crowd, met):
    got = sorted((r.a, r.b) for r in spatial.close_pairs(crowd, 2_000.0, "id", places=3).collect())
    assert got == [(a, b) for a in range(42) for b in range(a + 1, 42)]
    assert met[0] <= 500  # of 42 * 42 pairs of rows


def test_nearest_toponym_by_place(crowd, rows, met):
    sites = crowd.filter("id IN (5, 41, 42, 43)").withColumnRenamed("id", "site_id")
    got = spatial.nearest_toponym(sites, crowd.withColumn("name", F.concat(F.lit("n"), F.col("id"))), 5.0, "id")
    assert rows(got, "site_id", "id", "name") == [(5, 0, "n0"), (41, 40, "n40"), (42, 42, "n42")]
    assert met[0] <= 6


@pytest.mark.parametrize("pair", [
    lambda c: spatial.toponyms_around(c.withColumnRenamed("id", "site_id"), c, 5.0),
    lambda c: spatial.close_pairs(c, 2_000.0, "id")])
def test_pairs_are_held_by_the_pack(crowd, pair):
    """Rows that generated code makes of one row are held until the last is there: packs are small, and their rows are not written out in the code of the join."""
    got = pair(crowd)
    assert got.count() and got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    code = [re.findall(rf"\*\((\d+)\) {step}", plan)[:1] for step in (r"Generate explode\(_b#", r"Generate explode\(_a#", r"\w+Join")]
    assert all(code) and code[2] not in code[:2] and spatial.PAIR_ROWS**2 <= 5000, code


def test_packs_of_one_column_keep_it_as_it_is(spark, rows):
    """Also nulls, structs and copies; several columns and none beside the place go on as before."""
    at = spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT), 1), (7, 2), (7, 3) AS t(id, n)").select("id", F.struct("n").alias("s"), F.lit(-60.0).alias("lon"), F.lit(-10.0).alias("lat"))
    assert rows(spatial.toponyms_around(at.select("id", "lon", "lat"), at.select("s", "lon", "lat"), 1.0).selectExpr("coalesce(id, -1)", "s.n")) == [
        (-1, 1), (-1, 2), (-1, 3), (7, 1), (7, 1), (7, 2), (7, 2), (7, 3), (7, 3)]
    assert spatial.toponyms_around(at, at.select("lon", "lat").distinct(), 1.0).columns == ["id", "s", "site_lon", "site_lat", "toponym_lon", "toponym_lat", "distance_km"]
    assert rows(spatial.toponyms_around(at, at.select("lon", "lat").distinct(), 1.0).selectExpr("coalesce(id, -1)", "s.n")) == [(-1, 1), (7, 2), (7, 3)]


def test_pattern_counts_of_copies(spark, monkeypatch):
    texts = ["Rios rio verdes 12 verde"] * 3 + ["rio VERDE 123 mata\tmatas", "", "ab cd", None]
    df = spark.createDataFrame([(t,) for t in texts], "name STRING")
    want = {(r.pattern, r.o, r.n) for r in textmine.stem_names(df).groupBy("pattern").agg(F.sum("n").alias("o"), F.count("*").alias("n")).collect()}
    assert ("rio", 7, 2) in want and ("verde", 7, 2) in want
    monkeypatch.setattr(textmine, "stem_names", None)  # no row per word and name
    assert {(r.pattern, r.n_occurrences, r.n_names) for r in textmine.pattern_counts(df).collect()} == want
    textmine.root_candidates(df, spark.createDataFrame([("rio",)], "root STRING")).collect()


def test_shared_affixes_read_only_the_ends(spark, monkeypatch):
    monkeypatch.setattr(text, "words", None)  # texts are not split
    df = names(spark, "Rio a  ", "\tRIO b", "rio\nx ÁGUA", "rios água\n", "água", "", "  ")
    got = sorted((r.kind, r.affix, r.n) for r in textmine.shared_affixes(df).collect())
    assert got == [("prefix", "rio", 3), ("suffix", "a", 2), ("suffix", "água", 2)]


def test_trial_issues_do_not_gather_values_by_name(spark):
    log = spark.range(40).select(F.col("id").alias("trial_id"), (-1.0 - F.col("id")).alias("score"), F.lit(0).alias("n_candidates"), F.lit("completed").alias("status"),
                                 F.create_map(F.lit("d"), F.col("id") % 10 / 100.0).alias("params"))
    bounds = spark.createDataFrame([("d", 0.0, 1.0)], "name STRING, low DOUBLE, high DOUBLE")
    issues = trials.trial_issues(log, bounds)
    got = {r.issue_type: r.value for r in issues.collect()}
    assert got["candidates_zero_dominant"] == 1.0 and got["search_space_too_narrow"] == pytest.approx(0.09)
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(params") == 1  # values are reduced to ranges and not joined to them
    (row,) = trials.param_exploration(log, bounds).collect()
    assert (row.unique_count, row.near_min, row.near_max) == (10, 1.0, 0.0)


def test_drop_correlated_computes_its_input_once(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 7 * 2).alias("b"), F.xxhash64("id").alias("c"))
    out = similarity.drop_correlated(df, ["a", "b", "c"], 0.6)
    assert out.columns == ["id", "a", "c"] and out.count() == 50
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_few_distinct_values_are_not_ranked(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ordered", None)
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") % 20).cast("double").alias("v")).unionByName(spark.sql("SELECT 0L AS g, CAST(NULL AS DOUBLE) AS v"))
    got = {r.g: (r.m, r.q) for r in ordered.quantiles(df, "v", {"m": 0.5, "q": 0.9}, ["g"], max_group=10).collect()}
    assert got == {g: (np.quantile(range(g, 20, 2), 0.5), pytest.approx(np.quantile([x for x in range(g, 20, 2) for _ in range(50)], 0.9))) for g in (0, 1)}
    assert ordered.quantiles(df, "v", {"m": 0.5}, max_group=20).first().m == 9.5


def test_cluster_counts_share_their_distances(spark, monkeypatch):
    rng = random.Random(3)
    data = [(i, [rng.gauss(c * 9.0, 1.0), rng.gauss(0.0, 1.0)]) for i, c in enumerate([0, 1, 2] * 20)]
    vec = spark.createDataFrame(data, "id BIGINT, v ARRAY<DOUBLE>")
    calls, kernel = [], vectors.block_sums
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "block_sums", lambda *a: calls.append(1) or kernel(*a))
    out, k = similarity.cluster_vectors(vec, k_range=(2, 5))
    assert k == 3 and len(calls) == 1
    assert len({(r.id % 3, r.label) for r in out.collect()}) == 3
    two = vec.select("id", "v", (F.col("id") % 2).alias("a"), F.when(F.col("id") < 1, 1).otherwise(0).alias("b"))
    both = {r.labelling: r.silhouette for r in similarity.silhouettes(two.select("id", F.array("a", "b").alias("labels"), "v"), [2, 2]).collect()}
    for i, c in enumerate("ab"):
        assert both[i] == pytest.approx(similarity.silhouette(two.withColumn("label", F.col(c))).first()[0])


def test_distance_grid_by_tiles(spark):
    """Holes, copies, nulls, negative indices and sources across the edges of tiles: as by all pairs, and without a join of cells to each other."""
    rng = random.Random(5)
    cells = [(r, c, rng.choices([1, 0, -2, None], [1, 60, 20, 4])[0]) for r in range(-140, 140, 2) for c in range(100, 160) if rng.random() < 0.8]
    cells += [(r, c, rng.choice([1, 0, None])) for r, c, _ in cells[:300]] + [(5000, 5000, 0), (5001, 5000, None), (None, 3, 1), (None, 3, 0)]
    df = spark.createDataFrame(cells, "row INT, col INT, value INT")
    src = np.array([(r, c) for r, c, v in cells if v is not None and v > 0 and r is not None])
    looked = {(r, c) for r, c, v in cells if v is not None and v <= 0}
    want = []
    for r, c, v in cells:
        if v is not None and v > 0:
            d = 0.0
        elif r is None or (r, c) not in looked:
            d = 40.0
        else:
            d = min(40.0, 5.0 * math.sqrt(((src - (r, c)) ** 2).sum(1).min()))
        want.append((r, c, round(d, 9)))
    out = grid.distance_grid(df, 5.0, 5.0, 40.0)
    got = sorted(((r.row, r.col, round(r.distance, 9)) for r in out.collect()), key=str)
    assert got == sorted(want, key=str)
    assert out.schema["row"].dataType == df.schema["row"].dataType
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = grid.distance_grid(df.filter("value <= 0"), 5.0, 5.0, 40.0)
    assert {r.distance for r in none.collect()} == {40.0}
