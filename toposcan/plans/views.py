"""Inputs of the catalogue, derived from the given tables.

Each view is one SELECT that Spark and DuckDB both accept; ``{name}`` stands for
a table or another view. Spark binds DataFrames to the names, the oracle gets a
chain of CTEs. Every view covers the whole of its tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


NAME_PREFIX = ("CASE o_orderkey % 8 WHEN 0 THEN 'Rio' WHEN 1 THEN 'Igarapé' WHEN 2 THEN 'Lagôa' WHEN 3 THEN 'Ramal' "
               "WHEN 4 THEN 'Porto' WHEN 5 THEN 'Fazenda' WHEN 6 THEN 'Rua' ELSE 'Paraná' END")

VIEWS = {
    # map features: multilingual names, optional tags, explicit order
    "v_feature": f"""
        SELECT o_orderkey AS feature_id, concat({NAME_PREFIX}, ' ', o_orderpriority) AS name,
               -74 + (o_orderkey * 7919 % 14000) / {d(1000)} AS lon,
               -15 + (o_orderkey * 104729 % 10000) / {d(1000)} AS lat,
               CASE WHEN o_orderkey % 11 = 0 THEN 'stream' END AS waterway, o_orderkey AS ord
        FROM {{orders}}""",
    # one river segment per supplier
    "v_river": f"""
        SELECT s_suppkey AS river_id, 1 + s_suppkey % 5 AS ord_stra, s_suppkey % 17 AS main_riv,
               -74 + (s_suppkey * 7727 % 14000) / {d(1000)} AS x1, -15 + (s_suppkey * 15731 % 10000) / {d(1000)} AS y1,
               -74 + (s_suppkey * 7727 % 14000) / {d(1000)} + (s_suppkey * 31 % 400 - 200) / {d(1000)} AS x2,
               -15 + (s_suppkey * 15731 % 10000) / {d(1000)} + (s_suppkey * 53 % 400 - 200) / {d(1000)} AS y2
        FROM {{supplier}}""",
    # known sites: one per customer, a few hundred metres from some feature
    "v_site": f"""
        SELECT c_custkey AS site_id, concat('Site_', CAST(c_custkey AS VARCHAR(20))) AS site_name,
               -74 + (c_custkey * 79190 % 14000) / {d(1000)} + (c_custkey % 7 - 3) / {d(1000)} AS lon,
               -15 + (c_custkey * 1047290 % 10000) / {d(1000)} + (c_custkey % 5 - 2) / {d(1000)} AS lat,
               CASE c_custkey % 3 WHEN 0 THEN 'acre' WHEN 1 THEN 'marajo' ELSE 'casarabe' END AS culture_tag,
               CAST(1990 + c_custkey % 34 AS INT) AS discovery_year, c_acctbal AS acctbal
        FROM {{customer}}""",
    # candidates: features with a distance, an occurrence and a root
    "v_cand": f"""
        SELECT o_orderkey AS cand_id, concat({NAME_PREFIX}, ' ', o_orderpriority) AS name,
               -74 + (o_orderkey * 7919 % 14000) / {d(1000)} AS lon,
               -15 + (o_orderkey * 104729 % 10000) / {d(1000)} AS lat,
               CASE o_orderkey % 8 WHEN 0 THEN 'rio' WHEN 1 THEN 'igarape' WHEN 2 THEN 'lagoa' WHEN 4 THEN 'porto'
                    WHEN 7 THEN 'parana' ELSE 'outro' END AS root,
               CAST(o_totalprice AS DOUBLE) / {d(39971)} AS dist_km,
               {d("o_orderkey * 37 % 1000")} / {d(20)} AS occ_pct
        FROM {{orders}}""",
    # toponyms around sites in polar form: one per line item, sites keyed by supplier
    "v_site_toponym": f"""
        SELECT concat('Site_', CAST(l_suppkey AS VARCHAR(20))) AS site_name,
               concat(CASE l_linenumber WHEN 1 THEN 'Rio' WHEN 2 THEN 'Mata' WHEN 3 THEN 'Vila' WHEN 4 THEN 'Rua'
                      WHEN 5 THEN 'Fazenda' WHEN 6 THEN 'Torre' ELSE 'Xis' END, ' ', l_returnflag) AS toponym_name,
               {d("(l_orderkey * 7 + l_partkey * 31) % 5003")} / {d(1009)} AS radius,
               {d("(l_partkey * 37 + l_orderkey * 11) % 3600")} / {d(10)} AS angle,
               CASE WHEN l_orderkey % 29 <> 0 THEN {d("(l_orderkey * 3 + l_partkey) % 977")} / {d(17)} END AS river_radius,
               CASE WHEN l_orderkey % 29 <> 0 THEN {d("l_orderkey * 13 % 3600")} / {d(10)} END AS river_angle,
               l_suppkey % 17 AS nearest_river, l_suppkey % 5 AS culture,
               {d("l_suppkey % 100")} / {d(10)} - 15 AS site_lat, {d("l_suppkey * 7 % 140")} / {d(10)} - 74 AS site_lon
        FROM {{lineitem}}""",
    # optimisation trials
    "v_trial": f"""
        SELECT event_id AS trial_id, {d("0.5")} + event_id % 30 * {d("0.5")} AS distance_km,
               {d("0.5")} + event_id % 40 * {d("0.5")} AS occ_pct,
               CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 130 END AS n_candidates,
               value / {d(500)} - {d("0.05")} AS score,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN event_type = 'error' THEN concat('error ', CAST(event_id % 7 AS VARCHAR(20))) END AS error_message,
               {d("event_id % 600")} / {d(10)} AS duration, event_id % 8 AS root_no, {d("user_id % 91")} / {d(97)} + {d("0.1")} AS weight
        FROM {{events}}""",
    # a raster of 0.1 degree cells, in tiles of 140 x 100 cells; 255 is nodata
    "v_cell": f"""
        SELECT CAST(floor(o_orderkey / {d(14000)}) AS INT) AS tile,
               CAST(floor((o_orderkey % 14000) / {d(140)}) AS INT) AS row, CAST(o_orderkey % 140 AS INT) AS col,
               CASE WHEN o_orderkey % 23 = 0 THEN {d(255)} ELSE {d("o_orderkey * 31 % 101")} END AS value
        FROM {{orders}}""",
    # one planar grid, 150 columns wide, no holes
    "v_grid": f"""
        SELECT CAST(floor(o_orderkey / {d(150)}) AS INT) AS row, CAST(o_orderkey % 150 AS INT) AS col,
               CAST(o_totalprice AS DOUBLE) / {d(997)} AS value, o_custkey % 5 AS kind
        FROM {{orders}}""",
    # an ensemble: one member per line number, cells keyed by order
    "v_member": f"""
        SELECT l_linenumber AS member, CAST(floor(l_orderkey / {d(150)}) AS INT) AS row,
               CAST(l_orderkey % 150 AS INT) AS col, sum(CAST(l_quantity AS DOUBLE)) AS value
        FROM {{lineitem}} GROUP BY l_linenumber, l_orderkey""",
    # root dictionary from the parts table: names with a language, a token and meanings
    "v_root": f"""
        SELECT p_partkey AS ord, split_part(p_name, ' ', 2) AS root,
               CASE p_partkey % 4 WHEN 0 THEN 'por' WHEN 1 THEN 'tup' WHEN 2 THEN 'araw' ELSE 'xx' END AS lang,
               CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS regex_token,
               CASE p_partkey % 3 WHEN 0 THEN 'small river' WHEN 1 THEN 'hill' ELSE 'Lake side' END AS meaning_en,
               CASE p_partkey % 5 WHEN 0 THEN '川' WHEN 1 THEN '山' ELSE '村' END AS meaning_ja,
               lower(p_type) AS category
        FROM {{part}}""",
    # toponym dictionary from conversations: conversation -> canonical, text -> variant, turn -> order
    "v_dict": f"""
        SELECT conv_id * 1000 + turn AS ord, CASE WHEN conv_id % 11 = 3 THEN NULL ELSE conv_id END AS canonical_id, concat('name_', CAST(conv_id % 40 AS VARCHAR(20))) AS canonical_name,
               text AS variant_name, role AS root,
               CASE conv_id % 3 WHEN 0 THEN 'por' WHEN 1 THEN 'tup' ELSE 'mixed' END AS lang,
               CASE WHEN turn % 6 = 5 THEN 'n/a' WHEN turn % 6 = 4 THEN '1.5'
                    ELSE concat('0.', CAST(1 + conv_id % 9 AS VARCHAR(20))) END AS confidence
        FROM {{conversations}}""",
    # names: whole document texts
    "v_name": "SELECT doc_id AS ord, text AS name, lang, source FROM {documents}",
    # short names: part names with their key
    "v_word": "SELECT p_partkey AS ord, p_name AS name, p_brand AS brand, p_size AS size FROM {part}",
    # binary classification
    "v_binary": f"""
        SELECT doc_id AS id, quality AS truth, (n_chars % 997) / {d(997)} AS score, toxic,
               {d("n_chars")} / {d(1000)} AS y_true, {d("n_chars + doc_id % 13")} / {d(1000)} AS y_pred
        FROM {{labels}} JOIN {{documents}} USING (doc_id)""",
    # trial log lines
    "v_log": """
        SELECT event_id AS line_no,
               CASE event_type WHEN 'error' THEN concat('ERROR: ', props) WHEN 'signup' THEN concat('WARNING ', props)
                    WHEN 'view' THEN concat('params distance_km=', CAST(event_id % 20 AS VARCHAR(20)))
                    ELSE concat('[I 2025-06-23 23:07:36,744] Trial ', CAST(event_id AS VARCHAR(20)), ' finished with value: ',
                                CAST(value AS VARCHAR(20)), '.') END AS line
        FROM {events}""",
    # improvement proposals: one per event
    "v_prop": """
        SELECT event_id AS prop_id, concat('P', CAST(event_id AS VARCHAR(20))) AS title, event_type, user_id, value
        FROM {events}""",
}


def _refs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() * 2 <= cores:
        # long texts in a single row group would be read and split by one task
        df = df.repartition(cores, "doc_id")
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a given table) as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{r: view(spark, sf_dir, r) for r in _refs(text)})


def oracle(sql: str) -> str:
    """Expand ``{view}`` references of an oracle query to CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for r in _refs(VIEWS[name]):
                visit(r)
            order.append(name)

    for r in _refs(sql):
        visit(r)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    body = plain(sql).strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
