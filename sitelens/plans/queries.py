"""The engine's operators as queries over the test tables, each with SQL that gives the same rows.

Adapter views let the star-schema tables play atoms, sites, scores and metadata; see the functions named ``v_``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import binning, clusters, density, filters, partitions, resampling, spatial, stats
from ..shared import kept
from ..sources import readers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            for v in used:  # grows as it goes
                used += [x for x in VIEWS if re.search(rf"\b{x}\b", VIEWS[v]) and x not in used]
            ctes = [f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in used]
            body = sql.strip()
            if ctes and body.upper().startswith("WITH RECURSIVE"):
                body = "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[14:]
            elif ctes and body.upper().startswith("WITH"):
                body = "WITH " + ", ".join(ctes) + ", " + body[4:]
            elif ctes:
                body = "WITH " + ", ".join(ctes) + " " + body
            ORACLE_SQL[name] = body
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


VIEWS = {
    "v_points": """
SELECT vec_id AS id, 's' || CAST(vec_id % 25 AS VARCHAR) AS pdb_id, round(CAST(embedding[1] AS DOUBLE) * 10, 4) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 4) AS y,
  round(CAST(embedding[3] AS DOUBLE) * 10, 4) AS z, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster_id, round(CAST(embedding[4] AS DOUBLE) * 10, 4) AS b_factor FROM embeddings""",
    "v_members": """
SELECT p.*, cluster_id >= 0 AND sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) <= 2.0 AS within_cutoff
FROM v_points p JOIN (SELECT cluster_id, avg(x) cx, avg(y) cy, avg(z) cz FROM v_points GROUP BY 1) c USING (cluster_id)""",
    "v_clusters": """
SELECT cluster_id, avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z, stddev_pop(x) AS std_x, stddev_pop(y) AS std_y, stddev_pop(z) AS std_z,
  count(DISTINCT CASE WHEN within_cutoff THEN pdb_id END) / 25.0 AS cluster_occupancy, count(*) FILTER (NOT within_cutoff) AS n_radius_rejected
FROM v_members WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) FILTER (within_cutoff) > 0""",
    "v_centers": "SELECT cluster_id, center_x AS cx, center_y AS cy, center_z AS cz FROM v_clusters WHERE cluster_occupancy >= 0.3",
    "v_pr": """
SELECT pdb_id, num_water, coalesce(p / num_water, 0) AS "precision", coalesce(c / n, 0) AS recall,
  CASE WHEN coalesce(p, 0) + coalesce(c, 0) > 0 THEN 2 * (p / num_water) * (c / n) / (p / num_water + c / n) ELSE 0 END AS f1
FROM (SELECT pdb_id, CAST(count(*) AS DOUBLE) AS num_water FROM v_points GROUP BY 1)
LEFT JOIN (SELECT pdb_id, CAST(count(DISTINCT id) AS DOUBLE) AS p, CAST(count(DISTINCT v_centers.cluster_id) AS DOUBLE) AS c FROM v_points, v_centers WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= 4.0 GROUP BY 1) USING (pdb_id),
(SELECT CAST(count(*) AS DOUBLE) AS n FROM v_centers)""",
    "v_meta": """
SELECT o_orderkey AS pdb_id, o_orderpriority AS space_group, o_totalprice / 100000.0 AS resolution, 50 + (o_custkey % 97) / 10.0 AS cell_a, 60 + (o_custkey % 89) / 10.0 AS cell_b, 70 + (o_orderkey % 83) / 10.0 AS cell_c FROM orders""",
    "v_split": "SELECT l_orderkey AS unit, l_linestatus AS cohort, l_returnflag = 'R' AS lft, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount FROM lineitem WHERE l_returnflag <> 'A'",
    "v_labels": "SELECT vec_id AS id, label AS a, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS b FROM embeddings",
}


def v_points(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    at = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double") * 10, 4)
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), (F.col("vec_id") % 25).cast("string")).alias("pdb_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("cluster_id"), at(3).alias("b_factor"))


def v_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.members(v_points(spark, d), 2.0)


def v_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.table(v_members(spark, d), 25)


def v_centers(spark: SparkSession, d: str) -> DataFrame:
    return clusters.consensus_centers(v_clusters(spark, d), 0.3)


def v_pr(spark: SparkSession, d: str) -> DataFrame:
    return spatial.coverage(v_points(spark, d), v_centers(spark, d), 2.0, ["pdb_id"], "id", "cluster_id")


def v_meta(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("pdb_id"), F.col("o_orderpriority").alias("space_group"), (F.col("o_totalprice") / 100000.0).alias("resolution"), (50 + (F.col("o_custkey") % 97) / 10.0).alias("cell_a"), (60 + (F.col("o_custkey") % 89) / 10.0).alias("cell_b"), (70 + (F.col("o_orderkey") % 83) / 10.0).alias("cell_c"))


def v_split(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").where("l_returnflag <> 'A'")
    return x.select(F.col("l_orderkey").alias("unit"), F.col("l_linestatus").alias("cohort"), (F.col("l_returnflag") == "R").alias("lft"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount"))


def v_labels(spark: SparkSession, d: str) -> DataFrame:
    i, a = F.col("vec_id"), F.col("label")
    return t(spark, d, "embeddings").select(i.alias("id"), a.alias("a"), F.when(i % 5 == 0, (a + 1) % 10).when(i % 11 == 0, -1).otherwise(a).alias("b"))


# sources and scalar functions


@query("cohort_dedupe", r"""
WITH l AS (SELECT lang AS cohort, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents
), n AS (SELECT cohort, doc_id * 1000000 + k AS pos, lower(string_split(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')[1], '_')[1]) AS pdb_id FROM l WHERE NOT starts_with(trim(line), '#'))
SELECT cohort, min(pos) AS pos, pdb_id FROM n WHERE coalesce(pdb_id, '') <> '' GROUP BY cohort, pdb_id
""")  # fmt: skip
def cohort_dedupe(spark, d):
    x = t(spark, d, "documents").select(F.col("lang").alias("cohort"), "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return readers.cohort_ids(x.select("cohort", (F.col("doc_id") * 1000000 + F.col("k")).alias("pos"), "line"))


@query("ins_norm", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN '' ELSE l_returnflag END AS ins_code FROM lineitem
""")  # fmt: skip
def ins_norm(spark, d):
    n = F.col("l_linenumber")
    raw = F.when(n == 1, "?").when(n == 2, "  ").when(n == 3, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.insertion_code(raw).alias("ins_code"))


def _scores(spark, d):
    e = t(spark, d, "events")
    return e.select("user_id", "event_type", "event_id", F.from_json("props", "k int")["k"].cast("double").alias("score"))


@query("json_multimap", """
SELECT user_id, event_type, event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events
""")  # fmt: skip
def json_multimap(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return _scores(spark, d).withColumn("nth", F.row_number().over(w).cast("long"))


@query("json_last", "SELECT user_id, event_type, arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), event_id) AS score FROM events GROUP BY ALL")
def json_last(spark, d):
    return readers.last_scores(_scores(spark, d), ["user_id", "event_type"], "event_id")


@query("positional_pair", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view'),
b AS (SELECT user_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click')
SELECT a.user_id, a.event_id, b.score FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.n = b.n
""")  # fmt: skip
def positional_pair(spark, d):
    sites = t(spark, d, "events").where("event_type = 'view'").select("user_id", "event_id")
    scores = _scores(spark, d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("pos"), "score")
    return filters.attach_in_order(sites, scores, ["user_id"], "event_id", "pos")


@query("pdb_codes", r"""
SELECT page_id, array_to_string(list_distinct_in_order, '|') AS codes FROM (
  SELECT page_id, list_transform(list_filter(list_zip(c, range(1, len(c) + 1)), lambda x: list_position(c, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_in_order
  FROM (SELECT page_id, list_transform(regexp_extract_all(html, '\b([0-9][A-Za-z0-9]{3})\b', 1), lambda x: lower(x)) AS c FROM pages))
""")  # fmt: skip
def pdb_codes(spark, d):
    return t(spark, d, "pages").select("page_id", F.array_join(s.structure_codes("html"), "|").alias("codes"))


@query("starting_model", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 9 + 1 AS VARCHAR) || 'abc' END AS acc,
  CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN 'Free Text' ELSE 'PDB entry ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || 'ABC' END AS txt FROM orders),
c AS (SELECT *, CASE WHEN o_custkey_txt IS NOT NULL THEN o_custkey_txt END AS code FROM (SELECT *, CASE WHEN txt LIKE 'PDB%' THEN lower(right(txt, 4)) END AS o_custkey_txt FROM x))
SELECT o_orderkey, CASE WHEN acc IS NOT NULL AND code IS NOT NULL AND acc <> code THEN 'conflict' WHEN acc IS NOT NULL OR code IS NOT NULL THEN 'ok' WHEN txt IS NOT NULL THEN 'text' ELSE 'missing' END AS status,
  CASE WHEN acc IS NOT NULL AND code IS NOT NULL AND acc <> code THEN acc || ' | ' || code ELSE coalesce(acc, code, lower(txt)) END AS starting_model FROM c
""")  # fmt: skip
def starting_model(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    acc = F.when(k % 3 != 0, F.concat((k % 9 + 1).cast("string"), F.lit("abc")))
    txt = F.when(k % 4 == 1, "Free Text").when(k % 4 > 1, F.concat(F.lit("PDB entry "), (o % 9 + 1).cast("string"), F.lit("ABC")))
    status, value = s.starting_model(F.array(acc), F.array(txt))
    return t(spark, d, "orders").select("o_orderkey", status.alias("status"), value.alias("starting_model"))


@query("first_parseable", """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) ELSE o_totalprice END AS first_number, CASE WHEN o_custkey % 2 = 0 THEN least(CAST(o_custkey AS DOUBLE), o_totalprice) ELSE o_totalprice END AS least_number,
  CASE WHEN o_custkey % 5 = 0 THEN '4.4-4.8' ELSE CAST(o_custkey % 7 AS VARCHAR) || '.5' END AS ph, CASE WHEN o_custkey % 2 = 0 THEN 'a b; c' ELSE 'c' END AS details FROM orders
""")  # fmt: skip
def first_parseable(spark, d):
    k = F.col("o_custkey")
    values = F.array(F.lit("?"), F.when(k % 2 == 0, k.cast("string")).otherwise("nan"), F.lit(None).cast("string"), F.col("o_totalprice").cast("string"))
    ph = s.growth_ph(F.array(F.when(k % 5 != 0, F.concat((k % 7).cast("string"), F.lit(".5"))).otherwise("n/a")), F.array(F.lit(" "), F.lit("4.4-4.8")))
    details = s.joined_details(F.array(F.when(k % 2 == 0, "  a \n b "), F.lit(" "), F.lit("c")))
    return t(spark, d, "orders").select("o_orderkey", s.first_number(values).alias("first_number"), s.least_number(values).alias("least_number"), ph.alias("ph"), details.alias("details"))


@query("ligand_set", "SELECT l_orderkey, coalesce(string_agg(DISTINCT l_shipmode, '|' ORDER BY l_shipmode) FILTER (l_shipmode <> 'HOH'), '') AS ligands FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'HOH' ELSE l_returnflag || l_linestatus END AS l_shipmode FROM lineitem) GROUP BY 1")
def ligand_set(spark, d):
    x = t(spark, d, "lineitem").withColumn("c", F.when(F.col("l_linenumber") == 1, "HOH").otherwise(F.concat("l_returnflag", "l_linestatus")))
    return x.groupBy("l_orderkey").agg(F.collect_set("c").alias("c")).select("l_orderkey", s.ligand_names("c").alias("ligands"))


@query("max_cell_diff", "SELECT pdb_id, round(greatest(200 * abs(cell_a - 55) / (cell_a + 55), 200 * abs(cell_b - 65) / (cell_b + 65), 200 * abs(cell_c - 75) / (cell_c + 75)), 6) AS max_cell_diff FROM v_meta")
def max_cell_diff(spark, d):
    return v_meta(spark, d).select("pdb_id", r6(s.max_cell_diff(["cell_a", "cell_b", "cell_c"], [F.lit(55.0), F.lit(65.0), F.lit(75.0)])).alias("max_cell_diff"))


@query("p_marks", "SELECT o_orderkey, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS sig FROM (SELECT o_orderkey, 1.0 / (o_orderkey + 1) AS p FROM orders)")
def p_marks(spark, d):
    return t(spark, d, "orders").select("o_orderkey", s.stars(1.0 / (F.col("o_orderkey") + 1)).alias("sig"))


@query("rigid_transform", "SELECT id, round(-y + 1.0, 6) AS x, round(x - 2.0, 6) AS y, round(z + 0.5, 6) AS z FROM v_points")
def rigid_transform(spark, d):
    new = s.rigid([0, -1, 0, 1, 0, 0, 0, 0, 1], [1.0, -2.0, 0.5], ["x", "y", "z"])
    return v_points(spark, d).select("id", *[r6(c).alias(a) for c, a in zip(new, "xyz", strict=True)])


# filters


def _atoms_b(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("pdb_id"), "event_id", F.col("event_type").alias("kind"), F.col("value").alias("b_factor"), F.from_json("props", "k int")["k"].cast("double").alias("score"))


_KINDS = {"water": "kind = 'view'", "protein": "kind = 'click'", "all": "kind IN ('view', 'click')"}


def _bfactor_query(kind: str) -> None:
    sql = f"""
WITH a AS (SELECT user_id AS pdb_id, event_id, event_type AS kind, value AS b FROM events), r AS (SELECT pdb_id, avg(b) AS m, stddev_pop(b) AS sd FROM a WHERE {_KINDS[kind]} GROUP BY 1)
SELECT a.pdb_id, a.event_id, round(CASE WHEN sd = 0 THEN 0 ELSE (b - m) / sd END, 6) AS b_factor_zscore, sd = 0 OR coalesce((b - m) / nullif(sd, 0) <= 1.0, false) AS keep FROM a LEFT JOIN r USING (pdb_id) WHERE kind = 'view'
"""

    @query(f"bfactor_zscore_{kind}", sql)
    def run(spark, d):
        a = _atoms_b(spark, d)
        w, p = F.col("kind") == "view", F.col("kind") == "click"
        a = filters.with_reference(a, filters.population(kind, w, p))
        return a.where(w).select("pdb_id", "event_id", r6(filters.zscore()).alias("b_factor_zscore"), filters.keep_bfactor(1.0).alias("keep"))


for _kind in _KINDS:
    _bfactor_query(_kind)


@query("bfactor_abs", "SELECT event_id, value <= 40 AS keep FROM events WHERE event_type = 'view'")
def bfactor_abs(spark, d):
    return _atoms_b(spark, d).where("kind = 'view'").select("event_id", filters.keep_bfactor(40.0, "absolute").alias("keep"))


@query("filter_attrib", """
WITH w AS (SELECT user_id AS pdb_id, value <= 80 AS dk, CAST(json_extract(props, '$.k') AS DOUBLE) >= 20 AS ek, value <= 60 AS bk FROM events WHERE event_type = 'view')
SELECT pdb_id, count(*) AS n_waters_before, count(*) FILTER (NOT dk) AS n_waters_removed_by_distance, count(*) FILTER (dk AND NOT ek) AS n_waters_removed_edia,
  count(*) FILTER (dk AND ek AND NOT bk) AS n_waters_removed_bfactor, count(*) FILTER (dk AND ek AND bk) AS n_waters_remaining FROM w GROUP BY 1
""")  # fmt: skip
def filter_attrib(spark, d):
    w = _atoms_b(spark, d).where("kind = 'view'")
    rules = {"distance": filters.keep_distance("b_factor", 80.0), "edia": filters.keep_score("score", 20.0), "bfactor": filters.keep_bfactor(60.0, "absolute")}
    return filters.filter_report(w, rules, moved=None)


# clusters


@query("cluster_members", "SELECT id, pdb_id, cluster_id, within_cutoff FROM v_members")
def cluster_members(spark, d):
    return v_members(spark, d).select("id", "pdb_id", "cluster_id", "within_cutoff")


_CLUSTER = ["center_x", "center_y", "center_z", "std_x", "std_y", "std_z", "cluster_occupancy"]


@query("clusters", f"SELECT cluster_id, n_radius_rejected, {', '.join(f'round({c}, 6) AS {c}' for c in _CLUSTER)} FROM v_clusters")
def cluster_table(spark, d):
    return rounded(v_clusters(spark, d), *_CLUSTER)


@query("consensus_mask", "SELECT id, within_cutoff AND coalesce(c.cluster_occupancy >= 0.3, false) AS consensus, CASE WHEN within_cutoff AND coalesce(c.cluster_occupancy >= 0.3, false) THEN 'consensus' ELSE 'nonconsensus' END AS grp FROM v_members m LEFT JOIN v_clusters c USING (cluster_id)")
def consensus_mask(spark, d):
    m = clusters.consensus_mask(v_members(spark, d), v_clusters(spark, d), 0.3)
    return m.select("id", "consensus", clusters.consensus_label().alias("grp"))


@query("cluster_sizes", "SELECT cluster_id, count(*) AS size FROM v_points WHERE cluster_id >= 0 GROUP BY 1")
def cluster_sizes(spark, d):
    return clusters.sizes(v_points(spark, d))


@query("noise_stats", "SELECT count(DISTINCT pdb_id) AS n_structures, round(1.0 / count(DISTINCT pdb_id), 6) AS noise_occupancy, count(*) FILTER (cluster_id = -1) AS n_noise FROM v_points")
def noise_stats(spark, d):
    return rounded(clusters.noise_stats(v_points(spark, d)), "noise_occupancy")


@query("radius_pairs", "SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS distance FROM v_points a JOIN v_points b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.64")
def radius_pairs(spark, d):
    p = v_points(spark, d).select("id", "x", "y", "z")
    return spatial.radius_join(p, p, 0.8).where("id_l < id_r").select(F.col("id_l").alias("a"), F.col("id_r").alias("b"), r6("distance").alias("distance"))


@query("precision_recall", 'SELECT pdb_id, CAST(num_water AS BIGINT) AS num_water, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM v_pr')
def precision_recall(spark, d):
    return rounded(v_pr(spark, d), "precision", "recall", "f1")


@query("chamfer", """
WITH q AS (SELECT pdb_id, id, cluster_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM (SELECT pdb_id, id, x, y, z FROM v_points), v_centers),
a AS (SELECT pdb_id, avg(m) AS m FROM (SELECT pdb_id, id, min(dist) AS m FROM q GROUP BY ALL) GROUP BY 1), b AS (SELECT pdb_id, avg(m) AS m FROM (SELECT pdb_id, cluster_id, min(dist) AS m FROM q GROUP BY ALL) GROUP BY 1)
SELECT pdb_id, round(a.m + b.m, 6) AS chamfer FROM a JOIN b USING (pdb_id)
""")  # fmt: skip
def chamfer(spark, d):
    return rounded(spatial.chamfer(v_points(spark, d), v_centers(spark, d), ["pdb_id"], "id", "cluster_id"), "chamfer")


@query("too_close", "SELECT a.cluster_id AS a, b.cluster_id AS b, round(sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y) + (a.center_z - b.center_z) * (a.center_z - b.center_z)), 6) AS distance FROM v_clusters a JOIN v_clusters b ON a.cluster_id < b.cluster_id WHERE sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y) + (a.center_z - b.center_z) * (a.center_z - b.center_z)) < 3.0")
def too_close(spark, d):
    c = v_clusters(spark, d).select("cluster_id", *[F.col(f"center_{a}").alias(a) for a in "xyz"])
    return rounded(spatial.close_pairs(c, 1.5, "cluster_id"), "distance")


@query("nn_dist", """
SELECT a.id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 6) AS distance
FROM v_points a JOIN v_points b ON a.pdb_id = b.pdb_id AND a.cluster_id % 2 = 0 AND b.cluster_id % 2 <> 0 GROUP BY 1
""")  # fmt: skip
def nn_dist(spark, d):
    p = v_points(spark, d)
    return rounded(spatial.nearest(p.where("cluster_id % 2 = 0"), p.where("cluster_id % 2 <> 0"), ["pdb_id"]), "distance").select("id", "distance")


@query("sym_nearest", """
WITH ops(op) AS (VALUES (0), (1)), w AS (SELECT id, pdb_id, x, y, z FROM v_points WHERE cluster_id % 2 = 0), p AS (SELECT pdb_id, CASE op WHEN 0 THEN x ELSE -x END AS x, CASE op WHEN 0 THEN y ELSE y + 6 END AS y, CASE op WHEN 0 THEN z ELSE -z END AS z FROM v_points, ops WHERE cluster_id % 2 <> 0),
s AS (SELECT w.id, w.x - p.x AS dx, w.y - p.y AS dy, w.z - p.z AS dz FROM w JOIN p USING (pdb_id))
SELECT id, round(min(sqrt((dx - 10 * round_even(dx / 10, 0)) ** 2 + (dy - 12 * round_even(dy / 12, 0)) ** 2 + (dz - 14 * round_even(dz / 14, 0)) ** 2)), 4) AS min_distance FROM s GROUP BY 1
""")  # fmt: skip
def sym_nearest(spark, d):
    p = v_points(spark, d)
    water = F.col("cluster_id") % 2 == 0
    atoms = p.select("pdb_id", F.col("id").cast("int").alias("atom_ord"), F.when(water, "HETATM").otherwise("ATOM").alias("group_pdb"), F.when(water, "O").otherwise("C").alias("element"), F.when(water, "HOH").otherwise("ALA").alias("res_name"), "x", "y", "z")
    cell = [10.0, 12.0, 14.0, 90.0, 90.0, 90.0]
    st = p.select("pdb_id").distinct().select("pdb_id", F.lit("P 1 21 1").alias("space_group"), *[F.lit(v).alias(c) for v, c in zip(cell, filters.CELL, strict=True)])
    return filters.relocate(atoms, st).select(F.col("atom_ord").cast("long").alias("id"), F.round("min_distance", 4).alias("min_distance"))


@query("matched_pr")
def matched_pr(spark, d):
    return rounded(spatial.matched_coverage(v_points(spark, d), v_centers(spark, d), 2.0, ["pdb_id"], "id", "cluster_id"), "matched_precision", "matched_recall")


@query("pareto", 'SELECT pdb_id, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM v_pr a WHERE NOT EXISTS (SELECT 1 FROM v_pr b WHERE b."precision" >= a."precision" AND b.recall >= a.recall AND (b."precision" > a."precision" OR b.recall > a.recall))')
def pareto(spark, d):
    return rounded(clusters.pareto_front(v_pr(spark, d), "recall", "precision").select("pdb_id", "precision", "recall"), "precision", "recall")


@query("knee", 'SELECT pdb_id, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(sqrt((1 - recall) ** 2 + (1 - "precision") ** 2), 6) AS distance_to_ideal FROM v_pr ORDER BY v_pr.f1 DESC, pdb_id LIMIT 1')
def knee(spark, d):
    return rounded(clusters.knee(v_pr(spark, d), "pdb_id"), "precision", "recall", "f1", "distance_to_ideal")


@query("summary", """
SELECT c.*, m.*, round(n_noise / n_points, 6) AS noise_share, round(n_within / n_points, 6) AS within_share, k.* FROM (SELECT count(*) AS n_clusters, count(*) FILTER (cluster_occupancy >= 0.3) AS n_consensus FROM v_clusters) c,
(SELECT count(*) AS n_points, count(*) FILTER (cluster_id = -1) AS n_noise, count(*) FILTER (within_cutoff) AS n_within FROM v_members) m,
(SELECT pdb_id AS knee_id, round(f1, 6) AS knee_f1, round(sqrt((1 - recall) ** 2 + (1 - "precision") ** 2), 6) AS knee_distance FROM v_pr ORDER BY v_pr.f1 DESC, pdb_id LIMIT 1) k
""")  # fmt: skip
def summary(spark, d):
    # points and clusters are made once for all that is read from them
    m = kept(v_members(spark, d))
    c = kept(clusters.table(m, 25))
    pr = spatial.coverage(m, clusters.consensus_centers(c, 0.3), 2.0, ["pdb_id"], "id", "cluster_id")
    out = clusters.summary(kept(pr), c, m, 0.3, "pdb_id")
    return rounded(out, "noise_share", "within_share", "knee_f1", "knee_distance")


@query("jaccard_best", """
WITH n AS (SELECT a, b, count(*) AS n FROM v_labels WHERE a >= 0 AND b >= 0 GROUP BY ALL), na AS (SELECT a, count(*) AS na FROM v_labels WHERE a >= 0 GROUP BY 1), nb AS (SELECT b, count(*) AS nb FROM v_labels WHERE b >= 0 GROUP BY 1)
SELECT na.a, round(coalesce(max(n / (na + nb - n)), 0), 6) AS best_jaccard FROM na LEFT JOIN n ON n.a = na.a LEFT JOIN nb ON nb.b = n.b GROUP BY 1
""")  # fmt: skip
def jaccard_best(spark, d):
    return rounded(clusters.best_jaccard(v_labels(spark, d), "a", "b"), "best_jaccard")


@query("grid_rank", """
WITH g AS (SELECT p_partkey AS candidate, round(p_retailprice % 10, 2) AS dbcv, CAST(p_size AS DOUBLE) AS stab FROM part),
r AS (SELECT *, rank() OVER (ORDER BY dbcv DESC) AS dbcv_rank, rank() OVER (ORDER BY stab DESC) AS stab_rank FROM g)
SELECT candidate, dbcv_rank, stab_rank, greatest(dbcv_rank, stab_rank) AS max_rank, row_number() OVER (ORDER BY greatest(dbcv_rank, stab_rank), stab_rank, dbcv_rank, candidate) = 1 AS recommended FROM r
""")  # fmt: skip
def grid_rank(spark, d):
    g = t(spark, d, "part").select(F.col("p_partkey").alias("candidate"), F.round(F.col("p_retailprice") % 10, 2).alias("dbcv"), F.col("p_size").cast("double").alias("stab"))
    out = clusters.rank_candidates(g, ["dbcv", "stab"], "candidate")
    return out.select("candidate", *[F.col(c).cast("long").alias(c) for c in ("dbcv_rank", "stab_rank", "max_rank")], "recommended")


# binning


@query("occ_hist", """
WITH z AS (SELECT cluster_id, count(*) AS size FROM v_points WHERE cluster_id >= 0 GROUP BY 1), c AS (SELECT least(19, len(list_filter(range(1, 20), lambda k: cluster_occupancy >= k * CAST(0.05 AS DOUBLE)))) AS bin, size FROM v_clusters JOIN z USING (cluster_id)),
h AS (SELECT b.bin, count(c.size) AS n_clusters, coalesce(sum(c.size), 0) + CASE WHEN b.bin = 0 THEN (SELECT count(*) FROM v_points WHERE cluster_id = -1) ELSE 0 END AS n_points FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN c ON c.bin = b.bin GROUP BY b.bin)
SELECT CAST(bin AS INTEGER) AS bin, n_clusters, CAST(n_points AS BIGINT) AS n_points, round(n_points / sum(n_points) OVER (), 6) AS share, round(sum(n_points) OVER (ORDER BY bin DESC) / sum(n_points) OVER (), 6) AS share_above FROM h
""")  # fmt: skip
def occ_hist(spark, d):
    p = v_points(spark, d)
    return rounded(binning.occupancy_histogram(v_clusters(spark, d), clusters.sizes(p), clusters.noise_stats(p)), "share", "share_above")


@query("quantile_edges", "SELECT cohort, round(unnest(list_distinct(list_transform(quantile_cont(quantity, [0.01, 0.206, 0.402, 0.598, 0.794, 0.99]), lambda v: round_even(v, 0)))), 6) AS edge FROM v_split GROUP BY 1")
def quantile_edges(spark, d):
    out = binning.quantile_edges(v_split(spark, d), "quantity", 5, ["cohort"])
    return out.select("cohort", F.explode("edges").alias("edge")).withColumn("edge", r6("edge"))


@query("quantile_bins", """
WITH e AS (SELECT cohort, quantile_cont(price, [0.01, 0.255, 0.5, 0.745, 0.99]) AS q FROM v_split GROUP BY 1)
SELECT cohort, CAST(len(list_filter(q[2:len(q) - 1], lambda v: v < price)) AS INTEGER) AS bin, count(*) AS n, round(avg(discount), 6) AS mean FROM v_split JOIN e USING (cohort) GROUP BY ALL
""")  # fmt: skip
def quantile_bins(spark, d):
    x = v_split(spark, d)
    return rounded(binning.quantile_means(x, "price", "discount", binning.quantile_edges(x, "price", 4, ["cohort"]), ["cohort"]), "mean")


@query("density", """
WITH b AS (SELECT cohort, least(4, CAST(floor(quantity / 10) AS INTEGER)) AS bin FROM v_split WHERE quantity BETWEEN 0 AND 50), n AS (SELECT cohort, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT c.cohort, CAST(g.bin AS INTEGER) AS bin, round(coalesce(n.n, 0) / (10.0 * sum(n.n) OVER (PARTITION BY c.cohort)), 6) AS density FROM (SELECT DISTINCT cohort FROM v_split) c, (SELECT unnest(range(5)) AS bin) g LEFT JOIN n ON n.cohort = c.cohort AND n.bin = g.bin
""")  # fmt: skip
def density_query(spark, d):
    return rounded(binning.density(v_split(spark, d), "quantity", [0.0, 10.0, 20.0, 30.0, 40.0, 50.0], ["cohort"]), "density")


@query("limits", "SELECT cohort, round(min(price), 6) AS lo, round(quantile_cont(price, 0.999), 6) AS hi FROM v_split GROUP BY 1")
def limits(spark, d):
    return rounded(binning.limits(v_split(spark, d), "price", ["cohort"]), "lo", "hi")


@query("median_iqr", "SELECT cohort, lft, count(*) AS n, round(quantile_cont(quantity, 0.25), 2) AS q1, round(median(quantity), 2) AS median, round(quantile_cont(quantity, 0.75), 2) AS q3 FROM v_split GROUP BY ALL")
def median_iqr(spark, d):
    return binning.median_iqr(v_split(spark, d), "quantity", ["cohort", "lft"])


@query("violin_marks", "SELECT cohort, lft, round(avg(price), 4) AS mean, round(median(price), 4) AS median, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.75), 4) AS q3 FROM v_split GROUP BY ALL")
def violin_marks(spark, d):
    return binning.violin_marks(v_split(spark, d), "price", ["cohort", "lft"]).withColumns({c: F.round(c, 4) for c in ("mean", "median", "q1", "q3")})


@query("cluster_medians", "SELECT cluster_id, round(median(b_factor), 6) AS median FROM v_members WHERE within_cutoff GROUP BY 1")
def cluster_medians(spark, d):
    return v_members(spark, d).where("within_cutoff").groupBy("cluster_id").agg(r6(F.percentile("b_factor", 0.5)).alias("median"))


@query("good_poor", "SELECT unit, cohort, quantity, price, CASE WHEN price >= c THEN 'good' ELSE 'poor' END AS split FROM v_split JOIN (SELECT cohort, round(median(price), 4) AS c FROM v_split GROUP BY 1) USING (cohort)")
def good_poor(spark, d):
    return binning.good_poor(v_split(spark, d), "price", "cohort").select("unit", "cohort", "quantity", "price", "split")


# statistics


@query("cliffs_delta", """
WITH n AS (SELECT cohort, quantity, count(*) FILTER (lft) AS a, count(*) FILTER (NOT lft) AS b FROM v_split GROUP BY ALL), w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY cohort ORDER BY quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)
SELECT cohort, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right, round(CASE WHEN sum(a) * sum(b) = 0 THEN NULL ELSE 2 * sum(a * (below + b / 2)) / (sum(a) * sum(b)) - 1 END, 6) AS r FROM w GROUP BY 1
""")  # fmt: skip
def cliffs_delta(spark, d):
    return rounded(stats.cliffs_delta(v_split(spark, d), "quantity", "lft", ["cohort"]), "r")


@query("ks_d", """
WITH n AS (SELECT cohort, quantity, count(*) FILTER (lft) AS a, count(*) FILTER (NOT lft) AS b FROM v_split GROUP BY ALL), w AS (SELECT *, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM n WINDOW o AS (PARTITION BY cohort ORDER BY quantity ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY cohort))
SELECT cohort, CAST(max(na) AS BIGINT) AS n_left, CAST(max(nb) AS BIGINT) AS n_right, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 6) AS d FROM w GROUP BY 1
""")  # fmt: skip
def ks_d(spark, d):
    return rounded(stats.ks_distance(v_split(spark, d), "quantity", "lft", ["cohort"]), "d")


@query("cohens_d", "SELECT cohort, count(price) FILTER (lft) AS n_left, count(price) FILTER (NOT lft) AS n_right, round((avg(price) FILTER (lft) - avg(price) FILTER (NOT lft)) / sqrt((var_samp(price) FILTER (lft) + var_samp(price) FILTER (NOT lft)) / 2), 6) AS d FROM v_split GROUP BY 1")
def cohens_d(spark, d):
    return rounded(stats.cohens_d(v_split(spark, d), "price", "lft", ["cohort"]), "d")


@query("spearman", """
WITH k AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY quantity) + (count(*) OVER (PARTITION BY cohort, quantity) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort ORDER BY discount) + (count(*) OVER (PARTITION BY cohort, discount) - 1) / 2.0 AS rb FROM v_split)
SELECT cohort, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k GROUP BY 1
""")  # fmt: skip
def spearman(spark, d):
    return rounded(stats.spearman(v_split(spark, d), "quantity", "discount", ["cohort"]), "rho")


@query("qq_fit", """
WITH q AS (SELECT cohort, count(price) FILTER (lft) AS n_left, count(price) FILTER (NOT lft) AS n_right, quantile_cont(price, [(i + 0.5) / 199 FOR i IN range(199)]) FILTER (lft) AS qa, quantile_cont(price, [(i + 0.5) / 199 FOR i IN range(199)]) FILTER (NOT lft) AS qb FROM v_split GROUP BY 1), u AS (SELECT cohort, n_left, n_right, unnest(qa) AS a, unnest(qb) AS b FROM q WHERE n_left > 0 AND n_right > 0)
SELECT cohort, n_left, n_right, round(regr_slope(b, a), 3) AS slope, round(regr_intercept(b, a), 3) AS intercept, round(regr_r2(b, a), 4) AS r2 FROM u GROUP BY ALL
""")  # fmt: skip
def qq_fit(spark, d):
    return stats.qq_fit(v_split(spark, d), "price", "lft", ["cohort"])


@query("comparison_effects", """
WITH m AS (SELECT cohort, lft, 'quantity' AS metric, quantity AS v FROM v_split UNION ALL SELECT cohort, lft, 'price', price FROM v_split UNION ALL SELECT cohort, lft, 'discount', discount FROM v_split),
n AS (SELECT metric, cohort, v, count(*) FILTER (lft) AS a, count(*) FILTER (NOT lft) AS b FROM m GROUP BY ALL), w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY metric, cohort ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)
SELECT metric, cohort, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right, round(CASE WHEN sum(a) * sum(b) = 0 THEN NULL ELSE 2 * sum(a * (below + b / 2)) / (sum(a) * sum(b)) - 1 END, 6) AS r FROM w GROUP BY ALL
""")  # fmt: skip
def comparison_effects(spark, d):
    x = v_split(spark, d).unpivot(["cohort", "lft"], ["quantity", "price", "discount"], "metric", "v")
    return rounded(stats.cliffs_delta(x, "v", "lft", ["metric", "cohort"]), "r")


def _mix_sql(x: str, out: str) -> str:
    """Columns that end in ``out``: the bits of x spread as in ``resampling``."""
    return f"CAST({x} AS UBIGINT) AS {out}0, xor({out}0, {out}0 >> 16) AS {out}1, ({out}1 * 2246822507) % 4294967296 AS {out}2, xor({out}2, {out}2 >> 13) AS {out}3, ({out}3 * 3266489909) % 4294967296 AS {out}4, xor({out}4, {out}4 >> 16) AS {out}"


@query("bootstrap_ci", f"""
WITH u AS (SELECT cohort, unit, row_number() OVER (PARTITION BY cohort ORDER BY unit) - 1 AS idx, count(*) OVER (PARTITION BY cohort) AS n FROM (SELECT DISTINCT cohort, unit FROM v_split)),
b AS (SELECT draw, {_mix_sql("draw + 1", "h")} FROM range(2000) r(draw)), k AS (SELECT cohort, draw, n, {_mix_sql("(h + idx * 2654435769) % 4294967296", "x")} FROM u, b),
m AS (SELECT cohort, draw, CAST((x * n) >> 32 AS BIGINT) AS idx, count(*) AS k FROM k GROUP BY ALL),
w AS (SELECT cohort, draw, price, coalesce(sum(k) FILTER (lft), 0) AS a, coalesce(sum(k) FILTER (NOT lft), 0) AS b FROM v_split JOIN u USING (cohort, unit) JOIN m USING (cohort, idx) GROUP BY ALL
  UNION ALL SELECT cohort, -1, price, count(*) FILTER (lft), count(*) FILTER (NOT lft) FROM v_split GROUP BY ALL),
c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY cohort, draw ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
e AS (SELECT cohort, draw, sum(a) AS n_left, sum(b) AS n_right, CASE WHEN sum(a) * sum(b) > 0 THEN 2 * sum(a * (below + b / 2)) / (sum(a) * sum(b)) - 1 END AS r FROM c GROUP BY ALL),
s AS (SELECT cohort, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, least(1.0, greatest(0.0005, 2 * least(avg(CAST(r <= 0 AS INTEGER)), avg(CAST(r >= 0 AS INTEGER))))) AS p FROM e WHERE draw >= 0 AND r IS NOT NULL GROUP BY 1)
SELECT cohort, CASE WHEN ok THEN round(r, 6) END AS r, CASE WHEN ok THEN round(lo, 6) END AS lo, CASE WHEN ok THEN round(hi, 6) END AS hi, CASE WHEN ok THEN round(p, 6) END AS p, n_left, n_right
FROM (SELECT cohort, r, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, n_left > 1 AND n_right > 1 AS ok FROM e WHERE draw = -1) LEFT JOIN s USING (cohort)
""")  # fmt: skip
def bootstrap_ci(spark, d):
    x = v_split(spark, d)
    return rounded(resampling.bootstrap(x, "price", "lft", ["cohort"], "unit"), "r", "lo", "hi", "p")


# partitions


@query("space_group_survey", "SELECT space_group, count(*) AS n, round(median(resolution), 6) AS median_resolution, round(min(resolution), 6) AS best_resolution FROM v_meta GROUP BY 1")
def space_group_survey(spark, d):
    return rounded(partitions.space_group_survey(v_meta(spark, d)), "median_resolution", "best_resolution")


@query("isomorphous", """
WITH g AS (SELECT * FROM v_meta WHERE space_group = '1-URGENT'), m AS (SELECT median(cell_a) AS a, median(cell_b) AS b, median(cell_c) AS c FROM g),
x AS (SELECT pdb_id, greatest(200 * abs(cell_a - a) / (cell_a + a), 200 * abs(cell_b - b) / (cell_b + b), 200 * abs(cell_c - c) / (cell_c + c)) AS v FROM g, m)
SELECT pdb_id, round(v, 6) AS max_cell_diff, v <= 5.0 AS isomorphous FROM x
""")  # fmt: skip
def isomorphous(spark, d):
    out = partitions.isomorphous(v_meta(spark, d), "1-URGENT", 5.0, cell=("cell_a", "cell_b", "cell_c"))
    return rounded(out.select("pdb_id", "max_cell_diff", "isomorphous"), "max_cell_diff")


@query("query_arms", "SELECT CASE WHEN coalesce(resolution > 1.5 AND NOT (cell_a < 52), false) THEN 'A' ELSE 'B' END AS arm, count(*) AS n FROM v_meta GROUP BY 1")
def query_arms(spark, d):
    return partitions.query_arms(v_meta(spark, d), "resolution > 1.5 and not (cell_a < 52)").groupBy("arm").agg(F.count("*").alias("n"))


@query("contingency", "WITH n AS (SELECT a, b, count(*) AS n FROM v_labels GROUP BY ALL), na AS (SELECT a, count(*) AS n_a FROM v_labels GROUP BY 1), nb AS (SELECT b, count(*) AS n_b FROM v_labels GROUP BY 1) SELECT a, b, n, n_a, n_b, round(n / (n_a + n_b - n), 6) AS jaccard FROM n JOIN na USING (a) JOIN nb USING (b)")
def contingency(spark, d):
    return rounded(partitions.contingency(v_labels(spark, d), "a", "b"), "jaccard")


@query("agreement", """
WITH n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS k FROM v_labels GROUP BY ALL), na AS (SELECT a, CAST(count(*) AS DOUBLE) AS k FROM v_labels GROUP BY 1), nb AS (SELECT b, CAST(count(*) AS DOUBLE) AS k FROM v_labels GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v_labels),
s AS (SELECT (SELECT sum(k * (k - 1) / 2) FROM n) AS sij, (SELECT sum(k * (k - 1) / 2) FROM na) AS sa, (SELECT sum(k * (k - 1) / 2) FROM nb) AS sb, (SELECT n FROM t) AS n),
h AS (SELECT (SELECT -sum(k / t.n * ln(k / t.n)) FROM na, t) AS ha, (SELECT -sum(k / t.n * ln(k / t.n)) FROM nb, t) AS hb, (SELECT sum(n.k / t.n * ln(n.k * t.n / (na.k * nb.k))) FROM n JOIN na ON n.a = na.a JOIN nb ON n.b = nb.b, t) AS mi)
SELECT round((sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari, round(mi / sqrt(ha * hb), 6) AS nmi FROM s, h
""")  # fmt: skip
def agreement(spark, d):
    return rounded(partitions.agreement(v_labels(spark, d), "a", "b"), "ari", "nmi")


def _pairs(spark, d):
    c = v_clusters(spark, d).select("cluster_id", "center_x", "center_y", "center_z")
    a, b = c.toDF("i", "xi", "yi", "zi"), c.toDF("j", "xj", "yj", "zj")
    return a.crossJoin(b).select("i", "j", (F.abs(F.col("xi") - F.col("xj")) + 2 * F.greatest(F.col("yi") - F.col("yj"), F.lit(0.0)) + F.abs(F.col("zi") - F.col("zj"))).alias("v"))


_PAIRS_SQL = "p AS (SELECT a.cluster_id AS i, b.cluster_id AS j, abs(a.center_x - b.center_x) + 2 * greatest(a.center_y - b.center_y, 0) + abs(a.center_z - b.center_z) AS v FROM v_clusters a, v_clusters b)"


@query("symmetrise", f"WITH {_PAIRS_SQL} SELECT p.i, p.j, round((p.v + q.v) / 2, 6) AS v FROM p JOIN p q ON p.i = q.j AND p.j = q.i")
def symmetrise(spark, d):
    return rounded(partitions.symmetrise(_pairs(spark, d), "i", "j", "v"), "v")


@query("off_diagonal", f"WITH {_PAIRS_SQL} SELECT count(*) AS n, round(min(v), 6) AS least, round(median(v), 6) AS median, round(max(v), 6) AS greatest FROM p WHERE i < j")
def off_diagonal(spark, d):
    return rounded(partitions.off_diagonal(_pairs(spark, d), "i", "j", "v"), "least", "median", "greatest")


@query("linkage", f"""
WITH RECURSIVE {_PAIRS_SQL}, q AS (SELECT p.i, p.j, (p.v + q.v) / 2 AS v FROM p JOIN p q ON p.i = q.j AND p.j = q.i WHERE p.i < p.j),
st AS (SELECT 0 AS step, i AS member, i AS label FROM (SELECT cluster_id AS i FROM v_clusters)
  UNION ALL (
    WITH g AS (SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, max(v) AS h FROM q JOIN st x ON x.member = q.i JOIN st y ON y.member = q.j WHERE x.label <> y.label GROUP BY ALL),
    m AS (SELECT a, b FROM g WHERE h <= 3.0 ORDER BY h, a, b LIMIT 1)
    SELECT step + 1, member, CASE WHEN label = m.b THEN m.a ELSE label END FROM st, m
  )),
f AS (SELECT member, label FROM st WHERE step = (SELECT max(step) FROM st))
SELECT member, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS label FROM f
""")  # fmt: skip
def linkage(spark, d):
    return partitions.linkage_labels(partitions.symmetrise(_pairs(spark, d), "i", "j", "v"), "i", "j", "v", 3.0)


@query("mantel", f"""
WITH {_PAIRS_SQL}, q AS (SELECT p.i, p.j, (p.v + q.v) / 2 AS a, round((p.v + q.v) / 2) AS b FROM p JOIN p q ON p.i = q.j AND p.j = q.i WHERE p.i < p.j),
m AS (SELECT cluster_id AS m, row_number() OVER (ORDER BY cluster_id) - 1 AS idx FROM v_clusters),
r AS (SELECT x.idx AS i, y.idx AS j, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM q JOIN m x ON x.m = q.i JOIN m y ON y.m = q.j),
z AS (SELECT i, j, ra - avg(ra) OVER () AS a, rb - avg(rb) OVER () AS b FROM r), s AS (SELECT i, j, a FROM z UNION ALL SELECT j, i, a FROM z),
h AS (SELECT draw, {_mix_sql("draw + 1", "h")} FROM range(999) t(draw)), k AS (SELECT draw, idx, {_mix_sql("(h + idx * 2654435769) % 4294967296", "x")} FROM m, h),
o AS (SELECT draw, idx, row_number() OVER (PARTITION BY draw ORDER BY x, idx) - 1 AS place FROM k),
t AS (SELECT oi.draw, sum(s.a * z.b) AS v FROM z JOIN o oi ON oi.place = z.i JOIN o oj ON oj.place = z.j AND oj.draw = oi.draw JOIN s ON s.i = oi.idx AND s.j = oj.idx GROUP BY 1),
n AS (SELECT sum(a * b) AS v, sqrt(sum(a * a)) * sqrt(sum(b * b)) AS size FROM z)
SELECT (SELECT count(*) FROM m) AS n, round(n.v / n.size, 6) AS rho, round((1 + count(*) FILTER (abs(t.v / n.size) >= abs(n.v / n.size) - 1e-12)) / 1000, 6) AS p FROM t, n GROUP BY n.v, n.size
""")  # fmt: skip
def mantel(spark, d):
    p = partitions.symmetrise(_pairs(spark, d), "i", "j", "v").withColumn("whole", F.round("v"))
    return rounded(resampling.mantel(p, "i", "j", "v", "whole"), "rho", "p")


@query("hdbscan")
def hdbscan(spark, d):
    return density.cluster(v_points(spark, d).drop("cluster_id"), 5, 5).select("id", "pdb_id", "cluster_id")


@query("gridsearch")
def gridsearch(spark, d):
    out = density.search(v_points(spark, d), 25, 2.0)
    return rounded(out, "dbcv", "median_spread", "radius_reject_frac", "frac_water_in_occ", "mean_stability")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each structure with the consensus, and whether it is on the front of precision and recall."""
    pr = v_pr(spark, d)
    front = clusters.pareto_front(pr, "recall", "precision").select("pdb_id", F.lit(True).alias("on_front"))
    return pr.join(front, "pdb_id", "left").withColumn("on_front", F.coalesce("on_front", F.lit(False)))


from . import structures  # noqa: E402, F401  registers its queries
