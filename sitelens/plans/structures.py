"""Queries of the operators on structures, texts and partitions, over inputs made from the test tables; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import alignment, binning, clusters, density, filters, partitions, spatial, stats
from ..shared import address, kept, shared_dir
from ..sources import readers, structure_format, writers
from . import cohort as stages
from .queries import _mix_sql, query, rounded, t, v_clusters, v_members, v_meta, v_points, v_pr

# texts of structures


def _texts(spark, d):
    """A structure text for each nation: its suppliers are water oxygens, its suppliers of odd key alpha carbons too."""
    sup = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 5).alias("k"))
    line = lambda group, el, name, res, z: F.concat_ws(" ", F.lit(group), F.col("s_suppkey").cast("string"), F.lit(el), F.lit(name), F.lit("."), F.lit(res), F.lit("A"), F.col("s_suppkey").cast("string"), F.when(F.col("k") == 0, "?").otherwise("A"), F.format_string("%.3f", F.col("s_suppkey") / 8.0), F.lit("'1.5'"), F.lit(z), F.lit("1.00"), F.format_string("%.1f", F.col("k") * 2.0), F.lit("1"))
    rows = sup.select("s_nationkey", "s_suppkey", F.explode(F.array(F.struct(F.lit(0).alias("o"), line("HETATM", "O", "O", "HOH", "2.0").alias("l")), F.when(F.col("s_suppkey") % 2 == 1, F.struct(F.lit(1).alias("o"), line("ATOM", "C", "CA", "ALA", "-4.0").alias("l"))))).alias("x")).where("x is not null")
    body = rows.groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "x.o", "x.l"))), lambda r: r["l"]), "\n").alias("body"))
    tags = "group_PDB id type_symbol label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv pdbx_PDB_model_num".split()
    n = F.col("s_nationkey")
    head = F.concat(
        F.lit("data_x\n_cell.length_a "), (10 + n).cast("string"), F.lit("\n_cell.length_b 20\n_cell.length_c 30\n_cell.angle_alpha 90\n_cell.angle_beta 90\n_cell.angle_gamma 90\n_symmetry.space_group_name_H-M 'P 21 21 21'\n_refine.ls_d_res_high "),
        F.when(n % 4 == 0, "?").otherwise(F.concat(F.lit("1."), n.cast("string"))), F.lit("\nloop_\n_pdbx_entity_nonpoly.comp_id\nHOH\nGOL\nCL\nGOL\n"), F.lit("loop_\n" + "".join(f"_atom_site.{x}\n" for x in tags)),
    )
    return body.select(F.concat(F.lit("N"), F.lpad(n.cast("string"), 3, "0")).alias("pdb_id"), F.concat(head, F.col("body"), F.lit("\n#\n")).alias("value"))


_ATOMS_SQL = """a AS (
  SELECT 'n' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS pdb_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, o) - 1 AS INTEGER) AS atom_ord, CASE o WHEN 0 THEN 'HETATM' ELSE 'ATOM' END AS group_pdb,
    CASE o WHEN 0 THEN 'HOH' ELSE 'ALA' END AS res_name, CAST(s_suppkey AS INTEGER) AS res_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'A' END AS ins_code, round(s_suppkey / 8.0, 3) AS x, 1.5 AS y,
    CASE o WHEN 0 THEN 2.0 ELSE -4.0 END AS z, (s_suppkey % 5) * 2.0 AS b_factor, s_nationkey FROM supplier, (VALUES (0), (1)) v(o) WHERE o = 0 OR s_suppkey % 2 = 1
)"""


@query("cif_atoms", f"WITH {_ATOMS_SQL} SELECT pdb_id, atom_ord, group_pdb, res_name, res_id, ins_code, x, y, z, b_factor FROM a")
def cif_atoms(spark, d):
    return readers.atoms_from(_texts(spark, d)).select("pdb_id", "atom_ord", "group_pdb", "res_name", "res_id", "ins_code", "x", "y", "z", "b_factor")


@query("cif_waters", f"WITH {_ATOMS_SQL} SELECT pdb_id, res_id, x, y, z, b_factor, CASE WHEN res_id % 3 = 0 THEN res_id / 100.0 END AS edia FROM a WHERE group_pdb = 'HETATM'")
def cif_waters(spark, d):
    atoms = readers.atoms_from(_texts(spark, d))
    scores = atoms.where("res_name = 'HOH' and res_id % 3 = 0").select("pdb_id", F.col("atom_ord").alias("pos"), "chain_id", "res_id", "ins_code", (F.col("res_id") / 100.0).alias("score"))
    return readers.waters(atoms, scores).select("pdb_id", "res_id", "x", "y", "z", "b_factor", "edia")


@query("water_counts", f"WITH {_ATOMS_SQL} SELECT pdb_id, count(*) FILTER (group_pdb = 'HETATM') AS num_water FROM a GROUP BY 1")
def water_counts(spark, d):
    return filters.count_water_oxygens(readers.atoms_from(_texts(spark, d)))


@query("cif_metadata", f"""
WITH {_ATOMS_SQL} SELECT pdb_id, 'P 21 21 21' AS space_group, 10.0 + s_nationkey AS cell_a, (10.0 + s_nationkey) * 600 AS unit_cell_volume, CASE WHEN s_nationkey % 4 <> 0 THEN CAST('1.' || s_nationkey AS DOUBLE) END AS resolution,
  count(*) FILTER (group_pdb = 'HETATM') AS num_water, 'CL|GOL' AS ligand_names FROM a GROUP BY ALL
""")  # fmt: skip
def cif_metadata(spark, d):
    x = _texts(spark, d)
    m = readers.metadata(readers.structures_from(x), filters.count_water_oxygens(readers.atoms_from(x)))
    return m.select("pdb_id", "space_group", "cell_a", "unit_cell_volume", "resolution", "num_water", "ligand_names")


@query("cif_round_trip", f"WITH {_ATOMS_SQL} SELECT pdb_id, CAST(row_number() OVER (PARTITION BY pdb_id ORDER BY atom_ord) - 1 AS INTEGER) AS atom_ord, res_name, res_id, x, y, z + 1 AS z, b_factor FROM a WHERE res_id % 2 = 1")
def cif_round_trip(spark, d):
    x = _texts(spark, d).withColumn("pdb_id", F.lower("pdb_id"))
    kept = readers.atoms_from(x).where("res_id % 2 = 1").withColumn("z", F.col("z") + 1)
    back = readers.atoms_from(writers.edited_cifs(x, kept).withColumnRenamed("cif", "value"))
    return back.select("pdb_id", "atom_ord", "res_name", "res_id", "x", "y", "z", "b_factor")


@query("structure_files", f"WITH {_ATOMS_SQL} SELECT pdb_id, 10.0 + s_nationkey AS cell_a, CASE WHEN s_nationkey % 4 <> 0 THEN CAST('1.' || s_nationkey AS DOUBLE) END AS resolution, atom_ord, res_name, res_id, ins_code, x, y, z, b_factor FROM a")
def structure_files(spark, d):
    """The files are written to the shared folder and read by the format: scalars and atoms of one parse."""
    folder = f"{address(shared_dir(spark))}/structures-{uuid.uuid4().hex}"
    writers.write_texts(_texts(spark, d), folder, value="value")
    whole = structure_format.read_whole(spark, folder)
    out = kept(whole.select("pdb_id", "cell_a", "resolution", F.inline("atoms")).select("pdb_id", "cell_a", "resolution", "atom_ord", "res_name", "res_id", "ins_code", "x", "y", "z", "b_factor"))
    writers.remove(folder)
    return out


@query("cluster_sites", """
SELECT 'A' AS chain, CAST(cluster_id + 1 AS BIGINT) AS residue, round(center_x, 6) AS x, round(cluster_occupancy, 6) AS occupancy, round(sqrt((std_x ** 2 + std_y ** 2 + std_z ** 2) / 3), 6) AS b FROM v_clusters
UNION ALL SELECT 'B', row_number() OVER (ORDER BY pdb_id, x, y, z), round(x, 6), round(1 / 25.0, 6), round(b_factor, 6) FROM v_members WHERE cluster_id = -1
""")  # fmt: skip
def cluster_sites(spark, d):
    noise = v_members(spark, d).where("cluster_id = -1").withColumns({"chain_id": F.lit("A"), "res_id": F.lit(1), "altloc": F.lit(".")})
    return rounded(writers.cluster_sites(v_clusters(spark, d), noise, 25).select("chain", "residue", "x", "occupancy", "b"), "x", "occupancy", "b")


# cohorts


@query("scores_multimap", """
SELECT lower('U' || user_id) AS pdb_id, CAST(n AS INTEGER) AS pos, event_type AS chain_id, CAST(event_id % 3 AS INTEGER) AS res_id, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE '' END AS ins_code, score
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CAST(json_extract(props, '$.k') AS DOUBLE) AS score FROM events) WHERE event_type IN ('view', 'click')
""")  # fmt: skip
def scores_multimap(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", F.from_json("props", "k int")["k"].cast("double").alias("k"))
    row = F.struct(F.when(F.col("event_type") == "view", "HOH").when(F.col("event_type") == "click", "WAT").otherwise("ALA").alias("compID"), F.col("k").alias("EDIAm"), F.struct(F.col("event_type").alias("strandID"), (F.col("event_id") % 3).cast("int").alias("seqNum"), F.when(F.col("event_id") % 2 == 0, " B ").otherwise("?").alias("insCode")).alias("pdb"))
    files = e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("pdb_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("event_id", row.alias("r")))), lambda x: x["r"])).alias("value"))
    return readers.scores_of(files).withColumn("pos", F.col("pos").cast("int"))


@query("inputs_found", """
SELECT c_custkey AS pdb_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_scores, '/data/' || c_custkey || '/' || c_custkey || '_final.cif' AS path
FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")  # fmt: skip
def inputs_found(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "pdb_id")
    found = stages.inputs(t(spark, d, "customer").select(F.col("c_custkey").alias("pdb_id")), o, o.where("o_orderpriority = '1-URGENT'"))
    return found.withColumn("path", readers.structure_path(F.col("pdb_id").cast("string"), "/data/"))


@query("cohort_metadata", """
WITH c AS (SELECT r_name || '_' || n_name || '_iso' AS cohort FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT r_name AS name FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_name || '_' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)
SELECT cohort, (SELECT arg_max(name, length(name)) FROM n WHERE starts_with(cohort || '_', name || '_')) AS name FROM c
""")  # fmt: skip
def cohort_metadata(spark, d):
    both = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    full = F.concat_ws("_", "r_name", "n_name")
    names = t(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("name")).union(both.where("n_nationkey % 3 = 0").select(full))
    return readers.cohort_metadata(both.select(F.concat(full, F.lit("_iso")).alias("cohort")), names)


@query("numbers", """
SELECT c_custkey AS pdb_id, TRY_CAST(c_name AS DOUBLE) AS c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS nation FROM customer
""")  # fmt: skip
def numbers(spark, d):
    k = F.col("c_custkey")
    return stages.numbers(t(spark, d, "customer").select(k.alias("pdb_id"), "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), F.when(k % 3 == 0, "NaN").otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).alias("nation")))


@query("with_metadata", """
SELECT pdb_id, round(v_pr.num_water, 6) AS num_water, round(v_pr.recall, 6) AS recall, CAST(s_nationkey AS DOUBLE) AS num_water_deposited, round(CAST(s_acctbal AS DOUBLE), 6) AS recall_deposited, CAST(NULL AS DOUBLE) AS space_group
FROM v_pr LEFT JOIN supplier ON pdb_id = 's' || s_suppkey
""")  # fmt: skip
def with_metadata(spark, d):
    meta = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("pdb_id"), F.col("s_nationkey").alias("num_water"), F.col("s_acctbal").alias("recall"), F.col("s_name").alias("space_group"))
    out = stages.with_metadata(v_pr(spark, d).select("pdb_id", "num_water", "recall"), meta)
    return rounded(out.withColumn("num_water", F.col("num_water").cast("double")), "num_water", "recall", "recall_deposited")


@query("labels_percent", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'R-free (%)' WHEN l_linenumber = 1 THEN 'EDIA' WHEN l_linenumber = 3 THEN '#water (deposited)' ELSE 'other' END AS metric,
  round(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100 ELSE l_discount END, 6) AS "value" FROM lineitem
""")  # fmt: skip
def labels_percent(spark, d):
    n = F.col("l_linenumber")
    name, value = s.in_percent(F.when(n % 2 == 0, "r_free").when(n == 1, "edia").when(n == 3, "num_water_deposited").otherwise("other"), F.col("l_discount").cast("double"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("metric"), F.round(value, 6).alias("value"))


@query("three_digits", "SELECT o_orderkey, CAST(printf('%.2e', CAST(o_totalprice AS DOUBLE) / 7.3) AS DOUBLE) AS p FROM orders")
def three_digits(spark, d):
    return t(spark, d, "orders").select("o_orderkey", s.mantissa(F.col("o_totalprice").cast("double") / 7.3).alias("p"))


# filters as a whole


@query("filter_whole", """
WITH w AS (SELECT * FROM v_points WHERE cluster_id % 2 = 0 AND pdb_id <> 's3'), p AS (SELECT * FROM v_points WHERE cluster_id % 2 <> 0), s AS (
  SELECT w.id, w.pdb_id, w.b_factor, round_even((w.x - p.x) / 10, 0) AS i, round_even((w.y - p.y) / 12, 0) AS j, round_even((w.z - p.z) / 14, 0) AS k, w.x - p.x AS dx, w.y - p.y AS dy, w.z - p.z AS dz FROM w JOIN p USING (pdb_id)
), n AS (SELECT *, sqrt((dx - 10 * i) ** 2 + (dy - 12 * j) ** 2 + (dz - 14 * k) ** 2) AS dist FROM s), m AS (SELECT id, pdb_id, any_value(b_factor) AS b, min(dist) AS dist, arg_min(abs(i) + abs(j) + abs(k), dist) > 0 AS moved FROM n GROUP BY ALL
), z AS (SELECT *, CASE WHEN dist > 2.5 THEN 'd' WHEN (b - avg(b) OVER (PARTITION BY pdb_id)) / stddev_pop(b) OVER (PARTITION BY pdb_id) > 0.5 THEN 'b' END AS gone FROM m)
SELECT q.pdb_id, coalesce(count(z.id), 0) AS n_waters_before, count(*) FILTER (moved) AS n_waters_moved, count(*) FILTER (gone = 'd') AS n_waters_removed_by_distance, count(*) FILTER (gone = 'b') AS n_waters_removed_bfactor,
  count(z.id) FILTER (gone IS NULL) AS n_waters_remaining, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT pdb_id FROM v_points) q LEFT JOIN z USING (pdb_id) GROUP BY 1
""")  # fmt: skip
def filter_whole(spark, d):
    p = v_points(spark, d).where("not (pdb_id = 's3' and cluster_id % 2 = 0)")
    water = F.col("cluster_id") % 2 == 0
    pick = lambda a, b: F.when(water, a).otherwise(b)
    atoms = p.select("pdb_id", F.col("id").cast("int").alias("atom_ord"), pick("HETATM", "ATOM").alias("group_pdb"), pick("O", "C").alias("element"), pick("HOH", "ALA").alias("res_name"), "x", "y", "z", "b_factor")
    st = p.select("pdb_id").distinct().select("pdb_id", F.lit(None).cast("string").alias("space_group"), *[F.lit(v).alias(c) for v, c in zip((10.0, 12.0, 14.0, 90.0, 90.0, 90.0), filters.CELL, strict=True)])
    return filters.filter_waters(atoms, st, 2.5, b_cutoff=0.5)[2]


_SITES = """w AS (SELECT * FROM v_points WHERE cluster_id % 2 = 0 AND id % 5 <> 0), p AS (SELECT * FROM v_points WHERE cluster_id % 2 <> 0), s AS (
  SELECT w.id, w.pdb_id, w.x, w.y, w.z, round_even((w.x - p.x) / 10, 0) AS i, round_even((w.y - p.y) / 12, 0) AS j, round_even((w.z - p.z) / 14, 0) AS k, w.x - p.x AS dx, w.y - p.y AS dy, w.z - p.z AS dz FROM w JOIN p USING (pdb_id)
), n AS (SELECT *, sqrt((dx - 10 * i) ** 2 + (dy - 12 * j) ** 2 + (dz - 14 * k) ** 2) AS dist FROM s),
m AS (SELECT id, pdb_id, min(dist) AS dist, arg_min(x - 10 * i, dist) AS nx, arg_min(y - 12 * j, dist) AS ny, arg_min(z - 14 * k, dist) AS nz, arg_min(abs(i) + abs(j) + abs(k), dist) > 0 AS moved FROM n GROUP BY ALL)"""


def _sites(spark, d):
    """(atoms, structures): points of even clusters as waters, every fifth of them a water hydrogen, all others as protein."""
    p = v_points(spark, d)
    water, hydrogen = F.col("cluster_id") % 2 == 0, F.col("id") % 5 == 0
    pick = lambda a, b: F.when(water, a).otherwise(b)
    atoms = p.select(
        "pdb_id", F.col("id").cast("int").alias("atom_ord"), pick("HETATM", "ATOM").alias("group_pdb"), F.when(water & hydrogen, "H").otherwise(pick("O", "C")).alias("element"), pick("HOH", "ALA").alias("res_name"),
        F.lit("A").alias("chain_id"), F.floor(F.col("id") / 25 % 4).cast("int").alias("res_id"), F.lit("").alias("ins_code"), "x", "y", "z", "b_factor",
    )
    return atoms, p.select("pdb_id").distinct().select("pdb_id", F.lit(None).cast("string").alias("space_group"), *[F.lit(v).alias(c) for v, c in zip((10.0, 12.0, 14.0, 90.0, 90.0, 90.0), filters.CELL, strict=True)])


@query("filter_kept", f"""
WITH {_SITES} SELECT pdb_id, CAST(id AS INTEGER) AS atom_ord, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM p UNION ALL SELECT pdb_id, CAST(id AS INTEGER), round(nx, 4), round(ny, 4), round(nz, 4) FROM m WHERE dist <= 2.5
""")  # fmt: skip
def filter_kept(spark, d):
    """The atoms themselves: water hydrogens go, all that isn't water stays, waters stand where they were near."""
    atoms, st = _sites(spark, d)
    return filters.filter_waters(atoms, st, 2.5)[0].select("pdb_id", "atom_ord", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("filter_scores", f"""
WITH {_SITES}, a AS (SELECT m.*, (id // 25) % 4 AS res, row_number() OVER (PARTITION BY pdb_id, (id // 25) % 4 ORDER BY id) AS nth FROM m),
c AS (SELECT pdb_id, (id // 25) % 4 AS res, b_factor AS score, row_number() OVER (PARTITION BY pdb_id, (id // 25) % 4 ORDER BY id) AS nth FROM v_points WHERE id % 25 < 15 AND id % 3 <> 0),
h AS (SELECT DISTINCT pdb_id FROM c), g AS (SELECT pdb_id, drop_missing, pdb_id IN (SELECT pdb_id FROM h) OR drop_missing AS edia_applied FROM (SELECT DISTINCT pdb_id FROM v_points), (VALUES (true), (false)) f(drop_missing)),
e AS (SELECT g.pdb_id, drop_missing, edia_applied, a.id, moved, CASE WHEN dist > 2.5 THEN 'd' WHEN edia_applied AND NOT coalesce(score >= 0.1, false) THEN 'e' END AS gone FROM g LEFT JOIN a USING (pdb_id) LEFT JOIN c ON c.pdb_id = a.pdb_id AND c.res = a.res AND c.nth = a.nth)
SELECT pdb_id, drop_missing, count(id) AS n_waters_before, count(id) FILTER (moved) AS n_waters_moved, count(id) FILTER (gone = 'd') AS n_waters_removed_by_distance, count(id) FILTER (gone = 'e') AS n_waters_removed_edia, count(id) FILTER (gone IS NULL) AS n_waters_remaining, edia_applied
FROM e GROUP BY ALL
""")  # fmt: skip
def filter_scores(spark, d):
    """Scores paired in order, with structures that have none: kept, or dropped on demand."""
    atoms, st = _sites(spark, d)
    p = v_points(spark, d).where("id % 25 < 15 and id % 3 <> 0")
    scores = p.select("pdb_id", F.lit("A").alias("chain_id"), F.floor(F.col("id") / 25 % 4).cast("int").alias("res_id"), F.lit("").alias("ins_code"), F.col("id").cast("int").alias("pos"), F.col("b_factor").alias("score"))
    arms = [filters.filter_waters(atoms, st, 2.5, scores, 0.1, drop_without_scores=v)[2].withColumn("drop_missing", F.lit(v)) for v in (True, False)]
    return arms[0].unionByName(arms[1]).drop("error")


@query("best_altlocs", """
WITH a AS (SELECT pdb_id, id, x, 0.3 + (id % 5) / 10.0 AS oa FROM v_points WHERE id % 11 <> 0), f AS (SELECT pdb_id, min(id) + 9 AS off FROM a GROUP BY 1)
SELECT pdb_id, CAST(id + 10 - off AS INTEGER) AS res_id, CASE WHEN oa >= 0.5 THEN 'A' ELSE 'B' END AS altloc, round(CASE WHEN oa >= 0.5 THEN x ELSE x + 1 END, 4) AS x, CAST(off AS INTEGER) AS "offset" FROM a JOIN f USING (pdb_id)
""")  # fmt: skip
def best_altlocs(spark, d):
    """Each point as a residue at two alternative locations, the first kept on ties; others than amino acids go; the first residue is 1."""
    p = v_points(spark, d)
    k, first = F.col("id").cast("int"), F.col("alt") == "A"
    atoms = p.withColumn("alt", F.explode(F.array(F.lit("A"), F.lit("B")))).select(
        "pdb_id", (2 * k + F.when(first, 0).otherwise(1)).alias("atom_ord"), F.when(k % 11 == 0, "UNK").otherwise("GLY").alias("res_name"), F.lit("A").alias("chain_id"), (k + 10).alias("res_id"), F.lit("").alias("ins_code"),
        F.col("alt").alias("altloc"), F.when(first, 3 + k % 5).otherwise(7 - k % 5).cast("double").alias("occupancy"), F.when(first, F.col("x")).otherwise(F.col("x") + 1).alias("x"),
    )
    return readers.renumbered(alignment.best_altlocs(atoms)).select("pdb_id", "res_id", "altloc", F.round("x", 4).alias("x"), F.col("offset").cast("int").alias("offset"))


# superposition


def _copies(spark, d):
    """Thirty points of structure s0 as the trace and waters of every structure k, turned by k quarters and shifted by k."""
    base = v_points(spark, d).where("pdb_id = 's0'").orderBy("id").limit(30).select(F.row_number().over(filters.Window.partitionBy("pdb_id").orderBy("id")).alias("n"), "x", "y", "z")
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    turn = lambda a: F.when(k % 4 == 0, a[0]).when(k % 4 == 1, a[1]).when(k % 4 == 2, a[2]).otherwise(a[3])
    p = base.join(F.broadcast(spark.range(8).withColumnRenamed("id", "k"))).select("k", "n", (turn((x, -y, -x, y)) + k).alias("x"), (turn((y, x, -y, -x)) - k).alias("y"), "z")
    names = F.array(*[F.lit(v) for v in alignment.NAMES])
    p = p.withColumn("rows", F.array(F.lit(0), F.when(F.col("n") % 5 != F.col("k") % 5, 1))).select("*", F.explode(F.filter("rows", lambda r: r.isNotNull())).alias("w"))
    is_w = F.col("w") == 1
    return p.select(
        F.concat(F.lit("k"), k.cast("string")).alias("pdb_id"), (F.col("n") + 100 * F.col("w")).cast("int").alias("atom_ord"), F.when(is_w, "HETATM").otherwise("ATOM").alias("group_pdb"), F.when(is_w, "O").otherwise("C").alias("element"),
        F.when(is_w, "O").otherwise("CA").alias("atom_name"), F.lit(".").alias("altloc"), F.when(is_w, "HOH").otherwise(F.get(names, ((F.col("n") * 7) % 20).cast("int"))).alias("res_name"), F.lit("A").alias("chain_id"),
        F.col("n").cast("int").alias("res_id"), F.lit("").alias("ins_code"), "x", "y", "z", F.lit(1.0).alias("occupancy"), F.lit(1.0).alias("b_factor"), F.lit(1).alias("model_num"),
    )


@query("superpose", """
WITH b AS (SELECT * FROM v_points WHERE pdb_id = 's0' ORDER BY id LIMIT 30), c AS (
  SELECT k, x, y, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + k AS mx, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END - k AS my FROM b, range(8) r(k))
SELECT 'k' || k AS pdb_id, CAST(count(*) AS INTEGER) AS n_common_ca, round(sqrt(avg((mx - x) ** 2 + (my - y) ** 2)), 3) AS rmsd_before, 0.0 AS rmsd_after FROM c GROUP BY k
""")  # fmt: skip
def superpose(spark, d):
    atoms = _copies(spark, d)
    return stages.align_stage(atoms, "k0")[1].select("pdb_id", "n_common_ca", F.round("rmsd_before", 3).alias("rmsd_before"), (F.round("rmsd_after", 3) + 0.0).alias("rmsd_after"))


@query("pair_metrics", """
WITH b AS (SELECT row_number() OVER (ORDER BY id) AS n FROM (SELECT id FROM v_points WHERE pdb_id = 's0' ORDER BY id LIMIT 30)), w AS (SELECT k, n FROM b, range(8) r(k) WHERE n % 5 <> k % 5), c AS (SELECT k, CAST(count(*) AS INTEGER) AS n FROM w GROUP BY 1),
m AS (SELECT r.k AS r, m.k AS m, count(*) AS c FROM w r JOIN w m USING (n) GROUP BY ALL)
SELECT 'k' || r AS structure_ref, 'k' || m AS structure_mobile, cr.n AS n_water_ref, cm.n AS n_water_mobile, round(m.c / cm.n, 6) AS "precision", round(m.c / cr.n, 6) AS recall, round(m.c / cm.n, 6) AS matched_precision, round(m.c / cr.n, 6) AS matched_recall
FROM m JOIN c cr ON cr.k = r JOIN c cm ON cm.k = m
""")  # fmt: skip
def pair_metrics(spark, d):
    atoms = _copies(spark, d)
    st = atoms.select("pdb_id").distinct().select("pdb_id", *[F.lit(v).alias(c) for v, c in zip((10.0, 12.0, 14.0, 90.0, 90.0, 90.0), filters.CELL, strict=True)])
    out = alignment.pairwise(atoms, st, 0.001)
    return rounded(out.select("structure_ref", "structure_mobile", "n_water_ref", "n_water_mobile", "precision", "recall", "matched_precision", "matched_recall"), "precision", "recall", "matched_precision", "matched_recall")


@query("matched_chain", """
WITH p AS (SELECT n_regionkey AS g, count(*) AS n FROM nation GROUP BY 1), c AS (SELECT count(*) - 1 AS m FROM region)
SELECT CAST(g AS BIGINT) AS g, CAST(least(n, m) AS BIGINT) AS matched, round(least(n, m) / n, 6) AS matched_precision, round(least(n, m) / m, 6) AS matched_recall FROM p, c
""")  # fmt: skip
def matched_chain(spark, d):
    """Points at 1, 2, ... of each region and centers half way between: the matching is the shorter side."""
    w = filters.Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    p = t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("g"), F.row_number().over(w).cast("long").alias("id")).withColumns({"x": F.col("id").cast("double"), "y": F.lit(0.0), "z": F.lit(0.0)})
    c = t(spark, d, "region").where("r_regionkey > 0").select(F.col("r_regionkey").cast("long").alias("cluster_id"), (F.col("r_regionkey") + 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return rounded(spatial.matched_coverage(p, c, 0.6, ["g"], "id", "cluster_id"), "matched_precision", "matched_recall")


@query("density_blobs", "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings QUALIFY count(*) OVER (PARTITION BY label) >= 5")
def density_blobs(spark, d):
    """One tight blob for each label, far apart: density clustering finds the labels."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    p = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (at(0) + 1000.0 * F.col("label")).alias("x"), at(1).alias("y"), at(2).alias("z"))
    c = density.cluster(p, 5, 5)
    return c.join(c.groupBy("cluster_id").agg(F.min("id").alias("first")), "cluster_id").where("cluster_id >= 0").select("id", "first")


# tables for reports


@query("best_resolved", "SELECT pdb_id, resolution FROM v_meta ORDER BY resolution, pdb_id LIMIT 20")
def best_resolved(spark, d):
    return partitions.best_resolved(v_meta(spark, d), 20).select("pdb_id", "resolution")


@query("pivot_square", """
SELECT n_regionkey AS i, max(n_nationkey) FILTER (n_nationkey % 4 = 0) AS "0", max(n_nationkey) FILTER (n_nationkey % 4 = 1) AS "1", max(n_nationkey) FILTER (n_nationkey % 4 = 2) AS "2", max(n_nationkey) FILTER (n_nationkey % 4 = 3) AS "3" FROM nation GROUP BY 1
""")  # fmt: skip
def pivot_square(spark, d):
    n = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("i"), (F.col("n_nationkey") % 4).cast("string").alias("j")).agg(F.max("n_nationkey").alias("v"))
    return partitions.pivot_square(n, "i", "j", "v", ["0", "1", "2", "3"])


@query("value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, d):
    return partitions.value_counts(t(spark, d, "lineitem"), "l_returnflag")


@query("positive_ranges", """
WITH m AS (SELECT 'l_discount' AS "column", CAST(l_discount AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_tax', CAST(l_tax AS DOUBLE) FROM lineitem) SELECT "column", count(*) AS n, min(v) AS least, max(v) AS greatest FROM m WHERE v > 0 GROUP BY 1
""")  # fmt: skip
def positive_ranges(spark, d):
    return partitions.positive_ranges(t(spark, d, "lineitem"), ["l_discount", "l_tax"])


@query("sweep_summary", """
WITH p AS (SELECT 0 AS candidate, id, pdb_id, cluster_id FROM v_points UNION ALL SELECT 1, id, pdb_id, CASE WHEN id % 3 = 0 THEN -1 ELSE cluster_id END FROM v_points), o AS (SELECT candidate, cluster_id, count(DISTINCT pdb_id) / 25.0 AS occ FROM p WHERE cluster_id >= 0 GROUP BY ALL)
SELECT n.candidate, round(noise_frac, 6) AS noise_frac, count(occ) AS n_clusters, round(median(occ), 6) AS median_occ, round(max(occ), 6) AS max_occ, count(*) FILTER (occ >= 0.25) AS n_occ_ge_0_25, count(*) FILTER (occ >= 0.5) AS n_occ_ge_0_5, count(*) FILTER (occ >= 0.75) AS n_occ_ge_0_75
FROM (SELECT candidate, avg(CAST(cluster_id = -1 AS INTEGER)) AS noise_frac FROM p GROUP BY 1) n LEFT JOIN o USING (candidate) GROUP BY ALL
""")  # fmt: skip
def sweep_summary(spark, d):
    p = v_points(spark, d)
    both = [p, p.withColumn("cluster_id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("cluster_id")))]
    points = both[0].withColumn("candidate", F.lit(0)).unionByName(both[1].withColumn("candidate", F.lit(1)))
    tables = [clusters.table(clusters.members(x, 1e9), 25).withColumn("candidate", F.lit(k)) for k, x in enumerate(both)]
    return rounded(clusters.sweep_summary(points, tables[0].unionByName(tables[1])), "noise_frac", "median_occ", "max_occ")


@query("subset_noise", """
WITH g AS (SELECT cluster_id FROM v_clusters WHERE cluster_occupancy > 0.4), m AS (SELECT count(DISTINCT pdb_id) AS n_structures, count(*) AS n_points, count(*) FILTER (cluster_id = -1) AS n_noise, count(*) FILTER (NOT (within_cutoff AND cluster_id IN (SELECT cluster_id FROM g))) AS n_nonconsensus FROM v_members),
c AS (SELECT count(*) AS n_clusters, count(*) FILTER (cluster_occupancy <= 0.4) AS n_nonconsensus_clusters FROM v_clusters)
SELECT *, round(n_nonconsensus_clusters / n_clusters, 6) AS cluster_share, round(n_nonconsensus / n_points, 6) AS point_share FROM m, c
""")  # fmt: skip
def subset_noise(spark, d):
    return rounded(clusters.subset_noise(v_members(spark, d), v_clusters(spark, d), 0.4), "cluster_share", "point_share")


@query("pr_scatter", """
SELECT a.pdb_id, round(a."precision", 6) AS "precision", round(a.recall, 6) AS recall, round(a.f1, 6) AS f1, NOT EXISTS (SELECT 1 FROM v_pr b WHERE b."precision" >= a."precision" AND b.recall >= a.recall AND (b."precision" > a."precision" OR b.recall > a.recall)) AS on_front,
  a.pdb_id = (SELECT pdb_id FROM v_pr ORDER BY f1 DESC, pdb_id LIMIT 1) AS is_knee FROM v_pr a
""")  # fmt: skip
def pr_scatter(spark, d):
    return rounded(clusters.scatter(v_pr(spark, d), "pdb_id").select("pdb_id", "precision", "recall", "f1", "on_front", "is_knee"), "precision", "recall", "f1")


@query("qq_pairs", """
WITH q AS (SELECT id % 2 AS cohort, quantile_cont(x, [(i + 0.5) / 199 FOR i IN range(199)]) FILTER (cluster_id >= 3) AS a, quantile_cont(x, [(i + 0.5) / 199 FOR i IN range(199)]) FILTER (cluster_id < 3) AS b FROM v_points GROUP BY 1)
SELECT cohort, CAST(k AS INTEGER) AS k, round(a[k + 1], 6) AS "left", round(b[k + 1], 6) AS "right" FROM q, range(199) r(k)
""")  # fmt: skip
def qq_pairs(spark, d):
    x = v_points(spark, d).select((F.col("id") % 2).alias("cohort"), "x", (F.col("cluster_id") >= 3).alias("lft"))
    return rounded(stats.qq_pairs(x, "x", "lft", ["cohort"]).select("cohort", "k", "left", "right"), "left", "right")


@query("group_values", "SELECT l_returnflag, CAST(l_quantity AS DOUBLE) / l_linenumber AS value FROM lineitem WHERE l_linenumber <> 3")
def group_values(spark, d):
    n = F.col("l_linenumber")
    return stats.group_values(t(spark, d, "lineitem").select("l_returnflag", F.when(n == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double") / n).alias("v")), "v", ["l_returnflag"])


@query("hexbin", """
WITH g AS (SELECT x, y, b_factor, x / 2.0 AS u, y / (2 * sqrt(3)) AS v FROM v_points), h AS (
  SELECT b_factor, CASE WHEN (u - round(u)) ** 2 + 3 * (v - round(v)) ** 2 < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 THEN round(u) ELSE floor(u) + 0.5 END AS i,
    CASE WHEN (u - round(u)) ** 2 + 3 * (v - round(v)) ** 2 < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 THEN round(v) ELSE floor(v) + 0.5 END AS j FROM g)
SELECT round(i * 2, 4) + 0.0 AS hx, round(j * 2 * sqrt(3), 4) + 0.0 AS hy, count(*) AS n, round(avg(b_factor), 6) AS mean FROM h GROUP BY ALL
""")  # fmt: skip
def hexbin(spark, d):
    h = binning.hexbin_mean(v_points(spark, d), "x", "y", "b_factor", 2.0)
    return h.select((F.round("hx", 4) + 0.0).alias("hx"), (F.round("hy", 4) + 0.0).alias("hy"), "n", F.round("mean", 6).alias("mean"))


_LONG = """m AS (SELECT 'c' || (id % 2) AS cohort, cluster_id >= 3 AS lft, 'x' AS metric, x AS v FROM v_points UNION ALL SELECT 'c' || (id % 2), cluster_id >= 3, 'b_factor', b_factor FROM v_points),
n AS (SELECT metric, cohort, v, count(*) FILTER (lft) AS a, count(*) FILTER (NOT lft) AS b FROM m GROUP BY ALL), w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY metric, cohort ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)"""


#: Areas by midpoints: of the normal density within z, and of cos^(df - 1), whose share beyond an angle is Student's p.
_NORMAL_P = "1 - 2 * (SELECT sum(exp(0 - ((k + 0.5) / 20000 * z) ** 2 / 2)) FROM range(20000) r(k)) * z / 20000 / sqrt(2 * pi())"
_T_P = "1 - (SELECT sum(cos((k + 0.5) / 20000 * th) ** (df - 1)) * th / sum(cos((k + 0.5) / 20000 * pi() / 2) ** (df - 1)) / (pi() / 2) FROM range(20000) r(k))"
_U = """ties AS (SELECT metric, cohort, sum((a + b) ** 3 - (a + b)) AS ts FROM n GROUP BY ALL),
u AS (SELECT metric, cohort, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right, sum(a * (below + b / 2)) AS u FROM w GROUP BY ALL),
z AS (SELECT *, greatest(0, abs(u - n_left * n_right / 2) - 0.5) / sqrt(n_left * n_right / 12 * (n_left + n_right + 1 - ts / ((n_left + n_right) * (n_left + n_right - 1)))) AS z FROM u JOIN ties USING (metric, cohort)),
pu AS (SELECT metric, cohort, n_left, n_right, u, """ + _NORMAL_P + """ AS p FROM z)"""


def _long_split(spark, d):
    return v_points(spark, d).select(F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("cohort"), (F.col("cluster_id") >= 3).alias("lft"), "x", "b_factor")


@query("comparison_table", f"""
WITH {_LONG}, {_U},
sd AS (SELECT metric, cohort, lft, v, row_number() OVER (PARTITION BY metric, cohort, lft ORDER BY v) - 1 AS idx, count(*) OVER (PARTITION BY metric, cohort, lft) AS n FROM m),
hb AS (SELECT draw, st, {_mix_sql("(st * 2654435769 + draw + 1) % 4294967296", "h")} FROM range(2000) r(draw), range(2) s(st)),
kk AS (SELECT metric, cohort, lft, draw, n, {_mix_sql("(h + idx * 2654435769) % 4294967296", "x")} FROM sd JOIN hb ON hb.st = CASE WHEN lft THEN 0 ELSE 1 END),
mm AS (SELECT metric, cohort, lft, draw, CAST((x * n) >> 32 AS BIGINT) AS idx, count(*) AS k FROM kk GROUP BY ALL),
ww AS (SELECT metric, cohort, draw, v, coalesce(sum(k) FILTER (lft), 0) AS a, coalesce(sum(k) FILTER (NOT lft), 0) AS b FROM sd JOIN mm USING (metric, cohort, lft, idx) GROUP BY ALL),
cc AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY metric, cohort, draw ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ww),
ee AS (SELECT metric, cohort, draw, 2 * sum(a * (below + b / 2)) / (sum(a) * sum(b)) - 1 AS r FROM cc GROUP BY ALL),
ci AS (SELECT metric, cohort, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM ee GROUP BY ALL),
q AS (SELECT metric, cohort, median(v) FILTER (lft) AS median_left, quantile_cont(v, 0.25) FILTER (lft) AS q1_left, quantile_cont(v, 0.75) FILTER (lft) AS q3_left, median(v) FILTER (NOT lft) AS median_right, quantile_cont(v, 0.25) FILTER (NOT lft) AS q1_right, quantile_cont(v, 0.75) FILTER (NOT lft) AS q3_right FROM m GROUP BY ALL)
SELECT metric, cohort, n_left, round(median_left, 2) AS median_left, round(q1_left, 2) AS q1_left, round(q3_left, 2) AS q3_left, n_right, round(median_right, 2) AS median_right, round(q1_right, 2) AS q1_right, round(q3_right, 2) AS q3_right,
  round(2 * u / (n_left * n_right) - 1, 6) AS r, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 5) AS p, CASE WHEN p < 1e-4 THEN '****' WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS sig
FROM q JOIN pu USING (metric, cohort) JOIN ci USING (metric, cohort)
""")  # fmt: skip
def comparison_table(spark, d):
    out = stages.comparison_table(_long_split(spark, d), ["x", "b_factor"], "lft").withColumns({"lo": F.col("ci.lo"), "hi": F.col("ci.hi"), "p": F.round("p", 5)}).drop("ci")
    return rounded(out, "median_left", "q1_left", "q3_left", "median_right", "q1_right", "q3_right", "r", "lo", "hi")


@query("two_sample_tests", f"""
WITH RECURSIVE {_LONG}, {_U},
c AS (SELECT *, sum(a) OVER k / sum(a) OVER p AS fa, sum(b) OVER k / sum(b) OVER p AS fb FROM n WINDOW k AS (PARTITION BY metric, cohort ORDER BY v), p AS (PARTITION BY metric, cohort)), d AS (SELECT metric, cohort, max(abs(fa - fb)) AS d FROM c GROUP BY ALL),
s AS (SELECT metric, cohort, avg(v) FILTER (lft) - avg(v) FILTER (NOT lft) AS gap, var_samp(v) FILTER (lft) / count(*) FILTER (lft) AS va, var_samp(v) FILTER (NOT lft) / count(*) FILTER (NOT lft) AS vb, count(*) FILTER (lft) - 1 AS da, count(*) FILTER (NOT lft) - 1 AS db FROM m GROUP BY ALL),
t AS (SELECT metric, cohort, gap / sqrt(va + vb) AS t, (va + vb) ** 2 / (va ** 2 / da + vb ** 2 / db) AS df, atan(abs(gap) / sqrt(va + vb) / sqrt((va + vb) ** 2 / (va ** 2 / da + vb ** 2 / db))) AS th FROM s),
pt AS (SELECT metric, cohort, t, {_T_P} AS p FROM t),
k AS (SELECT metric, cohort, n_left AS n1, n_right AS n2, CAST(round(d * n_left * n_right) AS BIGINT) AS h, 0 AS s, [CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 1.0 END FOR i IN range(0, n_left + 1)] AS g FROM u JOIN d USING (metric, cohort)
  UNION ALL SELECT metric, cohort, n1, n2, h, s + 1, [CASE WHEN i > s + 1 OR s + 1 - i > n2 OR abs(i * n2 - (s + 1 - i) * n1) >= h THEN 1.0::DOUBLE ELSE (CASE WHEN i > 0 THEN i * g[i] ELSE 0 END + CASE WHEN s + 1 - i > 0 THEN (s + 1 - i) * g[i + 1] ELSE 0 END) / (s + 1) END FOR i IN range(0, n1 + 1)] FROM k WHERE s < n1 + n2),
pk AS (SELECT metric, cohort, g[n1 + 1] AS p FROM k WHERE s = n1 + n2)
SELECT metric, cohort, n_left, n_right, round(u, 4) AS u, round(d, 6) AS d, round(t, 6) AS t, round(pu.p, 5) AS p_mann_whitney, round(pk.p, 5) AS p_ks, round(pt.p, 5) AS p_welch
FROM pu JOIN d USING (metric, cohort) JOIN pt USING (metric, cohort) JOIN pk USING (metric, cohort)
""")  # fmt: skip
def two_sample_tests(spark, d):
    """Statistics with their p-values: areas under the curves, and Kolmogorov-Smirnov's by counting lattice paths."""
    x = _long_split(spark, d).unpivot(["cohort", "lft"], ["x", "b_factor"], "metric", "v")
    p = stats.p_values(x, "v", "lft", ["metric", "cohort"])
    return p.select("metric", "cohort", "n_left", "n_right", F.round("u", 4).alias("u"), F.round("d", 6).alias("d"), F.round("t", 6).alias("t"), *[F.round(c, 5).alias(c) for c in ("p_mann_whitney", "p_ks", "p_welch")])


@query("spearman_test", f"""
WITH m AS (SELECT 'c' || (id % 2) AS cohort, x, b_factor AS y FROM v_points), k AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY x) + (count(*) OVER (PARTITION BY cohort, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort ORDER BY y) + (count(*) OVER (PARTITION BY cohort, y) - 1) / 2.0 AS rb FROM m),
r AS (SELECT cohort, count(*) AS n, corr(ra, rb) AS rho FROM k GROUP BY 1), t AS (SELECT *, n - 2 AS df, atan(abs(rho) / sqrt(1 - rho * rho)) AS th FROM r)
SELECT cohort, n, round(rho, 6) AS rho, round({_T_P}, 5) AS p FROM t
""")  # fmt: skip
def spearman_test(spark, d):
    x = _long_split(spark, d)
    return stats.spearman_test(x, "x", "b_factor", ["cohort"]).select("cohort", "n", F.round("rho", 6).alias("rho"), F.round("p", 5).alias("p"))


# partitions of structures whose distances come in levels, so that classes are known


def _levels(spark, d):
    """Distances of nations: 1 in a class of keys modulo 4, 3 modulo 2, else 6; and 1 in a region, else 5."""
    n = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.toDF("i", "ri"), n.toDF("j", "rj")
    i, j = F.col("i"), F.col("j")
    # 25 nations: every pair is the operators' input
    pairs = a.join(b, i != j)
    return pairs.select("i", "j", "ri", "rj", F.when(i % 4 == j % 4, 1.0).when(i % 2 == j % 2, 3.0).otherwise(6.0).alias("u"), F.when(F.col("ri") == F.col("rj"), 1.0).otherwise(5.0).alias("v"))


_LEVELS_SQL = "p AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey AS ri, b.n_regionkey AS rj, CASE WHEN a.n_nationkey % 4 = b.n_nationkey % 4 THEN 1.0 WHEN a.n_nationkey % 2 = b.n_nationkey % 2 THEN 3.0 ELSE 6.0 END AS u, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.0 ELSE 5.0 END AS v FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)"


@query("crystal_forms", """
WITH m AS (SELECT n_nationkey AS member, CASE WHEN n_nationkey = 7 THEN 'alone' ELSE 'g' || n_regionkey END AS g, n_nationkey % 2 AS c FROM nation), f AS (SELECT *, min(member) OVER (PARTITION BY g, c) AS first FROM m)
SELECT member, g || '#' || dense_rank() OVER (PARTITION BY g ORDER BY first) AS label FROM f
""")  # fmt: skip
def crystal_forms(spark, d):
    m = t(spark, d, "nation").select(F.col("n_nationkey").alias("pdb_id"), F.when(F.col("n_nationkey") == 7, "alone").otherwise(F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))).alias("space_group"))
    return partitions.crystal_forms(_levels(spark, d), "i", "j", "u", m, 4.0)


@query("linkage_classes", """
WITH f AS (SELECT n_nationkey AS member, min(n_nationkey) OVER (PARTITION BY n_nationkey % 4) AS a, min(n_nationkey) OVER (PARTITION BY n_nationkey % 2) AS b FROM nation)
SELECT 2.0 AS cut, member, CAST(dense_rank() OVER (ORDER BY a) AS INTEGER) AS label FROM f UNION ALL SELECT 4.0, member, CAST(dense_rank() OVER (ORDER BY b) AS INTEGER) FROM f UNION ALL SELECT 6.0, member, 1 FROM f
""")  # fmt: skip
def linkage_classes(spark, d):
    return partitions.linkage_sweep(_levels(spark, d), "i", "j", "u", [2.0, 4.0, 6.0])


@query("agreement_sweep", """
WITH l AS (SELECT n_nationkey AS m, cut_a, CASE cut_a WHEN 2.0 THEN n_nationkey % 4 WHEN 4.0 THEN n_nationkey % 2 ELSE 0 END AS a, cut_b, CASE cut_b WHEN 0.5 THEN n_nationkey WHEN 2.0 THEN n_regionkey ELSE 0 END AS b FROM nation, (VALUES (2.0), (4.0), (6.0)) x(cut_a), (VALUES (0.5), (2.0), (5.0)) y(cut_b)),
c AS (SELECT cut_a, cut_b, sum(k * (k - 1) / 2) AS s FROM (SELECT cut_a, cut_b, a, b, CAST(count(*) AS DOUBLE) AS k FROM l GROUP BY ALL) GROUP BY ALL), sa AS (SELECT cut_a, cut_b, sum(k * (k - 1) / 2) AS sa, sum(k) AS n FROM (SELECT cut_a, cut_b, a, CAST(count(*) AS DOUBLE) AS k FROM l GROUP BY ALL) GROUP BY ALL),
sb AS (SELECT cut_a, cut_b, sum(k * (k - 1) / 2) AS sb FROM (SELECT cut_a, cut_b, b, CAST(count(*) AS DOUBLE) AS k FROM l GROUP BY ALL) GROUP BY ALL), x AS (SELECT *, sa * sb / (n * (n - 1) / 2) AS e, (sa + sb) / 2 AS most FROM c JOIN sa USING (cut_a, cut_b) JOIN sb USING (cut_a, cut_b))
SELECT CAST(cut_a AS DOUBLE) AS cut_a, CAST(cut_b AS DOUBLE) AS cut_b, round(CASE WHEN abs(most - e) > 1e-12 THEN (s - e) / (most - e) ELSE 1 END, 6) AS ari FROM x
""")  # fmt: skip
def agreement_sweep(spark, d):
    p = _levels(spark, d)
    return rounded(partitions.agreement_sweep(partitions.linkage_sweep(p, "i", "j", "u", [2.0, 4.0, 6.0]), partitions.linkage_sweep(p, "i", "j", "v", [0.5, 2.0, 5.0])), "ari")


@query("cophenetic", f"""
WITH {_LEVELS_SQL}, k AS (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS ra, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rb FROM p WHERE i < j) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k
""")  # fmt: skip
def cophenetic(spark, d):
    p = _levels(spark, d)
    both = partitions.cophenetic_heights(p, "i", "j", "u").withColumnRenamed("height", "a").join(partitions.cophenetic_heights(p, "i", "j", "v").withColumnRenamed("height", "b"), ["i", "j"])
    return rounded(stats.spearman(both.withColumn("_k", F.lit(1)), "a", "b", ["_k"]).select("n", "rho"), "rho")


@query("leaf_order", "SELECT n_nationkey AS member, CAST(row_number() OVER (ORDER BY n_nationkey % 2, n_nationkey % 4, n_nationkey) - 1 AS INTEGER) AS place FROM nation")
def leaf_order(spark, d):
    """Equal distances merge by least members, so classes, and the halves of classes, follow one another."""
    return partitions.leaf_order(_levels(spark, d), "i", "j", "u")


@query("rho_by_group", f"""
WITH {_LEVELS_SQL}, q AS (SELECT u, (i * j) % 11 AS w, ri = rj AS same FROM p WHERE i < j), m AS (SELECT 'all' AS pairs, * FROM q UNION ALL SELECT 'same', * FROM q WHERE same UNION ALL SELECT 'different', * FROM q WHERE NOT same),
k AS (SELECT pairs, rank() OVER (PARTITION BY pairs ORDER BY u) + (count(*) OVER (PARTITION BY pairs, u) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY pairs ORDER BY w) + (count(*) OVER (PARTITION BY pairs, w) - 1) / 2.0 AS rb FROM m)
SELECT pairs, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k GROUP BY 1
""")  # fmt: skip
def rho_by_group(spark, d):
    p = _levels(spark, d).where("i < j").withColumn("w", ((F.col("i") * F.col("j")) % 11).cast("double"))
    return rounded(stats.rho_by_group(p, "u", "w", "ri", "rj"), "rho")
