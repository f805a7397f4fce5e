"""Superposition of structures on a reference, and metrics of all ordered pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import NAMES, THREE_TO_ONE, superpose
from ..functions.scalars import max_cell_diff
from .filters import CELL, is_water_oxygen
from .spatial import maximum_matching

REPORT = "pdb_id string, n_common_ca int, rmsd_before double, rmsd_after double, rotation array<double>, shift array<double>, warning string"


def best_altlocs(atoms: DataFrame) -> DataFrame:
    """Protein atoms at each residue's alternative location of the largest summed occupancy (first on ties)."""
    p = atoms.where(F.col("res_name").isin(*NAMES, "MSE"))
    key = ["pdb_id", "chain_id", "res_id", "ins_code"]
    alt = F.coalesce("altloc", F.lit("."))
    s = p.where(~alt.isin(".", "")).groupBy(*key, "altloc").agg(F.sum("occupancy").alias("o"), F.min("atom_ord").alias("a"))
    best = s.groupBy(*key).agg(F.max_by("altloc", F.struct("o", -F.col("a"))).alias("_best"))
    return p.join(best, key, "left").where(alt.isin(".", "") | (F.col("altloc") == F.col("_best"))).drop("_best")


def ca_trace(atoms: DataFrame) -> DataFrame:
    """Per structure the alpha carbons in order: seq, xyz (flat). All chains follow one another; unknown residues are skipped."""
    names = F.create_map(*[F.lit(v) for kv in THREE_TO_ONE.items() for v in kv])
    ca = best_altlocs(atoms).where((F.col("atom_name") == "CA") & (F.col("group_pdb") == "ATOM")).withColumn("one", F.element_at(names, F.col("res_name"))).where("one is not null")
    g = ca.groupBy("pdb_id").agg(F.sort_array(F.collect_list(F.struct("atom_ord", "one", "x", "y", "z"))).alias("t"))
    return g.select("pdb_id", F.array_join(F.transform("t", lambda s: s["one"]), "").alias("seq"), F.flatten(F.transform("t", lambda s: F.array(s["x"], s["y"], s["z"]))).alias("xyz"))


def align(traces: DataFrame, reference: DataFrame) -> DataFrame:
    """Each structure on the reference (one row of ``ca_trace``): report with rotation and shift; few pairs give a warning."""
    ref = reference.select(F.col("seq").alias("_rs"), F.col("xyz").alias("_rx")).limit(1)

    def run(it):
        for pdf in it:
            rows = []
            for p, s, x, rs, rx in zip(pdf["pdb_id"], pdf["seq"], pdf["xyz"], pdf["_rs"], pdf["_rx"], strict=True):
                got = superpose(np.reshape(rx, (-1, 3)), rs, np.reshape(x, (-1, 3)), s)
                if got is None:
                    rows.append((p, None, None, None, None, None, "fewer than 10 common positions"))
                else:
                    rows.append((p, got["n_common_ca"], got["rmsd_before"], got["rmsd_after"], got["rotation"].ravel().tolist(), got["shift"].tolist(), None))
            yield pd.DataFrame(rows, columns=["pdb_id", "n_common_ca", "rmsd_before", "rmsd_after", "rotation", "shift", "warning"])

    return traces.join(F.broadcast(ref)).mapInPandas(run, REPORT)


def transform(atoms: DataFrame, report: DataFrame) -> DataFrame:
    """All atoms of aligned structures, moved; structures without a fit are left out."""
    t = atoms.join(report.where("rotation is not null").select("pdb_id", "rotation", "shift"), "pdb_id")
    new = {a: sum((F.get("rotation", F.lit(3 * i + j)) * F.col(b) for j, b in enumerate("xyz")), F.get("shift", F.lit(i))) for i, a in enumerate("xyz")}
    return t.withColumns(new).select(*atoms.columns)


PAIR = (
    "structure_ref string, structure_mobile string, n_water_ref int, n_water_mobile int, n_common_ca int, rmsd_after double, precision double, "
    "recall double, f1 double, matched_precision double, matched_recall double, chamfer double"
)


def pair_metrics(ref_w: np.ndarray, mob_w: np.ndarray, radius: float) -> tuple:
    """(precision, recall, F1, matched precision, matched recall, chamfer); all None if a side is empty."""
    if not len(ref_w) or not len(mob_w):
        return (None,) * 6
    d = np.sqrt(((ref_w[:, None] - mob_w[None]) ** 2).sum(2))
    near = d <= radius
    recall, precision = float(near.any(1).mean()), float(near.any(0).mean())
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    m = maximum_matching(list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    return precision, recall, f1, m / len(mob_w), m / len(ref_w), float(d.min(1).mean() + d.min(0).mean())


def pairwise(atoms: DataFrame, structures: DataFrame, radius: float, block: int = 32) -> DataFrame:
    """Metrics of every ordered pair, self pairs included: the mobile waters, superposed, against the reference's.

    Structures are dealt over blocks of some ``block``; a task gets two blocks and makes all pairs between them, so each
    structure travels once for each block, not once for each structure.
    """
    w = atoms.where(is_water_oxygen()).groupBy("pdb_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("atom_ord", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"]))).alias("w"))
    one = ca_trace(atoms).join(w, "pdb_id", "left").withColumn("w", F.coalesce("w", F.array().cast("array<double>")))
    blocks = max(1, -(-structures.count() // block))
    own = F.pmod(F.xxhash64("pdb_id"), F.lit(blocks)).cast("int")
    dealt = one.select("pdb_id", "seq", "xyz", "w", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        held = [(r.own, r.pdb_id, r.seq, np.reshape(r.xyz, (-1, 3)), np.reshape(r.w, (-1, 3))) for r in pdf.sort_values("pdb_id").itertuples()]
        rows = []
        for b1, ref, rs, rx, rw in held:
            for b2, mobile, ms, mx, mw in held:
                if (b1, b2) not in ((low, high), (high, low)):
                    continue
                got = superpose(rx, rs, mx, ms)
                m = pair_metrics(rw, mw @ got["rotation"].T + got["shift"], radius) if got else (None,) * 6
                rows.append((ref, mobile, len(rw), len(mw), got and got["n_common_ca"], got and got["rmsd_after"], *m))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")])

    out = dealt.groupBy("low", "high").applyInPandas(run, PAIR)
    c1 = structures.select(F.col("pdb_id").alias("structure_ref"), *[F.col(c).alias(f"_r{c}") for c in CELL])
    c2 = structures.select(F.col("pdb_id").alias("structure_mobile"), *[F.col(c).alias(f"_m{c}") for c in CELL])
    out = out.join(c1, "structure_ref").join(c2, "structure_mobile").withColumn("max_cell_diff", max_cell_diff([f"_r{c}" for c in CELL], [f"_m{c}" for c in CELL]))
    return out.drop(*[f"_r{c}" for c in CELL], *[f"_m{c}" for c in CELL])
