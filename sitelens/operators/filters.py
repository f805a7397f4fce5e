"""Site filters: distance after relocation, quality score, B-factor; each a flag, so that removals can be attributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import nearest_images

CELL = ("cell_a", "cell_b", "cell_c", "cell_alpha", "cell_beta", "cell_gamma")


def is_water_oxygen() -> Column:
    return (F.col("res_name") == "HOH") & (F.col("group_pdb") == "HETATM") & (F.col("element") == "O")


def is_protein_heavy() -> Column:
    return (F.col("group_pdb") != "HETATM") & (F.col("element") != "H")


def count_water_oxygens(atoms: DataFrame) -> DataFrame:
    """Per structure, alternative locations apart; structures without water count 0."""
    return atoms.groupBy("pdb_id").agg(F.count_if(is_water_oxygen()).alias("num_water"))


def relocate(atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """Water oxygens with columns nx, ny, nz (nearest symmetry copy), min_distance, moved and error.

    A structure without a cell, or in an unknown group, has an error in all its rows and no positions; the others go on.
    """
    work = atoms.where(is_water_oxygen() | is_protein_heavy()).withColumn("_w", is_water_oxygen()).join(structures.select("pdb_id", "space_group", *CELL), "pdb_id", "left")

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("atom_ord")
        w, p = pdf[pdf["_w"]], pdf[~pdf["_w"]]
        xyz = w[["x", "y", "z"]].to_numpy(float)
        out = pd.DataFrame({"pdb_id": w["pdb_id"].to_numpy(), "atom_ord": w["atom_ord"].to_numpy()})
        try:
            cell = [float(pdf[c].iloc[0]) for c in CELL]
            if not np.isfinite(cell).all():
                raise ValueError("no unit cell")
            group = pdf["space_group"].iloc[0]
            pos, dist = nearest_images(xyz, p[["x", "y", "z"]].to_numpy(float), cell, None if pd.isna(group) else group)
        except (ValueError, np.linalg.LinAlgError) as e:
            return out.assign(nx=None, ny=None, nz=None, min_distance=None, moved=None, error=str(e))
        shift = np.linalg.norm(pos - xyz, axis=1)
        return out.assign(nx=pos[:, 0], ny=pos[:, 1], nz=pos[:, 2], min_distance=dist, moved=shift > 1e-4, error=None)

    moved = work.select("pdb_id", "atom_ord", "x", "y", "z", "_w", "space_group", *CELL).groupBy("pdb_id").applyInPandas(move, "pdb_id string, atom_ord int, nx double, ny double, nz double, min_distance double, moved boolean, error string")
    return atoms.where(is_water_oxygen()).join(moved, ["pdb_id", "atom_ord"])


def attach_in_order(sites: DataFrame, scores: DataFrame, keys: list[str], order: str, pos: str, score: str = "score") -> DataFrame:
    """The nth site of a key gets the key's nth score; beyond the last one, or without any, NULL."""
    n = "_nth"
    a = sites.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    b = scores.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(pos)).alias(n), score)
    return a.join(b, [*keys, n], "left").drop(n)


def keep_distance(distance: str, cutoff: float) -> Column:
    return F.coalesce(F.col(distance) <= cutoff, F.lit(False))


def keep_score(score: str, cutoff: float, exclusive: bool = False) -> Column:
    """At least the cutoff (above it if exclusive); a missing score goes."""
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(s > cutoff if exclusive else s >= cutoff, F.lit(False))


def population(kind: str, water: Column | None = None, protein: Column | None = None) -> Column:
    water, protein = (is_water_oxygen() if water is None else water), (is_protein_heavy() if protein is None else protein)
    try:
        return {"water": water, "protein": protein, "all": water | protein}[kind]
    except KeyError:
        raise ValueError(f"unknown population {kind!r}") from None


def with_reference(atoms: DataFrame, member: Column, b: str = "b_factor", key: str = "pdb_id") -> DataFrame:
    """Columns ref_mean and ref_std (population) of B over the members of each structure."""
    ref = atoms.groupBy(key).agg(F.avg(F.when(member, F.col(b))).alias("ref_mean"), F.stddev_pop(F.when(member, F.col(b))).alias("ref_std"))
    return atoms.join(ref, key)


def zscore(b: str = "b_factor") -> Column:
    """(b - mean) / std of the reference; 0 where the std is."""
    return F.when(F.col("ref_std") == 0, F.lit(0.0)).otherwise((F.col(b) - F.col("ref_mean")) / F.col("ref_std"))


def keep_bfactor(cutoff: float, mode: str = "zscore", b: str = "b_factor", exclusive: bool = False) -> Column:
    """At most the cutoff, of B itself or of its z-score; all where the reference doesn't vary."""
    if mode == "absolute":
        c, always = F.col(b), F.lit(False)
    elif mode == "zscore":
        c, always = (F.col(b) - F.col("ref_mean")) / F.when(F.col("ref_std") != 0, F.col("ref_std")), F.col("ref_std") == 0
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(always, F.lit(False)) | F.coalesce(c < cutoff if exclusive else c <= cutoff, F.lit(False))


def attribute(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row fails, NULL if it passes all."""
    out = None
    for name, keep in rules.items():
        out = F.when(~keep, name) if out is None else out.when(~keep, name)
    return F.lit(None).cast("string") if out is None else out


def removed_column(rule: str) -> str:
    return f"n_waters_removed_{'by_' if rule == 'distance' else ''}{rule}"


def filter_report(sites: DataFrame, rules: dict[str, Column], key: str = "pdb_id", moved: str | None = "moved") -> DataFrame:
    """Per structure: sites before, moved, removed by each rule (the first failed), remaining."""
    s = sites.withColumn("_by", attribute(rules))
    return s.groupBy(key).agg(
        F.count("*").alias("n_waters_before"),
        *([F.count_if(F.col(moved)).alias("n_waters_moved")] if moved else []),
        *[F.count_if(F.col("_by") == name).alias(removed_column(name)) for name in rules],
        F.count_if(F.col("_by").isNull()).alias("n_waters_remaining"),
    )


def filter_waters(
    atoms: DataFrame, structures: DataFrame, distance: float = 4.0, scores: DataFrame | None = None, score_cutoff: float | None = None,
    b_cutoff: float | None = None, b_mode: str = "zscore", b_population: str = "water", exclusive: bool = False, drop_without_scores: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms kept, with waters moved; waters with flags; report).

    Waters count once per alternative location. Water hydrogens go; all that isn't water stays. A structure without any
    score keeps its waters unless ``drop_without_scores`` (``edia_applied`` says whether scores counted). The report has
    every structure: zeros without waters, NULL and an error where it failed; failed structures keep no atoms.
    """
    w = relocate(atoms, structures)
    rules = {"distance": keep_distance("min_distance", distance)}
    if score_cutoff is not None:
        scores = atoms.select("pdb_id", "chain_id", "res_id", "ins_code").limit(0).withColumns({"pos": F.lit(0), "score": F.lit(0.0)}) if scores is None else scores
        keys = ["pdb_id", "chain_id", "res_id", "ins_code"]
        w = attach_in_order(w, scores, keys, "atom_ord", "pos")
        has = scores.select("pdb_id", F.lit(True).alias("_has")).distinct()
        w = w.join(has, "pdb_id", "left").withColumn("edia_applied", F.coalesce("_has", F.lit(drop_without_scores))).drop("_has")
        rules["edia"] = keep_score("score", score_cutoff, exclusive) | ~F.col("edia_applied")
    if b_cutoff is not None:
        if b_mode == "zscore":
            m = population(b_population)
            ref = atoms.groupBy("pdb_id").agg(F.avg(F.when(m, F.col("b_factor"))).alias("ref_mean"), F.stddev_pop(F.when(m, F.col("b_factor"))).alias("ref_std"))
            w = w.join(ref, "pdb_id")
        rules["bfactor"] = keep_bfactor(b_cutoff, b_mode, exclusive=exclusive)
    w = w.withColumn("removed_by", attribute(rules))
    failed = w.where("error is not null").groupBy("pdb_id").agg(F.min("error").alias("error"))
    kept = w.where("removed_by is null and error is null").select("pdb_id", "atom_ord", "nx", "ny", "nz")
    water = F.coalesce((F.col("res_name") == "HOH") & (F.col("group_pdb") == "HETATM"), F.lit(False))
    rest = atoms.where(~water).join(failed.select("pdb_id"), "pdb_id", "left_anti").select(*atoms.columns)
    moved = atoms.join(kept, ["pdb_id", "atom_ord"]).withColumns({"x": F.col("nx"), "y": F.col("ny"), "z": F.col("nz")}).select(*atoms.columns)
    counts = filter_report(w.where("error is null"), rules)
    report = atoms.select("pdb_id").distinct().join(failed, "pdb_id", "left").join(counts, "pdb_id", "left")
    n = [c for c in counts.columns if c != "pdb_id"]
    columns = [F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in n]
    if score_cutoff is not None:
        report = report.join(has, "pdb_id", "left")
        columns.append(F.coalesce("_has", F.lit(drop_without_scores)).alias("edia_applied"))
    return rest.unionByName(moved), w, report.select("pdb_id", *columns, "error")
