"""The stages of a cohort as lazy plans: metadata, filter, align, cluster, pairwise metrics, consensus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..operators import alignment, binning, clusters, density, filters, resampling, spatial
from ..sources import readers, structure_format


def members_found(cohort: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with atoms, ids without)."""
    have = atoms.select("pdb_id").distinct()
    return cohort.join(have, "pdb_id", "left_semi"), cohort.join(have, "pdb_id", "left_anti")


def inputs(cohort: DataFrame, atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """(pdb_id, has_scores) of the ids with atoms."""
    have = scores.select("pdb_id").distinct().withColumn("has_scores", F.lit(True))
    return members_found(cohort, atoms)[0].select("pdb_id").distinct().join(have, "pdb_id", "left").withColumn("has_scores", F.coalesce("has_scores", F.lit(False)))


def filter_stage(atoms: DataFrame, structures: DataFrame, c: Config, scores: DataFrame | None = None, exclusive: bool = False, drop_without_scores: bool = False):
    return filters.filter_waters(atoms, structures, c.distance_cutoff, scores, c.edia_cutoff, c.bfactor_cutoff, c.bfactor_mode, c.bfactor_population, exclusive, drop_without_scores)


def align_stage(atoms: DataFrame, reference: str, raw: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(atoms moved onto the reference, report); the reference's own trace comes from the raw atoms."""
    traces = alignment.ca_trace(atoms)
    ref = alignment.ca_trace((atoms if raw is None else raw).where(F.col("pdb_id") == reference))
    report = alignment.align(traces, ref)
    return alignment.transform(atoms, report), report


def cluster_stage(atoms: DataFrame, c: Config, n_structures: int, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of the pooled waters; the occupancy's denominator is the number of structures found."""
    w = readers.waters(atoms, scores).withColumn("id", F.xxhash64("pdb_id", "atom_ord"))
    rows = clusters.members(density.cluster(w, c.min_cluster_size, c.min_samples, order=["pdb_id", "atom_ord"]), c.cluster_radius)
    return rows, clusters.table(rows, n_structures)


def add_zscore(members: DataFrame, atoms: DataFrame, population: str = "water") -> DataFrame:
    """b_factor_zscore from the structures' own atoms; NULL where a structure is missing."""
    m = filters.population(population)
    ref = atoms.groupBy("pdb_id").agg(F.avg(F.when(m, F.col("b_factor"))).alias("ref_mean"), F.stddev_pop(F.when(m, F.col("b_factor"))).alias("ref_std"))
    return members.join(ref, "pdb_id", "left").withColumn("b_factor_zscore", filters.zscore()).drop("ref_mean", "ref_std")


def numbers(df: DataFrame, ids: tuple[str, ...] = ("pdb_id", "cohort")) -> DataFrame:
    """Every other column as a number; what isn't one, names included, is NULL."""
    return df.select(*[F.col(c) if c in ids else F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c) for c in df.columns])


def with_metadata(pr: DataFrame, meta: DataFrame, suffix: str = "_deposited", coerce: bool = True) -> DataFrame:
    """Precision and recall beside the metadata by pdb_id; a metadata column of a name that is taken gets the suffix."""
    meta = numbers(meta) if coerce else meta
    return pr.join(meta.withColumnsRenamed({c: c + suffix for c in meta.columns if c in pr.columns and c != "pdb_id"}), "pdb_id", "left")


def cohort_frames(members: DataFrame, cluster_table: DataFrame, meta: DataFrame, c: Config, cohort: str, suffix: str = "_deposited") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(waters with group, structures with precision and recall beside their metadata as numbers, summary)."""
    waters = clusters.consensus_mask(members, cluster_table, c.consensus_cutoff)
    waters = waters.withColumns({"group": clusters.consensus_label(), "cohort": F.lit(cohort)})
    points = members.withColumn("_id", F.xxhash64("pdb_id", "chain_id", "res_id", "altloc", "x", "y", "z"))
    pr = spatial.coverage(points, clusters.consensus_centers(cluster_table, c.consensus_cutoff), c.match_radius, ["pdb_id"], "_id", "cluster_id")
    structures = with_metadata(pr, meta, suffix).withColumn("cohort", F.lit(cohort))
    return waters, structures, clusters.summary(pr, cluster_table, members, c.consensus_cutoff, "pdb_id").withColumn("cohort", F.lit(cohort))


def load_cohorts(spark: SparkSession, folder: str, cohorts: list[str], c: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frames of several cohorts below a folder (``<cohort>/cluster_members.csv`` and ``clusters.csv``) as one each."""
    out = None
    for name in cohorts:
        m, t = (readers.read_csv(spark, f"{folder.rstrip('/')}/{name}/{f}.csv", s) for f, s in (("cluster_members", schemas.MEMBERS), ("clusters", schemas.CLUSTERS)))
        meta = readers.read_metadata(spark, folder, name)
        if meta is None:
            meta = spark.createDataFrame([], schemas.METADATA)
        own = cohort_frames(m, t, meta, c, name)
        out = own if out is None else tuple(a.unionByName(b) for a, b in zip(out, own, strict=True))
    return out


def comparison_table(df: DataFrame, metrics: list[str], left: str, cohort: str = "cohort", unit: str | None = None, n_boot: int = 2000, test: str = "mannwhitney") -> DataFrame:
    """Per metric and cohort: medians and quartiles of both sides, effect with interval, p and its mark."""
    from ..functions.scalars import stars

    long = df.select(cohort, left, *([unit] if unit else []), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([cohort, left, *([unit] if unit else [])], metrics, "metric", "value")
    iqr = binning.median_iqr(long.where(F.col(left).isNotNull()), "value", ["metric", cohort, left])
    sides = [iqr.where(F.col(left) == v).select("metric", cohort, *[F.col(c).alias(f"{c}_{name}") for c in ("n", "median", "q1", "q3")]) for v, name in ((True, "left"), (False, "right"))]
    boot = resampling.bootstrap(long, "value", left, ["metric", cohort], unit, n_boot, test=test).select("metric", cohort, "r", F.struct("lo", "hi").alias("ci"), "p").withColumn("sig", stars("p"))
    return sides[0].join(sides[1], ["metric", cohort], "full").join(boot, ["metric", cohort], "left")


def load(spark: SparkSession, path: str, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, structures, scores) of a folder; with ``whole`` (``read_whole``, persisted) each file is parsed once for both."""
    whole = structure_format.read_whole(spark, path) if whole is None else whole
    return structure_format.atoms_in(whole), structure_format.structures_in(whole), readers.read_scores(spark, path)
