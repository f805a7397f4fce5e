"""Command line: one sub-command per stage over the DataFrame plans."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import alignment, density
from .operators.filters import count_water_oxygens
from .plans import cohort as stages
from .shared import address
from .sources import readers, structure_format, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitelens", description=__doc__)
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-j", "--jobs", type=int, help="local threads; on a cluster the master decides")
    sub = p.add_subparsers(dest="stage", required=True)
    for name in ("metadata", "filter", "align", "cluster", "search", "pairwise", "zscore", "frames"):
        s = sub.add_parser(name)
        s.add_argument("input", help="folder of structures (for zscore: the members table; for frames: the folder of finished cohorts)")
        s.add_argument("output", help="folder of results")
        s.add_argument("--cohort", help="list file; all structures without it")
        if name in ("align",):
            s.add_argument("--reference", required=True)
        if name in ("filter",):
            s.add_argument("--distance-cutoff", type=float)
            s.add_argument("--edia-cutoff", type=float)
            s.add_argument("--bfactor-cutoff", type=float)
            s.add_argument("--bfactor-mode", choices=("zscore", "absolute"))
            s.add_argument("--bfactor-population", choices=("water", "protein", "all"))
            s.add_argument("--drop-if-no-edia-json", action="store_true", help="drop all waters of structures without scores")
            s.add_argument("--exclusive-borderline", action="store_true", help="a value at a cutoff fails it")
        if name in ("cluster", "search"):
            s.add_argument("--cluster-radius", type=float)
            s.add_argument("--min-cluster-size", type=int)
            s.add_argument("--min-samples", type=int)
        if name == "cluster":
            s.add_argument("--write-cif", action="store_true")
            s.add_argument("--include-noise", action="store_true")
        if name in ("pairwise", "frames"):
            s.add_argument("--match-radius", type=float)
        if name == "frames":
            s.add_argument("--cohorts", nargs="+", required=True, help="subfolders with cluster_members.csv and clusters.csv")
            s.add_argument("--consensus-cutoff", type=float)
        if name == "metadata":
            s.add_argument("--entries", help="folder of archive entries as JSON")
        if name == "zscore":
            s.add_argument("--structures", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.INFO)
    names = ("consensus_cutoff", "distance_cutoff", "edia_cutoff", "bfactor_cutoff", "bfactor_mode", "bfactor_population", "cluster_radius", "match_radius", "min_cluster_size", "min_samples")
    c = Config.load(a.config, **{n: getattr(a, n, None) for n in names})
    if spark is None:
        b = SparkSession.builder.appName("sitelens")
        spark = (b.master(f"local[{a.jobs}]") if a.jobs else b).getOrCreate()
    if a.stage == "frames":
        for name, df in zip(("waters", "structures", "summary"), stages.load_cohorts(spark, a.input, a.cohorts, c), strict=True):
            writers.write_csv(df, f"{a.output}/{name}.csv", one_file=name != "waters")
        return
    source = a.structures if a.stage == "zscore" else a.input
    whole = structure_format.read_whole(spark, source, a.cohort).persist()
    atoms, structures, scores = stages.load(spark, source, whole)
    try:
        if a.stage == "metadata":
            entries = spark.read.option("pathGlobFilter", "*.json").text(a.entries, wholetext=True).select(F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)).alias("pdb_id"), F.col("value").alias("entry")) if a.entries else None
            writers.write_csv(readers.metadata(structures, count_water_oxygens(atoms), entries).orderBy(F.col("resolution").asc_nulls_last(), "pdb_id"), f"{a.output}/metadata.csv")
        elif a.stage == "filter":
            kept, _, report = stages.filter_stage(atoms, structures, c, scores, a.exclusive_borderline, a.drop_if_no_edia_json)
            kept.write.mode("overwrite").parquet(f"{a.output}/atoms")
            kept = spark.read.parquet(f"{a.output}/atoms")
            writers.write_texts(writers.edited_cifs(readers.read_texts(spark, a.input), kept), address(a.output))
            writers.write_report(report, f"{a.output}/{writers.report_name(c.distance_cutoff, c.edia_cutoff, c.bfactor_cutoff, c.bfactor_mode, c.bfactor_population)}")
        elif a.stage == "align":
            moved, report = stages.align_stage(atoms, a.reference.lower())
            moved.write.mode("overwrite").parquet(f"{a.output}/atoms")
            moved = spark.read.parquet(f"{a.output}/atoms")
            writers.write_texts(writers.edited_cifs(readers.read_texts(spark, a.input), moved), address(a.output))
            writers.write_csv(report.drop("rotation", "shift").orderBy("pdb_id"), f"{a.output}/alignment_report.csv")
        elif a.stage == "cluster":
            n = atoms.select("pdb_id").distinct().count()
            rows, table = stages.cluster_stage(atoms, c, n, scores)
            rows.write.mode("overwrite").parquet(f"{a.output}/cluster_members")
            rows = spark.read.parquet(f"{a.output}/cluster_members")
            writers.write_csv(rows, f"{a.output}/cluster_members.csv", one_file=False)
            if a.write_cif:
                noise = rows.where("cluster_id = -1") if a.include_noise else None
                writers.write_cluster_cif(writers.cluster_sites(table, noise, n), f"{address(a.output)}/clusters.cif")
            writers.write_csv(table.orderBy("cluster_id"), f"{a.output}/clusters.csv")
        elif a.stage == "search":
            n = atoms.select("pdb_id").distinct().count()
            w = readers.waters(atoms, scores).withColumn("id", F.xxhash64("pdb_id", "atom_ord"))
            writers.write_csv(density.search(w, n, c.cluster_radius), f"{a.output}/clustering_hyperparameters.csv")
        elif a.stage == "pairwise":
            writers.write_csv(alignment.pairwise(atoms, structures, c.match_radius), f"{a.output}/pairwise_metrics.csv")
        elif a.stage == "zscore":
            from . import schemas

            writers.write_csv(stages.add_zscore(readers.read_csv(spark, a.input, schemas.MEMBERS), atoms, c.bfactor_population), f"{a.output}/cluster_members.csv", one_file=False)
    finally:
        whole.unpersist()


if __name__ == "__main__":
    main()
