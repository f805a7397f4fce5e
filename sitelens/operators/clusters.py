"""Cluster tables, consensus masks and the labelling of structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def members(points: DataFrame, radius: float, cluster: str = "cluster_id") -> DataFrame:
    """All points with within_cutoff: at most the radius from the mean of all their cluster's points; noise (-1) never.

    The means are aggregated and joined back, so a giant cluster needs no window in one task.
    """
    center = points.groupBy(cluster).agg(*[F.avg(a).alias(f"_c{a}") for a in AXES])
    d2 = sum(((F.col(a) - F.col(f"_c{a}")) * (F.col(a) - F.col(f"_c{a}")) for a in AXES), F.lit(0.0))
    return points.join(center, cluster).withColumn("within_cutoff", (F.col(cluster) >= 0) & (F.sqrt(d2) <= radius)).select(*points.columns, "within_cutoff")


def table(member_rows: DataFrame, n_structures: int | None, cluster: str = "cluster_id", structure: str = "pdb_id") -> DataFrame:
    """Per cluster: mean and population std of all points, points beyond the radius, and the share of structures with a point
    within it (of ``n_structures``, or of those in the table). Clusters without such a point are left out."""
    m = member_rows
    out = m.where(F.col(cluster) >= 0).groupBy(cluster).agg(
        *[F.avg(a).alias(f"center_{a}") for a in AXES], *[F.stddev_pop(a).alias(f"std_{a}") for a in AXES],
        F.count_distinct(F.when(F.col("within_cutoff"), F.col(structure))).alias("_k"),
        F.count_if(~F.col("within_cutoff")).alias("n_radius_rejected"),
    ).where("_k > 0")
    if n_structures is None:
        out = out.join(F.broadcast(m.agg(F.count_distinct(structure).alias("_n"))))
    else:
        out = out.withColumn("_n", F.lit(n_structures))
    return out.withColumn("cluster_occupancy", F.try_divide("_k", "_n")).drop("_k", "_n")


def consensus_mask(member_rows: DataFrame, clusters: DataFrame, occupancy: float, cluster: str = "cluster_id") -> DataFrame:
    """All points with ``consensus``: within the radius of a cluster of at least this occupancy. A mask, not a filter."""
    good = clusters.where(F.col("cluster_occupancy") >= occupancy).select(cluster, F.lit(True).alias("_good"))
    return member_rows.join(good, cluster, "left").withColumn("consensus", F.col("within_cutoff") & F.coalesce("_good", F.lit(False))).drop("_good")


def consensus_centers(clusters: DataFrame, occupancy: float) -> DataFrame:
    return clusters.where(F.col("cluster_occupancy") >= occupancy).select("cluster_id", *[F.col(f"center_{a}").alias(a) for a in AXES])


def consensus_label(mask: str = "consensus"):
    return F.when(F.col(mask), "consensus").otherwise("nonconsensus")


def sizes(points: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return points.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("size"))


def noise_stats(points: DataFrame, cluster: str = "cluster_id", structure: str = "pdb_id") -> DataFrame:
    return points.agg(F.count_distinct(structure).alias("n_structures"), F.try_divide(F.lit(1.0), F.count_distinct(structure)).alias("noise_occupancy"), F.count_if(F.col(cluster) == -1).alias("n_noise"))


def best_jaccard(labels: DataFrame, base: str, other: str) -> DataFrame:
    """Per base cluster its largest Jaccard similarity with a cluster of the other labelling; 0 without overlap.

    Noise of the other labelling is no cluster; its points still count to the base cluster's size."""
    pairs = labels.where((F.col(base) >= 0) & (F.col(other) >= 0)).groupBy(base, other).agg(F.count("*").alias("n"))
    a, b = (labels.where(F.col(c) >= 0).groupBy(c).agg(F.count("*").alias(f"n_{c}")) for c in (base, other))
    j = pairs.join(b, other).join(a, base).select(base, (F.col("n") / (F.col(f"n_{base}") + F.col(f"n_{other}") - F.col("n"))).alias("j"))
    return a.join(j.groupBy(base).agg(F.max("j").alias("j")), base, "left").select(base, F.coalesce("j", F.lit(0.0)).alias("best_jaccard"))


def pareto_front(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Rows that no other dominates (at least as good in both, better in one); equal ones all stay.

    A row stays if of all rows with at least its x the best (y, then x) is its own. Without keys that is asked within
    hashed parts first, so few rows are left for the last, single part. The table is read once.
    """

    def front(d: DataFrame, part: list) -> DataFrame:
        best = F.max(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).over(Window.partitionBy(*part).orderBy(F.col(x).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return d.withColumn("_best", best).where((F.col("_best.y") == F.col(y)) & (F.col("_best.x") == F.col(x))).drop("_best")

    return front(df, list(keys)) if keys else front(front(df, [F.pmod(F.xxhash64(x, y), F.lit(64))]), [F.lit(0)])


def knee(df: DataFrame, id_col: str, keys: list[str] = ()) -> DataFrame:
    """The row of the largest F1 (lowest id on ties) and its distance to the ideal corner."""
    tie = df.groupBy(*keys).agg(F.max("f1").alias("_f"))
    best = (df.join(tie, keys).where("f1 = _f") if keys else df.join(F.broadcast(tie)).where("f1 = _f")).groupBy(*keys).agg(F.min_by(F.struct(id_col, "precision", "recall", "f1"), id_col).alias("k"))
    return best.select(*keys, "k.*").withColumn("distance_to_ideal", F.sqrt((1 - F.col("recall")) * (1 - F.col("recall")) + (1 - F.col("precision")) * (1 - F.col("precision"))))


def rank_candidates(df: DataFrame, scores: list[str], position: str) -> DataFrame:
    """Ranks (least, descending) of the scores, the greatest of them, and ``recommended`` for the best row.

    Order: greatest rank, then the ranks of the later scores first, then position. The table is a grid of candidates of
    bounded size."""
    w = Window.partitionBy(F.lit(0))
    names = [f"{s}_rank" for s in scores]
    for s, n in zip(scores, names, strict=True):
        df = df.withColumn(n, F.rank().over(w.orderBy(F.col(s).desc_nulls_last())))
    df = df.withColumn("max_rank", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    order = w.orderBy("max_rank", *reversed(names), position)
    return df.withColumn("recommended", F.row_number().over(order) == 1)


def sweep_summary(points: DataFrame, clusters: DataFrame, key: str = "candidate", cluster: str = "cluster_id") -> DataFrame:
    """Per candidate: clusters, share of noise, median and largest occupancy, clusters of at least 25, 50 and 75 %."""
    noise = points.groupBy(key).agg(F.avg((F.col(cluster) == -1).cast("int")).alias("noise_frac"))
    occ = clusters.groupBy(key).agg(
        F.count("*").alias("n_clusters"), F.percentile("cluster_occupancy", 0.5).alias("median_occ"), F.max("cluster_occupancy").alias("max_occ"),
        *[F.count_if(F.col("cluster_occupancy") >= x).alias(f"n_occ_ge_{str(x).replace('.', '_')}") for x in (0.25, 0.5, 0.75)],
    )
    out = noise.join(occ, key, "left")
    return out.fillna(0, [c for c in occ.columns if c.startswith("n_")])


def subset_noise(member_rows: DataFrame, clusters: DataFrame, occupancy: float, structure: str = "pdb_id") -> DataFrame:
    """Counts of what is no consensus, here clusters strictly above the occupancy."""
    good = clusters.where(F.col("cluster_occupancy") > occupancy).select("cluster_id", F.lit(True).alias("_good"))
    hit = F.col("within_cutoff") & F.coalesce("_good", F.lit(False))
    m = member_rows.join(good, "cluster_id", "left").agg(F.count_distinct(structure).alias("n_structures"), F.count("*").alias("n_points"), F.count_if(F.col("cluster_id") == -1).alias("n_noise"), F.count_if(~hit).alias("n_nonconsensus"))
    c = clusters.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("cluster_occupancy") <= occupancy).alias("n_nonconsensus_clusters"))
    return m.join(F.broadcast(c)).withColumns({"cluster_share": F.try_divide("n_nonconsensus_clusters", "n_clusters"), "point_share": F.try_divide("n_nonconsensus", "n_points")})


def scatter(pr: DataFrame, id_col: str) -> DataFrame:
    """Precision and recall by structure with ``on_front`` and ``is_knee``, for a scatter plot."""
    front = pareto_front(pr, "recall", "precision").select(id_col, F.lit(True).alias("on_front"))
    best = knee(pr, id_col).select(id_col, F.lit(True).alias("is_knee"))
    return pr.join(front, id_col, "left").join(F.broadcast(best), id_col, "left").fillna(False, ["on_front", "is_knee"])


def summary(pr: DataFrame, clusters: DataFrame, member_rows: DataFrame, occupancy: float, id_col: str) -> DataFrame:
    """Counts and shares of one clustering, and the structure of the largest F1 (NULL fields without any)."""
    c = clusters.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("cluster_occupancy") >= occupancy).alias("n_consensus"))
    m = member_rows.agg(F.count("*").alias("n_points"), F.count_if(F.col("cluster_id") == -1).alias("n_noise"), F.count_if(F.col("within_cutoff")).alias("n_within"))
    k = knee(pr, id_col)
    out = c.join(F.broadcast(m)).withColumns({"noise_share": F.try_divide("n_noise", "n_points"), "within_share": F.try_divide("n_within", "n_points")})
    return out.withColumn("_j", F.lit(1)).join(k.select(F.lit(1).alias("_j"), F.col(id_col).alias("knee_id"), F.col("f1").alias("knee_f1"), F.col("distance_to_ideal").alias("knee_distance")), "_j", "left").drop("_j")
