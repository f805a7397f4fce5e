"""Data behind figures: histograms, quantile bins, densities, limits, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..shared import kept
from .ranks import joined, quantiles


def uniform_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + k * step if k < bins else high for k in range(bins + 1)]


def bin_of(c: Column, edges: list[float]) -> Column:
    """Index of the half-open bin, the last one closed; NULL outside. Compared with the edges themselves."""
    inside = (c >= F.lit(edges[0])) & (c <= F.lit(edges[-1]))
    k = sum((F.when(c >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(inside, k)


def occupancy_histogram(clusters: DataFrame, sizes: DataFrame, n_noise: DataFrame, bins: int = 20) -> DataFrame:
    """bin, n clusters, n points (noise in the first bin), share of points, share at or above the bin."""
    edges = uniform_edges(0.0, 1.0, bins)
    c = clusters.join(sizes, "cluster_id").withColumn("bin", bin_of(F.col("cluster_occupancy"), edges))
    h = c.groupBy("bin").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_points"))
    h = h.unionByName(n_noise.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n_clusters"), F.col("n_noise").alias("n_points")))
    h = h.unionByName(clusters.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n_clusters"), F.lit(0).cast("long").alias("n_points")))
    h = h.groupBy("bin").agg(F.sum("n_clusters").alias("n_clusters"), F.sum("n_points").alias("n_points"))
    w = Window.partitionBy(F.lit(0))
    above = F.sum("n_points").over(w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n_points").over(w)
    return h.select("bin", "n_clusters", "n_points", F.try_divide("n_points", total).alias("share"), F.try_divide(above, total).alias("share_above"))


def _beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the row of their keys; few of those go to all tasks, so that no task gets all rows of a key."""
    small = kept(small)
    return joined(df, small, keys, small.count())


def quantile_edges(df: DataFrame, value: str, n: int, keys: list[str] = (), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Distinct quantiles at n + 1 even probabilities within [low, high], rounded if all values are whole."""
    keys = list(keys)
    d = df.select(*keys, finite(value).alias("_v")).where("_v is not null")
    q = quantiles(d, "_v", [low + (high - low) * k / n for k in range(n + 1)], keys)
    whole = d.groupBy(*keys).agg(F.bool_and(F.col("_v") == F.floor("_v")).alias("_whole"))
    q = q.join(whole, keys) if keys else q.join(F.broadcast(whole))
    return q.select(*keys, F.array_distinct(F.when(F.col("_whole"), F.transform("q", F.rint)).otherwise(F.col("q"))).alias("edges"))


def quantile_means(df: DataFrame, by: str, value: str, edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Count and mean of the value in right-closed bins of ``by``, the outer ones open to both sides."""
    d = df.select(*keys, finite(by).alias("_b"), finite(value).alias("_v")).where("_b is not null and _v is not null")
    d = _beside(d, edges, list(keys))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    d = d.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("_b"))))
    return d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))


def density(df: DataFrame, value: str, edges: list[float], keys: list[str] = ()) -> DataFrame:
    """Histogram density on shared edges, all bins present for each key."""
    d = df.select(*keys, finite(value).alias("_v")).withColumn("bin", bin_of(F.col("_v"), edges))
    groups = d.select(*keys).distinct() if keys else d.sparkSession.range(1).select()
    grid = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("bin"))
    n = d.where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = d.where("bin is not null").groupBy(*keys).agg(F.count("*").alias("_t"))
    out = grid.join(n, [*keys, "bin"], "left")
    out = out.join(total, list(keys), "left") if keys else out.join(F.broadcast(total))
    width = F.element_at(F.array(*[F.lit(b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]), F.col("bin") + 1)
    return out.select(*keys, "bin", F.coalesce(F.try_divide(F.col("n"), F.col("_t") * width), F.lit(0.0)).alias("density"))


def limits(df: DataFrame, value: str, keys: list[str] = (), robust: bool = True) -> DataFrame:
    """Axis limits: 0 and 99.9 % quantiles (or all); one value gets 1 more above; none gives (0, 1)."""
    keys = list(keys)
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    q = quantiles(df, value, [0.0, 0.999 if robust else 1.0], keys)
    out = groups.join(q, keys, "left") if keys else groups.join(q, F.lit(True), "left")
    lo, hi = F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("q", F.lit(1)), F.lit(1.0))
    return out.select(*keys, lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1).alias("hi"))


def _with_quartiles(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, q): count, mean and quartiles of the finite values; groups without any have no quartiles."""
    keys = list(keys)
    d = df.select(*keys, finite(value).alias("_v"))
    n = d.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    return n.join(quantiles(d, "_v", [0.25, 0.5, 0.75], keys).drop("n"), keys, "left")


def median_iqr(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    q = _with_quartiles(df, value, keys)
    return q.select(*keys, "n", *[F.round(F.get("q", F.lit(k)), 2).alias(name) for k, name in enumerate(("q1", "median", "q3"))])


def violin_marks(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median, mean and quartiles of the values as they are."""
    q = _with_quartiles(df, value, keys)
    return q.select(*keys, "mean", *[F.get("q", F.lit(k)).alias(name) for name, k in (("median", 1), ("q1", 0), ("q3", 2))])


def hexbin_mean(df: DataFrame, x: str, y: str, value: str, size: float) -> DataFrame:
    """Mean value in hexagons of this width: a point goes to the nearer centre of two shifted grids."""
    sx, sy = size, size * 3**0.5
    a, b = F.round(F.col(x) / sx), F.round(F.col(y) / sy)
    c, d = F.floor(F.col(x) / sx), F.floor(F.col(y) / sy)
    da = F.pow(F.col(x) / sx - a, F.lit(2)) + 3 * F.pow(F.col(y) / sy - b, F.lit(2))
    db = F.pow(F.col(x) / sx - c - 0.5, F.lit(2)) + 3 * F.pow(F.col(y) / sy - d - 0.5, F.lit(2))
    hx, hy = F.when(da < db, a).otherwise(c + 0.5) * sx, F.when(da < db, b).otherwise(d + 0.5) * sy
    return df.groupBy(hx.alias("hx"), hy.alias("hy")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def good_poor(df: DataFrame, metric: str, cohort: str) -> DataFrame:
    """Rows with the metric, labelled by their cohort's median (four decimals): good from it on."""
    d = df.withColumn("_m", finite(metric)).where("_m is not null")
    cut = quantiles(d, "_m", [0.5], [cohort]).select(cohort, F.round(F.get("q", F.lit(0)), 4).alias("split_cutoff"))
    return _beside(d, cut, [cohort]).withColumn("split", F.when(F.col("_m") >= F.col("split_cutoff"), "good").otherwise("poor")).drop("_m")
