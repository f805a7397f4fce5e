"""Joins in space: all pairs within a radius, nearest neighbours, matching. Grid cells make them equi-joins."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

AXES = ("x", "y", "z")


def _cell(r: float, suffix: str = "") -> list[Column]:
    return [F.floor(F.col(a + suffix) / r).cast("long").alias(f"_{a}") for a in AXES]


def distance2(a: str, b: str) -> Column:
    return sum(((F.col(x + a) - F.col(x + b)) * (F.col(x + a) - F.col(x + b)) for x in AXES), F.lit(0.0))


def radius_join(left: DataFrame, right: DataFrame, radius: float, keys: list[str] = ()) -> DataFrame:
    """Pairs within the radius, the boundary included, of points with equal keys.

    Columns x, y, z and the others get suffixes _l and _r. Each right point stands in its cell and the 26 around it, so
    an equi-join on (keys, cell) meets all pairs once; pass the smaller table as ``right``. A dense cell is a skewed key
    that adaptive execution splits.
    """
    keys = list(keys)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    lt = left.select(*keys, *[F.col(c).alias(f"{c}_l") for c in left.columns if c not in keys])
    lt = lt.select("*", *_cell(radius, "_l"))
    rt = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys])
    rt = rt.select("*", *_cell(radius, "_r"))
    for a in AXES:
        rt = rt.withColumn("_n", near).withColumn(f"_{a}", F.col(f"_{a}") + F.col("_n")).drop("_n")
    cells = [f"_{a}" for a in AXES]
    return lt.join(rt, [*keys, *cells]).where(distance2("_l", "_r") <= radius * radius).withColumn("distance", F.sqrt(distance2("_l", "_r"))).drop(*cells)


def close_pairs(points: DataFrame, radius: float, key: str) -> DataFrame:
    """Pairs of one table closer than twice the radius, by distance, each once (lower key first)."""
    p = points.select(key, *AXES)
    j = radius_join(p, p, 2 * radius).where((F.col(f"{key}_l") < F.col(f"{key}_r")) & (F.col("distance") < 2 * radius))
    return j.select(F.col(f"{key}_l").alias("a"), F.col(f"{key}_r").alias("b"), "distance").orderBy("distance", "a", "b")


#: Points of one key up to which a task compares them directly; points common to all keys up to which they are broadcast.
DIRECT, COMMON = 20_000, 20_000


def least_distances(a: np.ndarray, b: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Distance of each point of a to its nearest of b, in blocks of bounded size."""
    out, step = np.full(len(a), np.inf), max(1, block // max(1, len(b)))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None] - b[None]) ** 2).sum(2).min(1))
    return out


def _placed(df: DataFrame) -> DataFrame:
    """The rows with finite coordinates."""
    for c in AXES:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return df


def _ring(rest: DataFrame, right: DataFrame, keys: list[str], id_col: str, r: float) -> DataFrame:
    """(keys, id, distance) of the points that have one within r; right has its fine cells of a quarter of r.

    Occupied fine cells come first: a cell whose near side lies beyond another's far side, or beyond r, is left out, and
    only the others' points are compared.
    """
    side, fine = r / 4, [f"_f{a}" for a in AXES]
    right = right.withColumns({f: F.floor(F.col(a) / side).cast("long") for f, a in zip(fine, AXES, strict=True)})
    cells = right.select(*keys, *fine).distinct()
    cells = cells.withColumns({f"_{a}": F.floor(F.col(f) / 4).cast("long") for f, a in zip(fine, AXES, strict=True)})
    near = rest.select("*", *_cell(r))
    for a in AXES:
        near = near.withColumn("_n", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"_{a}", F.col(f"_{a}") + F.col("_n")).drop("_n")
    c = near.join(cells, [*keys, *[f"_{a}" for a in AXES]])
    low, high = F.lit(0.0), F.lit(0.0)
    for f, a in zip(fine, AXES, strict=True):
        before, behind = F.col(f) * side - F.col(a), F.col(a) - (F.col(f) + 1) * side
        gap, far = F.greatest(before, behind, F.lit(0.0)), F.greatest(-before, -behind)
        low, high = low + gap * gap, high + far * far
    c = c.withColumns({"_low": low, "_high": F.min(high).over(Window.partitionBy(*keys, id_col))})
    c = c.where(F.col("_low") <= F.least("_high", F.lit(r * r)) * (1 + 1e-9)).select(*keys, id_col, *AXES, *fine)
    p = c.join(right.select(*keys, *fine, *[F.col(a).alias(f"{a}_r") for a in AXES]), [*keys, *fine])
    return p.groupBy(*keys, id_col).agg(F.sqrt(F.min(distance2("", "_r"))).alias("distance")).where(F.col("distance") <= r)


def nearest(left: DataFrame, right: DataFrame, keys: list[str] = (), id_col: str = "id", start: float = 2.0) -> DataFrame:
    """For each left point the distance to its nearest right point of the same keys: (keys, id, distance).

    Where every key has at most ``DIRECT`` points (counted first), both sides meet by key and are compared in blocks. Else,
    and without keys, rings of doubling radius serve the points not served yet, until none is left: a point ends by the
    bound of its ring. Points without finite coordinates, or without a right point, have no row.
    """
    keys = list(keys)
    lt, rt = _placed(left.select(*keys, id_col, *AXES)), _placed(right.select(*keys, *AXES))
    if keys:
        most = lt.select(*keys).unionByName(rt.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= DIRECT:
            schema = ", ".join([f"{c} {lt.schema[c].dataType.simpleString()}" for c in (*keys, id_col)] + ["distance double"])

            def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
                if not len(a) or not len(b):
                    return pd.DataFrame({c: [] for c in (*keys, id_col, "distance")})
                return a[[*keys, id_col]].assign(distance=least_distances(a[list(AXES)].to_numpy(float), b[other].to_numpy(float)))

            # names of their own, as both sides may come from one table
            other, own = [f"_{a}" for a in AXES], [f"_k{i}" for i in range(len(keys))]
            rt = rt.select(*[F.col(c).alias(n) for c, n in zip((*keys, *AXES), (*own, *other), strict=True)])
            return lt.groupBy(*keys).cogroup(rt.groupBy(*own)).applyInPandas(run, schema)
    rt = kept(rt.distinct())
    rest = lt.join(rt.select(*keys).distinct(), keys, "left_semi") if keys else lt if rt.limit(1).count() else lt.limit(0)
    found, rest, r, step = None, kept(rest), start, 2.0
    while n := rest.count():
        hit = radius_join(rest, rt, r, keys).groupBy(*keys, F.col(f"{id_col}_l").alias(id_col)).agg(F.min("distance").alias("distance")) if found is None else _ring(rest, rt, keys, id_col, r)
        hit = kept(hit)
        found = hit if found is None else found.unionByName(hit)
        rest = kept(rest.join(hit.select(*keys, id_col), [*keys, id_col], "left_anti"))
        # where nothing is near, the rings grow faster
        step = 2.0 if rest.count() < n else 2 * step
        r *= step
    return lt.select(*keys, id_col).limit(0).withColumn("distance", F.lit(0.0)) if found is None else found


def coverage(points: DataFrame, centers: DataFrame, radius: float, keys: list[str], point_id: str, center_id: str) -> DataFrame:
    """Per keys: precision (points near a center), recall (centers near a point) and F1. Centers are common to all keys.

    0 where a denominator is; F1 is 0 where both are. Counts of distinct ids, in two aggregates over one radius join.
    """
    hits = radius_join(points.select(*keys, point_id, *AXES), centers.select(center_id, *AXES), radius)
    ks = [F.col(f"{k}_l").alias(k) for k in keys]
    got = hits.select(*ks, F.col(f"{point_id}_l").alias("p"), F.col(f"{center_id}_r").alias("c")).groupBy(*keys).agg(F.count_distinct("p").alias("_p"), F.count_distinct("c").alias("_c"))
    total = centers.agg(F.count_distinct(center_id).alias("_n"))
    out = points.groupBy(*keys).agg(F.count_distinct(point_id).alias("num_water")).join(got, keys, "left").join(F.broadcast(total))
    precision = F.coalesce(F.try_divide(F.coalesce("_p", F.lit(0)), "num_water"), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.coalesce("_c", F.lit(0)), "_n"), F.lit(0.0))
    out = out.select(*keys, "num_water", precision.alias("precision"), recall.alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def chamfer(points: DataFrame, centers: DataFrame, keys: list[str], point_id: str, center_id: str) -> DataFrame:
    """Per keys: mean distance of points to the nearest center plus that of centers to the nearest point.

    Up to ``COMMON`` centers are broadcast (counted first) and each key is compared in one task, after a single shuffle; more
    centers, or a key of over ``DIRECT`` points, go by ``nearest``.
    """
    few = centers.select(*AXES).limit(COMMON + 1).toPandas().to_numpy(float)
    most = points.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if len(few) <= COMMON and most <= DIRECT:
        shared = points.sparkSession.sparkContext.broadcast(few)
        schema = ", ".join([f"{k} {points.schema[k].dataType.simpleString()}" for k in keys] + ["chamfer double"])

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            p, c = pdf[list(AXES)].to_numpy(float), shared.value
            own = least_distances(p, c).mean() + least_distances(c, p).mean() if len(c) else None
            return pd.DataFrame([[*key, own]], columns=[*keys, "chamfer"])

        return points.select(*keys, *AXES).groupBy(*keys).applyInPandas(run, schema).where("chamfer is not null")
    groups = points.select(*keys).distinct()
    p = points.select(*keys, F.col(point_id).alias("_id"), *AXES)
    c = groups.join(centers.select(F.col(center_id).alias("_id"), *AXES))
    a = nearest(p, c, keys, "_id").groupBy(*keys).agg(F.avg("distance").alias("_a"))
    b = nearest(c, p, keys, "_id").groupBy(*keys).agg(F.avg("distance").alias("_b"))
    return a.join(b, keys).select(*keys, (F.col("_a") + F.col("_b")).alias("chamfer"))


def maximum_matching(edges: list[tuple[int, int]]) -> int:
    """Size of a largest one-to-one matching, by shortest augmenting paths in layers."""
    adjacent: dict[int, list[int]] = {}
    for u, v in edges:
        adjacent.setdefault(u, []).append(v)
    mate_u: dict[int, int] = {}
    mate_v: dict[int, int] = {}
    while True:
        layer = {u: 0 for u in adjacent if u not in mate_u}
        queue, found = deque(layer), False
        while queue:
            u = queue.popleft()
            for v in adjacent[u]:
                w = mate_v.get(v)
                if w is None:
                    found = True
                elif w not in layer:
                    layer[w] = layer[u] + 1
                    queue.append(w)
        if not found:
            return len(mate_u)
        for root in [u for u in adjacent if u not in mate_u]:
            stack, path = [(root, iter(adjacent[root]))], []
            while stack:
                u, it = stack[-1]
                for v in it:
                    w = mate_v.get(v)
                    if w is None:
                        path.append((u, v))
                        for x, y in path:
                            mate_u[x], mate_v[y] = y, x
                        stack = []
                        break
                    if layer.get(w) == layer[u] + 1:
                        path.append((u, v))
                        stack.append((w, iter(adjacent[w])))
                        break
                else:
                    layer.pop(u, None)
                    stack.pop()
                    if path:
                        path.pop()


#: Edges of one key up to which a task matches them all.
MATCH = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (u, v): the least node reachable. Labels spread to neighbours and along labels in rounds."""
    e = edges.select("u", "v").distinct()
    both = kept(e.union(e.select("v", "u")))
    labels, total = kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label"))), None
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("_m"))
        new = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "_m").alias("label"))
        on = new.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        labels = kept(new.join(on, F.col("label") == F.col("_at")).select("node", F.least("label", "_to").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def matched_coverage(points: DataFrame, centers: DataFrame, radius: float, keys: list[str], point_id: str, center_id: str) -> DataFrame:
    """Per keys: size of the largest one-to-one matching within the radius, and it over points and over centers.

    Where a key has over ``MATCH`` edges they are dealt out by connected components, which are local, and matched apart.
    """
    hits = radius_join(points.select(*keys, point_id, *AXES), centers.select(center_id, *AXES), radius)
    ks = [F.col(f"{k}_l").alias(k) for k in keys]
    pairs = hits.select(*ks, F.col(f"{point_id}_l").cast("long").alias("p"), F.col(f"{center_id}_r").cast("long").alias("c"))
    schema = ", ".join([f"{k} {points.schema[k].dataType.simpleString()}" for k in keys] + ["matched long"])

    def match(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, maximum_matching(list(zip(pdf["p"], pdf["c"], strict=True)))]], columns=[*keys, "matched"])

    pairs = kept(pairs)
    most = pairs.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (most[0] or 0) > MATCH:
        pairs = pairs.withColumns({"u": F.xxhash64(F.lit("p"), *keys, "p"), "v": F.xxhash64(F.lit("c"), *keys, "c")})
        part = F.pmod(F.xxhash64("label"), F.lit(-(-4 * most[1] // MATCH)))
        pairs = pairs.join(components(pairs).withColumnRenamed("node", "u"), "u").withColumn("_part", part)
        got = pairs.groupBy(*keys, "_part").applyInPandas(lambda key, pdf: match(key[:-1], pdf), schema).groupBy(*keys).agg(F.sum("matched").alias("matched"))
    else:
        got = pairs.groupBy(*keys).applyInPandas(match, schema)
    total = centers.agg(F.count_distinct(center_id).alias("_n"))
    out = points.groupBy(*keys).agg(F.count_distinct(point_id).alias("num_water")).join(got, keys, "left").join(F.broadcast(total))
    m = F.coalesce("matched", F.lit(0))
    return out.select(*keys, m.alias("matched"), F.coalesce(F.try_divide(m, "num_water"), F.lit(0.0)).alias("matched_precision"), F.coalesce(F.try_divide(m, "_n"), F.lit(0.0)).alias("matched_recall"))
