"""Partitions of structures: linkage cuts, agreement of labellings, isomorphous subsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import max_cell_diff
from ..shared import kept

CELL = ("cell_a", "cell_b", "cell_c", "cell_alpha", "cell_beta", "cell_gamma")


def symmetrise(pairs: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """(M + M') / 2 in long form; NULL where one direction is missing."""
    back = pairs.select(F.col(i).alias(j), F.col(j).alias(i), F.col(value).alias("_back"))
    return pairs.select(i, j, value).join(back, [i, j], "left").select(i, j, ((F.col(value) + F.col("_back")) / 2).alias(value))


def contingency(labels: DataFrame, a: str, b: str, keys: list[str] = (), least: int = 1) -> DataFrame:
    """Counts and Jaccard similarity of classes of at least ``least`` members."""
    n = labels.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    na = labels.groupBy(*keys, a).agg(F.count("*").alias("n_a")).where(F.col("n_a") >= least)
    nb = labels.groupBy(*keys, b).agg(F.count("*").alias("n_b")).where(F.col("n_b") >= least)
    j = n.join(na, [*keys, a]).join(nb, [*keys, b])
    return j.select(*keys, a, b, "n", "n_a", "n_b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index (1 where its range is empty) and normalised mutual information (geometric mean; 0 without entropy)."""
    c = contingency(labels, a, b)
    two = lambda x: x * (x - 1) / 2.0
    n = labels.agg(F.count("*").cast("double").alias("n"))
    cells = c.agg(F.sum(two(F.col("n"))).alias("sij"))
    side = lambda col, name: labels.groupBy(col).agg(F.count("*").alias("k")).agg(F.sum(two(F.col("k"))).alias(f"s_{name}"), F.sum(F.col("k") * F.ln("k")).alias(f"h_{name}"))
    mutual = c.agg(F.sum(F.col("n") * F.ln(F.col("n") / (F.col("n_a") * F.col("n_b")))).alias("m"))
    x = n.join(F.broadcast(cells)).join(F.broadcast(side(a, "a"))).join(F.broadcast(side(b, "b"))).join(F.broadcast(mutual))
    expected = F.try_divide(F.col("s_a") * F.col("s_b"), two(F.col("n")))
    most = (F.col("s_a") + F.col("s_b")) / 2
    ha, hb = F.ln("n") - F.col("h_a") / F.col("n"), F.ln("n") - F.col("h_b") / F.col("n")
    mi = F.col("m") / F.col("n") + F.ln("n")
    return x.select(
        F.coalesce(F.when(F.abs(most - expected) > 1e-12, (F.col("sij") - expected) / (most - expected)), F.lit(1.0)).alias("ari"),
        F.when((ha > 1e-12) & (hb > 1e-12), mi / F.sqrt(ha * hb)).otherwise(0.0).alias("nmi"),
    )


def space_group_survey(meta: DataFrame) -> DataFrame:
    """Structures per space group, median and best resolution, commonest first."""
    return meta.groupBy("space_group").agg(F.count("*").alias("n"), F.percentile("resolution", 0.5).alias("median_resolution"), F.min("resolution").alias("best_resolution")).orderBy(F.col("n").desc(), "space_group")


def isomorphous(meta: DataFrame, space_group: str, tolerance: float, reference: str = "median", cell=CELL) -> DataFrame:
    """Structures of the group with max_cell_diff to the median cell or the best-resolved one, and whether it is within tolerance."""
    d = meta.where(F.col("space_group") == space_group)
    if reference == "median":
        ref = d.agg(*[F.percentile(c, 0.5).alias(f"_{c}") for c in cell])
    elif reference == "best":
        ref = d.where("resolution is not null").orderBy("resolution", "pdb_id").limit(1).select(*[F.col(c).alias(f"_{c}") for c in cell])
    else:
        raise ValueError(f"unknown reference {reference!r}")
    d = d.join(F.broadcast(ref)).withColumn("max_cell_diff", max_cell_diff(list(cell), [f"_{c}" for c in cell]))
    return d.drop(*[f"_{c}" for c in cell]).withColumn("isomorphous", F.col("max_cell_diff") <= tolerance)


def query_arms(df: DataFrame, predicate: str) -> DataFrame:
    """``arm`` A where the predicate holds, else B; a missing comparison doesn't hold. A bad predicate raises ValueError."""
    try:
        out = df.withColumn("arm", F.when(F.coalesce(F.expr(f"({predicate})"), F.lit(False)), "A").otherwise("B"))
        out.schema  # noqa: B018  analysis happens here
    except Exception as e:
        raise ValueError(f"bad predicate {predicate!r}: {str(e).splitlines()[0]}") from e
    return out


def complete_linkage(d: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of complete linkage by nearest-neighbour chains; missing distances count as the largest."""
    d = np.array(d, float)
    d = np.where(np.isnan(d), np.nanmax(d) if np.isfinite(d).any() else 0.0, d)
    d = (d + d.T) / 2
    np.fill_diagonal(d, np.inf)
    n = len(d)
    name, size, alive = list(range(n)), np.ones(n, int), np.ones(n, bool)
    raw, chain = [], []
    while len(raw) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            row[i] = np.inf
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        i = chain.pop()
        chain.pop()
        i, j = min(i, j), max(i, j)
        raw.append((d[i, j], i, j))
        new = np.maximum(d[i], d[j])
        alive[j] = False
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        size[i] += size[j]
    order = sorted(range(len(raw)), key=lambda k: raw[k][0])
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    count, out = [1] * n, []
    for step, k in enumerate(order):
        h, i, j = raw[k]
        a, b = find(i), find(j)
        out.append((min(name[a], name[b]), max(name[a], name[b]), h, count[a] + count[b]))
        root[b] = a
        count[a] += count[b]
        name[a] = n + step
    return np.array(out, float).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, height: float) -> list[int]:
    """Labels from 1, by first member, of the tree cut at this height (merges at it are joined)."""
    root = list(range(n + len(merges)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for s, (a, b, h, _) in enumerate(merges):
        if h <= height:
            root[find(int(a))] = n + s
            root[find(int(b))] = n + s
    seen: dict[int, int] = {}
    return [seen.setdefault(find(i), len(seen) + 1) for i in range(n)]


def cophenetic(merges: np.ndarray, n: int) -> np.ndarray:
    """Height at which each pair first shares a cluster."""
    out, held = np.zeros((n, n)), {i: [i] for i in range(n)}
    for s, (a, b, h, _) in enumerate(merges):
        x, y = held.pop(int(a)), held.pop(int(b))
        out[np.ix_(x, y)] = out[np.ix_(y, x)] = h
        held[n + s] = x + y
    return out


#: Members up to which a group's tree is made in one task.
IN_TASK = 3000


def linkage_merges(pairs: DataFrame, i: str, j: str, value: str, group: list[str] = ()) -> DataFrame:
    """(group, lo, hi, height): the merges of complete linkage, named by their classes' least members, for groups of any size.

    In a round all classes that are each other's nearest merge (by distance, then names), and distances become the larger
    of both, as one aggregate; missing distances count as the largest of the group.
    """
    group = list(group)
    both = [(i, j), (j, i)]
    d = pairs.where(F.col(i) != F.col(j)).select(*group, F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in both])).alias("x"), F.col(value).cast("double").alias("d"))
    d = d.select(*group, "x.i", "x.j", F.nanvl("d", F.lit(None).cast("double")).alias("d")).groupBy(*group, "i", "j").agg(F.max("d").alias("d"))
    d = kept(d)
    of = lambda c: d.select(*group, F.col("i").alias(c)).distinct()
    every = of("i").join(of("j"), group) if group else of("i").join(of("j"), F.lit(True))
    most = d.groupBy(*group).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("_most"))
    d = every.where("i <> j").join(d, [*group, "i", "j"], "left")
    d = d.join(most, group) if group else d.join(F.broadcast(most))
    d = kept(d.select(*group, "i", "j", F.coalesce("d", "_most").alias("d")))
    out = None
    while True:
        near = d.groupBy(*group, "i").agg(F.min(F.struct("d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))).alias("n"))
        met = kept(near.groupBy(*group, F.col("n.lo").alias("lo"), F.col("n.hi").alias("hi"), F.col("n.d").alias("height")).agg(F.count("*").alias("_k")).where("_k = 2").drop("_k"))
        if not met.limit(1).count():
            return met if out is None else out
        out = met if out is None else out.unionByName(met)
        for c in ("i", "j"):
            to = met.select(*group, F.col("hi").alias(c), F.col("lo").alias("_to"))
            d = d.join(to, [*group, c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        d = kept(d.where("i <> j").groupBy(*group, "i", "j").agg(F.max("d").alias("d")))


def _cut_merges(names: list, lo: list, hi: list, height: np.ndarray, at: float) -> list[int]:
    """Labels from 1, by first member, of the classes that merges up to this height make."""
    where = {v: k for k, v in enumerate(names)}
    root = list(range(len(names)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b, h in zip(lo, hi, height, strict=True):
        if h <= at:
            root[find(where[b])] = find(where[a])
    seen: dict[int, int] = {}
    return [seen.setdefault(find(k), len(seen) + 1) for k in range(len(names))]


def _labels_by_rounds(pairs: DataFrame, i: str, j: str, value: str, heights: list[float], group: list[str]) -> DataFrame:
    """(cut, group, member, label) from ``linkage_merges``; a task has a group's members and merges."""
    kind = pairs.schema[i].dataType.simpleString()
    merges = linkage_merges(pairs, i, j, value, group).withColumnRenamed("lo", "member")
    rows = pairs.select(*group, F.explode(F.array(i, j)).alias("member")).distinct().withColumns({"hi": F.lit(None).cast(kind), "height": F.lit(None).cast("double")}).unionByName(merges)
    schema = ", ".join(["cut double", *[f"{g} {pairs.schema[g].dataType.simpleString()}" for g in group], f"member {kind}", "label int"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = pdf["height"].notna()
        names, m = sorted(pdf.loc[~merged, "member"]), pdf[merged]
        out = pd.concat([pd.DataFrame({"cut": h, "member": names, "label": _cut_merges(names, m["member"].tolist(), m["hi"].tolist(), m["height"].to_numpy(), h)}) for h in heights])
        for g, v in zip(group, key, strict=False):
            out[g] = v
        return out[["cut", *group, "member", "label"]]

    return rows.groupBy(*(group or [F.lit(0).alias("_g")])).applyInPandas(run, schema)


def _largest(pairs: DataFrame, i: str, j: str, group: list[str]) -> int:
    members = pairs.select(*group, F.explode(F.array(i, j)).alias("m")).distinct()
    return (members.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]) or 0


def linkage_labels(pairs: DataFrame, i: str, j: str, value: str, height: float, group: list[str] = ()) -> DataFrame:
    """Complete-linkage labels of each group's members: a group in a task, or by rounds where one has over ``IN_TASK`` members."""
    group = list(group)
    if _largest(pairs, i, j, group) > IN_TASK:
        return _labels_by_rounds(pairs, i, j, value, [height], group).drop("cut")
    schema = ", ".join([f"{g} {pairs.schema[g].dataType.simpleString()}" for g in group] + [f"member {pairs.schema[i].dataType.simpleString()}", "label int"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf[i]) | set(pdf[j]))
        at = {v: k for k, v in enumerate(names)}
        d = np.full((len(names), len(names)), np.nan)
        d[[at[v] for v in pdf[i]], [at[v] for v in pdf[j]]] = pdf[value].to_numpy(float)
        d = np.where(np.isnan(d), d.T, d)
        labels = cut(complete_linkage(d), len(names), height) if len(names) > 1 else [1] * len(names)
        out = pd.DataFrame({"member": names, "label": labels})
        for g, v in zip(group, key, strict=False):
            out[g] = v
        return out[[*group, "member", "label"]]

    if group:
        return pairs.groupBy(*group).applyInPandas(run, schema)
    return pairs.groupBy(F.lit(0).alias("_g")).applyInPandas(run, schema)


def crystal_forms(pairs: DataFrame, i: str, j: str, value: str, members: DataFrame, height: float, member: str = "pdb_id", group: str = "space_group") -> DataFrame:
    """(member, label): within each group a complete-linkage cut; labels ``group#k``, members alone in their group 1."""
    m = members.select(F.col(member).alias("member"), F.coalesce(F.col(group).cast("string"), F.lit("?")).alias("_g"))
    own = pairs.join(m.withColumnsRenamed({"member": i, "_g": "_gi"}), i).join(m.withColumnsRenamed({"member": j, "_g": "_gj"}), j)
    own = own.where(F.col("_gi") == F.col("_gj")).select(F.col("_gi").alias("_g"), i, j, value)
    labels = linkage_labels(own, i, j, value, height, ["_g"])
    return m.join(labels, ["_g", "member"], "left").select("member", F.concat("_g", F.lit("#"), F.coalesce("label", F.lit(1)).cast("string")).alias("label"))


def agreement_sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cut_a, cut_b, ari) of every two cuts; a and b: (cut, member, label). One pass: counts by both cuts, no loop."""
    two = lambda x: x * (x - 1) / 2.0
    a, b = a.select(F.col("cut").alias("cut_a"), "member", F.col("label").alias("la")), b.select(F.col("cut").alias("cut_b"), "member", F.col("label").alias("lb"))
    side = lambda df, cut, label, name: df.groupBy(cut, label).agg(F.count("*").alias("k")).groupBy(cut).agg(F.sum(two(F.col("k"))).alias(name), F.sum("k").alias(f"n_{name}"))
    cells = a.join(b, "member").groupBy("cut_a", "cut_b", "la", "lb").agg(F.count("*").alias("k")).groupBy("cut_a", "cut_b").agg(F.sum(two(F.col("k"))).alias("s"))
    x = cells.join(side(a, "cut_a", "la", "sa"), "cut_a").join(side(b, "cut_b", "lb", "sb"), "cut_b")
    expected, most = F.try_divide(F.col("sa") * F.col("sb"), two(F.col("n_sa"))), (F.col("sa") + F.col("sb")) / 2
    return x.select("cut_a", "cut_b", F.coalesce(F.when(F.abs(most - expected) > 1e-12, (F.col("s") - expected) / (most - expected)), F.lit(1.0)).alias("ari"))


def linkage_sweep(pairs: DataFrame, i: str, j: str, value: str, heights: list[float]) -> DataFrame:
    """(cut, member, label) of one complete-linkage tree cut at several heights."""
    if _largest(pairs, i, j, []) > IN_TASK:
        return _labels_by_rounds(pairs, i, j, value, heights, [])
    kind = pairs.schema[i].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf, i, j, value)
        tree = complete_linkage(d)
        return pd.concat([pd.DataFrame({"cut": h, "member": names, "label": cut(tree, len(names), h)}) for h in heights])

    return pairs.groupBy(F.lit(0).alias("_g")).applyInPandas(run, f"cut double, member {kind}, label int")


def cophenetic_heights(pairs: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """(i, j, height) for i < j: the height at which two members first share a class."""
    kind = pairs.schema[i].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf, i, j, value)
        h = cophenetic(complete_linkage(d), len(names))
        a, b = np.triu_indices(len(names), 1)
        return pd.DataFrame({i: [names[k] for k in a], j: [names[k] for k in b], "height": h[a, b]})

    return pairs.groupBy(F.lit(0).alias("_g")).applyInPandas(run, f"{i} {kind}, {j} {kind}, height double")


def leaf_order(pairs: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """(member, place) along an average-linkage tree, for a clustered map."""
    kind = pairs.schema[i].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf, i, j, value)
        n = len(names)
        held, size = {k: [k] for k in range(n)}, np.ones(n)
        # the mean distance of two merged classes is the mean of theirs, weighted by their sizes
        d = d.copy()
        np.fill_diagonal(d, np.inf)
        best = d.min(1) if n else d
        for _ in range(n - 1):
            a = int(best.argmin())
            b = int(d[a].argmin())
            a, b = min(a, b), max(a, b)
            mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            mean[a] = np.inf
            stale = np.flatnonzero((best == d[:, a]) | (best == d[:, b]))
            d[a], d[:, a] = mean, mean
            d[b], d[:, b] = np.inf, np.inf
            size[a] += size[b]
            held[a] += held.pop(b)
            best = np.minimum(best, d[:, a])
            best[stale] = d[stale].min(1)
            best[a], best[b] = d[a].min(), np.inf
        return pd.DataFrame({"member": [names[k] for k in next(iter(held.values()))], "place": range(len(names))})

    return pairs.groupBy(F.lit(0).alias("_g")).applyInPandas(run, f"member {kind}, place int")


def _matrix(pdf: pd.DataFrame, i: str, j: str, value: str) -> tuple[list, np.ndarray]:
    """Names in order and the symmetric matrix; missing distances count as the largest."""
    names = sorted(set(pdf[i]) | set(pdf[j]))
    at = {v: k for k, v in enumerate(names)}
    d = np.full((len(names), len(names)), np.nan)
    d[[at[v] for v in pdf[i]], [at[v] for v in pdf[j]]] = pdf[value].to_numpy(float)
    d = np.where(np.isnan(d), d.T, d)
    np.fill_diagonal(d, 0.0)
    return names, np.where(np.isnan(d), np.nanmax(d), d)


def pivot_square(pairs: DataFrame, i: str, j: str, value: str, names: list) -> DataFrame:
    """One row for each i, one column for each of the names (for display; names are few)."""
    return pairs.groupBy(i).pivot(j, names).agg(F.first(value))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def positive_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, least, greatest) of the positive values of each column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "_v").where("_v > 0 and not isnan(_v)")
    return long.groupBy("column").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))


def best_resolved(meta: DataFrame, n: int) -> DataFrame:
    """The n structures of the best resolution, missing ones last."""
    return meta.orderBy(F.col("resolution").asc_nulls_last(), "pdb_id").limit(n)


def off_diagonal(pairs: DataFrame, i: str, j: str, value: str) -> DataFrame:
    return pairs.where(F.col(i) < F.col(j)).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("greatest"))
