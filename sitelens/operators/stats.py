"""Two-sample statistics, correlations and resampling. Ranks, counts and moments are aggregates; the driver sees sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..shared import kept
from .ranks import Ordered, counted, joined, quantiles


def _sides(df: DataFrame, value: str, left: str, keys: list[str]) -> tuple[DataFrame, int]:
    """Every finite value of the keys with the rows of both sides at it (a, b), below it and in all; and the parts' number."""
    o = Ordered(counted(df, list(keys), value, left), list(keys), "_v", ["a", "b"])
    return joined(o.rows, o.totals.withColumnsRenamed({"a": "n_left", "b": "n_right"}), list(keys), o.parts), o.parts


def cliffs_delta(df: DataFrame, value: str, left: str, keys: list[str]) -> DataFrame:
    """2 U / (n1 n2) - 1 by keys; ``left`` is a boolean column. NULL where a side has no finite value."""
    u = _sides(df, value, left, keys)[0].groupBy(*keys, "n_left", "n_right").agg(F.sum(F.col("a") * (F.col("_before_b") + F.col("b") / 2.0)).alias("u"))
    return u.select(*keys, "n_left", "n_right", (F.try_divide(2 * F.col("u"), F.col("n_left") * F.col("n_right")) - 1).alias("r"))


def _gap() -> F.Column:
    return F.abs(F.try_divide(F.col("_before_a") + F.col("a"), "n_left") - F.try_divide(F.col("_before_b") + F.col("b"), "n_right"))


def ks_distance(df: DataFrame, value: str, left: str, keys: list[str]) -> DataFrame:
    """Largest difference of the two distribution functions, evaluated after ties."""
    return _sides(df, value, left, keys)[0].groupBy(*keys, "n_left", "n_right").agg(F.max(_gap()).alias("d"))


def cohens_d(df: DataFrame, value: str, left: str, keys: list[str]) -> DataFrame:
    """Difference of means over the root of the mean sample variance; NULL where that is 0."""
    d = df.select(*keys, finite(value).alias("_v"), F.col(left).alias("_l")).where("_v is not null and _l is not null")
    a, b = F.when(F.col("_l"), F.col("_v")), F.when(~F.col("_l"), F.col("_v"))
    m = d.groupBy(*keys).agg(F.count(a).alias("n_left"), F.count(b).alias("n_right"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    s = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    return m.select(*keys, "n_left", "n_right", F.when(s > 0, (F.col("_ma") - F.col("_mb")) / s).alias("d"))


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Rank correlation of complete pairs by keys; NULL below three pairs or of a column with itself."""
    if a == b:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("rho"))
    keys = list(keys)
    # equal pairs are counted first, then each side's values are put in order
    d = df.select(*keys, finite(a).alias("_a"), finite(b).alias("_b")).where("_a is not null and _b is not null")
    d = kept(d.groupBy(*keys, "_a", "_b").agg(F.count("*").alias("n")))
    for c in ("_a", "_b"):
        o = Ordered(d.groupBy(*keys, c).agg(F.sum("n").alias("n")), keys, c, ["n"])
        # the rank less the mean of all ranks
        r = joined(o.rows, o.totals.withColumnRenamed("n", "_total"), keys, o.parts)
        d = d.join(r.select(*keys, c, (F.col("_before_n") + (F.col("n") - F.col("_total")) / 2.0).alias(f"_r{c}")), [*keys, c])
    n = F.col("n")
    c = d.groupBy(*keys).agg(F.sum(n).alias("n"), *[F.sum(n * F.col(x) * F.col(y)).alias(x + y) for x, y in (("_r_a", "_r_a"), ("_r_b", "_r_b"), ("_r_a", "_r_b"))])
    return c.select(*keys, "n", F.when(n >= 3, F.try_divide("_r_a_r_b", F.sqrt(F.col("_r_a_r_a")) * F.sqrt(F.col("_r_b_r_b")))).alias("rho"))


def spearman_test(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """``spearman`` with its two-sided p-value, by the t distribution; NULL without rho."""
    out = spearman(df, a, b, keys)

    def run(it):
        for pdf in it:
            p = [None if pd.isna(r) else spearman_p(r, n) for r, n in zip(pdf["rho"], pdf["n"], strict=True)]
            yield pdf.assign(p=pd.Series(p, index=pdf.index, dtype=float))

    schema = ", ".join([f"{c} {out.schema[c].dataType.simpleString()}" for c in out.columns] + ["p double"])
    return out.mapInPandas(run, schema)


def qq_pairs(df: DataFrame, value: str, left: str, keys: list[str], n: int = 199) -> DataFrame:
    """(keys, n_left, n_right, k, left, right): quantile pairs of both sides at probabilities (k + 0.5) / n."""
    d = df.select(*keys, finite(value).alias("_v"), F.col(left).alias("_l")).where("_l is not null")
    q = quantiles(d, "_v", [(i + 0.5) / n for i in range(n)], [*keys, "_l"])
    both = q.groupBy(*keys).agg(*[F.max(F.when(side, F.col(c))).alias(f"{name}_{c}") for name, side in (("left", F.col("_l")), ("right", ~F.col("_l"))) for c in ("n", "q")])
    both = both.where("left_q is not null and right_q is not null").select(*keys, F.col("left_n").alias("n_left"), F.col("right_n").alias("n_right"), F.posexplode(F.arrays_zip("left_q", "right_q")).alias("k", "q"))
    return both.select(*keys, "n_left", "n_right", "k", F.col("q.left_q").alias("left"), F.col("q.right_q").alias("right"))


def qq_fit(df: DataFrame, value: str, left: str, keys: list[str], n: int = 199) -> DataFrame:
    """Line through the quantile pairs, right against left."""
    q = qq_pairs(df, value, left, keys, n)
    x, y = F.col("left"), F.col("right")
    return q.groupBy(*keys, "n_left", "n_right").agg(F.round(F.regr_slope(y, x), 3).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 4).alias("r2"))


def group_values(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The finite values of each group, a row each; groups without any have none."""
    return df.select(*keys, finite(value).alias("value")).where("value is not null")


def rho_by_group(pairs: DataFrame, a: str, b: str, group_i: str, group_j: str) -> DataFrame:
    """(pairs, n, rho): rank correlation over all pairs, those of one group and those across; NULL below three pairs."""
    same = F.coalesce(F.col(group_i) == F.col(group_j), F.lit(False))
    d = pairs.select(a, b, F.explode(F.array(F.lit("all"), F.when(same, "same").otherwise("different"))).alias("pairs"))
    return spearman(d, a, b, ["pairs"])


def p_values(df: DataFrame, value: str, left: str, keys: list[str]) -> DataFrame:
    """(keys, n_left, n_right, u, p_mann_whitney, d, p_ks, t, p_welch), two-sided, from aggregates.

    Mann-Whitney is exact for a side of up to 8 values without ties, Kolmogorov-Smirnov for up to ``EXACT`` values on each
    side; beyond, the limits. NULL where a side has no values (Welch: fewer than two, or no variance).
    """
    n, parts = _sides(df, value, left, keys)
    both = (F.col("a") + F.col("b")).cast("double")
    x = n.groupBy(*keys, "n_left", "n_right").agg(F.sum(F.col("a") * (F.col("_before_b") + F.col("b") / 2.0)).alias("u"), F.max(_gap()).alias("d"), F.sum(both * both * both - both).alias("_ties"))
    d = df.select(*keys, finite(value).alias("_v"), F.col(left).alias("_l")).where("_v is not null and _l is not null")
    a, b = F.when(F.col("_l"), F.col("_v")), F.when(~F.col("_l"), F.col("_v"))
    m = d.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    x = joined(m, x, list(keys), parts)

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                n1, n2 = int(r["n_left"]), int(r["n_right"])
                row = {k: r[k] for k in keys} | {"n_left": n1, "n_right": n2}
                if n1 and n2:
                    u = r["u"]
                    exact = min(n1, n2) <= 8 and r["_ties"] == 0
                    row |= {"u": u, "p_mann_whitney": mann_whitney_exact(u, n1, n2) if exact else mann_whitney_p(u, n1, n2, tie_sum=r["_ties"]), "d": r["d"]}
                    row["p_ks"] = ks_exact(r["d"], n1, n2) if max(n1, n2) <= EXACT else ks_p(r["d"], n1, n2)
                    if min(n1, n2) > 1 and r["_va"] + r["_vb"] > 0:
                        row["t"] = (r["_ma"] - r["_mb"]) / math.sqrt(r["_va"] / n1 + r["_vb"] / n2)
                        row["p_welch"] = welch_p(r["_ma"], r["_va"], n1, r["_mb"], r["_vb"], n2)
                out.append(row)
            yield pd.DataFrame(out, columns=[*keys, "n_left", "n_right", "u", "p_mann_whitney", "d", "p_ks", "t", "p_welch"])

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["n_left long, n_right long, u double, p_mann_whitney double, d double, p_ks double, t double, p_welch double"])
    return x.mapInPandas(run, schema)


# p-values in closed form

#: Fixed value: numbers on the larger side up to which the Kolmogorov-Smirnov p-value is exact.
EXACT = 10_000


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided, without ties: counts of the sums of ranks, one size of sample after the other."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    # the jth value of a sample of i lies above between 0 and n2 of the others
    for top in range(n1 + n2):
        for i in range(min(n1, top + 1), 0, -1):
            above = top - (i - 1)
            if above <= n2:
                ways[i, above:] += ways[i - 1, : n1 * n2 + 1 - above]
    share = ways[n1] / ways[n1].sum()
    low = min(u, n1 * n2 - u)
    return float(min(1.0, 2 * share[: int(math.floor(low + 1e-9)) + 1].sum()))


def ks_exact(d: float, n1: int, n2: int) -> float:
    """Two-sided: the share of orders of both samples whose largest gap reaches d, counted in the band where it doesn't.

    ``out[i]`` is the share of the orders of i values of one and s - i of the other sample that have left the band so far;
    s grows by one, so a step costs the band's width.
    """
    n1, n2 = int(n1), int(n2)
    n, h = n1 + n2, round(d * n1 * n2)
    if h < 1:
        return 1.0
    out, low = np.ones(n1 + 1), 0
    out[0] = 0.0
    for s in range(1, n + 1):
        lo, hi = max(-((h - 1 - s * n1) // n), 0, s - n2), min((s * n1 + h - 1) // n, s, n1)
        if lo > hi:
            return 1.0
        i = np.arange(lo, hi + 1)
        step = (s - i) * out[lo : hi + 1]
        step[int(lo == 0) :] += i[int(lo == 0) :] * out[max(lo - 1, 0) : hi]
        out[low:lo] = 1.0
        out[lo : hi + 1] = step / s
        low = lo
    return float(min(1.0, out[n1]))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney_p(u: float, n1: int, n2: int, ties: list[int] = (), tie_sum: float | None = None) -> float:
    """Two-sided, by the normal limit with corrections for ties and continuity."""
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - (sum(t**3 - t for t in ties) if tie_sum is None else tie_sum) / max(1, n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, 2 * normal_tail(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Two-sided, by the limit series with the finite-sample argument."""
    e = math.sqrt(n1 * n2 / (n1 + n2))
    x = (e + 0.12 + 0.11 / e) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def welch_p(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int) -> float:
    a, b = v1 / n1, v2 / n2
    if a + b == 0:
        return float("nan")
    return t_p((m1 - m2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or rho is None:
        return float("nan")
    return 0.0 if abs(rho) >= 1 else t_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
