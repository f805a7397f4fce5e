"""Values in order: one table that ranks, quantiles and distribution functions read.

The rows are dealt by range of (keys, value), so a group with very many values spreads over tasks; sums run inside each
part, and the parts' totals, a row for each key and part, carry them on. The table is written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from ..shared import kept

#: Rows up to which a table is sent to all tasks (some MB).
SMALL = 100_000
#: Cells of equal counts, in which quantiles look for their ranks.
CELLS = 1024


def sent(df: DataFrame, rows: int) -> DataFrame:
    """With the hint to broadcast where its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL else df


def joined(df: DataFrame, small: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """A join by keys with a table of so many rows; without keys it has one row."""
    return df.join(sent(small, rows), keys) if keys else df.join(F.broadcast(small))


def _running(n_keys: int, n_sums: int) -> callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, [0] * n_sums
        for b in batches:
            if not b.num_rows:
                continue
            new = np.full(b.num_rows, n_keys == 0 and last is None)
            new[0] |= last is None
            for k in range(n_keys):
                col = b.column(k) if last is None else pa.concat_arrays([last[k], b.column(k)])
                codes = col.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[last is None :] |= codes[1:] != codes[:-1]
            if n_keys == 0:
                new[1:] = False
            heads, group = np.flatnonzero(new), np.cumsum(new)
            out = []
            for s in range(n_sums):
                x = b.column(n_keys + 1 + s).to_numpy(zero_copy_only=False)
                before = np.cumsum(x) - x + carry[s]
                before = before - np.concatenate(([0], before[heads]))[group]
                carry[s] = int(before[-1] + x[-1])
                out.append(pa.array(before, pa.int64()))
            last = [b.column(k).slice(b.num_rows - 1, 1) for k in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int64()), *out], [*b.schema.names, "_block", *[f"_in{s}" for s in range(n_sums)]])

    return run


class Ordered:
    """``rows`` with ``_block`` and ``_before_<c>`` (the sum of c over all rows of the keys with smaller values); ``totals`` by keys.

    counted has one row for each (keys, value), and whole numbers in ``sums``.
    """

    def __init__(self, counted: DataFrame, keys: list[str], value: str, sums: list[str]) -> None:
        self.keys = keys = list(keys)
        c = counted.select(*keys, value, *[F.col(s).cast("long").alias(s) for s in sums])
        c = c.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
        schema = T.StructType([*c.schema.fields, *[T.StructField(n, T.LongType()) for n in ("_block", *[f"_in{k}" for k in range(len(sums))])]])
        d = kept(c.mapInArrow(_running(len(keys), len(sums)), schema))
        per = d.groupBy(*keys, "_block").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
        up = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        per = kept(per.select(*keys, "_block", *[f"_s_{s}" for s in sums], *[F.coalesce(F.sum(f"_s_{s}").over(up), F.lit(0)).alias(f"_o_{s}") for s in sums]))
        self.parts = per.count()
        d = d.join(sent(per.drop(*[f"_s_{s}" for s in sums]), self.parts), [*keys, "_block"])
        self.rows = d.select(*keys, value, *sums, "_block", *[(F.col(f"_o_{s}") + F.col(f"_in{k}")).alias(f"_before_{s}") for k, s in enumerate(sums)])
        self.totals = per.groupBy(*keys).agg(*[F.sum(f"_s_{s}").alias(s) for s in sums])


def counted(df: DataFrame, keys: list[str], value: str, left: str | None = None) -> DataFrame:
    """(keys, _v, n) of the finite values, or with ``left`` (keys, _v, a, b): rows of both sides."""
    d = df.select(*keys, finite(value).alias("_v"), *([F.col(left).alias("_l")] if left else [])).where("_v is not null")
    if left is None:
        return d.groupBy(*keys, "_v").agg(F.count("*").alias("n"))
    return d.where("_l is not null").groupBy(*keys, "_v").agg(F.count_if("_l").alias("a"), F.count_if(~F.col("_l")).alias("b"))


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, n, q): exact quantiles of the finite values, interpolated; no group is held in one buffer."""
    keys = list(keys)
    o = Ordered(counted(df, keys, value).withColumnRenamed("n", "_n"), keys, "_v", ["_n"])
    width = F.greatest(F.lit(1), F.floor(F.col("_total") / CELLS))
    total = o.totals.withColumnRenamed("_n", "_total")
    # the two ranks beside each quantile, looked up in their cells only
    h, at = F.col("_p") * (F.col("_total") - 1), lambda side, f: F.struct(F.lit(side).alias("_side"), f(h).cast("long").alias("_rank"))
    ranks = total.select(*keys, "_total", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_k", "_p"))
    ranks = ranks.select(*keys, "_total", "_k", (h - F.floor(h)).alias("_f"), F.explode(F.array(at(0, F.floor), at(1, F.ceil))).alias("_at"))
    ranks = ranks.select(*keys, "_total", "_k", "_f", "_at.*").withColumn("_cell", F.floor(F.col("_rank") / width))
    r = joined(o.rows, total, keys, o.parts)
    r = r.select(*keys, "_v", "_n", "_before__n", F.explode(F.sequence(F.floor(F.col("_before__n") / width), F.floor((F.col("_before__n") + F.col("_n") - 1) / width))).alias("_cell"))
    held = (F.col("_rank") >= F.col("_before__n")) & (F.col("_rank") < F.col("_before__n") + F.col("_n"))
    two = r.join(sent(ranks, o.parts * 2 * len(probs)), [*keys, "_cell"]).where(held)
    lo, hi = F.max(F.when(F.col("_side") == 0, F.col("_v"))), F.max(F.when(F.col("_side") == 1, F.col("_v")))
    two = two.groupBy(*keys, F.col("_total").alias("n"), "_k").agg(F.first("_f").alias("_f"), lo.alias("_lo"), hi.alias("_hi"))
    two = two.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    return two.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_q"))), lambda x: x["_q"]).alias("q"))
