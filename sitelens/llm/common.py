"""Shared helpers: the cluster's shared folder, written tables, bounded broadcasts and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = sc._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sitelens-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


_scratch: list[tuple[list[str], list]] = []


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1][0].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def broadcast(spark: SparkSession, value):
    """A broadcast that ``scratch`` destroys."""
    b = spark.sparkContext.broadcast(value)
    if _scratch:
        _scratch[-1][1].append(b)
    return b


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Drops at its end the tables and broadcasts made meanwhile, but for tables put into the list it gives.

    For plans whose result is written inside; a result that is still to be computed needs its tables.
    """
    keep: list[str] = []
    _scratch.append(([], []))
    try:
        yield keep
    finally:
        paths, shared = _scratch.pop()
        for b in shared:
            b.destroy()
        drop(spark, *(p for p in paths if p not in keep))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string array; a null counts as empty."""
    arr = col.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64, len(arr) + 1 + arr.offset)[arr.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near ``most`` (a longer single text is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_held: dict[str, object] = {}


def worker_cache(name: str, make):
    """An object that a Python worker keeps between its tasks; there is one at a time, the others give way."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, cache: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows; unused memory goes back now and then, other operators' caches at the start."""
    if _held and cache not in _held:
        _held.clear()
        tidy()
    done = 0
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        done += b.nbytes
        if done > 64 << 20:
            done = 0
            tidy()


def tidied(f):
    """An Arrow function that gives unused memory back once it is through and its variables are gone."""

    @functools.wraps(f)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        tidy()

    return run


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@tidied
def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to stars onto the least node of each local component, in blocks of bounded size."""
    def stars(us: list[np.ndarray], vs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.concatenate(us), np.concatenate(vs)
        names, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = idx[: len(u)], idx[len(u) :]
        lab = np.arange(len(names))
        while True:
            low = np.minimum(lab[a], lab[b])
            new = lab.copy()
            np.minimum.at(new, lab[a], low)
            np.minimum.at(new, lab[b], low)
            while not np.array_equal(nn := new[new], new):
                new = nn
            new = np.minimum(new, new[lab])
            if np.array_equal(new, lab):
                break
            lab = new
        keep = lab != np.arange(len(names))
        return names[keep], names[lab[keep]]

    us, vs, n = [], [], 0
    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n > 1_000_000:
            u, v = stars(us, vs)
            if len(u) > 0.8 * n:
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                us, vs, n = [], [], 0
            else:
                us, vs, n = [u], [v], len(u)
    if n:
        u, v = stars(us, vs)
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame, u: str, v: str, one_task: int = 1_000_000) -> DataFrame:
    """(node, component) for every node that has an edge to another; component: least node reachable.

    Local contraction per partition; what is left is contracted in one task if it is at most ``one_task`` edges (16 MB), else
    by alternating large-star and small-star rounds, each a checkpoint in the shared folder. Both give the same rows.
    Self loops and repeated edges are allowed; no rows give no rows.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    e = e.mapInArrow(_forest, "u long, v long").distinct()
    e = e.checkpoint()
    mark = None
    done = e.count() <= one_task
    if done:
        e = e.coalesce(1).mapInArrow(_forest, "u long, v long").checkpoint()
    while not done:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.mapInArrow(_forest, "u long, v long").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = small.where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
