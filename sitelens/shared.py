"""The folder that all executors share, and tables kept there between the steps of an operator."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
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


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: later steps read it, and lost executors don't take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def address(path: str) -> str:
    """A path as an address that pyarrow.fs knows."""
    if "://" in path:
        return path
    return Path(path.removeprefix("file:")).resolve().as_uri()
