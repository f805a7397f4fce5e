"""Incremental ingest: structure files that arrive in a folder are appended to an atom table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.readers import atoms_of, parse_cif


def atom_stream(spark: SparkSession, path: str, pattern: str = "*.cif") -> DataFrame:
    """A stream of atom rows, a file at a time."""

    def run(it):
        for pdf in it:
            for p, v in zip(pdf["pdb_id"], pdf["value"], strict=True):
                yield pd.DataFrame(atoms_of(parse_cif(v), p.lower()), columns=[c.split()[0] for c in schemas.ATOMS.split(", ")])

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_final)?\.[^.]*$", "")
    return files.select(name.alias("pdb_id"), F.decode("content", "utf-8").alias("value")).mapInPandas(run, schemas.ATOMS)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, pattern: str = "*.cif"):
    """Append all files that are there now, and remember them; the finished query."""
    q = atom_stream(spark, path, pattern).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
