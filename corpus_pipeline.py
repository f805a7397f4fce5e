"""Corpus preparation: toxicity, near duplicates, benchmark decontamination, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``docs``.

Defined cases: null and empty texts stay (they are no near duplicates and score as texts without letters); repeated rows
of one doc_id share the near-duplicate stage's decision; rows with a null doc_id stand for no class and stay in that stage;
very long texts are read whole; without labels of both classes nothing is rejected as toxic; empty tables give empty tables;
other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontam, jaccard, packing, pii, toxicity
from sitelens.llm.common import broadcast, drop, scratch, table

#: Documents scored at or above this are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows and drop the documents that score as toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(toxicity.keep_below(broadcast(spark, model), docs.columns.index("text"), TOXIC), docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the lowest doc_id of each class of linked documents."""
    classes = jaccard.near_classes(docs)
    gone = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by its kind; n_chars follows where there is one."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' tokens into sequences; a row per piece, ids included."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Scores and token ids can't be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, now = table(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(now)
        if path:
            drop(spark, path)
        path = now
    return STAGES[-1][1](spark, docs, sf_dir)
