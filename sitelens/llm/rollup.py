"""Token counts kept as delta-maintained rollups.

Counts come from real vocabularies: ``count_tokens`` encodes every whole text by byte-pair ranks, one column for each
tokenizer version. Events (op insert, delete or revise; source, lang, version, n_tokens; old_tokens for revisions; copies,
how many documents the event stands for) become signed changes of additive totals by source, language and tokenizer
version. A batch is pre-aggregated and committed under its id: the changes are written to a folder of their own and
renamed into place, so a batch that is already there, or a task that runs again, changes nothing. Totals are sums over the
committed batches; ``compact`` folds them into one.

Defined cases: null source, lang or version are groups of their own; null counts are 0, null copies 1; totals without
documents are left out; an unknown op raises; repeated event rows count each; no events commit an empty batch. Documents:
null text counts as empty, 0 tokens; very long texts are encoded whole; of equal texts, repeated rows and null doc_ids
included, the one of least doc_id stays (null last; of several such by least source, then lang) and the others are
deleted; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, new_path, slices, table, tidied, worker_cache

KEYS = ["source", "lang", "version"]
_SCHEMA = "source string, lang string, version string, n_docs bigint, n_tokens bigint, n_chars bigint"

#: Files of byte-pair ranks by tokenizer version.
TOKENIZERS = {"byte-50k": "byte_bpe_50k.tiktoken", "multi-50k": "byte_bpe_multi_50k.tiktoken"}


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """The rows of docs without their text; a count for each version (a name and a file of ranks)."""

    at, names, paths = docs.columns.index("text"), list(versions), list(versions.values())
    cache = f"ranks {paths}"

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = worker_cache(cache, lambda: [encoding(p) for p in paths])
        for b in slices(batches, 1000, cache):
            texts = [t or "" for t in b.column(at).to_pylist()]
            counts = [pa.array([len(e.encode_ordinary(t)) for t in texts], pa.int64()) for e in encoders]
            rest = [k for k in range(b.num_columns) if k != at]
            yield pa.record_batch([*(b.column(k) for k in rest), *counts], names=[*(b.schema.names[k] for k in rest), *names])

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in names)]))


def signed(events: DataFrame) -> DataFrame:
    """Signed changes n_docs, n_tokens, n_chars of each event; without a column ``copies`` each is one document's."""
    copies = F.coalesce(F.col("copies"), F.lit(1)).cast("long") if "copies" in events.columns else F.lit(1).cast("long")
    op = F.col("op")
    bad = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("long")
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad).cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return events.select(
        *KEYS, (sign * copies).alias("n_docs"),
        (copies * F.when(op == "revise", zero("n_tokens") - zero("old_tokens")).otherwise(sign * zero("n_tokens"))).alias("n_tokens"),
        (sign * copies * zero("n_chars")).alias("n_chars"),
    )


class Rollup:
    """Totals in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(path))

    def _p(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def batches(self) -> list[str]:
        """Names of the committed folders, each ``batch-<id>`` or ``base-<n>``, without those a base has folded in."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(self.path)))
        bases = [n for n in names if n.startswith("base-")]
        if not bases:
            return [n for n in names if n.startswith("batch-")]
        last = max(bases, key=lambda n: int(n.removeprefix("base-")))
        held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{last}/held").collect()}
        return [f"{last}/totals", *(n for n in names if n.startswith("batch-") and n not in held)]

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply a batch once; False if it was there already."""
        name = f"batch-{batch_id}"
        if self._fs.exists(self._p(self.path, name)):
            return False
        tmp = new_path(self.spark, "rollup")
        changes = signed(events).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        changes.write.parquet(tmp)
        done = self._fs.rename(self._p(tmp), self._p(self.path, name))
        # a rename onto a folder that came in between lands inside it: undo, as that commit holds
        inside = self._p(self.path, name, tmp.rsplit("/", 1)[-1])
        if self._fs.exists(inside):
            self._fs.delete(inside, True)
            return False
        return bool(done)

    def totals(self) -> DataFrame:
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        df = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])
        return df.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base; batches stay known by name, so replays are still ignored."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        number = 1 + max([int(n.removeprefix("base-")) for n in names if n.startswith("base-")], default=0)
        tmp = new_path(self.spark, "rollup")
        self.totals().write.parquet(f"{tmp}/totals")
        self.spark.createDataFrame([(n,) for n in names if n.startswith("batch-")], "batch string").write.parquet(f"{tmp}/held")
        self._fs.rename(self._p(tmp), self._p(self.path, f"base-{number}"))


def surplus(counts: DataFrame) -> DataFrame:
    """Of documents with a digest ``sha``: by (sha, source, lang) the copies to delete, so that one of each text stays.

    Pre-aggregated, so a text of very many copies is a few rows.
    """
    values = [c for c in counts.columns if c not in ("doc_id", "sha", "source", "lang")]
    by = counts.groupBy("sha", "source", "lang").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), *[F.first(f"`{c}`").alias(c) for c in values])
    w = Window.partitionBy("sha").orderBy(F.col("least").asc_nulls_last(), F.col("source").asc_nulls_first(), F.col("lang").asc_nulls_first())
    return by.withColumn("copies", F.col("copies") - (F.row_number().over(w) == 1).cast("long")).where("copies > 0").drop("least")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under two tokenizer versions, later copies of a text deleted, one version revised; replays ignored."""
    docs = documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"), "text")
    one, two = TOKENIZERS
    counts, _ = table(count_tokens(docs, {v: public_tokenizers.path(f) for v, f in TOKENIZERS.items()}), "counts")
    rollup = Rollup(spark, new_path(spark, "totals"))
    row = lambda op, v, n, old=F.lit(None).cast("long"): F.struct(F.lit(v).alias("version"), F.lit(op).alias("op"), n.alias("n_tokens"), old.alias("old_tokens"))

    def events(df: DataFrame, *rows) -> DataFrame:
        copies = F.col("copies") if "copies" in df.columns else F.lit(1)
        return df.select("source", "lang", "n_chars", copies.alias("copies"), F.explode(F.array(*rows)).alias("e")).select("source", "lang", "n_chars", "copies", "e.*")

    # the first version arrives wrong (characters) and is revised
    rollup.commit("1", events(counts, row("insert", one, F.col("n_chars")), row("insert", two, F.col(f"`{two}`"))))
    revised = events(counts, row("revise", one, F.col(f"`{one}`"), F.col("n_chars")))
    rollup.commit("2", revised)
    rollup.commit("3", events(surplus(counts), row("delete", one, F.col(f"`{one}`")), row("delete", two, F.col(f"`{two}`"))))
    rollup.commit("2", revised)
    rollup.compact()
    rollup.commit("2", revised)
    return rollup.totals().select("source", "lang", "version", "n_docs", "n_tokens", "n_chars")


QUERIES = {"op5_token_counts": op5_token_counts}
#: Byte-pair counts can't be expressed in SQL; tests compare them with plain counts.
ORACLE_SQL: dict[str, str] = {}
