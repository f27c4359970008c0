"""Exact deduplication as a stream with keyed state.

Rows land as (digest, length, id, locator) and a stream groups them by digest. Its state has no expiry and lies in an
embedded store on the workers' disks, saved to the checkpoint folder with every batch: per digest the row that stays,
with its stable identifier, and the group's size. New rows can land later and the stream goes on from its checkpoint.
Copies are combined in the task that reads them before they meet their digest's state, so a hot text costs one row per
task.

A digest that is hit more than once is only a claim: for each hit the full bytes are read again through the locator
and compared with the bytes of the row that the state names. Rows that differ although their digests agree form
groups of their own by their bytes, so the result does not rest on the digest. Copies of one text meet their own row
through a join whose large side is split at run time.

Texts are equal when they are after deletion of white space. Of equal texts the row with the most code points stays,
then the one with the smallest id; a null id comes last. Null counts as empty, and all such texts are one group. Rows
that repeat id and text are rows of one group. The locator is (id, digest of the original bytes), which finds the row
in whatever table holds the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, staging_path
from .common import SPACE, query, table, texts

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no disk space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Dedup:
    """A stream under ``folder``: landed rows, the checkpoint with the state, and the changed groups of each batch."""

    LANDED = "digest string, length int, doc_id bigint, original bigint"

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder or staging_path(spark, "dedup"), digest

    def land(self, docs: DataFrame) -> DataFrame:
        """Add ``docs`` (doc_id, text) to what the stream reads; the rows that were added."""
        rows = self._located(docs).select("digest", F.length("text").alias("length"), "doc_id", "original")
        path = f"{self.folder}/landed/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(self.LANDED).parquet(path)

    def _located(self, docs: DataFrame) -> DataFrame:
        plain = normalised(F.col("text"))
        return docs.select("doc_id", "text", self.digest(plain).alias("digest"), F.xxhash64("text").alias("original"))

    def advance(self) -> DataFrame:
        """Run the stream over what has landed since the last time; then all groups: digest, best, n."""
        for key, value in STATE_SETTINGS.items():
            self.spark.conf.set(key, value)

        def keep(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

        rows = self.spark.readStream.schema(self.LANDED).parquet(f"{self.folder}/landed/*")
        stays = F.struct((-F.col("length")).alias("shorter"), F.isnull("doc_id").alias("no_id"), "doc_id", "original")
        groups = rows.groupBy("digest").agg(F.min(stays).alias("best"), F.count(F.lit(1)).alias("n"))
        stream = groups.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(keep)
        stream.option("checkpointLocation", f"{self.folder}/checkpoint").start().awaitTermination()
        changes = self.spark.read.parquet(f"{self.folder}/changes")
        last = F.max(F.struct("batch", "best", "n")).alias("last")  # a group changes once in a batch
        return changes.groupBy("digest").agg(last).select("digest", "last.best", "last.n")

    def decide(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text) through the stream: doc_id, original, digest, keep_id, keep_original, group_size."""
        landed, groups = self.land(docs), self.advance()
        claims = materialize(
            landed.join(groups, "digest").select(
                "doc_id", "original", "digest", F.col("best.doc_id").alias("keep_id"),
                F.col("best.original").alias("keep_original"), F.col("n").alias("group_size"),
            )
        )
        clashing = self._clashing(docs, claims)
        if clashing.isEmpty():
            return claims
        by_bytes = Window.partitionBy("digest", "plain")
        stays = F.struct((-F.length("text")).alias("shorter"), F.isnull("doc_id").alias("no_id"), "doc_id", "original")
        apart = (
            self._located(docs)
            .join(clashing, "digest", "left_semi")
            .withColumn("plain", normalised(F.col("text")))
            .withColumns({"best": F.min(stays).over(by_bytes), "group_size": F.count(F.lit(1)).over(by_bytes)})
            .select(
                "doc_id", "original", "digest", F.col("best.doc_id").alias("keep_id"),
                F.col("best.original").alias("keep_original"), "group_size",
            )
        )
        return claims.join(clashing, "digest", "left_anti").unionByName(apart)

    def _clashing(self, docs: DataFrame, claims: DataFrame) -> DataFrame:
        """Digests under which the full bytes of two rows differ."""
        hits = claims.where("group_size > 1").select(
            F.col("doc_id").alias("i"), F.col("original").alias("o"), F.col("digest").alias("claimed"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("original") == F.col("keep_original"))).alias("stays"),
        ).distinct()
        located = self._located(docs).select("doc_id", "original", normalised(F.col("text")).alias("plain"))
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("original") == F.col("o"))
        read = located.join(hits.hint("shuffle_hash"), same).select("claimed", "stays", "plain")
        read = materialize(read)
        named = read.where("stays").select("claimed", F.col("plain").alias("of_state")).distinct()
        odd = read.where("not stays").join(named, "claimed").where(F.col("plain") != F.col("of_state"))
        return materialize(odd.select(F.col("claimed").alias("digest")).distinct())


def deduplicate(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``docs`` (with doc_id and text) without the rows that another one stands for."""
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("original") == F.col("keep_original"))
    kept = Dedup(docs.sparkSession, folder).decide(texts(docs)).where(stays)
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("original").alias("__o")).distinct()
    marked = docs.withColumn("__original", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__original") == F.col("__o"))
    joined = marked.join(kept.hint("shuffle_hash"), same, "left_semi")
    return joined.dropDuplicates(["doc_id", "__original"]).select(docs.columns)


_SQL = """
with d as (select doc_id, length(coalesce(text, '')) n,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t from documents),
g as (select t, first(doc_id order by n desc, doc_id) keep_id, count(*) group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) text_sha256 from d join g using (t)
"""


@query("op8_exact_stream", _SQL)
def op8(spark, sf_dir):
    """Every document with the row that stands for its text."""
    decided = Dedup(spark).decide(texts(table(spark, sf_dir, "documents")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("original") == F.col("keep_original"))
    return decided.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
