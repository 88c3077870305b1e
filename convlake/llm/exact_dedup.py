"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

The index is a table that is bucketed and sorted by the SHA-256 of the normalised text. A batch of documents is
reduced to digests, its distinct digests are held against the index by a sort-merge anti-join, and those that are
new are appended in the same buckets, so that neither the index nor its order is shuffled again by the next batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest is hot if it has at least a HOT-th of the rows, so that there are HOT hot digests at most.
HOT = 1_000
#: Groups of tasks whose counts of a digest meet first.
PARTS = 16
INDEX = "text_sha256 string, keep_id long, group_size long"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z only; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """A table (text_sha256, keep_id, group_size), bucketed and sorted by digest; made when first used."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], INDEX))

    def _append(self, df: DataFrame) -> None:
        path = f"{shared_dir(self.spark)}/{self.name}"
        df.write.mode("append").option("path", path).bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, grouped: DataFrame) -> None:
        self._append(grouped.join(self.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; the digests go into ``index``.

    Of equal texts in a batch the largest doc_id stays; a text that the index already holds keeps the row it was
    indexed with, and the whole batch's copies go. group_size counts the copies in the batch in which the text came
    first. Null and empty texts are equal texts. A null doc_id stays only if its whole group has none; rows that
    repeat a doc_id with the same text count as one document and share the verdict. Other columns are ignored.

    A hot digest is joined by broadcast: at most HOT digests can each hold a HOT-th of the rows, which bounds it.
    """
    spark = docs.sparkSession
    scratch, index = Scratch(spark, "exact"), index or DigestIndex(spark)
    rows = scratch.save(docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256")), "digests")
    # in two steps, so that no task gets a row of a hot digest from every task before it
    some = rows.groupBy("text_sha256", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = scratch.save(some.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "grouped")
    index.append_new(grouped)
    total = rows.count()
    hot = scratch.save(grouped.where(F.col("group_size") * HOT >= total).select("text_sha256"), "hot")
    known = index.rows()
    few = F.broadcast(known.join(F.broadcast(hot), "text_sha256", "left_semi"))
    rest = rows.join(F.broadcast(hot), "text_sha256", "left_anti").join(known.hint("merge"), "text_sha256")
    out = rows.join(few, "text_sha256").unionByName(rest)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
