"""Seeks in a log (S7, S8, S10): a table whose lookups, ranges and pages neither shuffle it nor read more than the buckets they need.

Ids are cut into blocks; a block of a session has one place, a hash by which the table is bucketed and sorted. So a long
session lies in many buckets, what a caller asks for is told by places alone, and rows that share a place meet what is asked of them as one row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept, shared_dir

#: Ids of a block: a row is held against so many wishes at most, where they are single ids.
BLOCK = 256
#: As many places are given to the scan as literals, so that it leaves out buckets and row groups; more are met by a join alone.
LITERALS = 64


def place(session: str | Column, block: Column) -> Column:
    return F.xxhash64(session, block)


def block_of(at: str) -> Column:
    return F.floor(F.col(at) / BLOCK).cast("long")


class SeekableLog:
    """A log of (session_id, id, ...) as a table in ``spark.checkpoint.dir``, or at ``path``. Ids may have gaps and may repeat; rows without an id are
    never found. A session without a name is one too. One writer at a time."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 256):
        self.spark, self.name, self.buckets = spark, name or f"log_{uuid.uuid4().hex}", buckets
        self.path = path or f"{shared_dir(spark)}/{self.name}"

    def add(self, rows: DataFrame) -> SeekableLog:
        """Append ``rows``. A block's rows go to one task, so that an append leaves one file for each bucket."""
        placed = rows.withColumn("_place", place("session_id", block_of("id")))
        placed.repartition(self.buckets, "_place").write.mode("append").option("path", self.path).bucketBy(self.buckets, "_place").sortBy("_place", "id").saveAsTable(self.name)
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("_place")

    def ranges(self, wishes: DataFrame) -> DataFrame:
        """The rows that lie in any of the ranges (session_id, first, last), once each, however many ask for them. Both ends are needed; a
        range is spelled out by its blocks, so it should be cut to what the log has."""
        whole = wishes.select("session_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).where("first <= last")
        cut = whole.withColumn("_b", F.explode(F.sequence(block_of("first"), block_of("last"))))
        clipped = cut.select(place("session_id", F.col("_b")).alias("_place"), "session_id", F.greatest("first", F.col("_b") * BLOCK).alias("first"), F.least("last", F.col("_b") * BLOCK + (BLOCK - 1)).alias("last"))
        asked = kept(clipped.groupBy("_place").agg(F.collect_set(F.struct("session_id", "first", "last")).alias("_asked")))
        log = self.spark.table(self.name)
        few = [r[0] for r in asked.select("_place").limit(LITERALS + 1).collect()]
        if not few:
            return log.drop("_place").limit(0)
        if len(few) <= LITERALS:
            log = log.where(reduce(lambda a, b: a | b, [F.col("_place") == p for p in few]))
        mine = lambda w: w["session_id"].eqNullSafe(F.col("session_id")) & F.col("id").between(w["first"], w["last"])
        return log.join(asked.hint("shuffle_hash"), "_place").where(F.exists("_asked", mine)).drop("_place", "_asked")

    def get(self, keys: DataFrame) -> DataFrame:
        """The records of (session_id, id) keys, once each."""
        return self.ranges(keys.select("session_id", F.col("id").alias("first"), F.col("id").alias("last")))

    def absent(self, keys: DataFrame) -> DataFrame:
        """The keys that the log lacks; what it has of them is read without texts."""
        found = self.get(keys).select(F.struct("session_id", F.col("id").cast("long").alias("id")).alias("_k")).distinct()
        asked = keys.withColumn("_k", F.struct("session_id", F.col("id").cast("long").alias("id")))
        return asked.join(found.hint("merge"), "_k", "left_anti").drop("_k")

    def page(self, newest: int) -> DataFrame:
        """Each session's ``newest`` records. Ids and names alone are read of the whole log, to count a session's last blocks; twice as many are
        taken where gaps leave too few. Of equal ids any may go."""
        counts = kept(self.spark.table(self.name).where("id is not null").groupBy("session_id", block_of("id").alias("b")).agg(F.count("*").alias("n"), F.max("id").alias("last")))
        named = counts.withColumn("_s", F.struct("session_id"))
        ends = kept(named.groupBy("_s").agg(F.max("b").alias("top"), F.min("b").alias("low"), F.max("last").alias("last")))
        wide, open_, wishes = -(-newest // BLOCK) + 1, ends, None
        while True:
            near = named.join(open_.select("_s", "top", "low", F.col("last").alias("end")).hint("merge"), "_s").where(F.col("b") > F.col("top") - wide)
            have = kept(near.groupBy("_s", "top", "low", "end").agg(F.sum("n").alias("n"), F.min("b").alias("b")).withColumn("done", (F.col("n") >= newest) | (F.col("b") == F.col("low"))))
            met = have.where("done").select("_s.session_id", (F.col("b") * BLOCK).alias("first"), F.col("end").alias("last"))
            wishes = met if wishes is None else wishes.unionByName(met)
            open_ = have.where("not done").select("_s", "top", "low", F.col("end").alias("last"))
            if open_.isEmpty():
                break
            wide *= 2
        # a wish names the blocks that are there alone, so gaps are not spelled out
        there = counts.withColumn("_s", F.struct("session_id")).select("_s", "b", F.col("last").alias("_l"))
        cut = wishes.withColumn("_s", F.struct("session_id")).join(there.hint("merge"), "_s").where(F.col("b") * BLOCK >= F.col("first"))
        rows = self.ranges(cut.select("session_id", (F.col("b") * BLOCK).alias("first"), F.col("_l").alias("last")))
        back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("id").desc()))
        return rows.withColumn("_back", back).where(F.col("_back") <= newest).drop("_back")
