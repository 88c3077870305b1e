"""Helpers that the corpus operators share: tables in the shared folder, checked broadcasts, balanced ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 2_000
#: A hub is a node with a HUB-th of the edges or more, so there are 2 * HUB at most.
HUB = 1_000
RANK_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none, as in tests, gets one made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables of one run in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing reads any more, and let Spark delete shuffle files of finished jobs."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


def join_checked(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``other`` if it has at most ``limit`` rows, counted here; else a sort-merge join, whose hot keys AQE splits."""
    small = other.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(other) if small else other.hint("merge"), on, how)


def ranked(df: DataFrame, keys: list[str], order: list[Column], salt: Column, rows: int, rank: str) -> DataFrame:
    """Add ``rank``: the row's place from 0 within ``keys`` by (salt, order), without gathering a hot key in one task.

    ``salt`` is a long in 0 .. 2^31-1 that spreads the rows evenly; ``rows`` is about how many there are. Ranks
    within (keys, slice of salt) come from a window over that pair, offsets from the counts of the slices.
    """
    slices = max(256, rows // RANK_ROWS)
    cut = df.withColumn("_slice", F.floor(salt * F.lit(slices) / F.lit(2.0**31)).cast("int"))
    by = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    named = [F.col(c).alias(f"_o_{c}") for c in by]
    offsets = counts.select(*named, "_before").hint("merge")
    place = Window.partitionBy(*by).orderBy(salt, *order)
    out = cut.withColumn("_at", F.row_number().over(place) - 1)
    on = [out[c].eqNullSafe(F.col(f"_o_{c}")) for c in by]
    return out.join(offsets, on, "left").withColumn(rank, (F.col("_at") + F.col("_before")).cast("long")).drop("_slice", "_at", "_before", *[f"_o_{c}" for c in by])


def spread(*cols: Column) -> Column:
    """An even long in 0 .. 2^31-1 from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with their node's m. Hubs, few by their definition, are broadcast, so no task gathers a hub's edges."""
    hubs = F.broadcast(least.where(F.col("n") * HUB >= total).select("a", "m"))
    others = rows.join(hubs.select("a"), "a", "left_anti")
    return rows.join(hubs, "a").unionByName(others.join(least.select("a", "m").hint("merge"), "a"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Alternating large-star and small-star rounds, each a minimum by node joined back to the edges and written
    to the shared folder; nothing is collected but one count and one checksum a round.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen, step = scratch.save(both, "edges0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, step = mark, step + 1
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), f"least{step}")
        large = _with_least(sides, least, mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large, f"large{step}")
        smallest = scratch.save(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"smallest{step}")
        small = _with_least(large, smallest, mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
        after = scratch.save(small.where("a <> b").distinct(), f"edges{step}")
        scratch.drop(f"large{step}", f"least{step}", f"smallest{step}", f"edges{step - 1}")
        now = after
