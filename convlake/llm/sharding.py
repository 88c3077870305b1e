"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order and numbered; a row's fractional rank is (number + 1/2)
over the source's rows. Sorted by fractional rank the sources interleave in proportion, so every contiguous cut
holds the corpus's mixture, and cuts at equal counts give shards whose sizes differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, spread

SEED = 20_240_601


def interleave_shards(docs: DataFrame, shards: int, source: str = "source", seed: int = SEED) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in each shard) to ``docs``, which needs a doc_id.

    A null source is a source of its own. Rows with the same doc_id and equal other columns are interchangeable;
    an empty table gives none. No source, however large, is gathered: ranks come from counts of even slices.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    salted = scratch.save(docs.withColumn("_salt", spread(F.lit(seed), F.col("doc_id"))), "salted")
    total = salted.count()
    tie = [F.col(c) for c in ("doc_id", *[c for c in docs.columns if c not in ("doc_id", source)])]
    sizes = salted.groupBy(source).count().select(F.col(source).alias("_s"), F.col("count").alias("_n"))
    inner = ranked(salted, [source], tie, F.col("_salt"), total, "_rank")
    sized = inner.join(sizes.hint("merge"), F.col(source).eqNullSafe(F.col("_s")), "left")
    share = scratch.save(sized.withColumn("_share", (F.col("_rank") + 0.5) / F.col("_n")).drop("_s", "_n", "_rank"), "shares")
    salt = F.floor(F.col("_share") * F.lit(2.0**31)).cast("long")
    placed = ranked(share.withColumn("_all", F.lit(0)), ["_all"], [F.col("_share"), F.col(source), *tie], salt, total, "_place")
    shard = F.expr(f"int((_place * {shards}) div {max(total, 1)})")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("_place") - first).cast("long")).drop("_all", "_share", "_salt", "_place")


def write_shards(docs: DataFrame, shards: int, path: str, **options) -> None:
    """Write whole documents, a folder per shard, in slot order within a file."""
    placed = interleave_shards(docs, shards, **options)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's columns: doc_id, size, text_crc32, law, shard, slot, grown_shard. Null text: no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleave_shards(small, shards)
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
