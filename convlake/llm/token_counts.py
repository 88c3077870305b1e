"""Token counts by a digest cache.

The cache is a table of (tokenizer, text_sha256, n_tokens): partitioned by the digest of the tokenizer's version,
bucketed and sorted by the digest of the content. A batch of documents is reduced to content digests; those that
the cache lacks under this version are encoded, once for each distinct text, and appended; every document then
takes its count from the cache.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_checked, shared_dir

LIMIT = 4_096
#: A digest is hot if it has at least a HOT-th of the rows, so that there are HOT hot digests at most.
HOT = 1_000
#: Distinct missing digests are broadcast up to so many (32 bytes each), else texts meet them by sort-merge.
MISSING_ROWS = 50_000
CACHE = "tokenizer string, text_sha256 string, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """How many ids the file's own library gives a text: sentencepiece for .model, tokenizers for .json, as they come."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


def tokenizer_version(path: str) -> str:
    """SHA-256 of the file, and of which library in which version reads it: either may change a count."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {version(library)}\n".encode() + Path(path).read_bytes()).hexdigest()


class TokenCache:
    """The table of known counts; made when first used. Texts that two runs append at once have one count twice, and rows() gives it once."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"token_cache_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self.append(spark.createDataFrame([], CACHE))

    def append(self, counted: DataFrame) -> None:
        path = f"{shared_dir(self.spark)}/{self.name}"
        dealt = counted.repartition(self.buckets, "text_sha256")  # as the buckets are, so that a task writes one file
        dealt.write.mode("append").option("path", path).partitionBy("tokenizer").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def rows(self, tokenizer: str) -> DataFrame:
        """(text_sha256, n_tokens) of one version: its folder alone is read, and buckets spare the shuffle."""
        known = self.spark.table(self.name).where(F.col("tokenizer") == tokenizer)
        return known.groupBy("text_sha256").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            counts = [count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["text_sha256", "n_tokens"])

    return texts.select("text_sha256", "text").mapInArrow(run, "text_sha256 string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, cache: TokenCache | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit, text_sha256.

    Content is normalised no further than a library's count allows: a null text is the empty one, 0 tokens. Texts are
    encoded whole, however long; equal texts are encoded once, whatever their doc_ids, and rows that repeat a doc_id,
    or have none, each get their count. Other columns are ignored. An empty table gives no rows and leaves the cache as it is.

    Of a hot digest only the rows with its smallest doc_id are sent to be encoded, so no group of copies is gathered;
    hot digests, HOT at most by their definition, are broadcast. A run that fails before its append leaves the cache as it was.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    scratch, cache, now = Scratch(spark, "tokens"), cache or TokenCache(spark), tokenizer_version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256).alias("text_sha256")
    rows = scratch.save(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    some = rows.groupBy("text_sha256", F.pmod(F.spark_partition_id(), F.lit(16)).alias("_part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    sized = scratch.save(some.groupBy("text_sha256").agg(F.sum("n").alias("n"), F.min("least").alias("least")), "sized")
    total = rows.count()
    known = cache.rows(now)
    missing = scratch.save(sized.join(known.select("text_sha256").hint("merge"), "text_sha256", "left_anti").select("text_sha256"), "missing")
    hot = scratch.save(sized.where(F.col("n") * HOT >= total).select("text_sha256", "least"), "hot")
    least = F.broadcast(hot.select("text_sha256", "least", F.lit(True).alias("_hot")))
    one = docs.select("doc_id", text.alias("text"), digest).join(least, "text_sha256", "left").where(F.col("_hot").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))
    one = one.select("text_sha256", "text")
    n_missing = missing.count()
    if n_missing:
        if n_missing <= MISSING_ROWS:
            fresh = one.join(F.broadcast(missing), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.first("text").alias("text"))
        else:  # map-side distinct first, then the same partitioning serves the join
            fresh = one.groupBy("text_sha256").agg(F.first("text").alias("text")).join(missing.hint("merge"), "text_sha256", "left_semi")
        counted = scratch.save(_encoded(fresh, path), "counted")
        cache.append(counted.select(F.lit(now).alias("tokenizer"), "text_sha256", "n_tokens"))
        known = cache.rows(now)
    few = F.broadcast(join_checked(known, hot.select("text_sha256"), ["text_sha256"], "left_semi", HOT))
    names = F.broadcast(hot.select("text_sha256"))
    met = rows.join(few, "text_sha256").unionByName(rows.join(names, "text_sha256", "left_anti").join(known.hint("merge"), "text_sha256"))
    return met.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "text_sha256")
