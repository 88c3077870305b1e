"""From raw documents to packed sequences: toxicity, exact dedup, near-dedup, mixing to target weights, packing.

Each stage reads what its predecessor wrote, and its verdicts are of rows: where rows share a doc_id or have none, a stage
numbers them first, in the order of their doc_ids, and gives the doc_ids back at its end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm.common import Scratch, join_checked, table
from convlake.llm.exact_dedup import exact_dedup
from convlake.llm.mixing import mix_sources
from convlake.llm.packing import pack
from convlake.llm.simhash import simhash_dedup
from convlake.llm.toxicity import THRESHOLD, fit_toxicity

#: Dropped doc_ids are broadcast up to so many (8 bytes each), else anti-joined by sort-merge.
DROPPED_ROWS = 500_000


def _by_row(stage: Callable[[SparkSession, DataFrame, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` of (spark, rows, docs, sf_dir), whose rows each have a doc_id of their own, as one of (spark, docs, sf_dir)."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch = Scratch(spark, "rows")
        odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1)
        if not odd.count():
            return stage(spark, docs, docs, sf_dir)
        given = "given_id"
        while given in docs.columns:
            given += "_"
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
        dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = scratch.save(dealt.withColumn(given, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
        out = stage(spark, numbered, docs, sf_dir)
        return out.select(*[F.col(given).alias("doc_id") if c == "doc_id" else c for c in docs.columns])

    return run


def _without(spark: SparkSession, docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    return join_checked(docs, Scratch(spark, "pipeline").save(dropped, label), ["doc_id"], "left_anti", DROPPED_ROWS)


@_by_row
def toxicity(spark: SparkSession, rows: DataFrame, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts. A null or empty text is judged by the model's value at no evidence; without labels all stay."""
    return fit_toxicity(docs, table(spark, sf_dir, "labels")).accepted(rows, THRESHOLD)


@_by_row
def exact(spark: SparkSession, rows: DataFrame, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, of those with the largest doc_id; null and empty texts are equal. An empty table stays empty."""
    return _without(spark, rows, exact_dedup(rows).where("not kept").select("doc_id"), "exact")


@_by_row
def near(spark: SparkSession, rows: DataFrame, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, of those with the smallest doc_id; texts without words are one group."""
    return _without(spark, rows, simhash_dedup(rows).where("doc_id <> component_id").select("doc_id"), "near")


@_by_row
def mixing(spark: SparkSession, rows: DataFrame, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so some not at all. A null source is a source."""
    name = "copies"
    while name in rows.columns:
        name += "_"
    copies = mix_sources(rows).select("doc_id", F.col("copies").alias(name))
    taken = rows.join(Scratch(spark, "pipeline").save(copies, "copies").hint("merge"), "doc_id")
    times = F.array_repeat(F.lit(0), F.col(name))
    return taken.withColumn(name, F.explode(times)).select(*rows.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null text is a single end mark, and texts are cut only where they exceed a sequence."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mixing), ("best-fit packing", packing)]

#: Learnt scores and seeded draws are beyond SQL; tests/llm holds exact and near dedup here against brute force, and the operators of the
#: other stages in tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
