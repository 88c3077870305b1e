"""Mixing sources to target weights by pivotal dependent rounding.

A document is to be taken target / source size times. The whole part is taken outright; the fractions are rounded
by the pivotal method: two documents of the same source and like size meet, mass moves at random from one to the
other until one of them is integral, and the other goes on to the next. What a task leaves undecided, one document
per group, meets in ever wider groups: a reduction tree over slices, then over size classes, then the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, join_checked, spread

SEED = 77
MAX_COPIES = 3
SLICE_ROWS = 2_000
FAN_IN = 32
EPS = 1e-9


def words(text: Column) -> Column:
    """How many runs of characters other than the six blanks there are."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Add weight and target to (source, source_size): weights 1, 2, 3 in code point order, null last.

    Filled like water: the sources by 3 * size / weight ascending; while the level that is left to share exceeds
    that, the source stops at 3 times its size. One row per source goes through a window, never a document.
    """
    named = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    cap = F.lit(float(MAX_COPIES)) * F.col("source_size")
    order = [cap / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = named.withColumn("_place", F.row_number().over(Window.orderBy(*order))).withColumn("_level", level).withColumn("_full", cap <= F.col("_level") * F.col("weight"))
    final = F.min_by("_level", F.when(~F.col("_full"), F.col("_place"))).over(every)  # the full ones come first
    return filled.withColumn("target", F.when(F.col("_full"), cap).otherwise(final * F.col("weight"))).drop("_level", "_full", "_place")


def _pivot(keys: int):
    """Sequential pivotal rounding down sorted rows; a change in the first ``keys`` columns ends a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, held_key = None, None, None
        out: list[dict] = []
        for batch in batches:
            names = batch.schema
            cols = batch.to_pydict()
            group = list(zip(*[cols[c] for c in names.names[:keys]], strict=True))
            rows = [dict(zip(cols, r, strict=True)) for r in zip(*cols.values(), strict=True)]
            for key, row in zip(group, rows, strict=True):
                if held is not None and key != held_key:
                    out.append(_settle(held))
                    held = None
                if held is None:
                    held, held_key = row, key
                    continue
                a, b = held["p"], row["p"]
                total, u = a + b, row["u"]
                if total < 1:
                    winner, loser, one = (held, row, False) if u * total < a else (row, held, False)
                else:
                    winner, loser, one = (held, row, True) if u * (2 - total) < 1 - b else (row, held, True)
                if one:  # the winner is taken, the other keeps what exceeds one
                    winner["bonus"], winner["p"] = 1, None
                    loser["p"] = total - 1
                    out.append(winner)
                    held = loser
                else:  # the loser is not taken, the winner gets its mass
                    loser["bonus"], loser["p"] = 0, None
                    winner["p"] = total
                    out.append(loser)
                    held = winner
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, names)
                out = []
        if held is not None:
            out.append(_settle(held))
        if out:
            yield pa.RecordBatch.from_pylist(out, names)

    return run


def _settle(row: dict) -> dict:
    """A unit that is integral but for rounding errors is decided."""
    if not EPS < row["p"] < 1 - EPS:
        row["bonus"], row["p"] = int(row["p"] >= 0.5), None
    return row


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    copies is the whole part of target / source_size, or one more, at most 3; taken = copies * size. The draws come
    from a seeded hash of doc_id, level and size, so reruns agree whatever the partitioning. Null texts have size 0; a source
    whose size is 0 has target 0 and no copies. Rows that repeat are rounded each. Empty tables give none.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = scratch.save(sources, "targets").select(F.col("source").alias("_source"), "source_size", "target")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null is a source too
    joined = join_checked(rows.withColumn("_source", key("source")), sources.withColumn("_source", key("_source")), ["_source"]).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(0.0)
    whole = F.floor(rate + EPS).cast("int")
    split = joined.withColumn("whole", whole).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    total = rows.count()
    slices, levels = 1, 0
    while slices * SLICE_ROWS < total:
        slices, levels = slices * FAN_IN, levels + 1
    size_class = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    todo = split.withColumn("bonus", F.lit(None).cast("int")).withColumn("klass", size_class).withColumn("slice", (spread(F.lit(seed), "doc_id", "size") % slices).cast("int"))
    decided, nested = [], ["source", "klass", "slice"]
    for level in range(levels + 2):
        keys = nested if level <= levels else nested[:1]
        draw = spread(F.lit(seed + 1 + level), "doc_id", "size") / F.lit(2.0**31)
        wide = todo.withColumn("u", draw).withColumn("slice", F.floor(F.col("slice") / (FAN_IN if level else 1)).cast("int"))
        wide = wide.select(*keys, *[c for c in wide.columns if c not in keys])
        met = wide.repartition(*keys).sortWithinPartitions(*keys, "size", "u", "doc_id").mapInArrow(_pivot(len(keys)), ", ".join(f"{c} {t}" for c, t in wide.dtypes))
        done = scratch.save(met, f"level{level}")
        decided.append(done.where("p is null"))
        todo = done.where("p is not null").drop("u")
    todo = todo.withColumn("bonus", (spread(F.lit(seed), F.lit("last"), "doc_id") / F.lit(2.0**31) < F.col("p")).cast("int"))
    out = todo.select("doc_id", "source", "size", "source_size", "target", "whole", "bonus")
    for d in decided:
        out = out.unionByName(d.select(*out.columns))
    copies = (F.col("whole") + F.col("bonus")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
