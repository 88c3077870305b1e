"""What of a session's items fits a budget, newest first, one that doesn't fit being skipped (W5, T8, T11), without one task a session.

While what is left keeps its highest bit, every size below that bit fits, and a size with that bit fits once at most, for
then the bit is gone. So a slice of a session tells by a sum and a least need for each bit whether the bit goes in it; a sum
over the slices finds the first where it does, and that slice alone is looked into. There are as many rounds as the budget has bits at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept

#: Items of a session that are streamed, and ids of the ranges that slices of longer ones are made of.
SLICE = 1 << 16
#: Slices that are looked into by a broadcast of their keys (some 10 MB); more meet their rows by a merge join.
LOOKED_INTO = 100_000


def fitting(sizes: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Which of ``sizes`` fit into ``left``, one after the other, and what is left then. Has as many steps as ``left`` has bits."""
    fits, at = sizes == 0, 0
    while left and at < len(sizes):
        rest, top = sizes[at:], 1 << (left.bit_length() - 1)
        small = rest < top
        used = np.cumsum(np.where(small, rest, 0))
        gone = (left - used < top) | (~small & (rest <= left - used))
        stop = int(np.argmax(gone)) if gone.any() else len(rest) - 1
        fits[at : at + stop + 1] = small[: stop + 1]
        fits[at + stop] |= gone[stop]
        left -= int(used[stop]) + (int(rest[stop]) if gone[stop] and not small[stop] else 0)
        at += stop + 1
    return fits, left


def _short(rows: DataFrame, count: int, size: int, within: tuple[str, ...]) -> DataFrame:
    """Sessions of one slice are streamed in order; the state is what was kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, used = None, 0, 0
        for batch in batches:
            fits = []
            for session, more in zip(batch.column("_s").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if session != at:
                    at, n, used = session, 0, 0
                fits.append((not count or n < count) and (not size or used + more <= size))
                if fits[-1]:
                    n, used = n + 1, used + more
            yield batch.filter(pa.array(fits, pa.bool_()))

    ordered = rows.repartition("_s").sortWithinPartitions("_s", F.col("id").desc(), *within, "bytes")
    return ordered.mapInArrow(run, ordered.schema).select("session_id", "id", *within)


def _entries(rows: DataFrame, size: int) -> DataFrame:
    """What is left where each slice (_g) begins."""
    bits = size.bit_length()

    def told(table: pa.Table) -> pa.Table:
        """By bit: what the sizes below it take, and what has to be left for the first size with it that fits."""
        sizes = table.sort_by("_p").column("bytes").to_numpy()
        used, least = [], []
        for k in range(bits):
            small, top = sizes < 1 << k, sizes < 2 << k
            taken = np.cumsum(np.where(small, sizes, 0))
            need = (sizes + taken)[top & ~small]
            used.append(min(int(taken[-1]), size + 1))
            least.append(int(need.min()) if len(need) else None)
        one = {c: table.column(c)[0].as_py() for c in ("_g", "_s", "slice")} | {"used": used, "least": least}
        return pa.Table.from_pylist([one], pa.schema([("_g", pa.string()), ("_s", pa.string()), ("slice", pa.int64()), ("used", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))]))

    def looked(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        _, left = fitting(table.column("bytes").to_numpy(), table.column("here")[0].as_py())
        return pa.table({"_s": table.column("_s").slice(0, 1), "first": pa.array([table.column("slice")[0].as_py() + 1], pa.int64()), "left": pa.array([left], pa.int64())})

    facts = kept(rows.groupBy("_g").applyInArrow(told, "_g string, _s string, slice long, used array<bigint>, least array<bigint>"))
    at = facts.groupBy("_s").agg(F.min("slice").alias("first"), F.lit(size).cast("long").alias("left"))
    each = Window.partitionBy("_s").orderBy("slice")
    bit = F.when(F.col("left") > 0, F.length(F.bin("left"))).otherwise(0) - 1  # below 0: nothing is left, so nothing more can go
    solved = []
    while True:
        ahead = facts.join(at.hint("merge"), "_s").where("slice >= first").withColumns({"bit": bit, "taken": F.coalesce(F.get("used", bit), F.lit(0))})
        ahead = ahead.withColumn("here", F.col("left") - F.coalesce(F.sum("taken").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        goes = (F.col("bit") >= 0) & ((F.col("here") - F.col("taken") < F.expr("shiftleft(1L, greatest(bit, 0))")) | F.coalesce(F.get("least", F.col("bit")) <= F.col("here"), F.lit(False)))
        ahead = ahead.withColumn("stop", F.min(F.when(goes, F.col("slice"))).over(Window.partitionBy("_s")))
        done = kept(ahead.where("stop is null or slice <= stop").select("_g", "here", F.col("slice").eqNullSafe(F.col("stop")).alias("look")))
        solved.append(done.select("_g", "here"))
        inside = done.where("look").select("_g", "here")
        n = inside.count()
        if not n:
            break
        met = rows.select("_g", "_s", "slice", "_p", "bytes").join(inside.hint("broadcast" if n <= LOOKED_INTO else "merge"), "_g")
        at = kept(met.groupBy("_g").applyInArrow(looked, "_s string, first long, left long"))
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out


def _long(rows: DataFrame, count: int, size: int, within: tuple[str, ...]) -> DataFrame:
    """Sessions of many slices (_g), each solved by itself once it is known what is left where it begins."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        fits, _ = fitting(table.column("bytes").to_numpy(), table.column("here")[0].as_py())
        met = table.filter(pa.array(fits)).select(out)
        return met.append_column("_n", pa.array(np.arange(1, met.num_rows + 1)))

    rows = kept(rows.withColumn("_p", F.row_number().over(Window.partitionBy("_g").orderBy(F.col("id").desc(), *within, "bytes"))))
    out = ["_g", "_s", "slice", "session_id", "id", *within]
    fits = rows.withColumn("_n", F.col("_p").cast("long")).select(*out, "_n")
    if size:
        fits = rows.join(_entries(rows, size).hint("merge"), "_g").groupBy("_g").applyInArrow(run, fits.schema)
    if count:
        fits = kept(fits)
        each = Window.partitionBy("_s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = fits.groupBy("_g", "_s", "slice").agg(F.count("*").alias("n")).select("_g", F.coalesce(F.sum("n").over(each), F.lit(0)).alias("_b"))
        fits = fits.join(sums.hint("merge"), "_g").where(F.col("_b") + F.col("_n") <= count)
    return fits.select("session_id", "id", *within)


def admit(items: DataFrame, count: int, size: int, within: tuple[str, ...] = (), rows: int = SLICE) -> DataFrame:
    """Per session, newest id first and by ``within`` in it: items (id, bytes) that fit ``count`` and ``size`` (0: no limit). One that
    doesn't fit is skipped and the next is tried.

    Sessions of at most ``rows`` items are streamed, however far apart their ids are; longer ones are solved slice by slice: the same items by
    another plan. Of items with equal id and ``within`` the smaller goes first. Bytes that are null or below zero count as none; a session without
    a name is one too, and an item without an id is its oldest.
    """
    size_of = F.greatest(F.coalesce(F.col("bytes").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("bytes")
    name = F.coalesce(F.concat(F.lit("="), F.col("session_id").cast("string")), F.lit(""))
    ids = F.coalesce(-F.expr(f"id div {rows}"), F.lit(2**62)).cast("long")
    cut = kept(items.select("session_id", size_of, "id", *within, name.alias("_s"), ids.alias("_r")))
    held = cut.groupBy("_s").agg(F.count("*").alias("_n"), F.min("_r").alias("_a"), F.max("_r").alias("_b"))
    wide = held.where((F.col("_n") > rows) & (F.col("_a") < F.col("_b"))).select("_s")
    if wide.isEmpty():
        return _short(cut, count, size, within)
    wide = kept(wide)
    short, long = (cut.join(wide.hint("merge"), "_s", how) for how in ("left_anti", "left_semi"))
    return _short(short, count, size, within).unionByName(_long(_sliced(long, rows), count, size, within))


def _sliced(long: DataFrame, rows: int) -> DataFrame:
    """Rows with their slice: ranges of ids (_r) that follow each other, together while they begin within the same ``rows`` items of their session,
    so that far apart ids make no more slices than close ones."""
    each = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = long.groupBy("_s", "_r").agg(F.count("*").alias("_n"))
    slices = ranges.select("_s", "_r", F.floor(F.coalesce(F.sum("_n").over(each), F.lit(0)) / rows).cast("long").alias("slice"))
    met = long.join(slices.hint("merge"), ["_s", "_r"])
    return met.withColumn("_g", F.concat(F.col("slice").cast("string"), F.col("_s")))
