"""Runs of a log that close by size, one after the other (C1, C2, C7), without one task a session.

Where a run that starts at a place would close is a search on prefix sums, alike for every place. Only which places
are starts follows from those before: a session is cut into slices, each of which tells for the few starts that may
reach it where they leave it, and these few are followed from slice to slice. Sessions of one slice need no more
than their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept

#: Rows of a slice: what a task holds of a session.
SLICE = 1 << 16
NUMBERED = "session_id string, id long, weight long, alone boolean, extra double, chunk_id long, open boolean"
ROWS = ["session_id", "id", "weight", "less", "closer", "alone", "span", "extra"]
CARRIED = ["session_id", "id", "weight", "alone", "extra"]


class Rows:
    """Rows of sessions one after the other, in order: where each one's run would close if it started there.

    A run closes with the first closer at which it weighs ``target`` or more over ``least`` rows or more; before a row that stands
    alone; or, where ``before`` is set, before the row that brings it to ``target``. ``less`` is what a run's first row doesn't weigh.
    """

    def __init__(self, table: dict[str, np.ndarray], ends: np.ndarray, target: int, least: int, before: bool):
        self.weight, self.alone, self.span = table["weight"], table["alone"], table["span"]
        self.size, self.least, self.target, self.before = len(self.weight), least, target, before
        self.total = np.cumsum(self.weight)
        self.closers = np.flatnonzero(table["closer"] & ~self.alone)
        self.singles = np.flatnonzero(self.alone)
        self.free = self.total - self.weight + table["less"]  # what to take off the sum for a run that starts here
        at = np.arange(self.size)
        close, single = self.after(self.free, at, at + 1)
        held = np.where(close < ends + (not before), close, -1)  # -1: still open at the session's end
        held = np.where((single < ends) & ((held < 0) | (single < held)), single, held)
        self.next = np.where(self.alone, at + 1, held)

    def after(self, free: np.ndarray, first: np.ndarray, least_single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of runs with ``free`` to take off, whose first row is ``first`` (below 0: rows before these): where the next run starts if they
        close by size, and if they do at a row that stands alone. Past the end: they don't."""
        by_size = np.searchsorted(self.total[self.closers], free + self.target)
        at = np.maximum(by_size, np.searchsorted(self.closers, first + self.least - 1))
        far = 2 * self.size + 2
        close = np.append(self.closers, far)[at] + (0 if self.before else 1)
        single = np.append(self.singles, far)[np.searchsorted(self.singles, least_single)]
        return close, single

    def follow(self, start: int, stop: int) -> tuple[list[int], int]:
        """The starts from ``start`` on, and the last one's next: -1 where its run stays open, or ``stop``."""
        starts, nexts = [], self.next
        while 0 <= start < stop:
            starts.append(start)
            start = int(nexts[start])
        return starts, start

    def dealt(self, starts: list[int], first_id: int, before: int, size: int) -> np.ndarray:
        """The chunk of each of ``size`` rows: ``first_id`` at the first start, ``before`` ahead of it."""
        out = np.full(size, before, np.int64)
        if starts:
            ids = first_id + np.r_[0, np.cumsum(self.spans(starts))[:-1]]
            out[starts[0] :] = np.repeat(ids, np.diff(np.r_[starts, size]))
        return out

    def spans(self, starts: list[int]) -> np.ndarray:
        """How many chunk ids the run of each start takes."""
        return np.where(self.alone[starts], self.span[starts], 1)


def _arrays(table: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight", "less", "closer", "alone", "span")}


def _short(rows: DataFrame, target: int, least: int, before: bool) -> DataFrame:
    """Sessions of a slice at most, whole ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> pa.RecordBatch:
            x, names = _arrays(table), table.column("session_id").combine_chunks()
            code = names.dictionary_encode()
            code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
            all_ = Rows(x, np.repeat(cuts[1:], np.diff(cuts)), target, least, before)
            chunks, opened = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                starts, end = all_.follow(int(a), int(b))
                ids = np.r_[0, np.cumsum(all_.spans(starts))[:-1]]
                chunks[a:b] = np.repeat(ids, np.diff(np.r_[starts, b]))
                opened[starts[-1] : b] = end < 0
            own = [table.column(c).combine_chunks() for c in CARRIED]
            return pa.RecordBatch.from_arrays([*own, pa.array(chunks), pa.array(opened)], [*CARRIED, "chunk_id", "open"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("session_id")
            last, at = names[batch.num_rows - 1].as_py(), batch.num_rows
            while at and names[at - 1].as_py() == last:
                at -= 1
            if held and (at or held[-1].column("session_id")[held[-1].num_rows - 1].as_py() != last):
                yield solved(pa.Table.from_batches([*held, batch.slice(0, at)] if at else held))
                held = []
            elif at:
                yield solved(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
        if held:
            yield solved(pa.Table.from_batches(held))

    return rows.select(*ROWS).repartition("session_id").sortWithinPartitions("session_id", "id").mapInArrow(run, NUMBERED)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("id")


def _long(rows: DataFrame, target: int, least: int, before: bool) -> DataFrame:
    """Sessions of many slices: (session_id, slice) groups, and per session a row for each slice and each start that leaves it open."""
    key = ["session_id", "slice"]
    each = Window.partitionBy("session_id").orderBy("slice")
    earlier = lambda c: F.coalesce(F.sum(c).over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    def whole(table: pa.Table) -> Rows:
        n = table.num_rows
        return Rows(_arrays(table), np.full(n, n), target, least, before)

    def leave(table: pa.Table) -> pa.Table:
        """One row of the slice itself (start null), and one for each start that it leaves open."""
        table = _ordered(table)
        own = whole(table)
        starts = np.flatnonzero(own.next < 0)
        last = own.closers[-1] if len(own.closers) else None
        head = {"session_id": table.column("session_id")[0].as_py(), "slice": table.column("slice")[0].as_py(), "start": None, "weight": int(own.total[-1]), "rows": own.size, "closer": None if last is None else int(last), "closed": None if last is None else int(own.total[last]), "single": bool(len(own.singles))}
        some = [head | {"start": int(s), "weight": int(own.free[s]), "rows": int(s)} for s in starts]
        return pa.Table.from_pylist([head, *some], pa.schema([("session_id", pa.string()), ("slice", pa.int64()), ("start", pa.int64()), ("weight", pa.int64()), ("rows", pa.int64()), ("closer", pa.int64()), ("closed", pa.int64()), ("single", pa.bool_())]))

    found = kept(rows.groupBy(*key).applyInArrow(leave, "session_id string, slice long, start long, weight long, rows long, closer long, closed long, single boolean"))
    slices = kept(found.where("start is null").withColumn("w0", earlier("weight")).withColumn("n0", earlier("rows")).select(*key, "w0", "n0", (F.col("w0") + F.col("closed")).alias("top"), (F.col("n0") + F.col("closer")).alias("far"), "single"))
    # an open start's free weight and place, counted from the session's start; it closes in the first later slice that reaches both, or has a row that stands alone
    opened = found.where("start is not null").join(slices.select(*key, "w0", "n0").hint("merge"), key).select(*key, "start", (F.col("weight") + F.col("w0")).alias("free"), (F.col("start") + F.col("n0")).alias("place"))
    # sums grow along a session, so the slices that reach a need are its last ones, and the first that reaches both needs is the later of two
    by_need = lambda value: Window.partitionBy("session_id").orderBy(F.col(value), F.col("asks").desc(), "slice").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    asks = opened.select("session_id", "slice", "start", F.col("free").alias("free"), "place", (F.col("free") + target).alias("need_w"), (F.col("place") + least - 1).alias("need_n"), F.lit(1).alias("asks"))
    gives = slices.select("session_id", "slice", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("free"), F.lit(None).cast("long").alias("place"), F.col("top").alias("need_w"), F.col("far").alias("need_n"), F.lit(0).alias("asks"), "single")
    both = asks.withColumn("single", F.lit(False)).unionByName(gives)
    reach = lambda value: F.first(F.when((F.col("asks") == 0) & F.col(value).isNotNull(), F.col("slice")), ignorenulls=True).over(by_need(value))
    by_single = F.min(F.when((F.col("asks") == 0) & F.col("single"), F.col("slice"))).over(Window.partitionBy("session_id").orderBy("slice").rangeBetween(1, Window.unboundedFollowing))
    placed = both.withColumn("_w", reach("need_w")).withColumn("_n", reach("need_n")).withColumn("_s", by_single).where("asks = 1")
    by_both = F.when(F.col("_w").isNotNull() & F.col("_n").isNotNull(), F.greatest("_w", "_n"))
    asked = placed.select("session_id", F.col("slice").alias("from"), "start", "free", "place", F.least(by_both, F.col("_s")).alias("slice")).where("slice is not null")
    asked = kept(asked.join(slices.select(*key, "w0", "n0").hint("merge"), key).select(*key, "from", "start", (F.col("free") - F.col("w0")).alias("free"), (F.col("place") - F.col("n0")).alias("place")))

    def enter(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each start that closes in this slice, and for a run that starts with it: the first start here, and which start leaves it open."""
        table = _ordered(left)
        own, n = whole(table), table.num_rows
        queries = right.to_pylist()
        heads = [(None, None, 0)]
        if queries:
            free, place = (np.array([q[c] for q in queries], np.int64) for c in ("free", "place"))
            heads += [(q["from"], q["start"], int(h)) for q, h in zip(queries, np.minimum(*own.after(free, place, np.zeros(len(queries), np.int64))), strict=True)]
        known: dict[int, tuple[int, int]] = {}  # a start: the start that leaves the slice from it (n: none), and the chunk ids up to that one
        out = []
        for origin, start, head in heads:
            path, at = [], head
            while at < n and at not in known and own.next[at] >= 0:
                path.append(at)
                at = int(own.next[at])
            end = known.get(at, (min(at, n), 0))
            for s in reversed(path):
                end = (end[0], end[1] + int(own.spans([s])[0]))
                known[s] = end
            out.append({"session_id": table.column("session_id")[0].as_py(), "slice": table.column("slice")[0].as_py(), "from": origin, "start": start, "head": head, "exit": None if end[0] >= n else end[0], "spans": end[1]})
        return pa.Table.from_pylist(out, pa.schema([("session_id", pa.string()), *[(c, pa.int64()) for c in ("slice", "from", "start", "head", "exit", "spans")]]))

    ways = kept(rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(enter, "session_id string, slice long, from long, start long, head long, exit long, spans long"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice: its first start and that one's chunk, or the chunk that runs through it; and whether the session's last run is open."""
        session, now, chunk, at, seen = None, None, 0, None, False

        def row():
            return (session, at, None if not seen else head, base, base - 1 if seen else chunk)

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["session_id"] != session or session is None and at is None:
                    if at is not None:
                        out.append(row())
                    session, now, chunk, at, seen, base = r["session_id"], "fresh", 0, r["slice"], False, 0
                elif r["slice"] != at:
                    out.append(row())
                    at, seen, base = r["slice"], False, chunk
                mine = r["start"] is None if now == "fresh" else (r["from"], r["start"]) == now
                if mine and not seen:
                    seen, head, base = True, r["head"], chunk + (now != "fresh")
                    chunk, now = (base + r["spans"], "fresh") if r["exit"] is None else (base + r["spans"], (at, r["exit"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate([pa.string(), *[pa.int64()] * 4])], ["session_id", "slice", "head", "base", "before"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row(), [pa.string(), *[pa.int64()] * 4], strict=True)], ["session_id", "slice", "head", "base", "before"])

    entries = ways.repartition("session_id").sortWithinPartitions("session_id", "slice", "from").mapInArrow(walk, "session_id string, slice long, head long, base long, before long")
    tops = slices.groupBy("session_id").agg(F.max("slice").alias("_top"))
    entries = kept(entries.join(tops.hint("merge"), "session_id").withColumn("last", F.col("slice") == F.col("_top")).drop("_top"))

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _ordered(left)
        own, n, entry = whole(table), table.num_rows, right.to_pylist()[0]
        starts, end = ([], -1) if entry["head"] is None else own.follow(entry["head"], n)
        chunks = own.dealt(starts, entry["base"], entry["before"], n)
        opened = np.zeros(n, bool)
        tail = bool(entry["last"]) and (entry["head"] is None or end < 0)
        return pa.Table.from_arrays([*[table.column(c) for c in CARRIED], pa.array(chunks), pa.array(opened), pa.array(np.full(n, tail))], [*CARRIED, "chunk_id", "open", "_tail"])

    dealt = rows.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(deal, NUMBERED + ", _tail boolean")
    dealt = kept(dealt)
    last = dealt.where("_tail").groupBy("session_id").agg(F.max("chunk_id").alias("_open"))
    return dealt.join(last.hint("merge"), "session_id", "left").select(*CARRIED, "chunk_id", F.col("chunk_id").eqNullSafe(F.col("_open")).alias("open"))


def segments(rows: DataFrame, target: int, least: int, before: bool = False) -> DataFrame:
    """Each row (session_id, id, weight, alone, extra) with its run's number in the session and whether that run is still open: runs follow each
    other from a session's first row on, and the last may not close.

    Rows carry weight (long, not negative), less (what a run's first row doesn't weigh), closer (whether a run may close with it), alone
    (whether it is a run of its own, of ``span`` numbers, that ends the run before it), extra (a double that is handed on) and ``slice``, a
    long that grows with id and has no more rows than a task is to hold. Sessions of one slice are solved in one pass, others slice by slice:
    the same numbers by another plan. A session without a name is one too.
    """
    name = F.when(F.col("session_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "session_id"))
    rows = kept(rows.withColumn("session_id", name).select(*ROWS, "slice"))
    wide = rows.groupBy("session_id").agg(F.min("slice").alias("_a"), F.max("slice").alias("_b")).where("_a < _b").select("session_id")
    if wide.isEmpty():
        out = _short(rows, target, least, before)
    else:
        long = kept(wide)
        short = rows.join(long.hint("merge"), "session_id", "left_anti")
        out = _short(short, target, least, before).unionByName(_long(rows.join(long.hint("merge"), "session_id", "left_semi"), target, least, before))
    return out.withColumn("session_id", F.expr("if(session_id = '', null, substr(session_id, 2))"))
