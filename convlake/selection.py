"""What a plan shows and how it changes: layouts, unfolding, coarsening, adoption, carried frontiers (K);
demand, coverage and work (D); runs to merge and the text that a merge reads (M)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import runs
from .keep import kept
from .plans import chunks_of, closure, growth, members
from .turns import kv_cost

NODE = ["session_id", "level", "id"]
FOLDED = ["session_id", "level", "id", "growth", "parent", "last_chunk", "now", "window", "target"]


def layout(cut: DataFrame, memories: DataFrame, edges: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """What a cut (session_id, chunk_id, level, raw) renders: a chunk raw, or its memory at that level once for all
    chunks under it. A chunk without such a memory stays raw. Windows (session_id, head, tail: tokens) stand before and
    after it where they are positive."""
    at = memories.select("session_id", "level", F.col("id").alias("ancestor"), "tokens")
    above = closure(edges).join(at.hint("merge"), ["session_id", "level", "ancestor"])
    rows = cut.join(above.hint("merge"), ["session_id", "chunk_id", "level"], "left")
    shown = rows.withColumn("unit", F.when(F.col("tokens").isNull(), F.concat(F.lit("raw:"), "chunk_id")).otherwise(F.concat(F.lit("recall:"), "level", F.lit(":"), "ancestor")))
    out = shown.groupBy("session_id", "unit").agg(F.min("chunk_id").alias("first_chunk"), F.first(F.coalesce("tokens", "raw")).alias("tokens"))
    if windows is None:
        return out
    head = windows.where("head > 0").select("session_id", F.lit("head").alias("unit"), F.lit(-1).cast("long").alias("first_chunk"), F.col("head").cast("long").alias("tokens"))
    tail = windows.where("tail > 0").select("session_id", F.lit("tail").alias("unit"), F.lit(2**62).alias("first_chunk"), F.col("tail").cast("long").alias("tokens"))
    return out.unionByName(head).unionByName(tail)


def _shown_total(chunks: DataFrame, shown: DataFrame, cover: DataFrame) -> DataFrame:
    """Per session: the shown memories and the chunks that none of them covers."""
    raw = chunks.join(cover.hint("merge"), ["session_id", "chunk_id"], "left_anti").select("session_id", F.col("raw").alias("tokens"))
    return raw.unionByName(shown.select("session_id", "tokens")).groupBy("session_id").agg(F.sum("tokens").alias("before"))


def unfold_to_target(chunks: DataFrame, memories: DataFrame, shown: DataFrame, edges: DataFrame, target: float) -> DataFrame:
    """Per session: tokens before and after the newest memory gives way to what it merged, again and again, while the
    total stays within the target. A memory opens before what is under it, so one order serves all steps."""
    tops = shown.select("session_id", "level", F.col("id").alias("ancestor"))
    cover = closure(edges).join(tops.hint("merge"), ["session_id", "level", "ancestor"]).select("session_id", F.col("level").alias("_top"), "chunk_id")
    steps = chunks_of(growth(chunks, memories, edges), edges)
    steps = steps.join(cover.withColumnRenamed("chunk_id", "last_chunk").hint("merge"), ["session_id", "last_chunk"]).where("level <= _top")
    by = Window.partitionBy("session_id").orderBy(F.col("last_chunk").desc(), F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = _shown_total(chunks, shown, cover)
    rows = steps.join(totals.hint("merge"), "session_id").withColumn("_t", F.col("before") + F.sum("growth").over(by))
    done = rows.withColumn("_worst", F.max("_t").over(by)).where(F.col("_worst") <= target)
    opened = done.groupBy("session_id").agg(F.sum("growth").alias("_g"), F.count("*").alias("unfolds"))
    return totals.join(opened.hint("merge"), "session_id", "left").select("session_id", "before", (F.col("before") + F.coalesce("_g", F.lit(0))).alias("after"), F.coalesce("unfolds", F.lit(0)).alias("unfolds"))


def _prefix(rows: DataFrame, start: str, target: float) -> DataFrame:
    """Leading rows by (level, rank) that apply while the total, less what was saved so far, is over the target."""
    by = Window.partitionBy("session_id").orderBy("level", "rank")
    saved = F.coalesce(F.sum("growth").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = rows.withColumn("_left", F.col(start) - saved)
    lowest = F.min("_left").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return left.withColumn("_low", lowest).where(F.col("_low") > target).drop("_left", "_low")


def coarsen(chunks: DataFrame, memories: DataFrame, edges: DataFrame, window: float, target: float) -> DataFrame:
    """The ideal cut's folds, from chunks with ``cap`` and ``salience``: past the target within the bands, in the order
    (level, least salient and oldest leaf); if that leaves more than the window, past the bands too."""
    ranked = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy("salience", "chunk_id")))
    leaves = closure(edges).withColumnRenamed("ancestor", "id")
    groups = leaves.hint("merge").join(ranked.select("session_id", "chunk_id", "cap", "_r"), ["session_id", "chunk_id"]).groupBy(*NODE).agg(F.min("cap").alias("_cap"), F.min("_r").alias("rank"))
    totals = chunks.groupBy("session_id").agg(F.sum("raw").alias("before"))
    rows = growth(chunks, memories, edges).select(*NODE, "growth").join(groups.hint("merge"), NODE).join(totals.hint("merge"), "session_id")
    first = _prefix(rows.where("_cap >= level"), "before", target).select(*NODE, "growth", F.lit("within").alias("phase"))
    left = totals.join(first.groupBy("session_id").agg(F.sum("growth").alias("_g")).hint("merge"), "session_id", "left").select("session_id", (F.col("before") - F.coalesce("_g", F.lit(0))).alias("_now"))
    past = rows.join(first.select(*NODE).hint("merge"), NODE, "left_anti").join(left.where(F.col("_now") > window).hint("merge"), "session_id")
    second = _prefix(past, "_now", target).select(*NODE, "growth", F.lit("past").alias("phase"))
    return first.unionByName(second).withColumnRenamed("growth", "saving")


def opened(folded: DataFrame) -> DataFrame:
    """Folded memories (FOLDED; ``parent`` is the folded memory that holds one, ``now`` the session's total) that open again: while the total is under
    the target, from the top level down and newest first, each shown one that brings it nearer to the target within the window. Sessions are
    streamed; the state is the total and what opened a level up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, level, total, above, mine = None, None, 0.0, set(), set()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["session_id"] != session:
                    session, level, total, above, mine = r["session_id"], r["level"], r["now"], set(), set()
                if r["level"] != level:
                    above, mine = mine if r["level"] == level - 1 else set(), set()
                    level = r["level"]
                shown = r["parent"] is None or r["parent"] in above
                after = total + r["growth"]
                if shown and total < r["target"] and after <= r["window"] and abs(after - r["target"]) < abs(total - r["target"]):
                    total = after
                    mine.add(r["id"])
                    out.append((session, level, r["id"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], NODE)

    dealt = folded.repartition("session_id").sortWithinPartitions("session_id", F.col("level").desc(), F.col("last_chunk").desc())
    return dealt.mapInArrow(run, "session_id string, level int, id long")


def refine(shown: DataFrame, chunks: DataFrame, memories: DataFrame, edges: DataFrame, window: float, target: float) -> DataFrame:
    """The memories that open after coarsening, of a cut's shown memories (session_id, level, id): while the total is under the
    target, from the top level down and newest first, each that brings it nearer to the target within the window. What opened gives
    what it merged to the next level.
    """
    tops = kept(shown.select(*NODE))
    cover = closure(edges).join(tops.withColumnRenamed("id", "ancestor").hint("merge"), ["session_id", "level", "ancestor"]).select("session_id", F.col("level").alias("_top"), "chunk_id")
    cover = kept(cover)
    totals = _shown_total(chunks, memories.join(tops.hint("merge"), NODE, "left_semi"), cover)
    steps = chunks_of(growth(chunks, memories, edges), edges).join(cover.withColumnRenamed("chunk_id", "last_chunk").hint("merge"), ["session_id", "last_chunk"]).where("level <= _top")
    parents = members(edges).select("session_id", F.col("member_level").alias("level"), F.col("member").alias("id"), F.col("id").alias("_up"))
    held = steps.join(parents.hint("merge"), NODE, "left").withColumn("parent", F.when(F.col("level") < F.col("_top"), F.col("_up")))
    rows = held.join(totals.withColumnRenamed("before", "now").hint("merge"), "session_id").withColumn("window", F.lit(float(window))).withColumn("target", F.lit(float(target)))
    return opened(rows.select(*FOLDED))


def project(cut: DataFrame, edges: DataFrame) -> DataFrame:
    """The valid cut below ``cut`` (session_id, chunk_id, level): leaves come down by one, deepest first, while the chunks under
    their memory at that level don't all stand there; again and again until nothing changes.

    A pass is a window a level over the sessions' rows, which one shuffle deals out; there are about as many passes as levels.
    """
    level_up = closure(edges).groupBy("session_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "ancestor"))).alias("_up"))  # an entry a level
    rows = cut.select("session_id", "chunk_id", F.col("level").cast("int").alias("level")).join(level_up.hint("merge"), ["session_id", "chunk_id"], "left")
    now = kept(rows.repartition("session_id"))
    while True:
        top = now.agg(F.max("level")).first()[0] or 0
        after = now.withColumn("_was", F.col("level"))
        for level in range(top, 0, -1):
            after = after.withColumn("_at", F.try_element_at("_up", F.lit(level)))
            apart = F.count_if(F.col("level") != level).over(Window.partitionBy("session_id", "_at"))
            after = after.withColumn("_n", apart).withColumn("level", F.when((F.col("_was") == level) & (F.col("_at").isNull() | (F.col("_n") > 0)), level - 1).otherwise(F.col("level")))
        after = kept(after.select("session_id", "chunk_id", "level", "_up", (F.col("level") != F.col("_was")).alias("_moved")))
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now.select("session_id", "chunk_id", "level")


def suffix_adopt(carried: DataFrame, ideal: DataFrame, chunks: DataFrame, memories: DataFrame, edges: DataFrame, reach: float | DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """The cut (session_id, chunk_id, level) that takes the ideal's changes from a boundary on, projected: per session the oldest
    boundary whose switch re-reads at most ``reach`` tokens (one for all, or session_id, reach), by a binary search over the changed chunks
    that all sessions make at once. Windows are rendered too.

    ``carried`` must be valid. A session without an affordable boundary keeps it.
    """
    raw = chunks.select("session_id", "chunk_id", "raw")
    both = carried.withColumnRenamed("level", "_c").join(ideal.withColumnRenamed("level", "_i").hint("merge"), ["session_id", "chunk_id"]).join(raw.hint("merge"), ["session_id", "chunk_id"])
    changed = F.when(F.col("_c") != F.col("_i"), F.row_number().over(Window.partitionBy("session_id", F.col("_c") != F.col("_i")).orderBy("chunk_id")) - 1)
    both = kept(both.withColumn("_k", changed))
    search = kept(both.groupBy("session_id").agg(F.lit(0).cast("long").alias("low"), F.count("_k").alias("high")))
    reaches = search.select("session_id", F.lit(reach).alias("reach")) if not isinstance(reach, DataFrame) else reach
    place = lambda cut: layout(cut, memories, edges, windows).withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("first_chunk")))
    before = kept(place(both.select("session_id", "chunk_id", F.col("_c").alias("level"), "raw")))

    def cut_at(boundary: DataFrame) -> DataFrame:
        """The projected cut of each session's boundary (session_id, at): the at-th change and what is newer are the ideal's."""
        edge = both.join(boundary.hint("merge"), "session_id")
        from_ = F.min(F.when(F.col("_k") == F.col("at"), F.col("chunk_id"))).over(Window.partitionBy("session_id"))
        return project(edge.withColumn("_f", from_).select("session_id", "chunk_id", F.when(F.col("chunk_id") >= F.col("_f"), F.col("_i")).otherwise(F.col("_c")).alias("level")), edges)

    while not (going := search.where("low < high")).isEmpty():
        mid = going.select("session_id", F.floor((F.col("low") + F.col("high")) / 2).cast("long").alias("at"))
        cost = kv_cost(before, place(cut_at(mid).join(raw.hint("merge"), ["session_id", "chunk_id"]))).select("session_id", F.col("cost").alias("_cost"))
        met = search.join(mid.join(cost.hint("merge"), "session_id").hint("merge"), "session_id", "left").join(reaches.hint("merge"), "session_id", "left")
        fits = F.col("_cost") <= F.col("reach")
        search = kept(met.select("session_id", F.when(F.col("at").isNull() | fits, F.col("low")).otherwise(F.col("at") + 1).alias("low"), F.when(fits, F.col("at")).otherwise(F.col("high")).alias("high")))
    return cut_at(search.select("session_id", F.col("low").alias("at")))


def adopt(stats: DataFrame, window: float | F.Column, target: float | F.Column, reach: float | F.Column, gap: float) -> DataFrame:
    """Which step applies, of (session_id, now, now_loss, ideal, ideal_loss, cost, part, part_loss): hold the carried cut,
    switch to the ideal if that re-reads at most ``reach``, take its newest changes, or the ideal at its full cost."""
    near = lambda loss: F.col(loss) - F.col("ideal_loss") <= gap * F.greatest(F.lit(1.0), F.col("ideal_loss"))
    held = F.col("now").between(target, window) & near("now_loss")
    part = (F.col("part") <= window) & near("part_loss")
    branch = F.when(held, "hold").when(F.col("cost") <= reach, "ideal").when(part, "suffix").when(F.col("part") > window, "infeasible").otherwise("quality-gap")
    rows = stats.withColumn("branch", branch)
    return rows.select("session_id", "branch", F.when(held, F.col("now")).when(F.col("branch") == "suffix", F.col("part")).otherwise(F.col("ideal")).alias("tokens"))


def adopted_cut(branches: DataFrame, carried: DataFrame, ideal: DataFrame, part: DataFrame) -> DataFrame:
    """The cut (session_id, chunk_id, level) that each session's branch takes: the carried one on hold, its newest changes on
    suffix, else the ideal."""
    named = [carried.withColumn("_b", F.lit("hold")), part.withColumn("_b", F.lit("suffix")), ideal.withColumn("_b", F.lit("ideal"))]
    taken = branches.select("session_id", F.when(F.col("branch").isin("hold", "suffix"), F.col("branch")).otherwise("ideal").alias("_b"))
    return named[0].unionByName(named[1]).unionByName(named[2]).join(taken.hint("merge"), ["session_id", "_b"], "left_semi").drop("_b")


def carry_frontier(compiles: DataFrame, chunks: DataFrame) -> DataFrame:
    """The newest compile's nodes (session_id, compile_id, level, id, last_chunk), and chunks closed since as raw nodes."""
    newest = F.max("compile_id").over(Window.partitionBy("session_id"))
    kept = compiles.withColumn("_n", newest).where("compile_id = _n").select(*NODE, "last_chunk")
    cover = kept.groupBy("session_id").agg(F.max("last_chunk").alias("_c"))
    fresh = chunks.join(cover.hint("merge"), "session_id", "left").where(F.col("_c").isNull() | (F.col("chunk_id") > F.col("_c")))
    return kept.select(*NODE).unionByName(fresh.select("session_id", F.lit(0).alias("level"), F.col("chunk_id").alias("id")))


def fold_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Between two frontiers (session_id, level, id, last_chunk, tokens): nodes replaced, nodes shown in their place, and
    tokens saved, as far as the earlier one reaches."""
    reach = before.groupBy("session_id").agg(F.max("last_chunk").alias("_reach"))
    gone = before.join(after.hint("merge"), NODE, "left_anti").select("session_id", F.lit(1).alias("_gone"), "tokens")
    new = after.join(before.hint("merge"), NODE, "left_anti").join(reach.hint("merge"), "session_id").where("last_chunk <= _reach").select("session_id", F.lit(0).alias("_gone"), (-F.col("tokens")).alias("tokens"))
    changed = gone.unionByName(new).groupBy("session_id")
    return changed.agg(F.sum("_gone").alias("replaced"), F.sum(1 - F.col("_gone")).alias("shown"), F.sum("tokens").alias("saved"))


def fold_diffs(frontiers: DataFrame) -> DataFrame:
    """How each compile of frontiers (session_id, compile_id, level, id, last_chunk, tokens) folds what the one before it showed."""
    each = frontiers.select("session_id", "compile_id").distinct()
    after = each.withColumn("_next", F.lead("compile_id").over(Window.partitionBy("session_id").orderBy("compile_id")))
    key = lambda df, c: df.withColumn("session_id", F.concat_ws("\x1f", "session_id", c))
    moved = frontiers.join(after.where("_next is not null").hint("merge"), ["session_id", "compile_id"])
    found = fold_diff(key(moved, "_next"), key(frontiers.join(after.where("_next is not null").select("session_id", F.col("_next").alias("compile_id")).hint("merge"), ["session_id", "compile_id"]), "compile_id"))
    part = F.split("session_id", "\x1f")
    return found.select(part[0].alias("session_id"), part[1].cast("long").alias("compile_id"), "replaced", "shown", "saved")


def held_in_band(before: DataFrame, after: DataFrame, totals: DataFrame, window: float, low: float) -> DataFrame:
    """Per session (session_id, total: of the carried frontier): whether a total inside the band left the frontier as it was."""
    changed = before.select(*NODE).join(after.select(*NODE).hint("merge"), NODE, "left_anti").unionByName(after.select(*NODE).join(before.select(*NODE).hint("merge"), NODE, "left_anti")).select("session_id", F.lit(True).alias("_c")).distinct()
    inside = F.col("total").between(window * low, window)
    return totals.join(changed.hint("merge"), "session_id", "left").select("session_id", inside.alias("inside"), (~inside | F.col("_c").isNull()).alias("kept"))


def merge_first_run(candidates: DataFrame, taken: DataFrame, k: int, widest: int | None = None) -> DataFrame:
    """The stricter rule of merges: a level has a merge due only with ``k`` unmerged memories (session_id, level, id, first, last) that
    aren't too wide for it, and only its first run that has k of them, or two with a newer run after it."""
    each = Window.partitionBy("session_id", "level")
    free = candidates.join(taken.hint("merge"), NODE, "left_anti").withColumn("_all", F.count("*").over(each))
    if widest is not None:
        free = free.where(F.col("last") - F.col("first") <= widest * F.pow(F.lit(float(k)), F.greatest(F.lit(0), F.col("level") - 3)))
    by = each.orderBy("first", "last")
    broken = F.coalesce((F.col("first") != F.lag("last").over(by) + 1).cast("int"), F.lit(1))
    numbered = free.where(F.col("_all") >= k).withColumn("_b", broken).withColumn("run", F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("session_id", "level", "run")
    sized = numbered.withColumn("_n", F.count("*").over(run)).withColumn("_k", F.row_number().over(run.orderBy("first", "last"))).withColumn("_newest", F.max("run").over(each))
    due = (F.col("_n") >= k) | (F.col("_n") >= 2) & (F.col("run") < F.col("_newest"))
    chosen = sized.withColumn("_first", F.min(F.when(due, F.col("run"))).over(each))
    return chosen.where((F.col("run") == F.col("_first")) & (F.col("_k") <= k)).select(*NODE, F.min("first").over(run).alias("first"), "run")


def frontier_guarantees(shown: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per session: whether shown nodes (level, first_chunk, last_chunk) tile its chunks, and levels fall to the present."""
    by = Window.partitionBy("session_id").orderBy("first_chunk")
    rows = shown.withColumn("_gap", F.col("first_chunk") != F.coalesce(F.lag("last_chunk").over(by), F.lit(-1)) + 1).withColumn("_rise", F.col("level") > F.lag("level").over(by))
    found = rows.groupBy("session_id").agg(F.count_if("_gap").alias("_g"), F.count_if("_rise").alias("_r"), F.max("last_chunk").alias("_l"))
    ends = chunks.groupBy("session_id").agg(F.max("chunk_id").alias("_e"))
    whole = (F.coalesce("_g", F.lit(1)) == 0) & F.col("_l").eqNullSafe(F.col("_e"))
    return ends.join(found.hint("merge"), "session_id", "left").select("session_id", whole.alias("whole"), (F.coalesce("_r", F.lit(0)) == 0).alias("falling"))


def stop_rules(carried: DataFrame, shown: DataFrame, chunks: DataFrame, memories: DataFrame, edges: DataFrame, window: float, slack: float, low: float) -> DataFrame:
    """Per session, whether a plan stopped too early, of the nodes that it shows (session_id, level, id; level 0: a chunk) and the carried frontier's total
    (session_id, total): after folding (carried over the window) above window * (1 - slack) with a group left to fold, or after folding, or from below
    window * low, with room within that target for the newest memory to open."""
    target = window * (1 - slack)
    cost = chunks.select("session_id", F.lit(0).alias("level"), F.col("chunk_id").alias("id"), F.col("raw").alias("tokens")).unionByName(memories.select(*NODE, "tokens"))
    now = shown.select(*NODE).join(cost.hint("merge"), NODE).groupBy("session_id").agg(F.sum("tokens").alias("_now"))
    named = edges if "member_level" in edges.columns else edges.withColumn("member_level", F.col("level") - 1)
    there = shown.select("session_id", F.col("level").alias("member_level"), F.col("id").alias("member"), F.lit(1).alias("_s"))
    groups = named.join(there.hint("merge"), ["session_id", "member_level", "member"], "left").groupBy(*NODE).agg((F.count("*") == F.count("_s")).alias("_whole"))
    left = groups.where("_whole").select("session_id").distinct().withColumn("_left", F.lit(True))
    newest = chunks_of(growth(chunks, memories, edges), edges).join(shown.select(*NODE).hint("merge"), NODE, "left_semi").groupBy("session_id").agg(F.max_by("growth", F.struct("last_chunk", "level")).alias("_g"))
    rows = carried.join(now.hint("merge"), "session_id").join(left.hint("merge"), "session_id", "left").join(newest.hint("merge"), "session_id", "left")
    folded = F.col("total") > window
    folding = folded & (F.col("_now") > target) & F.coalesce("_left", F.lit(False))
    opening = (folded | (F.col("total") < window * low)) & F.coalesce(F.col("_now") + F.col("_g") <= target, F.lit(False))
    return rows.select("session_id", folding.alias("stopped_folding"), opening.alias("stopped_unfolding"))


def demand_runs(chunks: DataFrame, memories: DataFrame, zone: DataFrame, escalated: DataFrame) -> DataFrame:
    """Of escalated sessions: the runs of chunks that no L1 stands for and no raw zone holds."""
    have = memories.where("level = 1").select("session_id", F.col("id").alias("chunk_id"))
    free = chunks.join(escalated.hint("merge"), "session_id", "left_semi").join(have.hint("merge"), ["session_id", "chunk_id"], "left_anti").join(zone.hint("merge"), ["session_id", "chunk_id"], "left_anti")
    return runs(free.select("session_id", F.col("chunk_id").alias("id"))).select("session_id", "first", "last")


def covered_by_l1(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """The memory that stands for each chunk (first, last, ordinal), of owned spans (memory, first, last, ordinal), and
    whether one has just its boundaries. Spans meet on a shared message; equal ranges are shards, told by ordinal."""
    mine = spans.select("session_id", "chunk_id", "first", "last", "ordinal", F.explode(F.sequence("first", "last")).alias("_at"))
    theirs = owned.select("session_id", "memory", F.col("first").alias("_a"), F.col("last").alias("_b"), F.col("ordinal").alias("_o"), F.explode(F.sequence("first", "last")).alias("_at"))
    same = (F.col("first") == F.col("_a")) & (F.col("last") == F.col("_b"))
    met = mine.hint("merge").join(theirs, ["session_id", "_at"]).where(~same | (F.col("ordinal") == F.col("_o")))
    return met.groupBy("session_id", "chunk_id").agg(F.min("memory").alias("memory"), F.bool_or(same).alias("exact"))


def overlap_blocked(covered: DataFrame) -> DataFrame:
    return covered.where("not exact").drop("exact")


def merge_by_run(candidates: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """Members of merges due, of memories (session_id, level, id, first, last) less ``taken``: a contiguous run of at least
    ``k`` gives its first k; a shorter one of two or more goes whole once its level reaches beyond it."""
    each = Window.partitionBy("session_id", "level")
    by = each.orderBy("first", "last")
    free = candidates.withColumn("_live", F.max("last").over(each)).join(taken.hint("merge"), NODE, "left_anti")
    broken = F.coalesce((F.col("first") > F.lag("last").over(by) + 1).cast("int"), F.lit(1))
    numbered = free.withColumn("_b", broken).withColumn("_run", F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("session_id", "level", "_run")
    sized = numbered.withColumn("_n", F.count("*").over(run)).withColumn("_end", F.max("last").over(run)).withColumn("_k", F.row_number().over(run.orderBy("first", "last")))
    due = ((F.col("_n") >= k) & (F.col("_k") <= k)) | ((F.col("_n") < k) & (F.col("_n") >= 2) & (F.col("_end") < F.col("_live")))
    return sized.where(due).select(*NODE, F.min("first").over(run).alias("first"), F.col("_run").alias("run"))


def work(l1s: DataFrame, merges: DataFrame, zone: DataFrame, covered: DataFrame, done: DataFrame, stalled: DataFrame) -> DataFrame:
    """Work in the order (level, first), children before parents: an L1 for each due chunk outside the raw zone that no
    memory covers, then merges (of merge_by_run) by level; less targets done or stalled."""
    chunk = ["session_id", "chunk_id"]
    one = l1s.join(zone.hint("merge"), chunk, "left_anti").join(covered.hint("merge"), chunk, "left_anti").select("session_id", F.lit(1).alias("level"), "first", F.concat(F.lit("L1:"), "chunk_id").alias("target"))
    ids = F.array_join(F.array_sort(F.collect_list("id")), "+")  # at most k
    up = merges.groupBy("session_id", (F.col("level") + 1).alias("level"), "run").agg(F.min("first").alias("first"), ids.alias("_ids"))
    up = up.select("session_id", "level", "first", F.concat(F.lit("L"), "level", F.lit(":"), "_ids").alias("target"))
    return one.unionByName(up).join(done.hint("merge"), ["session_id", "target"], "left_anti").join(stalled.hint("merge"), ["session_id", "target"], "left_anti")


def reading_stretch(leaves: DataFrame, chunks: DataFrame, multiple: int) -> DataFrame:
    """Works whose leaves (session_id, work, group, tokens) are all shards of one group, with the whole group's size, if
    that is at least ``multiple`` times theirs."""
    one = leaves.groupBy("session_id", "work").agg(F.count_distinct("group").alias("_g"), F.count("group").alias("_n"), F.count("*").alias("_all"), F.max("group").alias("group"), F.sum("tokens").alias("portion"))
    whole = chunks.where("group is not null").groupBy("session_id", "group").agg(F.sum("tokens").alias("whole"))
    return one.where("_g = 1 and _n = _all").join(whole.hint("merge"), ["session_id", "group"]).where(F.col("whole") >= multiple * F.col("portion")).select("session_id", "work", "group", "portion", "whole")


def merge_source_text(texts: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """The text that each merged memory was made from, one level deeper than what it merged: chunks (session_id, chunk_id,
    text) for level 2, recalls of its members' members above."""
    named = edges if "member_level" in edges.columns else edges.withColumn("member_level", F.col("level") - 1)
    under = named.select("session_id", F.col("level").alias("_l"), F.col("id").alias("member"), F.col("member_level").alias("_d"), F.col("member").alias("_i"))
    deep = members(edges).withColumnRenamed("member_level", "_l").hint("merge").join(under, ["session_id", "_l", "member"]).select(*NODE, F.col("_d").alias("_l"), "_i")
    nodes = texts.select("session_id", F.lit(0).alias("_l"), F.col("chunk_id").alias("_i"), F.col("chunk_id").alias("_o"), "text").unionByName(memories.select("session_id", F.col("level").alias("_l"), F.col("id").alias("_i"), F.col("first").alias("_o"), "text"))
    parts = F.array_sort(F.collect_list(F.struct("_o", "text")))  # a memory's members' members
    return deep.hint("merge").join(nodes, ["session_id", "_l", "_i"]).groupBy(*NODE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def live_quarantine(quarantined: DataFrame, edges: DataFrame) -> DataFrame:
    """Quarantined runs (session_id, run, level, id, a row for each member) less those with a member merged elsewhere."""
    merged = members(edges).select("session_id", F.col("member_level").alias("level"), F.col("member").alias("id"))
    stale = quarantined.join(merged.hint("merge"), NODE, "left_semi").select("session_id", "run").distinct()
    return quarantined.join(stale.hint("merge"), ["session_id", "run"], "left_anti")
