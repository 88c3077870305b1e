"""One plan for all sessions at once: the ideal cut under a budget, and the step that leads to it from the carried one (K7 to K11).

A plan is a set of folded memories, closed downwards: a memory is shown if it is folded and what holds it isn't. Folding
or opening one changes a session's total by a fixed amount, whatever else was done, so each phase is a running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept
from .plans import closure, growth, members
from .selection import FOLDED, NODE, adopt, layout, opened, project, suffix_adopt
from .turns import kv_cost, misallocation

#: Rounds of the ideal cut, at most.
ROUNDS = 3


def _prefix(rows: DataFrame, start: str) -> DataFrame:
    """Leading rows by (level, rank) that fold while the total, less what was saved so far, has never been at the target or below."""
    by = Window.partitionBy("session_id").orderBy("level", "rank")
    saved = F.coalesce(F.sum("growth").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = F.min("_left").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_left", F.col(start) - saved).withColumn("_low", lowest).where(F.col("_low") > F.col("target")).select(*NODE, "growth")


def ideal_cut(chunks: DataFrame, memories: DataFrame, edges: DataFrame, budgets: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """The ideal cut (session_id, chunk_id, level), of chunks (raw, cap, salience) under budgets (session_id, window, target).

    In rounds, three at most: past the target fold within the bands, in the order (level, least salient and oldest leaf); still past the window,
    beyond the bands; under the target, open what nears it. Totals count head and tail (windows), also where they are negative; a round is the
    last if what is rendered, without negative ones, fits or no longer shrinks. Edges lead one level down.
    """
    leaves = closure(edges).withColumnRenamed("ancestor", "id")
    ranked = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy("salience", "chunk_id")))
    own = leaves.hint("merge").join(ranked.select("session_id", "chunk_id", "cap", "_r"), ["session_id", "chunk_id"]).groupBy(*NODE).agg(F.min("cap").alias("cap"), F.min("_r").alias("rank"), F.max("chunk_id").alias("last_chunk"))
    parents = members(edges).select("session_id", F.col("member_level").alias("level"), F.col("member").alias("id"), F.col("id").alias("parent"))
    groups = growth(chunks, memories, edges).select(*NODE, F.col("growth").cast("double").alias("growth")).join(own.hint("merge"), NODE).join(parents.hint("merge"), NODE, "left")
    groups = kept(groups.repartition("session_id"))
    sides = chunks.select("session_id").distinct().withColumn("head", F.lit(0)).withColumn("tail", F.lit(0)) if windows is None else windows
    raw = chunks.groupBy("session_id").agg(F.sum("raw").alias("_raw"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both, seen = zero(F.col("head")) + zero(F.col("tail")), F.greatest(F.lit(0), zero(F.col("head"))) + F.greatest(F.lit(0), zero(F.col("tail")))
    totals = raw.join(sides.hint("merge"), "session_id", "left").join(budgets.select("session_id", "window", "target").hint("merge"), "session_id")
    totals = kept(totals.select("session_id", (F.col("_raw") + both).cast("double").alias("all"), (F.col("_raw") + seen).cast("double").alias("seen"), F.col("window").cast("double").alias("window"), F.col("target").cast("double").alias("target")))
    saved = lambda some: some.groupBy("session_id").agg(F.sum("growth").alias("_s"))
    folded = kept(groups.select(*NODE, "growth").limit(0))
    active = totals.select("session_id", F.lit(None).cast("double").alias("rendered"))
    for _ in range(ROUNDS):
        here = totals.join(active.select("session_id").hint("merge"), "session_id", "left_semi").join(saved(folded).hint("merge"), "session_id", "left").withColumn("now", F.col("all") - F.coalesce("_s", F.lit(0.0))).drop("_s")
        here = kept(here)
        rest = groups.join(folded.select(*NODE).hint("merge"), NODE, "left_anti").join(here.select("session_id", "now", "window", "target").hint("merge"), "session_id")
        first = kept(_prefix(rest.where("cap >= level"), "now"))
        left = here.join(saved(first).hint("merge"), "session_id", "left").withColumn("now", F.col("now") - F.coalesce("_s", F.lit(0.0))).where("now > window")
        past = rest.drop("now", "window", "target").join(first.select(*NODE).hint("merge"), NODE, "left_anti").join(left.select("session_id", "now", "target").hint("merge"), "session_id")
        more = kept(first.unionByName(_prefix(past, "now")))
        folded = folded.unionByName(more)
        after = here.join(saved(more).hint("merge"), "session_id", "left").withColumn("now", F.col("now") - F.coalesce("_s", F.lit(0.0)))
        under = groups.join(folded.select(*NODE).hint("merge"), NODE, "left_semi").join(after.where("now < target").select("session_id", "now", "window", "target").hint("merge"), "session_id")
        mine = folded.select("session_id", (F.col("level") - 1).alias("level"), F.col("id").alias("parent"), F.lit(True).alias("_p"))
        held = under.select(*FOLDED).join(mine.distinct().hint("merge"), ["session_id", "level", "parent"], "left")
        shown_by = held.withColumn("parent", F.when(F.col("_p"), F.col("parent"))).drop("_p")
        folded = kept(folded.join(opened(shown_by).hint("merge"), NODE, "left_anti"))
        render = here.join(saved(folded).hint("merge"), "session_id", "left").select("session_id", "window", (F.col("seen") - F.coalesce("_s", F.lit(0.0))).alias("rendered"))
        old = active.select("session_id", F.col("rendered").alias("_was"))
        active = kept(render.join(old.hint("merge"), "session_id").where("rendered > window and (_was is null or rendered < _was)").select("session_id", "rendered"))
        if active.isEmpty():
            break
    at = leaves.join(folded.select(*NODE).hint("merge"), NODE, "left_semi").groupBy("session_id", "chunk_id").agg(F.max("level").alias("level"))
    return chunks.select("session_id", "chunk_id").join(at.hint("merge"), ["session_id", "chunk_id"], "left").select("session_id", "chunk_id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def plan(chunks: DataFrame, memories: DataFrame, edges: DataFrame, carried: DataFrame, budgets: DataFrame, gap: float, windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The cut (session_id, chunk_id, level) that each session adopts, and how: (session_id, branch, tokens, cost, loss, escalated, demanded).

    ``carried`` is the cut it had (a chunk it lacks stands raw), budgets are (session_id, window, target, reach). The carried cut is held if it renders
    between target and window and is at most ``gap`` worse than the ideal one; else the ideal follows if that re-reads at most ``reach``
    tokens; else its newest changes, as far as they go, if they fit and are near enough; else the ideal at its full cost. A session whose
    ideal is past its window is escalated, and demands its chunks without a memory (a count here), unless it holds or takes newest changes.
    """
    raw = chunks.select("session_id", "chunk_id", "raw")
    leaf = chunks.select("session_id", "chunk_id", "cap", "salience")
    was = chunks.select("session_id", "chunk_id").join(carried.select("session_id", "chunk_id", "level").hint("merge"), ["session_id", "chunk_id"], "left").select("session_id", "chunk_id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))
    now, ideal = kept(project(was, edges)), kept(ideal_cut(chunks, memories, edges, budgets, windows))
    part = kept(suffix_adopt(now, ideal, chunks, memories, edges, budgets.select("session_id", "reach"), windows))

    def placed(cut: DataFrame) -> DataFrame:
        units = layout(cut.join(raw.hint("merge"), ["session_id", "chunk_id"]), memories, edges, windows)
        return kept(units.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("first_chunk"))))

    units = {name: placed(cut) for name, cut in (("now", now), ("ideal", ideal), ("part", part))}
    stats = budgets
    for name, cut in (("now", now), ("ideal", ideal), ("part", part)):
        size = units[name].groupBy("session_id").agg(F.sum("tokens").alias(name))
        loss = misallocation(cut.join(leaf.hint("merge"), ["session_id", "chunk_id"])).select("session_id", F.col("misallocation").alias(f"{name}_loss"))
        stats = stats.join(size.hint("merge"), "session_id").join(loss.hint("merge"), "session_id")
        if name != "now":
            stats = stats.join(kv_cost(units["now"], units[name]).select("session_id", F.col("cost").alias(f"{name}_cost")).hint("merge"), "session_id")
    stats = kept(stats.withColumn("cost", F.col("ideal_cost")))
    chosen = adopt(stats, F.col("window"), F.col("target"), F.col("reach"), gap)
    bare = chunks.join(memories.where("level = 1").select("session_id", F.col("id").alias("chunk_id")).hint("merge"), ["session_id", "chunk_id"], "left_anti").groupBy("session_id").agg(F.count("*").alias("_bare"))
    hold, suffix = F.col("branch") == "hold", F.col("branch") == "suffix"
    told = chosen.join(stats.hint("merge"), "session_id").join(bare.hint("merge"), "session_id", "left")
    escalated = ~hold & ~suffix & (F.col("ideal") > F.col("window"))
    cost = F.when(hold, 0).when(suffix, F.col("part_cost")).otherwise(F.col("ideal_cost")).cast("long")
    loss = F.when(hold, F.col("now_loss")).when(suffix, F.col("part_loss")).otherwise(F.col("ideal_loss"))
    told = kept(told.select("session_id", "branch", F.col("tokens").cast("long").alias("tokens"), cost.alias("cost"), loss.alias("loss"), escalated.alias("escalated"), F.when(escalated, F.coalesce("_bare", F.lit(0))).otherwise(0).cast("long").alias("demanded")))
    taken = told.select("session_id", F.when(F.col("branch").isin("hold", "suffix"), F.col("branch")).otherwise("ideal").alias("_b"))
    named = now.withColumn("_b", F.lit("hold")).unionByName(part.withColumn("_b", F.lit("suffix"))).unionByName(ideal.withColumn("_b", F.lit("ideal")))
    return named.join(taken.hint("merge"), ["session_id", "_b"], "left_semi").drop("_b"), told
