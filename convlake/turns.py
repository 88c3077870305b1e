"""Turns of a request: joining, repair of calls, marks for a cache, budgets of the next attempt (T), costs of a change (K2, K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .admission import admit
from .sources import by_id

# Fixed values of the rules: a recall's envelope, the least budget of a merge, the halvings it can have.
ENVELOPE, LEAST, HALVINGS = 50, 8_000, 4


def collapse_turns(log: DataFrame, rule: str = "\n\n---\n\n") -> DataFrame:
    """A participant's consecutive messages as one turn, a rule between each."""
    change = (~F.col("participant").eqNullSafe(F.lag("participant").over(by_id()))).cast("int")
    numbered = log.withColumn("_c", F.when(F.lag("id").over(by_id()).isNull(), 1).otherwise(change))
    numbered = numbered.withColumn("turn", F.sum("_c").over(by_id().rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))  # one turn's messages
    text = F.array_join(F.transform(parts, lambda p: p["text"]), rule)
    return numbered.groupBy("session_id", "turn").agg(F.first("participant").alias("participant"), F.min("id").alias("first"), F.max("id").alias("last"), text.alias("text"))


def unpaired_tools(blocks: DataFrame) -> DataFrame:
    """Of blocks (session_id, id, pos, type, call), the calls without a result and the results without a call."""
    tools = blocks.where(F.col("type").isin("tool_use", "tool_result"))
    other = tools.select("session_id", "call", F.when(F.col("type") == "tool_use", "tool_result").otherwise("tool_use").alias("type")).distinct()
    return tools.join(other.hint("merge"), ["session_id", "call", "type"], "left_anti")


def drop_unpaired_tools(blocks: DataFrame) -> DataFrame:
    """Blocks kept of each message, and whether it lost all it had and says that a call was omitted."""
    lost = unpaired_tools(blocks).select("session_id", "id", "pos", F.lit(True).alias("_lost"))
    kept = F.count_if(F.col("_lost").isNull())
    return blocks.join(lost.hint("merge"), ["session_id", "id", "pos"], "left").groupBy("session_id", "id").agg(kept.alias("kept"), (kept == 0).alias("omitted"))


def drop_trailing_calls(log: DataFrame) -> DataFrame:
    last = F.max(F.when(~F.col("tool_use"), F.col("id"))).over(Window.partitionBy("session_id"))
    return log.withColumn("_last", last).where("id <= _last").drop("_last")


def newest_kept(log: DataFrame, kept: DataFrame) -> DataFrame:
    """Per session: whether its newest message is still there."""
    newest = log.groupBy("session_id").agg(F.max("id").alias("_n"))
    left = kept.groupBy("session_id").agg(F.max("id").alias("_k"))
    return newest.join(left.hint("merge"), "session_id", "left").select("session_id", F.col("_n").eqNullSafe(F.col("_k")).alias("kept"))


def cache_seams(recalls: DataFrame) -> DataFrame:
    """Of recalls (session_id, pos, level): before the first, the newest above level 1, the newest."""
    return recalls.groupBy("session_id").agg((F.min("pos") - 1).alias("before"), F.max(F.when(F.col("level") > 1, F.col("pos"))).alias("above"), F.max("pos").alias("newest"))


def recall_within_budget(recalls: DataFrame, budget: int) -> DataFrame:
    """Recalls (session_id, id, tokens) that fit, newest first; one that doesn't fit is skipped."""
    return admit(recalls.withColumn("bytes", F.col("tokens") + ENVELOPE), 0, budget)


def next_attempt(attempts: DataFrame, budget: int) -> DataFrame:
    """Before each attempt of a target: its failures so far, the budget of its recalls, and whether tools go."""
    by = Window.partitionBy("target").orderBy("id")
    tries = F.coalesce(F.sum((F.col("kind") == "fail").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = attempts.withColumn("tries", tries).withColumn("was", F.lag("reason").over(by))
    halved = F.floor(F.lit(float(budget)) * F.pow(F.lit(0.5), F.least(F.lit(HALVINGS), "tries")) + 0.5).cast("long")
    gone = F.col("was").eqNullSafe(F.lit("tool_call")) & (F.col("tries") >= 2)
    return rows.select("target", "id", "tries", F.greatest(F.lit(LEAST), halved).alias("budget"), gone.alias("drop_tools"))


def kv_cost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tokens of ``after`` (session_id, pos, unit, tokens) from the first unit that differs from ``before``."""
    was = before.select("session_id", "pos", F.col("unit").alias("_was"))
    both = after.join(was.hint("merge"), ["session_id", "pos"], "full")
    first = F.min(F.when(~F.col("unit").eqNullSafe(F.col("_was")), F.col("pos"))).over(Window.partitionBy("session_id"))
    return both.withColumn("_f", first).groupBy("session_id").agg(F.coalesce(F.sum(F.when(F.col("pos") >= F.col("_f"), F.col("tokens"))), F.lit(0)).alias("cost"))


def misallocation(cut: DataFrame) -> DataFrame:
    """Of a cut (session_id, level, cap, salience): depth past the cap, weighted by salience."""
    return cut.groupBy("session_id").agg(F.sum(F.col("salience") * F.greatest(F.lit(0), F.col("level") - F.col("cap"))).alias("misallocation"))


def next_rung(calls: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Per target of calls (target, id, stop, text) so far: how the next one asks, or none if the last reply is accepted or nothing
    is left to ask. A call for tools leads to a line against them, then to no tools; a reply that was all reasoning to plain prose;
    any other failure to a request with a summary opened up. Given how many of those a target can have (variants: target, variants), ``variant`` is
    the number of the one that is next, and the rung is ``exhausted`` once all were tried."""
    by = Window.partitionBy("target").orderBy("id")
    tools = F.col("stop") == "tool_use"
    rows = calls.withColumn("_k", F.row_number().over(by)).withColumn("_tools", F.min(tools.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    ended = F.col("stop") == "end_turn"
    blank = ended & (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    rows = rows.withColumn("_prose", F.coalesce(F.max(blank.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    rung = F.when(ended & ~blank, "none").when(F.col("_prose"), "none").when(blank, "prose").when(F.col("_tools") & (F.col("_k") == 1), "no tools").when(F.col("_tools") & (F.col("_k") == 2), "tools dropped").otherwise("variant")
    found = rows.groupBy("target").agg(F.max_by(rung, "id").alias("rung"), F.count("*").alias("tries"), F.sum(F.col("_tools").cast("int")).alias("_t"))
    if variants is None:
        return found.drop("_t")
    # calls before the variants: the first, and one more for each of the first two that asked for tools
    tried = F.col("tries") - 1 - F.least(F.lit(2), "_t")
    met = found.join(variants.hint("merge"), "target", "left").withColumn("variants", F.coalesce("variants", F.lit(0)))
    open_ = F.col("rung") == "variant"
    left = tried < F.col("variants")
    return met.select("target", F.when(open_ & ~left, "exhausted").otherwise(F.col("rung")).alias("rung"), F.when(open_ & left, tried + 1).alias("variant"), "tries")
