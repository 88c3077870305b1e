"""Forming the memories that merges make (M3, M4, M5): who goes together, the text, price and span of what they make, and its edges.

A level is closed before the next one is looked at, so each rule deals out all groups of a level at once; there are
as many rounds as levels, and one more for each lift.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept
from .plans import unmerged
from .pricing import digest_words, written_tokens
from .segments import SLICE, segments

NODE = ["session_id", "level", "id"]
EDGES = "session_id string, level int, id long, member_level int, member long"
#: Of unmerged memories of one level (and all of that level): those that merge, with their group.
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def first_edges(memories: DataFrame) -> DataFrame:
    """Edges of memories of level 1: each stands for the chunk of its number."""
    return memories.where("level = 1").select("session_id", F.lit(1).alias("level"), "id", F.lit(0).alias("member_level"), F.col("id").alias("member"))


def _numbered_runs(free: DataFrame) -> DataFrame:
    """``free`` with ``_run`` (runs that leave no gap, numbered) and ``_k``, a memory's place in its run from 0."""
    each = Window.partitionBy("session_id", "level").orderBy("first", "last", "id")
    broken = F.coalesce((F.col("first") > F.lag("last").over(each) + 1).cast("int"), F.lit(1))
    runs = free.withColumn("_b", broken).withColumn("_run", F.sum("_b").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("session_id", "level", "_run")
    return runs.withColumn("_k", F.row_number().over(run.orderBy("first", "last", "id")) - 1).withColumn("_n", F.count("*").over(run)).withColumn("_end", F.max("last").over(run))


def by_run(k: int) -> Rule:
    """A contiguous run gives groups of k; what is left of it, two or more, is one too where its level reaches beyond it."""

    def rule(free: DataFrame, level: DataFrame) -> DataFrame:
        live = level.groupBy("session_id", "level").agg(F.max("last").alias("_live"))
        sized = _numbered_runs(free).join(live.hint("merge"), ["session_id", "level"])
        group, left = F.floor(F.col("_k") / k), F.col("_n") % k
        whole = F.col("_k") < F.col("_n") - left
        due = whole | ((left >= 2) & (F.col("_end") < F.col("_live")))
        return sized.where(due).withColumn("group", F.concat_ws(":", "_run", group)).drop("_b", "_run", "_k", "_n", "_end", "_live")

    return rule


def by_first_run(k: int, widest: int | None = None) -> Rule:
    """The stricter rule: while a level has k unmerged memories, the first run of k or more, or of two or more with a newer run after it,
    gives its first k. Memories that are too wide for their level count, and are in no run."""

    def rule(free: DataFrame, level: DataFrame) -> DataFrame:
        each = Window.partitionBy("session_id", "level")
        held = free.withColumn("_all", F.count("*").over(each))
        if widest is not None:
            held = held.where(F.col("last") - F.col("first") <= widest * F.pow(F.lit(float(k)), F.greatest(F.lit(0), F.col("level") - 3)))
        sized = _numbered_runs(held).withColumn("_newest", F.max("_run").over(each))
        group, left = F.floor(F.col("_k") / k), F.col("_n") % k
        due = (F.col("_k") < F.col("_n") - left) | ((left >= 2) & (F.col("_run") < F.col("_newest")))
        before = F.coalesce(F.count("*").over(each.orderBy("_run", "_g").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.count("*").over(Window.partitionBy("session_id", "level", "_run", "_g"))
        taken = sized.where(due).withColumn("_g", group).withColumn("_before", before).where(F.col("_all") - F.col("_before") >= k)
        return taken.withColumn("group", F.concat_ws(":", "_run", "_g")).drop("_all", "_b", "_run", "_k", "_n", "_end", "_newest", "_g", "_before")

    return rule


def by_tokens(least: int, target: int, size: int = SLICE) -> Rule:
    """The fewest memories, at least ``least``, that hold ``target`` tokens, oldest first: runs that close by size."""

    def rule(free: DataFrame, level: DataFrame) -> DataFrame:
        rows = free.select(F.concat_ws("|", "level", "session_id").alias("session_id"), "id", F.col("tokens").cast("long").alias("weight"), F.lit(0).cast("long").alias("less"), F.lit(True).alias("closer"), F.lit(False).alias("alone"), F.lit(1).cast("long").alias("span"), F.lit(None).cast("double").alias("extra"), F.floor(F.col("id") / size).alias("slice"))
        closed = segments(rows, target, least).where("not open").select(F.regexp_extract("session_id", "^[0-9]+", 0).cast("int").alias("level"), F.regexp_replace("session_id", r"^[0-9]+\|", "").alias("session_id"), "id", F.col("chunk_id").cast("string").alias("group"))
        return free.join(closed.hint("merge"), NODE)

    return rule


def _formed(groups: DataFrame, memories: DataFrame, words: int) -> DataFrame:
    """Memories of groups (columns of memories, ``group`` and ``up``, the level they go to), numbered after those of their level,
    with their members."""
    parts = F.array_sort(F.collect_list(F.struct("first", "level", "id", "text")))  # a group's members
    made = groups.groupBy("session_id", "up", "group").agg(parts.alias("_p"), F.min("first").alias("first"), F.max("last").alias("last"))
    text = digest_words(F.array_join(F.transform("_p", lambda p: p["text"]), " "), words)
    counts = memories.groupBy("session_id", F.col("level").alias("up")).agg((F.max("id") + 1).alias("_base"))
    place = F.row_number().over(Window.partitionBy("session_id", "up").orderBy("first", "last")) - 1
    named = made.join(counts.hint("merge"), ["session_id", "up"], "left").withColumn("id", (place + F.coalesce("_base", F.lit(0))).cast("long"))
    return named.select("session_id", F.col("up").cast("int").alias("level"), "id", "first", "last", text.alias("text"), F.transform("_p", lambda p: F.struct(p["level"].alias("level"), p["id"].alias("id"))).alias("_m")).withColumn("tokens", written_tokens(F.col("text")))


def added(memories: DataFrame, edges: DataFrame, formed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and edges with those that were formed."""
    fresh = formed.select("session_id", "level", "id", F.explode("_m").alias("_m")).select("session_id", "level", "id", F.col("_m.level").cast("int").alias("member_level"), F.col("_m.id").alias("member"))
    return memories.unionByName(formed.drop("_m")), edges.unionByName(fresh)


def form(memories: DataFrame, rule: Rule, edges: DataFrame | None = None, words: int = 40) -> tuple[DataFrame, DataFrame]:
    """All memories and edges (session_id, level, id, member_level, member) once no level has a merge due.

    ``memories`` (session_id, level, id, first, last, text, tokens) with their ``edges`` so far; those of level 1 stand for a chunk each. Levels
    are closed from the lowest up.
    """
    memories = memories.select(*NODE, "first", "last", "text", "tokens").withColumn("level", F.col("level").cast("int"))
    edges = first_edges(memories) if edges is None else edges
    level, top = 1, memories.agg(F.max("level")).first()[0] or 0
    while level <= top:
        here = memories.where(F.col("level") == level)
        groups = rule(unmerged(here, edges), here).withColumn("up", F.col("level") + 1)
        formed = kept(_formed(groups, memories, words))
        if not formed.isEmpty():
            memories, edges = added(memories, edges, formed)
            top = max(top, level + 1)
        level += 1
    return memories, edges


def lift(memories: DataFrame, edges: DataFrame, escalated: DataFrame, least: int, target: int, words: int = 40) -> DataFrame:
    """A lifted memory with its members (``_m``) for each escalated session (session_id) that has one due: of its unmerged memories below its
    top level, oldest first, the fewest, at least ``least``, that hold ``target`` tokens make one above the highest of them."""
    free = unmerged(memories.join(escalated.hint("merge"), "session_id", "left_semi"), edges)
    top = F.max("level").over(Window.partitionBy("session_id"))
    below = free.withColumn("_top", top).where("level < _top").drop("_top")
    by = Window.partitionBy("session_id").orderBy("first", F.col("level").desc(), "id")
    run = below.withColumn("_t", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(by))
    full = F.min(F.when((F.col("_t") >= target) & (F.col("_k") >= least), F.col("_k"))).over(Window.partitionBy("session_id"))
    highest = F.max("level").over(Window.partitionBy("session_id")) + 1
    groups = run.withColumn("_full", full).where(F.col("_k") <= F.col("_full")).withColumn("up", highest).withColumn("group", F.lit("lift"))
    return _formed(groups.drop("_t", "_k", "_full"), memories, words)


def form_with_lifts(memories: DataFrame, escalated: DataFrame, least: int, target: int, words: int = 40, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """form() by tokens, and a lift for each escalated session when no level has a merge due; then merges and lifts go on, for ``rounds``
    lifts at most or until neither is left."""
    rule = by_tokens(least, target)
    memories, edges = form(memories, rule, words=words)
    wanted = kept(escalated.select("session_id").distinct())
    while rounds is None or rounds > 0:
        formed = kept(lift(memories, edges, wanted, least, target, words))
        if formed.isEmpty():
            break
        memories, edges = added(memories, edges, formed)
        memories, edges = form(kept(memories), rule, kept(edges), words)
        wanted, rounds = kept(formed.select("session_id").distinct()), None if rounds is None else rounds - 1
    return memories, edges
