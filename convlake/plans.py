"""More of the pyramid as relations (C5, C8, D3, D4, M4-M10), checks of plans (K12, K16) and of outcomes (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import owner_of

# Fixed values of the rules: statuses worth another try, other names of a good end, failed shapes that end a chunk's tries.
RETRYABLE = [408, 429]
ENDS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "content_filter": "refusal"}
SHAPES = 3


def chunk_spans(chunks: DataFrame) -> DataFrame:
    """Each chunk's message range, with its ordinal among chunks of that range (shards of one message)."""
    same = Window.partitionBy("session_id", "first", "last").orderBy("chunk_id")
    return chunks.select("session_id", "chunk_id", "first", "last", (F.row_number().over(same) - 1).cast("long").alias("ordinal"))


def chunk_raw(priced: DataFrame, chunks: DataFrame) -> DataFrame:
    owned = owner_of(priced, chunks.select("session_id", "chunk_id", "first", "last")).where("chunk_id is not null")
    return owned.groupBy("session_id", "chunk_id").agg(F.sum("tokens").alias("raw"))


def demanded(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks that meet a demanded range (session_id, first, last); a missing end is open.

    A chunk meets a range if the range starts in it or it starts in the range. So chunks and the starts of ranges are laid along the session:
    a chunk is taken if the ranges that start before it reach it, or one starts in it.
    """
    r = ranges.select("session_id", F.coalesce("first", F.lit(0)).cast("long").alias("at"), F.coalesce("last", F.lit(2**62)).cast("long").alias("end"))
    return meeting(chunks, r).select("session_id", "chunk_id")


def meeting(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks (session_id, first, last and more) that meet a range (session_id, at, end). Each is laid at its start: the furthest end of the
    ranges at or before a chunk's start reaches it, or the next range starts by its last message."""
    laid = chunks.select("session_id", F.col("first").cast("long").alias("at"), F.lit(None).cast("long").alias("end"), F.struct(*chunks.columns).alias("_c"))
    both = laid.unionByName(ranges.where("end >= at").select("session_id", "at", "end", F.lit(None).cast(laid.schema["_c"].dataType).alias("_c")))
    by = lambda at: Window.partitionBy("session_id").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("end").over(by(F.col("at")))
    after = F.min(F.when(F.col("_c").isNull(), F.col("at"))).over(by(F.col("at").desc()))  # a frame that ends with the session is summed anew for each row
    found = both.withColumn("_r", reach).withColumn("_n", after).where(F.col("_c").isNotNull() & ((F.col("_r") >= F.col("at")) | (F.col("_n") <= F.col("_c.last"))))
    return found.select("_c.*")


def enqueue(queue: DataFrame, candidates: DataFrame, done: DataFrame) -> DataFrame:
    """``queue`` (key, at) and then each candidate once, neither queued nor done, in order of arrival."""
    fresh = candidates.groupBy("key").agg(F.min("at").alias("at")).join(queue.hint("merge"), "key", "left_anti").join(done.hint("merge"), "key", "left_anti")
    return queue.select("key", "at", F.lit(0).alias("fresh")).unionByName(fresh.select("key", "at", F.lit(1).alias("fresh")))


def count_edges(memories: DataFrame, k: int) -> DataFrame:
    """Edges (session_id, level, id, member) of memories merged by count; a member is one level down, a chunk below level 1."""
    ids = F.when(F.col("level") == 1, F.array("id")).otherwise(F.sequence(F.col("id") * k, F.col("id") * k + k - 1))
    return memories.select("session_id", "level", "id", F.explode(ids).alias("member"))


def members(edges: DataFrame) -> DataFrame:
    """The memories that each merged memory holds (member_level, member): one level down, or where edges say."""
    below = F.col("member_level") if "member_level" in edges.columns else F.col("level") - 1
    return edges.where(below > 0).select("session_id", "level", "id", below.alias("member_level"), "member")


def closure(edges: DataFrame) -> DataFrame:
    """The ancestor of each chunk at each level that covers it: a join a level, from the chunks up.

    A memory's members are one level down, or at the levels that edges name (member_level, 0: a chunk)."""
    top = edges.agg(F.max("level")).first()[0] or 0
    if "member_level" in edges.columns:
        out = edges.where("member_level = 0").select("session_id", F.col("member").alias("chunk_id"), "level", F.col("id").alias("ancestor"))
        for level in range(2, top + 1):
            up = edges.where((F.col("level") == level) & (F.col("member_level") > 0)).select("session_id", F.col("member_level").alias("level"), F.col("member").alias("ancestor"), F.col("id").alias("_up"))
            out = out.unionByName(out.hint("merge").join(up, ["session_id", "level", "ancestor"]).select("session_id", "chunk_id", F.lit(level).alias("level"), F.col("_up").alias("ancestor")))
        return out
    now = edges.where("level = 1").select("session_id", F.col("member").alias("chunk_id"), "level", F.col("id").alias("ancestor"))
    out = now
    for level in range(2, top + 1):
        up = edges.where(F.col("level") == level).select("session_id", F.col("member").alias("ancestor"), F.col("level"), F.col("id").alias("_up"))
        now = now.drop("level").hint("merge").join(up, ["session_id", "ancestor"]).select("session_id", "chunk_id", "level", F.col("_up").alias("ancestor"))
        out = out.unionByName(now)
    return out


def chunks_of(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Each memory with the first and last chunk under it."""
    spans = closure(edges).groupBy("session_id", "level", F.col("ancestor").alias("id")).agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))
    return memories.join(spans.hint("merge"), ["session_id", "level", "id"])


def growth(chunks: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Each memory with what its members cost more than it does."""
    below = chunks.select("session_id", F.lit(0).alias("member_level"), F.col("chunk_id").alias("member"), F.col("raw").alias("_cost"))
    below = below.unionByName(memories.select("session_id", F.col("level").alias("member_level"), F.col("id").alias("member"), F.col("tokens").alias("_cost")))
    named = edges if "member_level" in edges.columns else edges.withColumn("member_level", F.col("level") - 1)
    cost = named.hint("merge").join(below, ["session_id", "member_level", "member"]).groupBy("session_id", "level", "id").agg(F.sum("_cost").alias("_cost"))
    return memories.join(cost.hint("merge"), ["session_id", "level", "id"]).withColumn("growth", F.col("_cost") - F.col("tokens")).drop("_cost")


def unmerged(memories: DataFrame, edges: DataFrame, before: int | None = None) -> DataFrame:
    """Memories that no merge took, ending before a message."""
    taken = members(edges).select("session_id", F.col("member_level").alias("level"), F.col("member").alias("id"))
    free = memories.join(taken.hint("merge"), ["session_id", "level", "id"], "left_anti")
    return free if before is None else free.where(F.col("last") < before)


def first_group(entries: DataFrame, order: list[str], least: int, target: int) -> DataFrame:
    """Per session, the fewest leading entries, at least ``least``, that hold ``target`` tokens; none if all hold less."""
    by = Window.partitionBy("session_id").orderBy(*order)
    run = entries.withColumn("_t", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(by))
    full = F.min(F.when((F.col("_t") >= target) & (F.col("_k") >= least), F.col("_k"))).over(Window.partitionBy("session_id"))
    keep = [c for c in entries.columns if c in ("session_id", "level", *order)]
    return run.withColumn("_full", full).where(F.col("_k") <= F.col("_full")).select(*keep)


def lift(memories: DataFrame, edges: DataFrame, least: int, target: int) -> DataFrame:
    """The group of a lifted memory: unmerged ones of all levels below the session's top, oldest first."""
    top = F.max("level").over(Window.partitionBy("session_id"))
    below = unmerged(memories, edges).withColumn("_top", top).where("level < _top")
    return first_group(below, ["first", "id"], least, target)


def span_guard(memories: DataFrame, base: int, k: int) -> DataFrame:
    """``reason`` why a memory is no candidate of a merge: unresolved, or wider than its level allows; else null."""
    widest = base * F.pow(F.lit(float(k)), F.greatest(F.lit(0), F.col("level") - 3))
    return memories.withColumn("reason", F.when(F.col("first").isNull() | F.col("last").isNull(), "unresolved").when(F.col("last") - F.col("first") > widest, "too wide"))


def over_budget(totals: DataFrame, window: int, grace: float) -> DataFrame:
    """Totals with the most a window takes, and whether they pass it; what they hold (other columns) stays beside them."""
    most = F.floor(F.lit(window * (1 + grace))).cast("int")
    return totals.withColumn("most", most).withColumn("over", F.col("total") > F.col("most"))


def uncovered(chunks: DataFrame, shown: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Chunks neither shown raw (session_id, chunk_id) nor inside a shown memory (first_chunk, last_chunk): empty if a plan is whole."""
    held = shown.select("session_id", F.explode(F.sequence("first_chunk", "last_chunk")).alias("chunk_id"))
    held = held if raw is None else held.unionByName(raw.select("session_id", "chunk_id"))
    return chunks.join(held.hint("merge"), ["session_id", "chunk_id"], "left_anti").select("session_id", "chunk_id")


def blocked(attempts: DataFrame, lengths: DataFrame, limit: int) -> DataFrame:
    """Targets of attempts (session_id, id, target, outcome, messages) that wait: all of a session whose last attempt was a
    refusal, and one that was tried ``limit`` times at the log's present length (session_id, messages)."""
    by = Window.partitionBy("session_id")
    now = lengths.select("session_id", F.col("messages").alias("_now"))
    rows = attempts.withColumn("_last", F.max_by("outcome", "id").over(by)).join(now.hint("merge"), "session_id", "left")
    found = rows.groupBy("session_id", "target").agg(F.first("_last").alias("_last"), F.count_if(F.col("messages") == F.col("_now")).alias("_n"))
    return found.select("session_id", "target", (F.col("_last").eqNullSafe(F.lit("refusal")) | (F.col("_n") >= limit)).alias("blocked"))


def quarantine(attempts: DataFrame, limit: int, shapes: int = SHAPES) -> DataFrame:
    """Targets that failed ``limit`` times, or in ``shapes`` different requests where attempts name theirs."""
    asked = F.count_distinct("request") if "request" in attempts.columns else F.lit(0)
    rows = attempts.where("kind = 'fail'").groupBy("target").agg(F.count("*").alias("failures"), asked.cast("long").alias("shapes"))
    return rows.where((F.col("failures") >= max(1, limit)) | (F.col("shapes") >= shapes))


def discard_stale(results: DataFrame) -> DataFrame:
    """A result made against another version than the log has now becomes a stale event and burns nothing."""
    old = F.col("version") != F.col("now")
    return results.select("target", "id", F.when(old, "fail").otherwise(F.col("kind")).alias("kind"), F.when(old, "stale").otherwise(F.col("reason")).alias("reason"))


def classify_response(status: Column, body: Column) -> Column:
    """ok, malformed, retryable (no answer, 408, 429 and 5xx) or final."""
    finish = F.get_json_object(body, "$.choices[0].finish_reason")
    good = status.between(200, 299)
    return F.when(good & finish.isNotNull(), "ok").when(good, "malformed").when(status.isNull() | status.isin(*RETRYABLE) | (status >= 500), "retryable").otherwise("final")


def stop_reason(body: Column) -> Column:
    """A recorded answer's stop reason under the name that gate() knows; unknown ones stay as they are."""
    said = F.get_json_object(body, "$.choices[0].finish_reason")
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])[said], said)


def clear_debt(attempts: DataFrame, targets: DataFrame, at: int) -> DataFrame:
    """The attempts log with a clear appended for each target."""
    return attempts.unionByName(targets.select("target", F.lit(at).cast("long").alias("id"), F.lit("clear").alias("kind"), F.lit(None).cast("string").alias("reason")))


def last_prompt(usage: DataFrame) -> DataFrame:
    return usage.groupBy("session_id").agg(F.max("id").alias("id"), F.max_by("tokens", "id").alias("tokens"))


def unlearnt(replies: DataFrame, compiles: DataFrame) -> DataFrame:
    """Replies (session_id, id) whose compile, the last at or before them, is still the session's last (session_id, compile_id)."""
    last = compiles.groupBy("session_id").agg(F.max("compile_id").alias("_c"))
    return replies.join(last.hint("merge"), "session_id").where(F.col("id") >= F.col("_c")).drop("_c")
