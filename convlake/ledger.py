"""Outcomes, ledgers, calibration, limits (F), and turns and admission of requests (T)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the rules.
ACTIONS = {"refusal": "retry", "empty": "retry", "truncated": "retry", "tool_call": "retry", "overflow": "shrink", "provider_error": "transient"}
ALPHA, LOW, HIGH = 0.2, 0.6, 1.8
MAX_ATTEMPTS, PROVIDER_STREAK = 3, 12
DAY = 86_400_000_000


def gate(error: Column, stop: Column, tool_call: Column, text: Column) -> Column:
    """Why a reply is refused, by tests in this order; null if it is accepted."""
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    return F.when(error.isNotNull(), error).when(stop == "refusal", "refusal").when(tool_call | (stop == "tool_use"), "tool_call").when(blank, "empty").when(stop != "end_turn", "truncated")


def ledger(attempts: DataFrame) -> DataFrame:
    """Per target, of (target, id, kind, reason): attempts and streak since the last clear, last reason, cleared.

    A provider error or a stale result burns no attempt; a stale one breaks no streak. A mint clears but resets nothing.
    """
    by = Window.partitionBy("target")
    since = attempts.withColumn("_clear", F.coalesce(F.max(F.when(F.col("kind") == "clear", F.col("id"))).over(by), F.lit(-1)))
    live = (F.col("id") > F.col("_clear")) & (F.col("kind") == "fail")
    burned = live & ~F.col("reason").isin("provider_error", "stale")
    since = since.withColumn("_break", F.coalesce(F.max(F.when(burned, F.col("id"))).over(by), F.lit(-1)))
    return since.groupBy("target").agg(
        F.count_if(burned).alias("attempts"),
        F.count_if(live & (F.col("reason") == "provider_error") & (F.col("id") > F.col("_break"))).alias("streak"),
        F.max_by(F.when(live, F.col("reason")), F.when(live, F.col("id"))).alias("last"),
        F.bool_or(F.col("kind").isin("clear", "mint")).alias("cleared"),
    )


def stalled(ledgers: DataFrame, attempts: int = MAX_ATTEMPTS, streak: int = PROVIDER_STREAK) -> DataFrame:
    return ledgers.where(~F.col("cleared") & ((F.col("attempts") >= attempts) | (F.col("streak") >= streak)))


def policy(ledgers: DataFrame, attempts: int = MAX_ATTEMPTS, streak: int = PROVIDER_STREAK) -> DataFrame:
    """What to do about a target's last reason: a provider's fault passes while its streak is short, else a target out of
    attempts is terminal, else the reason's action counts; none for a target that hasn't failed or is only stale."""
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    passing = (F.col("last") == "provider_error") & (F.col("streak") < streak)
    spent = F.col("last").isNotNull() & (F.col("attempts") >= attempts)
    return ledgers.withColumn("action", F.when(passing, "transient").when(spent, "terminal").otherwise(F.coalesce(table[F.col("last")], F.lit("none"))))


def samples(usage: DataFrame) -> DataFrame:
    """Ratios (session_id, id, r) to learn from, of rows (session_id, id, armed, reported): a compile arms the tokens it
    rendered, and only the next positive report after it is held against them."""
    valid = F.col("armed").isNotNull() | (F.col("reported") > 0) & (F.abs("reported") < F.lit(float("inf")))
    by = Window.partitionBy("session_id").orderBy("id")
    rows = usage.where(valid).withColumn("_a", F.lag("armed").over(by)).where(F.col("armed").isNull() & (F.col("_a") > 0))
    return rows.select("session_id", "id", (F.col("reported") / F.col("_a")).alias("r"))


def calibrate(usage: DataFrame) -> DataFrame:
    """Per session: the multiplier after its samples in order. An estimate already holds the multiplier m, so a ratio r
    moves m towards r * m; ratios outside the band are ignored. A sample is 16 bytes, one a compile."""
    items = F.array_sort(F.collect_list(F.struct("id", "r")))
    step = lambda m, x: F.least(F.lit(HIGH), F.greatest(F.lit(LOW), m + ALPHA * (x["r"] * m - m)))
    return samples(usage).where(F.col("r").between(LOW, HIGH)).groupBy("session_id").agg(F.aggregate(items, F.lit(1.0), step).alias("multiplier"), F.count("*").alias("samples"))


def rate_limit(posts: DataFrame, per_day: Column) -> DataFrame:
    """Posts by a session in a channel in the trailing day, how many the cap leaves, and when the next is free: now, or a day
    after the post that holds the oldest place of the cap (its ``per_day``-th from the newest)."""
    each = Window.partitionBy("channel", "session_id")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    window = each.orderBy(micros).rangeBetween(-DAY, 0)
    rows = posts.withColumns({"used": F.count("*").over(window), "_m": micros, "_cap": per_day, "_k": F.row_number().over(each.orderBy(micros, "event_id"))})
    last = F.max("_k").over(each.orderBy(micros).rangeBetween(0, 0))  # posts of one instant count together
    rows = rows.withColumn("_at", F.greatest(F.lit(1), last - F.col("_cap") + 1))
    places = posts.select("channel", "session_id", F.row_number().over(each.orderBy(micros, "event_id")).alias("_at"), F.col("at").alias("_held"))
    met = rows.join(places.hint("merge"), ["channel", "session_id", "_at"], "left")
    free = F.when((F.col("used") < F.col("_cap")) | (F.col("_cap") <= 0), F.when(F.col("_cap") > 0, F.col("at"))).otherwise(F.col("_held") + F.expr("interval 1 day"))
    return met.withColumn("remaining", F.greatest(F.lit(0), F.col("_cap") - F.col("used"))).withColumn("next_free", free).drop("_m", "_cap", "_k", "_at", "_held")


def accepted_posts(posts: DataFrame, per_day: Column) -> DataFrame:
    """Posts (channel, session_id, event_id, at) as they come: ``accepted`` while fewer than ``per_day`` accepted ones are in the trailing day, how many
    the cap leaves after it, and for a refused one ``frees``, when the next can go. A refused post takes no place.

    A post that comes more than a day after the one before it starts anew, so a member's posts fall into bursts, which are streamed by time; the state is the
    times that count, at most the cap.
    """
    names = [c for c in posts.columns if c not in ("_m", "_cap")]
    each = Window.partitionBy("channel", "session_id").orderBy("_m", "event_id")
    rows = posts.withColumn("_m", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("_cap", per_day.cast("long"))
    rows = rows.withColumn("_new", F.coalesce((F.col("_m") - F.lag("_m").over(each) > DAY).cast("int"), F.lit(0))).withColumn("_burst", F.sum("_new").over(each.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = None, deque()
        for batch in batches:
            good, left, frees = [], [], []
            for channel, who, burst, now, cap in zip(*[batch.column(c).to_pylist() for c in ("channel", "session_id", "_burst", "_m", "_cap")], strict=True):
                if (channel, who, burst) != at:
                    at, made = (channel, who, burst), deque()
                while made and made[0] < now - DAY:
                    made.popleft()
                good.append(len(made) < cap)
                frees.append(None if good[-1] or cap <= 0 else made[len(made) - cap] + DAY)
                if good[-1]:
                    made.append(now)
                left.append(max(0, cap - len(made)))
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(good, pa.bool_()), pa.array(left, pa.int64()), pa.array(frees, pa.int64())], [*names, "accepted", "remaining", "_frees"])

    dealt = rows.repartition("channel", "session_id", "_burst").sortWithinPartitions("channel", "session_id", "_burst", "_m", "event_id")
    kinds = ", ".join(f"{c} {t}" for c, t in posts.select(*names).dtypes)
    return dealt.mapInArrow(run, f"{kinds}, accepted boolean, remaining long, _frees long").withColumn("frees", F.timestamp_micros("_frees")).drop("_frees")


def fan_out(posts: DataFrame, members: DataFrame) -> DataFrame:
    """Each post to each listening member but its author."""
    m = members.where("inputs").select("channel", F.col("session_id").alias("to"))
    return posts.join(m.hint("merge"), "channel").where("`to` <> session_id")


def running_totals(costs: DataFrame) -> DataFrame:
    by = Window.partitionBy("session_id", "purpose").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("total", F.sum("tokens").over(by))


def input_bound(n_messages: Column, payload_bytes: Column) -> Column:
    return payload_bytes + 512 + 128 * n_messages


def turns_of(log: DataFrame) -> DataFrame:
    """Turns start at a user's message that isn't a call's results (``tool_result``, where the log has it)."""
    starts = F.col("participant") == "user"
    starts = starts & ~F.col("tool_result") if "tool_result" in log.columns else starts
    by = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = log.withColumn("turn", F.sum(starts.cast("int")).over(by))
    return numbered.groupBy("session_id", "turn").agg(F.min("id").alias("first"), F.max("id").alias("last"))
