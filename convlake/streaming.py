"""Incremental operators (X) on Structured Streaming."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from .ledger import ALPHA, DAY, HIGH, LOW
from .segments import Rows

CHUNKS = "session_id string, chunk_id long, first long, last long, raw long, late boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(df: DataFrame) -> DataFrame:
    """``df``, with the session set to the store that typed state needs; queries that start later use it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def _gathered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of a micro-batch, which come in pieces, in order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class ClosingRuns(StatefulProcessor):
    """Of a session: its open run, and the last id seen. Where a message says that the session has ended, or none came for ``idle`` ms, it goes."""

    def __init__(self, target: int, least: int, idle: int | None):
        self.target, self.least, self.idle = target, least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "chunk_id long, first long, last long, n long, tokens long", ttlDurationMs=self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chunk, first, last, n, tokens = self.run.get() if self.run.exists() else (0, 0, -1, 0, 0)
        came = _gathered(rows, ["id"])
        late = (came["id"] <= last) | came["id"].duplicated()
        out = [(key[0], None, i, i, t, True) for i, t in came.loc[late, ["id", "tokens"]].itertuples(index=False)]
        fresh = came[~late]
        ids, m = fresh["id"].to_numpy(), len(fresh)
        if m:
            plain, none = np.zeros(m, np.int64), np.zeros(m, bool)
            mine = Rows({"weight": fresh["tokens"].to_numpy(np.int64), "less": plain, "closer": ~fresh["tool_use"].to_numpy(bool), "alone": none, "span": plain + 1}, np.full(m, m), self.target, self.least, False)
            one = np.ones(1, np.int64)
            head = int(min(mine.after(-tokens * one, -n * one, 0 * one)[0][0], 2 * m + 2))
            starts, end = ([], -1) if head > m else mine.follow(head, m)
            cuts = [] if head > m else [head, *starts[1:], *([end] if starts and end >= 0 else [])]
            at = 0
            for cut in cuts:
                raw = int(mine.total[cut - 1] - (mine.total[at - 1] if at else 0)) + tokens
                out.append((key[0], chunk, int(ids[at]) if n == 0 else first, int(ids[cut - 1]), raw, False))
                chunk, n, tokens, at = chunk + 1, 0, 0, cut
            if at < m:
                first = int(ids[at]) if n == 0 else first
                n, tokens = n + m - at, tokens + int(mine.total[-1] - (mine.total[at - 1] if at else 0))
            last = int(ids[-1])
        if "ended" in came.columns and came["ended"].fillna(False).any():
            self.run.clear()
        else:
            self.run.update((int(chunk), int(first), int(last), int(n), int(tokens)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")]).astype({"chunk_id": "Int64"})


def close_chunks(priced: DataFrame, target: int, least: int, idle: int | None = None) -> DataFrame:
    """chunks that close as messages (session_id, id, tokens, tool_use) arrive; the open run is the state.

    A closed chunk never opens again: a message up to the last one seen comes out as a row of its own with ``late`` set and no
    chunk, for the caller to put aside. A message with ``ended`` set (a column that may be left out) is its session's last, and the session's
    state goes with it, as it does after ``idle`` milliseconds without a message; a message after that starts a session anew.
    """
    return typed_state(priced).groupBy("session_id").transformWithStateInPandas(ClosingRuns(target, least, idle), CHUNKS, "Append", "ProcessingTime" if idle else "None")


MEMORIES = "session_id string, level int, id long, first long, last long, text string, tokens long"
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def _memory(texts: list[str], words: int) -> tuple[str, int]:
    """What pricing.digest_words and written_tokens make of texts."""
    said = " ".join([w for w in BLANKS.split(" ".join(texts).strip(" ")) if w][:words])
    return said, -(-(len(said.encode("utf-16-le")) // 2) // 3)


class Forming(StatefulProcessor):
    """Of a session: the newest chunks, held back, and at each level the memories that wait for the rest of their group, fewer than k of them.

    So the state grows with a session's levels, and what a batch reads is its own sessions' state, however much was formed before.
    """

    def __init__(self, holdback: int, k: int, words: int, idle: int | None):
        self.holdback, self.k, self.words, self.idle = holdback, k, words, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "chunk_id long", ttlDurationMs=self.idle)
        self.held = handle.getListState("held", "chunk_id long, first long, last long, text string", ttlDurationMs=self.idle)
        self.open = handle.getListState("open", "level int, id long, first long, last long, text string", ttlDurationMs=self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = _gathered(rows, ["chunk_id"])
        last = self.seen.get()[0] if self.seen.exists() else -1
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        waiting: dict[int, list[tuple]] = {}
        for level, *node in self.open.get() if self.open.exists() else []:
            waiting.setdefault(level, []).append(tuple(node))
        for chunk, first, end, text in zip(came["chunk_id"], came["first"], came["last"], came["text"], strict=True):
            if chunk > last:  # else it came before
                last = int(chunk)
                held.append((last, int(first), int(end), text or ""))
        out, due = [], held[: max(0, len(held) - self.holdback)]
        held = held[len(due) :]
        for chunk, first, end, text in due:
            level, node = 1, (chunk, first, end, *_memory([text], self.words))
            while node:
                out.append((key[0], level, *node))
                group = waiting.setdefault(level, [])
                group.append(node[:4])
                node = None
                if len(group) == self.k:
                    node = (group[0][0] // self.k, group[0][1], group[-1][2], *_memory([g[3] for g in group], self.words))
                    waiting[level], level = [], level + 1
        self.seen.update((last,))
        for state, values in ((self.held, held), (self.open, [(level, *g) for level, groups in waiting.items() for g in groups])):
            if values:
                state.put(values)
            else:
                state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MEMORIES.split(", ")])


def form_memories(chunks: DataFrame, holdback: int, k: int, words: int = 40, idle: int | None = None) -> DataFrame:
    """Memories as chunks (session_id, chunk_id, first, last, text) close: an L1 for each but the newest ``holdback``, and merges of k as they
    are complete. Chunk ids ascend from 0 in a session; one that comes again adds nothing. State goes after ``idle`` ms without a chunk."""
    return typed_state(chunks).groupBy("session_id").transformWithStateInPandas(Forming(holdback, k, words, idle), MEMORIES, "Append", "ProcessingTime" if idle else "None")


def due_work(chunks: DataFrame, at: str, holdback: int, k: int, words: int = 40) -> StreamingQuery:
    """form_memories() written to the table ``at``/memories, batch by batch; a batch that is run again after a failure replaces its own rows."""
    formed = form_memories(chunks, holdback, k, words)
    return formed.writeStream.format("parquet").option("path", f"{at}/memories").option("checkpointLocation", f"{at}/checkpoint").start()


class Multipliers(StatefulProcessor):
    """Of a session: its multiplier and samples, what the last compile armed, and the last id."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("multiplier", "m double, armed double, n long, last long", ttlDurationMs=self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m, armed, n, last = self.kept.get() if self.kept.exists() else (1.0, 0.0, 0, -1)
        came, late = _gathered(rows, ["id"]), 0
        for i, arms, reported in zip(came["id"], came["armed"], came["reported"], strict=True):
            if i <= last:
                late += 1
                continue
            last = i
            if not pd.isna(arms):
                armed = arms
            elif reported > 0 and isfinite(reported) and armed > 0:
                ratio, armed = reported / armed, 0.0
                if LOW <= ratio <= HIGH:
                    m, n = min(HIGH, max(LOW, m + ALPHA * (ratio * m - m))), n + 1
        self.kept.update((float(m), float(armed), int(n), int(last)))
        yield pd.DataFrame([(key[0], m, n, late)], columns=["session_id", "multiplier", "samples", "late"])


def calibrate(usage: DataFrame, idle: int | None = None) -> DataFrame:
    """Per session and batch: the multiplier after it, of compiles and reports (session_id, id, armed, reported) as they arrive, and how many
    came late, after a later one, and count for nothing. The rule is ledger.calibrate's; a session's state goes after ``idle`` ms without use."""
    return typed_state(usage).groupBy("session_id").transformWithStateInPandas(Multipliers(idle), "session_id string, multiplier double, samples long, late long", "Update", "ProcessingTime" if idle else "None")


class PostTimes(StatefulProcessor):
    """Of a member of a channel: the times of its accepted posts of the last day. A timer lets them go a day after the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.made = handle, handle.getListState("made", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        made = [t for (t,) in self.made.get()] if self.made.exists() else []
        out = []
        came = _gathered(rows, ["at", "event_id"])
        for event, at, cap in zip(came["event_id"], came["at"], came["cap"], strict=True):
            now = int(at.timestamp() * 1e6)
            made = [t for t in made if t >= now - DAY]
            good = len(made) < cap
            if good:
                made.append(now)
            out.append((*key, event, good, max(0, cap - len(made))))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if made:
            self.made.put([(t,) for t in made])
            self.handle.registerTimer(max(made[-1] // 1000 + DAY // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        else:
            self.made.clear()
        yield pd.DataFrame(out, columns=["channel", "session_id", "event_id", "accepted", "remaining"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.made.clear()
        yield pd.DataFrame({"channel": [], "session_id": [], "event_id": [], "accepted": [], "remaining": []}).astype({"channel": str, "session_id": "int64", "event_id": "int64", "accepted": bool, "remaining": "int64"})


def rate_limit(posts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each post (channel, session_id, event_id, at, cap) as it arrives: accepted or not, and how many are left. Only accepted posts
    count; the state is their times within the last day, at most ``cap``, and goes a day after the last one."""
    rows = typed_state(posts).withWatermark("at", lateness).groupBy("channel", "session_id")
    return rows.transformWithStateInPandas(PostTimes(), "channel string, session_id long, event_id long, accepted boolean, remaining long", "Append", "EventTime")


def usage_windows(usage: DataFrame, size: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tokens per session in windows, tumbling or, with a slide, sliding; the same on a batch and on a stream."""
    rows = usage.withWatermark("at", lateness).groupBy(F.window("at", size, slide), "session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return rows.select("session_id", F.col("window.start").alias("start"), "tokens", "n")


def usage_sessions(usage: DataFrame, gap: str = "6 hours", lateness: str = "10 minutes") -> DataFrame:
    """Tokens per session in stretches of use that no ``gap`` parts."""
    rows = usage.withWatermark("at", lateness).groupBy(F.session_window("at", gap), "session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return rows.select("session_id", F.col("session_window.start").alias("start"), "tokens", "n")


def dedupe_append(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A message id that arrives again within the lateness counts once."""
    return messages.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["session_id", "id"])
