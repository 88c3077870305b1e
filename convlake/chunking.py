"""Windows over a log (W) and chunks of it (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept
from .segments import SLICE, segments
from .sources import by_id, newest_first


def crossing(priced: DataFrame, limit: int, newest: bool = False) -> DataFrame:
    """Per session: how many items come before the running total first exceeds ``limit`` (null: it never does)."""
    order = newest_first() if newest else by_id()
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return priced.select("session_id", F.row_number().over(order).alias("k"), total.alias("t")).groupBy("session_id").agg((F.min(F.when(F.col("t") > limit, F.col("k"))) - 1).alias("inside"))


def head_end(priced: DataFrame, limit: int, chunks: DataFrame | None = None) -> DataFrame:
    """Where the head window ends; a tool call just before the edge stays with its result. Once a session has a closed chunk
    the head ends where its first one starts, and never moves."""
    total = F.sum("tokens").over(by_id().rowsBetween(Window.unboundedPreceding, 0))
    rows = priced.select("session_id", "id", total.alias("t"), F.lag("tool_use", 1, False).over(by_id()).alias("call"))
    over = F.when(F.col("t") > limit, F.struct("id", "call"))
    found = rows.groupBy("session_id").agg(F.min(over).alias("x"), F.count("*").alias("n"))
    free = F.coalesce(F.col("x.id") - F.col("x.call").cast("int"), F.col("n"))
    if chunks is None:
        return found.select("session_id", free.alias("head_end"))
    frozen = chunks.groupBy("session_id").agg(F.min_by("first", "chunk_id").alias("_f"))
    return found.join(frozen.hint("merge"), "session_id", "left").select("session_id", F.coalesce("_f", free).alias("head_end"))


def tail_start(priced: DataFrame, limit: int) -> DataFrame:
    """Where the tail window starts; a tool result first in it brings its call in."""
    total = F.sum("tokens").over(newest_first().rowsBetween(Window.unboundedPreceding, 0))
    rows = priced.select("session_id", "id", total.alias("t"), F.lead("tool_result").over(by_id()).alias("answer"))
    over = F.when(F.col("t") > limit, F.struct("id", "answer"))
    found = rows.groupBy("session_id").agg(F.max(over).alias("x"))
    return found.select("session_id", F.coalesce(F.col("x.id") + 1 - F.coalesce(F.col("x.answer"), F.lit(False)).cast("int"), F.lit(0)).alias("tail_start"))


def raw_zone(chunks: DataFrame, head: int, tail_tokens: int, pinned: DataFrame | None = None) -> DataFrame:
    """Chunks shown raw: the first ``head``, the newest until the tail budget is used, and pinned ones (session_id, chunk_id)."""
    by = Window.partitionBy("session_id").orderBy("chunk_id")
    newer = F.sum("raw").over(Window.partitionBy("session_id").orderBy(F.col("chunk_id").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumn("k", F.row_number().over(by)).withColumn("newer", F.coalesce(newer, F.lit(0)))
    held = (F.col("k") <= head) | (F.col("newer") < tail_tokens)
    if pinned is not None:
        rows = rows.join(pinned.select("session_id", "chunk_id", F.lit(True).alias("_p")).distinct().hint("merge"), ["session_id", "chunk_id"], "left")
        held |= F.col("_p").isNotNull()
    return rows.where(held).select(*chunks.columns)


def _rows(priced: DataFrame, weight: F.Column, size: int, **others: F.Column) -> DataFrame:
    """Rows of segments(), of a log whose ids count from 0: slices are ranges of ids."""
    plain = {"less": F.lit(0).cast("long"), "closer": F.lit(True), "alone": F.lit(False), "span": F.lit(1).cast("long"), "extra": F.lit(None).cast("double")} | others
    return priced.select("session_id", "id", F.coalesce(weight, F.lit(0)).cast("long").alias("weight"), *[c.alias(n) for n, c in plain.items()], F.floor(F.col("id") / size).alias("slice"))


def chunk_of(priced: DataFrame, target: int, least: int, size: int = SLICE) -> DataFrame:
    """Each message (session_id, id, tokens) with its chunk_id, and whether that chunk is open. A run closes at ``target`` tokens over
    at least ``least`` messages and not on a tool call; the last run may stay open. A session is solved by slices of ``size`` ids."""
    rows = _rows(priced, F.col("tokens"), size, closer=~F.coalesce("tool_use", F.lit(False)))
    return segments(rows, target, least).select("session_id", "id", F.col("weight").alias("tokens"), "chunk_id", "open")


def close_chunks(priced: DataFrame, target: int, least: int, size: int = SLICE) -> DataFrame:
    """chunks(session_id, chunk_id, first, last, raw)."""
    closed = chunk_of(priced, target, least, size).where("not open")
    return closed.groupBy("session_id", "chunk_id").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("tokens").alias("raw"))


def spans(priced: DataFrame, target: int, least: int, size: int = SLICE) -> DataFrame:
    """chunks(session_id, chunk_id, first, last, raw, salience, group) where a message over twice the target is cut into
    ceil(tokens / target) chunks of its own, one group; it closes the open run first, however small that is.

    Needs tokens, ``cut`` (the price of what is left of a long text), salience and tool_use; a chunk is as salient as its least
    message.
    """
    long = F.coalesce(F.col("tokens") > 2 * target, F.lit(False))
    pieces = F.when(long, F.ceil(F.col("tokens") / target)).otherwise(1).cast("long")
    rows = _rows(priced, F.when(long, F.col("tokens")).otherwise(F.col("cut")), size, closer=~F.coalesce("tool_use", F.lit(False)), alone=long, span=pieces, extra=F.col("salience").cast("double"))
    closed = segments(rows, target, least).where("not open").groupBy("session_id", "chunk_id").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("weight").alias("raw"), F.min("extra").alias("salience"), F.max("alone").alias("_a"))
    n = F.when(F.col("_a"), F.ceil(F.col("raw") / target)).otherwise(1).cast("int")
    each = closed.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    group = F.when(F.col("_n") > 1, F.concat(F.lit("g"), "first"))
    return each.select("session_id", (F.col("chunk_id") + F.col("_k")).alias("chunk_id"), "first", "last", F.floor(F.col("raw") / F.col("_n")).cast("long").alias("raw"), "salience", group.alias("group"))


def groups_of(chunks: DataFrame) -> DataFrame:
    """The group of each chunk that is a shard."""
    return chunks.where("group is not null").select("session_id", "chunk_id", "group")


def fixed_chunks(log: DataFrame, size: int, held: int = SLICE) -> DataFrame:
    """Chunks of a log's texts of at most ``size`` characters, a line end between messages: (session_id, chunk_id, start_id, start_offset,
    end_id, end_offset, text). Texts come in pieces of at most ``size``; a piece that doesn't fit closes the chunk, and the last chunk stays open.

    Pieces are chosen by their sizes alone, by slices of ``held`` ids; texts are cut and joined after that. Ids
    are below 2^32.
    """
    texts = log.select("session_id", "id", F.coalesce("text", F.lit("")).alias("text"))
    count = F.ceil(F.length("text") / size).cast("int")
    pieces = kept(texts.where("text <> ''").select("session_id", "id", F.length("text").alias("_l"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_k")))
    own = F.least(F.lit(size), F.col("_l") - F.col("_k") * size)
    first = (F.col("_k") == 0).cast("long")
    # a piece after another message's weighs its line end too, but not as a chunk's first
    place = F.col("id") * 2**31 + F.col("_k")
    rows = pieces.select("session_id", place.alias("id"), (own + first).cast("long").alias("weight"), first.alias("less"), F.lit(True).alias("closer"), F.lit(False).alias("alone"), F.lit(1).cast("long").alias("span"), F.lit(None).cast("double").alias("extra"), F.floor(place / (held * 2**31)).alias("slice"))
    closed = segments(rows, size + 1, 1, before=True).where("not open")
    dealt = closed.select("session_id", "chunk_id", F.shiftright("id", 31).alias("id"), F.col("id").bitwiseAND(2**31 - 1).cast("int").alias("k"))
    met = dealt.hint("merge").join(texts, dealt["session_id"].eqNullSafe(texts["session_id"]) & (dealt["id"] == texts["id"])).select(dealt["session_id"], "chunk_id", dealt["id"], "k", F.substring("text", F.col("k") * size + 1, F.lit(size)).alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct("id", "k", "piece")))  # pieces of at most ``size`` characters in all
    text = F.array_join(F.transform("_p", lambda p, i: F.concat(F.when((i > 0) & (p["k"] == 0), "\n").otherwise(""), p["piece"])), "")
    last = F.element_at("_p", -1)
    made = met.groupBy("session_id", "chunk_id").agg(parts.alias("_p"))
    offset = lambda p: (p["k"] * size).cast("long")
    return made.select("session_id", "chunk_id", F.col("_p")[0]["id"].alias("start_id"), offset(F.col("_p")[0]).alias("start_offset"), last["id"].alias("end_id"), (offset(last) + F.length(last["piece"])).alias("end_offset"), text.alias("text"))


def owner_of(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk that holds each message: spans exploded to an equi-join."""
    ids = chunks.select("session_id", "chunk_id", F.explode(F.sequence("first", "last")).alias("id"))
    return log.join(ids.hint("merge"), ["session_id", "id"], "left")  # ids are unique, so the join makes no more rows


def open_start(log: DataFrame, chunks: DataFrame) -> DataFrame:
    ends = chunks.groupBy("session_id").agg((F.max("last") + 1).alias("start"))
    return log.select("session_id").distinct().join(ends.hint("merge"), "session_id", "left").select("session_id", F.coalesce("start", F.lit(0)).alias("open_start"))


def shard(priced: DataFrame, target: int) -> DataFrame:
    """Messages over twice the target as ceil(tokens / target) slices; the last takes the rest of the text."""
    pieces = F.ceil(F.col("tokens") / target).cast("int")
    cut = priced.where(F.col("tokens") > 2 * target).withColumn("pieces", pieces).withColumn("share", F.floor(F.length("text") / F.col("pieces")).cast("int"))
    rows = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    length = F.when(F.col("piece") < F.col("pieces") - 1, F.col("share")).otherwise(F.length("text"))
    return rows.select("session_id", "id", "piece", "pieces", F.substring("text", F.col("piece") * F.col("share") + 1, length).alias("slice"))


def runs(items: DataFrame) -> DataFrame:
    """Maximal runs of adjacent ids."""
    gap = (F.col("id") - F.lag("id").over(by_id()) != 1).cast("int")
    numbered = items.withColumn("gap", F.coalesce(gap, F.lit(1))).withColumn("run", F.sum("gap").over(by_id()))
    return numbered.groupBy("session_id", "run").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
