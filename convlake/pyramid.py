"""Derived work (D), the summary pyramid (M) and what is shown under a budget (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import owner_of
from .plans import growth, meeting
from .pricing import digest_words, trim_js, utf16_len, written_tokens


def l1_due(chunks: DataFrame, memories: DataFrame, holdback: int, demanded: DataFrame | None = None) -> DataFrame:
    """Chunks without an L1, less the newest ``holdback`` that nobody demands (session_id, chunk_id)."""
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("chunk_id").desc()))
    held = F.col("k") <= holdback
    open_ = chunks.withColumn("k", newest)
    if demanded is None:
        open_ = open_.where(~held)
    else:
        wanted = demanded.select("session_id", "chunk_id", F.lit(True).alias("_d")).distinct()
        open_ = open_.join(wanted.hint("merge"), ["session_id", "chunk_id"], "left").where(~held | F.col("_d").isNotNull()).drop("_d")
    open_ = open_.drop("k")
    return open_.join(memories.where("level = 1").select("session_id", F.col("id").alias("chunk_id")).hint("merge"), ["session_id", "chunk_id"], "left_anti")


def quiet_stub(log: DataFrame, chunks: DataFrame, least: int) -> DataFrame:
    """Chunks of text blocks alone (a message's ``text_only``) with so little text that they get a fixed memory."""
    owned = owner_of(log, chunks).where("chunk_id is not null")
    sized = owned.groupBy("session_id", "chunk_id").agg(F.sum(utf16_len(trim_js(F.col("text")))).alias("chars"), F.bool_and("text_only").alias("_t"))
    return sized.where(F.col("_t") & (F.col("chars") < least)).drop("_t")


def protected_chunks(chunks: DataFrame, pins: DataFrame) -> DataFrame:
    """Chunks whose range meets a pinned range of their session."""
    return meeting(chunks, pins.select("session_id", F.col("first").cast("long").alias("at"), F.col("last").cast("long").alias("end")))


def chunk_texts(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each chunk's text (session_id, chunk_id, text, first, last): its messages, a blank between them."""
    owned = owner_of(log, chunks.select("session_id", "chunk_id", "first", "last")).where("chunk_id is not null")
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))  # a chunk's messages
    text = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    return owned.groupBy("session_id", "chunk_id").agg(text.alias("text"), F.min("id").alias("first"), F.max("id").alias("last"))


def max_level(memories: DataFrame) -> DataFrame:
    return memories.groupBy("session_id").agg(F.max("level").alias("level"))


def profile(nodes: DataFrame) -> DataFrame:
    """How many nodes stand at each level."""
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


def mint_l1(log: DataFrame, chunks: DataFrame, words: int = 40) -> DataFrame:
    """A memory for each chunk: the leading words of its text stand in for a summary."""
    made = chunk_texts(log, chunks).withColumn("text", digest_words(F.col("text"), words))
    return made.select("session_id", F.lit(1).alias("level"), F.col("chunk_id").alias("id"), "first", "last", "text", written_tokens(F.col("text")).alias("tokens"))


def merge_by_count(memories: DataFrame, k: int, words: int = 40) -> DataFrame:
    """All levels: entry p of the next level takes entries p*k .. p*k+k-1 of the one below.

    How many levels there are follows from the largest id. ``memories`` is read once for each, so it should be a table.
    """
    most = memories.agg(F.max("id")).first()[0]
    left = 0 if most is None else (most + 1) // k
    out, level = memories, memories
    while left:
        parts = F.array_sort(F.collect_list(F.struct("id", "text")))  # at most k
        up = level.groupBy("session_id", F.floor(F.col("id") / k).cast("long").alias("p"), (F.col("level") + 1).alias("up")).agg(F.count("*").alias("n"), parts.alias("parts"), F.min("first").alias("first"), F.max("last").alias("last"))
        text = digest_words(F.array_join(F.transform("parts", lambda x: x["text"]), " "), words)
        level = up.where(F.col("n") == k).select("session_id", F.col("up").alias("level"), F.col("p").alias("id"), "first", "last", text.alias("text")).withColumn("tokens", written_tokens(F.col("text")))
        out, left = out.unionByName(level), left // k
    return out


def age_band(age: str | F.Column, zone: int, k: int, protected: F.Column | None = None) -> F.Column:
    """How many levels an age allows: -1 if protected, 0 when younger than the zone, else by powers of k (2 or more), compared as integers:
    a long has fewer than 64 of them."""
    ratio = F.floor((F.col(age) if isinstance(age, str) else age) / zone)
    powers = [k**i for i in range(64) if k**i < 2**63]
    band = F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: ratio >= p))
    return F.when(F.lit(False) if protected is None else protected, -1).otherwise(band)


def fold_to_target(chunks: DataFrame, memories: DataFrame, edges: DataFrame, window: int, slack: float) -> DataFrame:
    """Per session: tokens before and after, and the folds applied. Over ``window`` the lowest level's oldest group
    folds, again and again, until the total is at most window * (1 - slack).

    Each fold saves a fixed amount and they apply in order of (level, first), so the loop is a running sum.
    """
    saving = growth(chunks, memories, edges).select("session_id", "level", "id", "first", F.col("growth").alias("saving"))
    totals = chunks.groupBy("session_id").agg(F.sum("raw").alias("before"))
    by = Window.partitionBy("session_id").orderBy("level", "first")
    saved = F.coalesce(F.sum("saving").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = saving.join(totals.hint("merge"), "session_id").withColumn("left", F.col("before") - saved)
    lowest = F.min("left").over(by.rowsBetween(Window.unboundedPreceding, 0))
    target = float(window * (1 - slack))
    applied = rows.withColumn("lowest", lowest).where((F.col("before") > window) & (F.col("lowest") > target))
    folded = applied.groupBy("session_id").agg(F.sum("saving").alias("saved"), F.count("*").alias("folds"))
    return totals.join(folded.hint("merge"), "session_id", "left").select("session_id", "before", (F.col("before") - F.coalesce("saved", F.lit(0))).alias("after"), F.coalesce("folds", F.lit(0)).alias("folds"))
