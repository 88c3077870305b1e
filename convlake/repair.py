"""Turns as a provider takes them, as rows of blocks: splitting, joining, pairing calls with results (T1-T5), requests of merges
(T13), finding a log in a transcript (T19), and images that go (W7).

Blocks are rows (session_id, id, pos, participant, type, call, text): ``id`` orders a session's entries, ``pos`` an entry's blocks, and
``call`` is a call's id or the id that a result answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pricing import trim_js

# Fixed values of the rules: what stands for a call left out, for a result that is missing, between joined turns, and for an image.
OMITTED = "[tool call omitted]"
STUB = "[tool result unavailable — omitted during context compression]"
SEPARATOR = "\n\n---\n\n"
STRIPPED = "[image stripped]"
LOOKAHEAD = 6
#: Blocks that a task sorts at once when entries are split and turns joined (a session is not split for the latter).
TASK_BLOCKS = 200_000
#: Tasks that a scan's blocks are dealt to at most for splitting: what a task writes for more than 200 others is held in its memory first.
SPLIT_TASKS = 200
BLOCKS = ["session_id", "id", "pos", "participant", "type", "call", "text"]


def _text(kind: str) -> list[Column]:
    return [F.lit("text").alias("type"), F.lit(None).cast("string").alias("call"), F.lit(kind).alias("text")]


def tasks_for(blocks: DataFrame) -> int:
    """Tasks that ``blocks`` need: a task's memory follows from how many blocks it gets, not from their compressed size."""
    return -(-blocks.count() // TASK_BLOCKS)


def _dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), *keys)


def split_turns(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks with their ``part``: an entry that isn't the user's and holds results becomes runs of its own blocks and user
    turns of results. ``tasks``: tasks_for(), where it is known."""
    tasks = tasks_for(blocks) if tasks is None else tasks
    blocks = _dealt(blocks, min(tasks, SPLIT_TASKS), "session_id", "id")
    by = Window.partitionBy("session_id", "id").orderBy("pos")
    result, mixed = F.col("type") == "tool_result", F.lower("participant") != "user"
    change = F.coalesce((mixed & (result != F.lag(result).over(by))).cast("int"), F.lit(0))
    numbered = blocks.withColumn("_c", change).withColumn("part", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("participant", F.when(mixed & result, "user").otherwise(F.col("participant"))).drop("_c")


def join_turns(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Parts of entries as turns: a participant's consecutive ones are one turn, a rule between each. ``id`` counts turns from 0,
    ``pos`` their blocks. ``tasks``: tasks_for(), where it is known."""
    tasks = tasks_for(parts) if tasks is None else tasks
    by = Window.partitionBy("session_id").orderBy("id", "part", "pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    was = lambda c: F.col(c).eqNullSafe(F.lag(c).over(by))
    starts = F.row_number().over(by) == 1
    part = starts | ~(was("id") & was("part"))
    rows = _dealt(parts, tasks, "session_id").select("session_id", "id", "part", "pos", "participant", "type", "call", "text", part.alias("_p"), (starts | (part & ~was("participant"))).alias("_f"))
    rows = rows.withColumn("_rule", F.col("_p") & ~F.col("_f"))
    # a place counts a session's blocks and rules, less those before its turn
    rows = rows.withColumns({"_n": F.row_number().over(by) + F.count_if("_rule").over(so_far) - 1, "turn": F.count_if("_f").over(so_far) - 1})
    rows = rows.withColumn("_at", F.col("_n") - F.max(F.when(F.col("_f"), F.col("_n"))).over(so_far))
    own = F.struct(F.col("_at").cast("int").alias("pos"), "type", "call", "text")
    rule = F.struct((F.col("_at") - 1).cast("int").alias("pos"), *_text(SEPARATOR))
    return rows.select("session_id", F.col("turn").cast("long").alias("id"), "participant", F.explode(F.when(F.col("_rule"), F.array(rule, own)).otherwise(F.array(own))).alias("_b")).select("session_id", "id", "_b.pos", "participant", "_b.type", "_b.call", "_b.text")


def turns_of(blocks: DataFrame) -> DataFrame:
    """Entries split and joined: turns, with the blocks counted once."""
    tasks = tasks_for(blocks)
    return join_turns(split_turns(blocks, tasks), tasks)


def drop_unpaired(turns: DataFrame) -> DataFrame:
    """Blocks less calls and results whose partner is nowhere in the session; a turn that loses all it had says that a call was
    omitted."""
    tool = F.col("type").isin("tool_use", "tool_result")
    call = F.when(tool, F.col("call"))
    pair = Window.partitionBy("session_id", call, F.when(call.isNull(), F.col("id")))  # what is in no pair stays with its turn, in small groups
    paired = call.isNotNull() & (F.count_if(F.col("type") == "tool_use").over(pair) > 0) & (F.count_if(F.col("type") == "tool_result").over(pair) > 0)
    known = turns.select(*BLOCKS, (~F.coalesce(tool, F.lit(False)) | paired).alias("_s"))
    turn = Window.partitionBy("session_id", "id")
    marked = known.withColumns({"_n": F.count_if("_s").over(turn), "_k": F.row_number().over(turn.orderBy("pos"))}).where("_s or (_n = 0 and _k = 1)")
    said = [F.when(F.col("_s"), F.col(c)).otherwise(gone).alias(c) for c, gone in zip(("type", "call", "text"), _text(OMITTED), strict=True)]
    return marked.select("session_id", "id", "pos", "participant", *said)


def normalize_turns(blocks: DataFrame) -> DataFrame:
    """Entries as turns: split, joined, unpaired calls dropped, then blank texts and empty turns."""
    paired = drop_unpaired(turns_of(blocks))
    return paired.where((F.col("type") != "text") | (F.length(trim_js(F.col("text"))) > 0))


def pair_tools(blocks: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """Entries in which each result answers a call of the entry just before, once; others go. A call that the next entry doesn't
    answer gets its result from the ``ahead`` entries after that, else a stub: before that entry's blocks if it answers any call, else
    in a user's entry of its own before it; after the last entry, stubs.

    An entry is judged by the given one before it, as what is put in between answers all and calls nothing. ``id`` counts
    entries from 0 in steps of 2, so that those put in have odd ones; ``given`` is the entry's old id, or null.
    """
    each = Window.partitionBy("session_id")
    at = F.dense_rank().over(each.orderBy("id")) - 1
    rows = blocks.withColumn("_at", at).withColumn("_last", F.max("_at").over(each))
    first = lambda kind: rows.where(F.col("type") == kind).groupBy("session_id", "_at", "call").agg(F.min("pos").alias("pos"))
    calls = first("tool_use").select("session_id", (F.col("_at") + 1).alias("_at"), "call", F.col("pos").alias("_order"))
    answers = first("tool_result").join(calls.hint("merge"), ["session_id", "_at", "call"], "left_semi")
    # results that stay, and entries that lose all they had
    keeps = rows.join(answers.select("session_id", "_at", "pos", F.lit(True).alias("_a")).hint("merge"), ["session_id", "_at", "pos"], "left")
    keeps = keeps.withColumn("_s", (F.col("type") != "tool_result") | F.col("_a").isNotNull())
    inside = Window.partitionBy("session_id", "_at")
    keeps = keeps.withColumns({"_n": F.count_if("_s").over(inside), "_k": F.row_number().over(inside.orderBy("pos")), "_answered": F.count_if(F.col("_a").isNotNull()).over(inside)})
    named = ["session_id", (2 * F.col("_at")).alias("id"), F.col("id").alias("given"), F.lit(1).alias("_part"), F.col("pos").alias("_pos"), "participant"]
    stay = keeps.where("_s").select(*named, "type", "call", "text")
    gone = keeps.where("_n = 0 and _k = 1").select(*named, *_text(OMITTED))
    # calls without an answer
    missing = calls.join(answers.hint("merge"), ["session_id", "_at", "call"], "left_anti")
    entries = keeps.groupBy("session_id", "_at").agg(F.first("id").alias("given"), F.first("participant").alias("participant"), F.max("_answered").alias("_answered"), F.max("_last").alias("_last"))
    found = rows.where("type = 'tool_result'").select("session_id", "call", F.col("_at").alias("_from"), "pos", F.col("text").alias("_text"))
    later = (F.col("_from") > F.col("_at")) & (F.col("_from") <= F.col("_at") + ahead)
    near = missing.hint("merge").join(found, ["session_id", "call"]).where(later).groupBy("session_id", "_at", "call").agg(F.min_by("_text", F.struct("_from", "pos")).alias("_text"), F.lit(True).alias("_f"))
    made = missing.join(near.hint("merge"), ["session_id", "_at", "call"], "left").join(entries.hint("merge"), ["session_id", "_at"], "left")
    own = F.coalesce(F.col("_answered") > 0, F.lit(False))
    put = made.select(
        "session_id", (2 * F.col("_at") - F.when(own, 0).otherwise(1)).alias("id"), F.when(own, F.col("given")).alias("given"), F.lit(0).alias("_part"), F.col("_order").alias("_pos"),
        F.when(own, F.col("participant")).otherwise("user").alias("participant"), F.lit("tool_result").alias("type"), "call", F.when(F.col("_f"), F.col("_text")).otherwise(STUB).alias("text"),
    )
    out = stay.unionByName(gone).unionByName(put)
    place = F.row_number().over(Window.partitionBy("session_id", "id").orderBy("_part", "_pos")) - 1
    return out.select("session_id", "id", place.alias("pos"), "participant", "type", "call", "text", "given")


def assemble_merge(recalls: DataFrame, runs: DataFrame, targets: DataFrame, instruction: str, lines: dict[str, str] | None = None) -> DataFrame:
    """A merge's request, as rows (session_id, section, ord, text): 1 recalls (session_id, first, last, text) that end before
    the run, 2 what the run is shown as (targets: session_id, ord, text, refused: the run itself, else one level deeper), 3 the
    instruction, with the line that the last outcome asks for.

    ``runs`` has a row for each session: session_id, first, refused, outcome.
    """
    at = runs.select("session_id", F.col("first").alias("_t"), "refused")
    before = recalls.join(at.drop("refused").hint("merge"), "session_id").where(F.col("last") < F.col("_t"))
    shown = targets.join(at.drop("_t").hint("merge"), ["session_id", "refused"])
    extra = F.create_map(*[F.lit(x) for pair in lines.items() for x in pair])[F.col("outcome")] if lines else F.lit(None).cast("string")
    told = runs.select("session_id", F.lit(3).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit(instruction), F.coalesce(extra, F.lit(""))).alias("text"))
    one = before.select("session_id", F.lit(1).alias("section"), F.col("first").cast("long").alias("ord"), "text")
    two = shown.select("session_id", F.lit(2).alias("section"), F.col("ord").cast("long").alias("ord"), "text")
    return one.unionByName(two).unionByName(told)


def _tails(texts: DataFrame, by: list[str]) -> DataFrame:
    """Of texts (``by``, t): for each number n of last lines a 128-bit hash of them (h1, h2), from hashes of the lines by their places from the end."""
    lines = texts.select(*by, F.posexplode(F.reverse(F.split("t", "\n", -1))).alias("n", "_line"))
    run = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "n", "_line")).over(run)
    return lines.select(*by, "n", mark(1).alias("h1"), mark(2).alias("h2"))


def align_transcript(log: DataFrame, transcript: DataFrame) -> DataFrame:
    """Where each session's transcript takes up its log: (session_id, matched, start).

    Of log messages (session_id, id, assistant, key, text) each is found, newest first, in the last transcript message (session_id, at,
    assistant, keys, texts, system, results) before the match of the one after it: by its key if it has one, else by its text, which
    may be the last lines of theirs. ``matched`` is the oldest match; ``start`` goes back from there to a message that is neither
    the system's nor holds results.

    Texts meet by how many lines they have and a hash of so many last lines, and are compared where these agree, so a text of very many
    lines takes a row for each.
    """
    side = ["session_id", "assistant"]
    by_key = transcript.select(*side, "at", F.explode("keys").alias("key")).distinct()
    keyed = log.where("key is not null").select(*side, "id", "key").hint("merge").join(by_key, [*side, "key"]).select("session_id", "id", "at")
    said = log.where("key is null").where(F.length(F.trim("text")) > 0).select(*side, "id", F.col("text").alias("t"))
    sent = transcript.select(*side, "at", F.posexplode("texts").alias("k", "t")).where("t is not null")
    every = _tails(said, [*side, "id"])
    asked = every.withColumn("_all", F.max("n").over(Window.partitionBy(*side, "id"))).where("n = _all").drop("_all")
    met = asked.hint("merge").join(_tails(sent, [*side, "at", "k"]), [*side, "n", "h1", "h2"]).select(*side, "id", "at", "k")
    both = met.join(said.withColumnRenamed("t", "_mine").hint("merge"), [*side, "id"]).join(sent.withColumnRenamed("t", "_theirs").hint("merge"), [*side, "at", "k"])
    same = (F.col("_theirs") == F.col("_mine")) | F.endswith("_theirs", F.concat(F.lit("\n"), "_mine"))
    places = keyed.unionByName(both.where(same).select("session_id", "id", "at")).groupBy("session_id", "id").agg(F.collect_set("at").alias("ats"))
    items = F.reverse(F.array_sort(F.collect_list(F.struct("id", "ats"))))  # what a log message may be, newest first
    end = F.lit(2**62)
    fold = F.aggregate(items, end, lambda e, m: F.coalesce(F.array_max(F.filter(m["ats"], lambda a: a < e)), e))
    matched = places.groupBy("session_id").agg(fold.alias("matched")).where(F.col("matched") < end)
    starts = transcript.where("not system and not results").select("session_id", "at")
    near = matched.join(starts.hint("merge"), "session_id", "left").groupBy("session_id", "matched").agg(F.max(F.when(F.col("at") <= F.col("matched"), F.col("at"))).alias("start"))
    return near.select("session_id", "matched", F.coalesce("start", F.lit(0)).cast("long").alias("start"))


def strip_images(blocks: DataFrame, depth: int, count: int, price: int) -> DataFrame:
    """Blocks (session_id, id, pos, type, text) with images past the newest ``count``, or with more than ``depth`` tokens after
    them, as a marker. What comes after counts ``price`` for each image and a quarter of each newer message's characters."""
    image = F.col("type") == "image"
    after = Window.partitionBy("session_id").orderBy(F.col("id").desc(), F.col("pos").desc())
    said = F.when(image, 0).otherwise(F.coalesce(F.length("text"), F.lit(0)))
    whole = Window.partitionBy("session_id", "id")
    ends = F.when(F.row_number().over(whole.orderBy("pos")) == 1, F.floor(F.sum(said).over(whole) / 4)).otherwise(0)  # once a message, after its blocks
    rows = blocks.withColumn("_w", ends + F.when(image, price).otherwise(0)).withColumn("_i", image.cast("int"))
    deep = F.coalesce(F.sum("_w").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_d", deep).withColumn("_live", F.sum("_i").over(after.rowsBetween(Window.unboundedPreceding, 0)))
    gone = image & ((F.col("_d") > depth) | (F.col("_live") > count))
    return rows.select("session_id", "id", "pos", F.when(gone, "text").otherwise(F.col("type")).alias("type"), F.when(gone, STRIPPED).otherwise(F.col("text")).alias("text"))
