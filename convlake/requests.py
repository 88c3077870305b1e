"""Requests: what of a message is sent (P13, P22, P27, P28, W6, W8), how turns and sections go together (T), tasks (S16, F16, F17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .admission import admit
from .blocks import BLOCK, IMAGE
from .keep import kept as written
from .ledger import input_bound
from .plans import members
from .pricing import recall_label, trim_js

# Fixed values of the rules: an image's stand-in, the note of a cut text, how many calls a turn's summary lists.
PLACEHOLDER = 9
NOTE = "\n\n[truncated — original was {tokens} tokens]"
LISTED = 20
EXCHANGE = "id long, at double, session_id string, request string, status int, answer string, failure string"


def truncate_blocks(content: Column, cap: int) -> Column:
    """Texts up to ``cap`` tokens of four characters in all; the one that crosses it is cut and says its size, later ones
    go; other blocks stay."""
    start = F.struct(F.lit(4 * cap).alias("left"), F.array().cast(f"array<struct<{BLOCK}>>").alias("out"))

    def step(s, b):
        n, text = F.length(b["text"]), b["type"] == "text"
        note = F.concat(F.lit(NOTE.split("{")[0]), F.ceil(n / 4.0), F.lit(NOTE.split("}")[1]))
        cut = b.withField("text", F.concat(F.substring(b["text"], F.lit(1), s["left"]), note))
        out = F.when(text & (s["left"] <= 0), s["out"]).otherwise(F.array_append(s["out"], F.when(text & (n > s["left"]), cut).otherwise(b)))
        return F.struct(F.when(text, F.greatest(F.lit(0), s["left"] - n)).otherwise(s["left"]).alias("left"), out.alias("out"))

    size = F.aggregate(content, F.lit(0), lambda a, b: a + F.when(b["type"] == "text", F.length(b["text"])).otherwise(0))
    return F.when(F.floor(size / 4) <= cap, content).otherwise(F.aggregate(content, start, step, lambda s: s["out"]))


def brief(content: Column) -> Column:
    """A line for each block: text, calls, results and reasoning (no signature) as they are, an image's size, else the type."""
    kept = lambda b: F.when(b["type"].isin("text", "thinking", "tool_result"), b["text"]).when(b["type"] == "tool_use", b["input"]).when(b["type"] == "image", F.floor(b["bytes"] / 1024).cast("string"))
    return F.transform(content, lambda b: F.concat_ws(":", b["type"], kept(b)))


def render_prompt(rows: DataFrame, templates: dict[str, str], kind: str, fields: list[str]) -> DataFrame:
    """``prompt``: the kind's template with each {field} given its column's value."""
    text = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])[F.col(kind)]
    for f in fields:
        text = F.replace(text, F.lit("{" + f + "}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    return rows.withColumn("prompt", text)


#: Our wording of the six texts that a request for a memory is made of; {fields} as the rule fills them.
TEMPLATES = {
    "system": "You keep the memory of a long conversation.",
    "marker": "A new memory is about to be formed. What follows is the part of the conversation that it will hold.",
    "l1_chunk": "Write down what happened in the part above, from your own point of view, in about {target_tokens} tokens.",
    "reading_l1": "The part above is one portion of a text of {total_tokens} tokens. Write down what this portion says, in about {target_tokens} tokens.",
    "merge": "You have looked again at {seen_description}. Make one memory of level {target_level} of them, in about {target_tokens} tokens.",
    "reading_merge": "You have looked again at {seen_description}, of a text of {total_tokens} tokens. Make one reflection of level {target_level} of them, in about {target_tokens} tokens.",
}
# Fixed values of the rule: how a merge's sources are called, by whether they are of a reading and whether they are raw.
SEEN = {
    (False, True): "the slices of recent experience above (raw conversation)",
    (False, False): "the L{shown} memories above",
    (True, True): "the portions of text you read above (raw passages from a larger piece)",
    (True, False): "your earlier L{shown} reflections above on portions you read",
}


def seen_description(level: Column, reading: Column) -> Column:
    """How a merge that makes a memory of ``level`` calls what it is shown: what lies two levels below it, or raw messages."""
    shown = F.greatest(F.lit(0), level - 2)
    text = F.when(reading & (shown == 0), SEEN[True, True]).when(reading, SEEN[True, False]).when(shown == 0, SEEN[False, True]).otherwise(SEEN[False, False])
    return F.replace(text, F.lit("{shown}"), shown.cast("string"))


def memory_requests(targets: DataFrame, target_tokens: int, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``system``, ``user`` and ``scope`` of requests for memories, of targets (level, source, prefix, reading_tokens, source_only).

    A level of 1 asks with prefix, marker, source and instruction, without the prefix where ``source_only`` is set; a level above with prefix, source and
    instruction. Where the source is part of a larger text, reading_tokens says how large, and the reading's instruction is asked. Empty parts are left out.
    """
    reading, one = F.col("reading_tokens") > 0, F.col("level") == 1
    reading = F.coalesce(reading, F.lit(False))
    kind = F.when(one & reading, "reading_l1").when(one, "l1_chunk").when(reading, "reading_merge").otherwise("merge")
    fields = {"target_tokens": F.lit(target_tokens), "total_tokens": F.col("reading_tokens"), "target_level": F.col("level"), "seen_description": seen_description(F.col("level"), reading)}
    rows = targets.withColumn("_kind", kind).withColumns({f"_{k}": v for k, v in fields.items()})
    asked = render_prompt(rows, {k: v.replace("{", "{_") for k, v in templates.items()}, "_kind", [f"_{k}" for k in fields])
    bare = F.coalesce("source_only", F.lit(False)) & one
    parts = F.array(F.when(~bare, F.col("prefix")), F.when(one, templates["marker"]), F.col("source"), F.col("prompt"))
    user = F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")
    scope = F.when(bare, "source-only").when(one, "six-section").otherwise("prefix+one-level-deeper")
    return asked.withColumns({"system": F.lit(templates["system"]), "user": user, "scope": scope}).drop("_kind", "prompt", *[f"_{k}" for k in fields])


# Fixed values of the rule: tools whose calls aren't listed, how long a command is shown, what stands for a turn without a text.
UNLISTED = ["message", "finish"]
COMMAND = 80
SILENT = "(it ended the turn without saying anything)"


def shown_call(name: Column, arguments: Column) -> Column:
    """A call as a turn's end lists it, of its name and arguments (JSON): a command's first line, an edit's path, a search's words, else its name."""
    field = lambda k: F.coalesce(F.get_json_object(arguments, f"$.{k}"), F.lit(""))
    line = F.regexp_replace(F.substring_index(field("command"), "\n", 1), "\r$", "")
    command = F.concat(F.lit("$ "), F.when(F.length(line) > COMMAND, F.concat(F.substring(line, 1, COMMAND), F.lit("…"))).otherwise(line))
    return F.when(name == "bash", command).when(name == "edit", F.concat(F.lit("edit "), field("path"))).when(name == "web_search", F.concat(F.lit("web_search “"), field("query"), F.lit("”"))).otherwise(F.coalesce(name, F.lit("?")))


def turn_ended(blocks: DataFrame, name: str) -> DataFrame:
    """What a turn's partner hears at its end (session_id, turn, text), of its blocks (session_id, turn, id, pos, participant, type, text, call, name, input,
    failed): the last text that a reply has, then the calls of its replies, as shown_call has them, LISTED at most, failed ones marked and the others counted."""
    turn = ["session_id", "turn"]
    replies = blocks.where("participant = 'assistant'")
    failed = blocks.where("type = 'tool_result' and failed").select(*turn, "call", F.lit(True).alias("_f")).distinct()
    calls = replies.where((F.col("type") == "tool_use") & ~F.coalesce(F.col("name"), F.lit("")).isin(*UNLISTED)).select(*turn, "id", "pos", "call", shown_call(F.col("name"), F.col("input")).alias("s")).join(failed.hint("merge"), [*turn, "call"], "left")
    placed = calls.withColumn("_k", F.row_number().over(Window.partitionBy(*turn).orderBy("id", "pos")))
    listed = F.when(F.col("_k") <= LISTED, F.struct("_k", F.concat("s", F.when(F.col("_f"), " (failed)").otherwise("")).alias("s")))
    ran = placed.groupBy(*turn).agg(F.array_join(F.transform(F.array_sort(F.collect_list(listed)), lambda c: c["s"]), " · ").alias("_ran"), F.greatest(F.count("*") - LISTED, F.lit(0)).alias("_more"))
    texts = replies.where("type = 'text'").groupBy(*turn, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda b: b["text"]), "\n\n").alias("_t"))  # a message's blocks
    said = texts.where(trim_js(F.col("_t")) != "").groupBy(*turn).agg(F.max_by("_t", "id").alias("_said"))
    met = blocks.select(*turn).distinct().join(said.hint("merge"), turn, "left").join(ran.hint("merge"), turn, "left")
    more = F.when(F.col("_more") > 0, F.concat(F.lit(" · and "), "_more", F.lit(" more"))).otherwise("")
    told = F.when(F.col("_ran").isNotNull(), F.concat(F.lit(f"\n\nWhat {name} ran this turn: "), "_ran", more)).otherwise("")
    return met.select(*turn, F.concat(F.coalesce("_said", F.lit(SILENT)), told).alias("text"))


def turn_summary(blocks: DataFrame) -> DataFrame:
    """Per turn of blocks (session_id, turn, id, type, text, call, name, failed): the last text said, and up to LISTED calls
    in order, failed ones marked, with how many more there were."""
    turn = ["session_id", "turn"]
    failed = blocks.where("type = 'tool_result' and failed").select(*turn, "call", F.lit(True).alias("_f")).distinct()
    calls = blocks.where("type = 'tool_use'").select(*turn, "id", "call", "name").join(failed.hint("merge"), [*turn, "call"], "left")
    placed = calls.withColumn("_k", F.row_number().over(Window.partitionBy(*turn).orderBy("id")))
    shown = F.when(F.col("_k") <= LISTED, F.struct("_k", F.concat("name", F.when(F.col("_f"), " (failed)").otherwise("")).alias("s")))
    ran = placed.groupBy(*turn).agg(F.array_sort(F.collect_list(shown)).alias("_c"), F.greatest(F.count("*") - LISTED, F.lit(0)).alias("more"))
    said = blocks.groupBy(*turn).agg(F.max_by(F.when(F.trim("text") != "", F.col("text")), F.when((F.col("type") == "text") & (F.trim("text") != ""), F.col("id"))).alias("said"))
    listed = F.array_join(F.transform(F.coalesce("_c", F.array()), lambda c: c["s"]), " · ")
    return said.join(ran.hint("merge"), turn, "left").select(*turn, "said", listed.alias("calls"), F.coalesce("more", F.lit(0)).alias("more"))


def post_strip_tokens(messages: DataFrame, depth: int, count: int, size: int) -> DataFrame:
    """Prices (session_id, id, tokens, image, bytes) after images go: one is kept if the strictly newer messages hold at
    most ``depth`` tokens and it is admitted by count and bytes; a stripped one's price comes down to its stand-in."""
    newer = F.sum("tokens").over(Window.partitionBy("session_id").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumn("_d", F.coalesce(newer, F.lit(0)))
    near = F.col("_d") <= depth if depth else F.lit(True)
    kept = admit(rows.where(F.col("image") & near), count, size).withColumn("_kept", F.lit(True))
    gone = F.col("image") & F.col("_kept").isNull()
    return rows.join(kept.hint("merge"), ["session_id", "id"], "left").select("session_id", "id", (F.col("tokens") - F.when(gone, IMAGE - PLACEHOLDER).otherwise(0)).alias("tokens"))


def stripped_prices(messages: DataFrame, images: DataFrame, depth: int, count: int, size: int) -> DataFrame:
    """Prices (session_id, id, tokens) of messages after images go, of any number a message: images (session_id, id, pos, raw, bytes) are admitted newest
    message first and by their place in it, where the strictly newer messages hold at most ``depth`` tokens; one that isn't takes its ``raw`` price,
    less that of its stand-in, off its message's. Limits of 0 are none; images without a message are let go."""
    key = F.struct("session_id", "id").alias("_m")
    newer = F.sum("tokens").over(Window.partitionBy("session_id").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = written(messages.select(key, "session_id", "id", "tokens", F.coalesce(newer, F.lit(0)).alias("_d")))
    near = F.col("_d") <= depth if depth else F.lit(True)
    met = written(images.select(key, "session_id", "id", "pos", "raw", "bytes").join(rows.select("_m", near.alias("_near")).hint("merge"), "_m"))
    place = F.struct("session_id", "id", "pos").alias("_i")
    live = admit(met.where("_near"), count, size, ("pos",)).select(place)
    gone = met.withColumn("_i", place).join(live.hint("merge"), "_i", "left_anti").groupBy("_m").agg(F.sum(F.greatest(F.lit(0), F.col("raw") - PLACEHOLDER)).alias("_gone"))
    return rows.join(gone.hint("merge"), "_m", "left").select("session_id", "id", (F.col("tokens") - F.coalesce("_gone", F.lit(0))).alias("tokens"))


def live_price(messages: DataFrame, tails: DataFrame) -> DataFrame:
    """Prices with images counted in the tail window (session_id, tail_start) only."""
    outside = F.col("image") & (F.col("id") < F.col("tail_start"))
    return messages.join(tails.hint("merge"), "session_id").select("session_id", "id", (F.col("tokens") - F.when(outside, IMAGE).otherwise(0)).alias("tokens"))


def split_mixed_turns(blocks: DataFrame) -> DataFrame:
    """Parts of messages of blocks (session_id, id, pos, participant, type): one that isn't the user's and holds results
    becomes runs of its own blocks and user turns of results."""
    by = Window.partitionBy("session_id", "id").orderBy("pos")
    result = F.col("type") == "tool_result"
    mixed = F.lower("participant") != "user"
    change = F.coalesce((mixed & (result != F.lag(result).over(by))).cast("int"), F.lit(0))
    numbered = blocks.withColumn("_c", change).withColumn("part", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda b: b["type"]), ",")
    return numbered.groupBy("session_id", "id", "part", mixed.alias("_m"), "participant").agg(F.bool_or(result).alias("_r"), kinds.alias("kinds")).select("session_id", "id", "part", F.when(F.col("_m") & F.col("_r"), "user").otherwise(F.col("participant")).alias("participant"), "kinds")


def cap_images(images: DataFrame, size: int) -> DataFrame:
    """Images (session_id, id, bytes), each with whether it is kept: newest first while bytes fit; 0 keeps all."""
    kept = admit(images, 0, size).withColumn("_k", F.lit(True))
    return images.join(kept.hint("merge"), ["session_id", "id"], "left").select("session_id", "id", F.col("_k").isNotNull().alias("kept"))


def cap_nested_images(images: DataFrame, size: int) -> DataFrame:
    """Images (session_id, id, pos, part, bytes; part -1 for a block of its own, else its place in a result) with whether each is
    kept: newest turn first and in a turn's order while bytes fit; 0 keeps all."""
    kept = admit(images, 0, size, ("pos", "part")).withColumn("_k", F.lit(True))
    on = ["session_id", "id", "pos", "part"]
    return images.join(kept.hint("merge"), on, "left").select(*on, F.col("_k").isNotNull().alias("kept"))


def admit_request(sized: DataFrame, reserve: int, budget: int) -> DataFrame:
    """Requests (session_id, n: messages, bytes) with their estimate (bytes), their bound (with what roles and marks can add), and
    whether the bound and the output's reserve fit the budget; rejected ones keep both numbers."""
    bound = F.col("bytes") + 512 + 128 * F.col("n")
    return sized.select("session_id", F.col("bytes").alias("estimate"), bound.alias("bound"), (bound + reserve).alias("needed"), (bound + reserve <= budget).alias("admitted"))


def cache_marks(before: DataFrame, after: DataFrame, head: int) -> DataFrame:
    """Of entries (session_id, pos, key): the last of the head, the end of the unchanged prefix, and the last entry."""
    was = before.select("session_id", "pos", F.col("key").alias("_was"))
    rows = after.join(was.hint("merge"), ["session_id", "pos"], "left").groupBy("session_id").agg(F.min(F.when(~F.col("key").eqNullSafe(F.col("_was")), F.col("pos"))).alias("_d"), F.max("pos").alias("last"))
    return rows.select("session_id", F.least(F.lit(head) - 1, "last").alias("head"), (F.coalesce("_d", F.col("last") + 1) - 1).alias("same"), "last")


def assemble(log: DataFrame, recalls: DataFrame, target: DataFrame, head: int, marker: str, instruction: str) -> DataFrame:
    """A request's rows (session_id, section, ord, text) for a target (session_id, first, text) of each session: 1 head raw,
    2 recalls (first, last, text) and 3 messages no recall covers, 4 marker, 5 target, 6 instruction. Nothing follows the target's place in the log."""
    at = target.select("session_id", F.col("first").alias("_t"))
    before = log.join(at.hint("merge"), "session_id").where("id < _t")
    told = recalls.join(at.hint("merge"), "session_id").where((F.col("first") >= head) & (F.col("last") < F.col("_t")))
    held = told.select("session_id", F.explode(F.sequence("first", "last")).alias("id"))
    open_ = before.where(F.col("id") >= head).join(held.hint("merge"), ["session_id", "id"], "left_anti")
    row = lambda df, section, place, text: df.select("session_id", F.lit(section).alias("section"), place.cast("long").alias("ord"), text.alias("text"))
    parts = [
        row(before.where(F.col("id") < head), 1, F.col("id"), F.col("text")),
        row(told, 2, F.col("first"), F.col("text")),
        row(open_, 3, F.col("id"), F.col("text")),
        row(target, 4, F.lit(0), F.lit(marker)),
        row(target, 5, F.lit(0), F.col("text")),
        row(target, 6, F.lit(0), F.lit(instruction)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_only(request: DataFrame, refused: DataFrame) -> DataFrame:
    """Requests of refused sessions keep marker, target and instruction; others stay whole."""
    again = refused.select("session_id", F.lit(True).alias("_again")).distinct()
    return request.join(again.hint("merge"), "session_id", "left").where(F.col("_again").isNull() | (F.col("section") >= 4)).drop("_again")


def recall_variants(shown: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` other requests a session: in each, one shown memory (session_id, level, id, last) above level 1, newest
    first, gives way to the members that ``edges`` (session_id, level, id, member) name."""
    by = Window.partitionBy("session_id").orderBy(F.col("last").desc())
    tries = shown.where("level > 1").withColumn("variant", F.row_number().over(by)).where(F.col("variant") <= n).select("session_id", "variant", F.col("level").alias("_l"), F.col("id").alias("_i"))
    rest = shown.join(tries.hint("merge"), "session_id").where("not (level = _l and id = _i)").select("session_id", "variant", "level", "id")
    opened = edges.join(tries.hint("merge"), "session_id").where("level = _l and id = _i").select("session_id", "variant", (F.col("level") - 1).alias("level"), F.col("member").alias("id"))
    return rest.unionByName(opened)


def unpaired_turns(request: DataFrame) -> DataFrame:
    """The turns (session_id, pos) of a request's blocks (session_id, pos, part, type, call, text) that a provider would refuse: with a blank text, or a
    result whose call isn't in the turn before."""
    calls = request.where("type = 'tool_use'").select("session_id", (F.col("pos") + 1).alias("pos"), "call", F.lit(True).alias("_c")).distinct()
    met = request.join(calls.hint("merge"), ["session_id", "pos", "call"], "left")
    blank = (F.col("type") == "text") & (trim_js(F.coalesce("text", F.lit(""))) == "")
    return met.where(blank | ((F.col("type") == "tool_result") & F.col("_c").isNull())).select("session_id", "pos").distinct()


def admitted_variants(request: DataFrame, memories: DataFrame, edges: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """The first ``n`` other requests of a session (session_id, variant, level, id, pos, bound), newest memory first, in which a recalled memory above
    level 1 gives way to what it merged.

    The request is rows of blocks (session_id, pos, part, type, call, text, level, id), where the two turns of a recall, its label and its answer, name the
    memory (level, id) and others have nulls. A memory must be recalled once; the new request must be one that a provider takes (unpaired_turns), and its
    input and ``reserve`` fit ``budget`` (budgets: session_id, provider, reserve, budget): the input is the provider's count of the first request and what
    the variant adds to its bound, 1 at least, or the variant's bound where there is no count.
    """
    turns = request.groupBy("session_id", "pos").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("_b"), F.max("level").alias("level"), F.max("id").alias("id"))
    sized = turns.groupBy("session_id").agg(F.sum("_b").alias("_bytes"), F.count("*").alias("_turns"))
    bad = unpaired_turns(request)
    wrong = bad.groupBy("session_id").agg(F.count("*").alias("_bad"))
    marked = turns.where("level > 1").join(bad.withColumn("_w", F.lit(1)).hint("merge"), ["session_id", "pos"], "left")
    shown = marked.groupBy("session_id", "level", "id").agg(F.min("pos").alias("pos"), F.count("*").alias("_n"), F.max("pos").alias("_end"), F.sum("_b").alias("_own"), F.sum(F.coalesce("_w", F.lit(0))).alias("_mine"))
    shown = shown.where("_n = 2 and _end = pos + 1")
    parts = memories.select("session_id", F.col("level").alias("member_level"), F.col("id").alias("member"), F.octet_length(recall_label(F.concat_ws(":", "level", "id"))).alias("_label"), F.octet_length("text").alias("_text"), (trim_js(F.col("text")) == "").alias("_blank"))
    inner = members(edges).join(parts.hint("merge"), ["session_id", "member_level", "member"]).groupBy("session_id", "level", "id").agg(F.sum(F.col("_label") + F.col("_text")).alias("_new"), F.count("*").alias("_k"), F.bool_or("_blank").alias("_any"))
    ends = memories.select("session_id", "level", "id", "last")
    rows = shown.join(inner.hint("merge"), ["session_id", "level", "id"]).join(ends.hint("merge"), ["session_id", "level", "id"]).join(sized.hint("merge"), "session_id").join(wrong.hint("merge"), "session_id", "left").join(budgets.hint("merge"), "session_id")
    clean = ~F.col("_any") & (F.coalesce("_bad", F.lit(0)) == F.col("_mine"))
    first = input_bound(F.col("_turns"), F.col("_bytes"))
    bound = input_bound(F.col("_turns") + 2 * F.col("_k") - 2, F.col("_bytes") - F.col("_own") + F.col("_new"))
    taken = F.when(F.col("provider").isNull(), bound).otherwise(F.col("provider") + F.greatest(F.lit(1), bound - first))
    fit = rows.withColumn("bound", bound.cast("long")).where(clean & (taken + F.col("reserve") <= F.col("budget")))
    by = Window.partitionBy("session_id").orderBy(F.col("last").desc(), F.col("pos").desc())
    return fit.withColumn("variant", F.row_number().over(by)).where(F.col("variant") <= n).select("session_id", "variant", "level", "id", "pos", "bound")


def variant_requests(request: DataFrame, memories: DataFrame, edges: DataFrame, variants: DataFrame) -> DataFrame:
    """The blocks (session_id, variant, pos, part, type, call, text) of the requests that admitted_variants names, turns numbered anew."""
    at = variants.select("session_id", "variant", F.col("level").alias("_l"), F.col("id").alias("_i"), F.col("pos").alias("_p"))
    rest = request.join(at.hint("merge"), "session_id").where("pos < _p or pos > _p + 1").select("session_id", "variant", F.col("pos").alias("_a"), F.lit(0).cast("long").alias("_b"), F.lit(0).alias("_c"), "part", "type", "call", "text")
    parts = memories.select("session_id", F.col("level").alias("member_level"), F.col("id").alias("member"), "first", "text")
    inner = members(edges).withColumnsRenamed({"level": "_l", "id": "_i"}).join(at.hint("merge"), ["session_id", "_l", "_i"]).join(parts.hint("merge"), ["session_id", "member_level", "member"])
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t")) for k, t in enumerate((recall_label(F.concat_ws(":", "member_level", "member")), F.col("text")))]))
    new = inner.withColumn("_q", pair).select("session_id", "variant", F.col("_p").alias("_a"), F.col("first").alias("_b"), F.col("_q.k").alias("_c"), F.lit(0).alias("part"), F.lit("text").alias("type"), F.lit(None).cast(request.schema["call"].dataType).alias("call"), F.col("_q.t").alias("text"))
    place = F.dense_rank().over(Window.partitionBy("session_id", "variant").orderBy("_a", "_b", "_c")) - 1
    return rest.unionByName(new).withColumn("pos", place.cast("long")).drop("_a", "_b", "_c")


# --- exchanges, tasks


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Recorded requests and answers, with ``failed`` for those without a good answer."""
    return spark.read.schema(EXCHANGE).json(path).withColumn("failed", F.col("failure").isNotNull() | ~F.coalesce(F.col("status").between(200, 299), F.lit(False)))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task files ``board/column/NN-name.md`` below ``path``: title and owner from the front matter, description, comments."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.split(F.input_file_name(), "/").alias("p"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("t"))
    head = F.regexp_extract("t", r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    field = lambda name: F.regexp_replace(F.trim(F.regexp_extract("_h", rf"(?m)^\s*{name}\s*:(.*)$", 1)), "^[\"']+|[\"']+$", "")
    rows = raw.withColumn("_h", head).withColumn("_b", F.regexp_replace("t", r"(?s)^---\n.*?\n---(?:\n|$)", ""))
    parts = F.split("_b", r"(?im)^\s*## comments\s*$", 2)
    said = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"(?m)^\s*- (?=\*\*)"), lambda c: c.rlike(r"(?s)^\*\*.*?\*\*:"))
    comments = F.transform(said, lambda c: F.struct(F.trim(F.regexp_extract(c, r"(?s)^\*\*(.*?)\*\*:", 1)).alias("author"), F.regexp_replace(trim_js(F.regexp_replace(c, r"(?s)^\*\*.*?\*\*:", "")), r"\s*\n\s*", "\n").alias("text")))
    file = F.element_at("p", -1)
    named = F.replace(F.regexp_replace(F.regexp_replace(file, r"\.md$", ""), "^[0-9-]+", ""), F.lit("-"), F.lit(" "))
    owner = field("owner")
    return rows.select(F.element_at("p", -3).alias("board"), F.element_at("p", -2).alias("column"), file.alias("file"), F.try_to_number(F.regexp_extract(file, "^[0-9]+", 0), F.lit("999999999")).cast("long").alias("number"), F.when(field("title") != "", field("title")).otherwise(named).alias("title"), F.when(~owner.isin("", "none"), owner).alias("owner"), trim_js(F.get(parts, F.lit(0))).alias("description"), comments.alias("comments"))


def task_changes(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Whom a change of tasks (board, file, owner, comments) tells: a new owner unless they took it themselves, and an
    owner of each new comment by another."""
    was = before.select("board", "file", F.col("owner").alias("_o"), F.size("comments").alias("_n"))
    now = after.join(was.hint("merge"), ["board", "file"], "left").where("owner is not null")
    handed = now.where(~F.col("owner").eqNullSafe(F.col("_o")) & (F.col("owner") != by)).select("board", "file", F.col("owner").alias("to"), F.lit("handed").alias("what"), F.lit(None).cast("string").alias("text"))
    new = now.select("board", "file", "owner", "_n", F.posexplode("comments").alias("_p", "c")).where(F.col("_p") >= F.coalesce("_n", F.lit(0)))
    said = new.where(F.col("c.author") != F.col("owner")).select("board", "file", F.col("owner").alias("to"), F.lit("comment").alias("what"), F.col("c.text").alias("text"))
    return handed.unionByName(said)


def board_view(tasks: DataFrame) -> DataFrame:
    """Each column's tasks in order of their numbers, with their comments' counts."""
    cards = F.array_sort(F.collect_list(F.struct("number", "file", F.size("comments").alias("n"))))
    return tasks.groupBy("board", "column").agg(F.array_join(F.transform(cards, lambda c: F.concat(c["file"], F.lit(":"), c["n"])), ",").alias("tasks"))
