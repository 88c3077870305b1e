"""Messages whose blocks nest to any depth (P5, P9, P11, P12, P15): content as JSON, walked level by level as variants.

A level's results that hold blocks are exploded into the next one's rows. No level is shuffled; only the sums by
message are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import IMAGE_CHARS, block, compact_len, raw_tokens, text_only_tokens, well_formed
from .keep import kept
from .pricing import external, let, utf16_len


def _json(b: Column, path: str) -> Column:
    return F.try_variant_get(b, f"$.{path}", "variant")


def _string(b: Column, path: str) -> Column:
    """A field that is a string, else null."""
    return F.when(F.schema_of_variant(_json(b, path)) == "STRING", F.try_variant_get(b, f"$.{path}", "string"))


def _number(b: Column, path: str) -> Column:
    kind = F.schema_of_variant(_json(b, path))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(b, f"$.{path}", "double"))


def inner(b: Column) -> Column:
    """The blocks inside a result, else null."""
    return F.when(_string(b, "type") == "tool_result", F.try_variant_get(b, "$.content", "array<variant>"))


def typed(b: Column) -> Column:
    """A variant as a block of its own level: what is inside it has rows of its own."""
    kind = _string(b, "type")
    text = F.when(kind == "thinking", _string(b, "thinking")).when(kind == "tool_result", _string(b, "content")).otherwise(_string(b, "text"))
    base64 = (_string(b, "source.type") == "base64") & _string(b, "source.mediaType").isNotNull()
    source = F.when(base64, _string(b, "source.data")).when((kind == "image") & (_string(b, "source.type") == "url"), _string(b, "source.url"))
    data = F.when(kind.isin("image", "document", "audio", "video"), source).otherwise(_string(b, "data"))
    there = F.when(inner(b).isNotNull(), F.array().cast("array<struct<type:string,text:string,stamp:double,bytes:bigint>>"))
    # an input that isn't an object is priced as well, though a block with it is not well formed
    made = block("tool_use", text=text, data=data, id=F.coalesce(_string(b, "toolUseId"), _string(b, "id")), name=_string(b, "name"), input=F.to_json(_json(b, "input")), signature=_string(b, "signature"), stamp=_number(b, "tokenEstimate"), parts=there)
    return made.withField("type", kind)


def _opened(messages: DataFrame) -> DataFrame:
    """A row for each of a message's own blocks (b) with its place (pos); one without b for a message that has none."""
    return messages.select("session_id", "id", F.posexplode_outer(F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>")).alias("pos", "b"))


def walk(messages: DataFrame, levels: int | None = None) -> DataFrame:
    """The blocks of messages (session_id, id, content: a JSON array) at every depth: session_id, id, pos (the block of the message that it is
    in), depth (0: that block itself), b (variant), cut (whether it holds blocks that ``levels`` leaves unread).

    ``levels`` None walks to the end: a pass for each level that the deepest message has. A message without blocks, of null or broken content too, is
    one row without b; pairs of session_id and id have to be unique.
    """
    level = _opened(messages)
    out, depth = None, 0
    while True:
        last = levels is not None and depth >= levels
        holds = inner(F.col("b")).isNotNull()
        level = kept(level.withColumns({"depth": F.lit(depth), "cut": F.coalesce(holds & (F.size(inner(F.col("b"))) > 0), F.lit(False)) & F.lit(last)}))
        out = level if out is None else out.unionByName(level)
        if last or level.where(holds).isEmpty():
            return out
        level = level.where(holds).select("session_id", "id", "pos", F.explode(inner(F.col("b"))).alias("b"))
        depth += 1


def weight(b: Column) -> Column:
    """Characters of a message's block, and how many exist elsewhere: a result of blocks weighs as its JSON does."""

    def whole(kind: Column, said: Column) -> Column:
        field = F.when(kind == "tool_use", _json(b, "input")).otherwise(_json(b, "content"))
        shown = let(field, lambda v: F.coalesce(F.to_json(F.when(~F.is_variant_null(v), v)), F.when(kind == "tool_use", "{}").otherwise('""')))
        long = F.when(kind == "image", IMAGE_CHARS).when((kind == "tool_use") | ((kind == "tool_result") & said.isNull()), compact_len(shown)).when(kind.isin("tool_result", "text"), utf16_len(said))
        return F.coalesce(long, F.lit(0)).cast("long")

    def both(x: Column) -> Column:
        apart = lambda n: F.when(x["kind"] == "text", F.coalesce(external(x["said"]), F.lit(0))).otherwise(n).cast("long")
        return let(whole(x["kind"], x["said"]), lambda n: F.struct(n.alias("whole"), apart(n).alias("apart")))

    said = lambda kind: F.when(kind == "text", _string(b, "text")).when(kind == "tool_result", _string(b, "content"))
    return let(_string(b, "type"), lambda kind: let(F.struct(kind.alias("kind"), said(kind).alias("said")), both))


def _well_formed(b: Column, t: Column) -> Column:
    """Of a block without what is inside it; a generated image has its own fields, and only objects are inputs."""
    kind = t["type"]
    own = F.when(kind == "generated_image", _string(b, "data").isNotNull() & _string(b, "mimeType").isNotNull()).when(kind == "tool_use", well_formed(t) & F.schema_of_variant(_json(b, "input")).startswith("OBJECT"))
    signed = (kind != "thinking") | _json(b, "signature").isNull() | _string(b, "signature").isNotNull()
    return F.coalesce(own.when(kind == "tool_result", well_formed(t) & _string(b, "toolUseId").isNotNull()).otherwise(well_formed(t) & signed), F.lit(False))


def _salience(whole: Column, apart: Column) -> Column:
    return F.when(whole <= 0, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - 0.8 * F.least(F.lit(1.0), apart / whole)))


def nested_salience(messages: DataFrame) -> DataFrame:
    """nested_prices' salience alone (session_id, id, salience): a message's own blocks weigh as their whole JSON does, at any depth, so no
    level has to be opened."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    each = _opened(messages).select("session_id", "id", weight(F.col("b")).alias("w"))
    sums = each.groupBy("session_id", "id").agg(total("w.whole").alias("_w"), total("w.apart").alias("_a"))
    return sums.select("session_id", "id", _salience(F.col("_w"), F.col("_a")).alias("salience"))


def nested_prices(messages: DataFrame, levels: int | None = None) -> DataFrame:
    """A message (session_id, id) with prices (of each of its blocks, for store_tokens), raw (their sum), text, text_only, image_bytes, salience, good (blocks
    that are well formed with all inside them), depth (of its deepest block; null: none) and cut (how many results were left unread by ``levels``; what
    they hold is priced at 0)."""
    b = F.col("b")
    each = walk(messages, levels).withColumn("t", typed(b))
    top = lambda c: F.max(F.when(F.col("depth") == 0, c))
    shown = F.when(F.col("t.type") == "image", F.lit("[image]")).when(F.col("t.type") == "text", F.coalesce("t.text", F.lit("")))
    blocks = each.groupBy("session_id", "id", "pos").agg(
        F.sum(raw_tokens(F.col("t")).cast("double")).alias("raw"), F.max("depth").alias("depth"), F.count_if("cut").alias("cut"), F.bool_and(_well_formed(b, F.col("t"))).alias("good"),
        top(shown).alias("shown"), top(text_only_tokens(F.col("t")).cast("long")).alias("text_only"), top(F.when(F.col("t.type") == "image", utf16_len(_string(b, "source.data")))).alias("image_bytes"), top(weight(b)).alias("w"),
    )
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", c)))), lambda x: x[c])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    made = blocks.groupBy("session_id", "id").agg(
        listed("raw").alias("prices"), total(F.when(F.col("pos").isNotNull(), F.col("raw"))).cast("double").alias("raw"), F.array_join(listed("shown"), "\n").alias("text"),
        total("text_only").cast("long").alias("text_only"), total("image_bytes").cast("long").alias("image_bytes"), total("w.whole").alias("_w"), total("w.apart").alias("_a"),
        F.count_if(F.col("good") & F.col("pos").isNotNull()).alias("good"), F.max(F.when(F.col("pos").isNotNull(), F.col("depth"))).alias("depth"), F.sum("cut").alias("cut"),
    )
    return made.withColumn("salience", _salience(F.col("_w"), F.col("_a"))).drop("_w", "_a")
