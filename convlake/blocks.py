"""Messages as arrays of blocks: their prices and their text (P)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import DENSE, density_tokens, external, flat_tokens, let, round_half_up, trim_js, utf16_len

BLOCK = "type string, text string, data string, id string, name string, input string, signature string, stamp double, bytes long, parts array<struct<type:string,text:string,stamp:double,bytes:bigint>>"
# Fixed values of the rules.
HIDDEN, CALL, IMAGE, MEDIA = 600, 20, 1600, 1000
IMAGE_CHARS, FLAT_IMAGE = 6400, 400
REASONING = ["thinking", "redacted_thinking"]


def block(kind: str, **fields: Column) -> Column:
    """A block with the fields given and nulls for the rest."""
    names = [f.split() for f in BLOCK.split(", ")]
    return F.struct(*[(F.lit(kind) if n == "type" else fields.get(n, F.lit(None))).cast(t).alias(n) for n, t in names])


def _fewest_digits(v: Column) -> Column:
    """A number that isn't negative, by the fewest digits that give the same double. Java before 19 writes some more, so 15 and 16 are tried."""
    told = v.cast("string")
    fewer = [F.format_string(f"%.{n}e", v) for n in (14, 15)]
    return F.when(F.length(told) > 15, F.coalesce(*[F.when(s.cast("double") == v, s) for s in fewer], told)).otherwise(told)


def number_lens(shown: Column) -> Column:
    """How many characters each JSON number of an array has as JavaScript writes it: with a point from 1e-6 up to 1e21, else with an exponent."""
    own = F.transform(shown, lambda x: F.struct(x.cast("double").alias("v"), _fewest_digits(F.abs(x.cast("double"))).alias("t")))
    parts = F.transform(own, lambda x: F.struct(x["v"], F.regexp_extract(x["t"], r"^(\d+)", 1).alias("whole"), F.regexp_extract(x["t"], r"\.(\d+)", 1).alias("part"), F.coalesce(F.regexp_extract(x["t"], r"[eE]\+?(-?\d+)$", 1).try_cast("int"), F.lit(0)).alias("power")))
    digits = F.transform(parts, lambda x: F.struct(x["v"], F.regexp_replace(F.concat(x["whole"], x["part"]), "^0+", "").alias("d"), (x["power"] - F.length(x["part"])).alias("power")))
    # the number is 0.digits times ten to n, of k digits without the zeros at their end
    placed = F.transform(digits, lambda x: F.struct(x["v"], (F.length(x["d"]) + x["power"]).alias("n"), F.length(F.regexp_replace(x["d"], "0+$", "")).alias("k")))

    def length(x: Column) -> Column:
        n, k = x["n"], x["k"]
        plain = F.when((k <= n) & (n <= 21), n).when((n > 0) & (n <= 21), k + 1).when((n > -6) & (n <= 0), k + 2 - n).otherwise(k + (k > 1).cast("int") + 2 + F.length(F.abs(n - 1).cast("string")))
        return F.when(F.abs(x["v"]) == float("inf"), 4).when(x["v"] == 0, 1).otherwise(plain + (x["v"] < 0).cast("int"))

    return F.transform(placed, length)


def json_len(s: Column) -> Column:
    """Length of the compact JSON text of ``s``, its numbers as JavaScript writes them."""
    return compact_len(F.to_json(F.parse_json(s)))


def compact_len(s: Column) -> Column:
    """The same of a text that is compact JSON already."""

    def longer(text: Column, numbers: Column) -> Column:
        more = F.zip_with(numbers, number_lens(numbers), lambda x, n: n - F.length(x))
        return F.aggregate(more, utf16_len(text).cast("int"), lambda a, x: (a + x).cast("int"))

    bare = lambda text: F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    return let(s, lambda text: let(F.regexp_extract_all(bare(text), F.lit(r"-?\d[\d.eE+-]*"), F.lit(0)), lambda numbers: longer(text, numbers)))


def _total(content: Column, price, kind: str = "double") -> Column:
    return F.aggregate(content, F.lit(0).cast(kind), lambda a, b: a + price(b).cast(kind))


def text_of(content: Column) -> Column:
    """The text blocks' text and a mark for each image, a line each."""
    shown = F.filter(content, lambda b: b["type"].isin("text", "image"))
    return F.array_join(F.transform(shown, lambda b: F.when(b["type"] == "image", "[image]").otherwise(b["text"])), "\n")


def text_only_tokens(b: Column) -> Column:
    """A quarter of the characters; a call's input and 20; nothing for other kinds."""
    said = b["type"].isin("text", "thinking", "tool_result") & b["text"].isNotNull()
    return F.when(said, flat_tokens(b["text"])).when(b["type"] == "tool_use", F.ceil(json_len(b["input"]) / 4.0) + CALL).otherwise(0)


def flat_tokens_of(content: Column) -> Column:
    """A quarter of all characters, an image counting as FLAT_IMAGE of them; a call's are its input's."""
    own = lambda b: F.when(b["type"] == "image", FLAT_IMAGE).otherwise(F.coalesce(F.length(F.when(b["type"] == "tool_use", b["input"]).otherwise(b["text"])), F.lit(0)))
    return F.floor(_total(content, own, "long") / 4).cast("long")


def content_salience(content: Column) -> Column:
    """1 for talk, down to 0.2 for what exists elsewhere: fenced code, bare link lines, what tools were given and gave, images."""
    size = lambda text: F.coalesce(utf16_len(text), F.lit(0)).cast("long")
    nested = lambda b: F.aggregate(F.coalesce(b["parts"], F.array()), F.lit(0).cast("long"), lambda a, p: a + F.when(p["type"] == "image", IMAGE_CHARS).otherwise(size(p["text"])))
    whole = lambda b: F.when(b["type"] == "image", F.lit(IMAGE_CHARS).cast("long")).when(b["type"] == "tool_use", json_len(F.coalesce(b["input"], F.lit("{}"))).cast("long")).otherwise(size(b["text"]) + nested(b))
    apart = lambda b: F.when(b["type"].isin("image", "tool_use", "tool_result"), whole(b)).when(b["type"] == "text", F.coalesce(external(b["text"]), F.lit(0))).otherwise(0)
    total = _total(content, whole, "long")
    return F.when(total <= 0, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - 0.8 * F.least(F.lit(1.0), _total(content, apart, "long") / total)))


def block_prices(content: Column) -> Column:
    """The uncalibrated price of each block, for store_tokens."""
    return F.transform(content, raw_tokens)


def raw_tokens(b: Column) -> Column:
    """The uncalibrated price by kind; a stamped estimate goes first for reasoning and images. A result of parts costs what
    they do."""
    part = lambda p: F.when(p["type"] == "image", F.coalesce(p["stamp"], F.lit(float(IMAGE)))).when(p["type"] == "text", F.coalesce(density_tokens(p["text"]), F.lit(0)).cast("double")).when(p["type"].isin("document", "audio", "video"), float(MEDIA)).otherwise(0.0)
    kind, text = b["type"], b["text"]
    hidden = (F.coalesce(b["signature"], F.lit("")) != "") & (F.coalesce(text, F.lit("")) == "")
    return (
        F.when(kind.isin(*REASONING, "image") & b["stamp"].isNotNull(), b["stamp"])
        .when((kind == "thinking") & hidden, HIDDEN)
        .when(kind.isin("thinking", "text"), F.coalesce(density_tokens(text), F.lit(0)))
        .when(kind == "redacted_thinking", F.when(F.length(b["data"]) > 0, round_half_up(utf16_len(b["data"]) / 6.0)).otherwise(HIDDEN))
        .when(kind == "tool_use", F.ceil(json_len(b["input"]) / DENSE) + CALL)
        .when((kind == "tool_result") & b["parts"].isNotNull(), F.aggregate(b["parts"], F.lit(0.0), lambda a, p: a + part(p)))
        .when(kind == "tool_result", F.coalesce(F.ceil(utf16_len(text) / DENSE), F.lit(0)))
        .when(kind == "image", IMAGE)
        .when(kind.isin("document", "audio", "video"), MEDIA)
        .otherwise(0)
    )


def image_bytes(content: Column) -> Column:
    return _total(content, lambda b: F.when(b["type"] == "image", F.coalesce(b["bytes"], F.lit(0))).otherwise(0), "long")


def message_price(messages: DataFrame) -> DataFrame:
    """What windows and chunks read of a message: kinds, raw, images, image_bytes, text_only, salience. Computed once."""
    c = F.col("content")
    return messages.withColumns({
        "kinds": F.array_sort(F.array_distinct(F.transform(c, lambda b: b["type"]))),
        "raw": _total(c, raw_tokens),
        "images": F.size(F.filter(c, lambda b: b["type"] == "image")).cast("long"),
        "image_bytes": image_bytes(c),
        "text_only": _total(c, text_only_tokens, "long"),
        "salience": content_salience(c),
    }).drop("content")


def well_formed(b: Column) -> Column:
    """A block has the fields that its kind needs."""
    kind, there = b["type"], lambda *names: F.array_max(F.array(*[b[n].isNull() for n in names])) == F.lit(False)
    return (
        F.when(kind.isin("text", "thinking"), there("text"))
        .when(kind == "redacted_thinking", there("data"))
        .when(kind == "tool_use", there("id", "name", "input"))
        .when(kind == "tool_result", there("id") & (b["text"].isNotNull() | b["parts"].isNotNull()))
        .when(kind.isin("image", "document", "audio", "video"), b["data"].isNotNull() | b["bytes"].isNotNull())
        .otherwise(F.lit(False))
    )


def strip_reasoning(content: Column) -> Column:
    return F.filter(content, lambda b: ~b["type"].isin(*REASONING))


def answer(content: Column, text: Column) -> Column:
    """A memory's recall: its blocks' text without reasoning if any of it is visible, else the memory's text."""
    said = F.filter(strip_reasoning(content), lambda b: b["type"] == "text")
    return F.when(F.exists(said, lambda b: trim_js(b["text"]) != ""), F.array_join(F.transform(said, lambda b: b["text"]), "\n")).otherwise(text)


def request_overhead(system: Column, tools: Column) -> Column:
    return density_tokens(system) + density_tokens(tools)


def usage_input(provider: Column, n: Column, written: Column, read: Column) -> Column:
    """The provider's count of a request's input; two providers count cache writes and reads apart. None above 0: null."""
    apart = F.lower(provider).isin("anthropic", "bedrock")
    total = n + F.when(apart, F.coalesce(written, F.lit(0)) + F.coalesce(read, F.lit(0))).otherwise(0)
    return F.when((n >= 0) & (total > 0), total)
