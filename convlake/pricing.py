"""Prices and text rules (P): all are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules: characters a token, the probe's length and share, and the characters that count as dense.
PROSE, DENSE, PROBE, SHARE = 2.9, 2.3, 2000, 0.12
DENSE_CLASS = r'[\x{7f}-\x{10ffff}{}\[\]":_/=`]'
JS_SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def utf16_len(s: Column) -> Column:
    return (F.length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def round_half_up(x: Column) -> Column:
    return (F.floor(x) + (x - F.floor(x) >= 0.5).cast("int")).cast("long")


def trim_js(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, f"^{JS_SPACE}+", ""), f"{JS_SPACE}+$", "")


def flat_tokens(s: Column) -> Column:
    return F.ceil(utf16_len(s) / 4.0).cast("long")


def _probe(s: Column) -> Column:
    """The first PROBE code units: as many characters, less those that astral ones push out; a split pair is dense."""
    head = F.substring(s, 1, PROBE)
    return F.when(utf16_len(head) <= PROBE, head).otherwise(F.decode(F.substring(F.encode(s, "UTF-16BE"), 1, 2 * PROBE), "UTF-16BE"))


def density_tokens(s: Column) -> Column:
    units = utf16_len(s)
    n = F.least(units, F.lit(PROBE))
    plain = F.length(F.regexp_replace(_probe(s), DENSE_CLASS, ""))
    rate = F.when((n - plain) / n > SHARE, DENSE).otherwise(PROSE)
    return F.when(units > 0, F.ceil(units / rate)).otherwise(0).cast("long")


def store_tokens(raw: Column, multiplier: float = 1.0) -> Column:
    """Rounded for each block, then summed."""
    return F.aggregate(raw, F.lit(0).cast("long"), lambda a, r: a + round_half_up(r * multiplier))


def external(s: Column) -> Column:
    """Characters of fenced code and bare link lines."""
    size = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + utf16_len(p))
    fenced = F.filter(F.split(s, "```"), lambda p, i: i % 2 == 1)
    links = F.filter(F.transform(F.split(s, "\n"), trim_js), lambda p: p.rlike(f"^https?://[^{JS_SPACE[1:-1]}]+$"))
    return size(fenced) + size(links)


def salience(s: Column) -> Column:
    """1 for talk, down to 0.2 for what exists elsewhere: fenced code and bare link lines."""
    total = utf16_len(s)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - 0.8 * F.least(F.lit(1.0), external(s) / total)))


def strip_thinking(s: Column) -> Column:
    closed = F.regexp_replace(s, r"(?is)^\s*<thinking>.*?</thinking>\s*", "")
    return F.when(s.rlike(r"(?is)^\s*<thinking>") & ~s.rlike(r"(?is)</thinking>"), "").otherwise(closed)


def written_tokens(s: Column, output: Column | None = None) -> Column:
    """A memory's price: the tokens its reply took if they are known, else a third of its characters."""
    third = F.ceil(utf16_len(s) / 3.0).cast("long")
    return third if output is None else F.when(output > 0, output.cast("long")).otherwise(third)


def recall_label(memory_id: Column) -> Column:
    return F.concat(F.lit("[CM] Recall memory "), memory_id.cast("string"), F.lit("."))


def recall_tokens(memory_id: Column, s: Column) -> Column:
    return flat_tokens(recall_label(memory_id)) + flat_tokens(s)


def words(s: Column) -> Column:
    return F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")


def digest_words(s: Column, n: int | None = 40) -> Column:
    """The leading ``n`` words; without one an eighth of them, 40 at least."""
    w = words(s)
    most = F.lit(n) if n is not None else F.greatest(F.lit(40), F.floor(F.size(w) / 8)).cast("int")
    return F.array_join(F.slice(w, F.lit(1), most), " ")


def halve_source(s: Column) -> Column:
    w = words(s)
    half = F.floor(F.size(w) / 2).cast("int")
    return F.array_join(F.slice(w, half + 1, F.size(w)), " ")


def repeats_tail(s: Column, n: int) -> Column:
    size = F.length(s)
    return (size > n) & F.contains(F.substring(s, F.lit(1), size - n), F.substring(s, size - n + 1, F.lit(n)))
