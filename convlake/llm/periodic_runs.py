"""Periodic runs of words, found octave by octave in overlapping tiles and stitched by document and period.

A run of period q in the octave S <= q < 2S has at least 4q words, so it holds a boundary (a multiple of S) from
which 2S words on the words q apart are equal. A document's words are dealt out in overlapping tiles for each
octave, each solved by itself: which periods a boundary's Z-function passes 2S at is read off the names of the
2S-grams (prefix doubling, exact), and from there it is evaluated to both sides as far as the tile shows. Tiles
overlap so far that fragments of one run meet; they are shuffled by document and period and stitched as intervals.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Words of a tile's core, at least, a power of two; a tile reaches half of its core beyond it on both sides.
TILE = 1 << 16
#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
SOLVED = "row long, doc_id long, n long, text string, fragments array<struct<period:long,a:long,b:long>>"


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a document under the rule that makes some of them periodic; a document without an id stays as it is."""
    n, h = len(ids), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return ids[np.where(at < a, at, a + (at - a) % p)]


class Names:
    """Names of the 2^k-grams of a tile: two are equal just if the grams are. ``grams(k)`` has one for each place that holds a whole gram."""

    def __init__(self, ids: np.ndarray):
        self.levels, self.repeats = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], True

    def grams(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[:-step] * (len(last) + 1) + last[step:] if len(last) > step else last[:0]
            found, names = np.unique(pairs, return_inverse=True)
            self.levels.append(names.astype(np.int64))
            self.repeats = len(found) < len(pairs)
        return self.levels[k]

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` >= 1 words from i and from j on are equal: two grams that overlap cover them."""
        out, k = np.zeros(len(i), bool), np.frexp(length.astype(float))[1] - 1
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            names, rest = self.grams(int(level)), length[at] - (1 << int(level))
            out[at] = (names[i[at]] == names[j[at]]) & (names[i[at] + rest] == names[j[at] + rest])
        return out


def primitive(names: Names, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` words from start on aren't a shorter stretch repeated: none of period / prime is a period of theirs."""
    out, rest, factor = np.ones(len(start), bool), period.copy(), np.full(len(start), 2)
    while (going := np.flatnonzero(rest > 1)).size:
        hit = going[rest[going] % factor[going] == 0]
        if hit.size:
            part = period[hit] // factor[hit]
            out[hit] &= ~names.equal(start[hit], start[hit] + part, period[hit] - part)
            while (more := hit[rest[hit] % factor[hit] == 0]).size:
                rest[more] //= factor[more]
        factor[going] += 1
        last = going[(factor[going] ** 2 > rest[going]) & (rest[going] > 1)]
        factor[last] = rest[last]
    return out


def _extent(ids: np.ndarray, at: int, q: int, step: int) -> int:
    """The boundary's Z-function at q: how many words on (step 1) or back (step -1) from ``at`` equal those q further on."""
    size, done = 64, 0
    while True:
        left, right = (ids[at + done : at + done + size], ids[at + done + q : at + done + q + size]) if step > 0 else (ids[max(0, at - done - size) : at - done][::-1], ids[max(0, at - done - size) + q : at - done + q][::-1])
        n = min(len(left), len(right))
        apart = np.flatnonzero(left[:n] != right[:n])
        if apart.size:
            return done + int(apart[0])
        done += n
        if n < size:
            return done
        size *= 4


def solve_tile(ids: np.ndarray, names: Names, s: int, core: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Fragments (q, a, b) of a tile in the octave ``s``: for places a <= i < b words i and i + q are equal, q the smallest period there.

    Boundaries are the multiples of s in the core; two squares of primitive roots at most start at one in an octave.
    """
    k = s.bit_length()
    grams = names.grams(k)
    starts = np.arange(core[0], min(core[1], len(grams) - s), s)
    if not len(starts):
        return []
    found_c, found_q = [], []
    block = max(1, (1 << 20) // s)
    for lo in range(0, len(starts), block):
        c = starts[lo : lo + block]
        at = c[:, None] + np.arange(s, 2 * s)[None, :]
        same = (grams[np.minimum(at, len(grams) - 1)] == grams[c][:, None]) & (at < len(grams))
        row, col = np.nonzero(same)
        found_c.append(c[row])
        found_q.append(col + s)
    c, q = np.concatenate(found_c), np.concatenate(found_q)
    keep = primitive(names, c, q)
    c, q = c[keep], q[keep]
    order = np.lexsort((c, q))
    c, q = c[order], q[order]
    apart = (np.diff(q) != 0) | (np.diff(c) != s)
    opens, closes = np.flatnonzero(np.r_[len(c) > 0, apart]), np.flatnonzero(np.r_[apart, len(c) > 0])
    out = []
    for first, last in zip(opens, closes, strict=True):
        period, a, b = int(q[first]), int(c[first]), int(c[last]) + 2 * s
        out.append((period, a - _extent(ids, a, period, -1), b + _extent(ids, b, period, 1)))
    return out


def fragments_of(ids: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, int]]:
    """Fragments of all runs of a document, from all tiles of all octaves.

    Octaves whose tiles would be small share tiles (and the names in them); a wider octave has tiles of 8 times its
    least period. A core's tile shows half of the core more on either side, at least 4 times the octave's least period.
    """
    n, s = len(ids), 1
    while TIMES * s <= n:
        core = max(tile, 8 * s)
        octaves = [s << j for j in range(max(1, (core // 8 // s).bit_length())) if TIMES * (s << j) <= n]
        for x0 in range(0, n, core):
            lo, hi = max(0, x0 - core // 2), min(n, x0 + core + core // 2)
            words = ids[lo:hi]
            names = Names(words)
            for octave in octaves:
                names.grams(octave.bit_length())
                if not names.repeats:  # no gram so long stands twice here, so no longer one does
                    break
                yield from ((q, a + lo, b + lo) for q, a, b in solve_tile(words, names, octave, (x0 - lo, min(x0 + core, n) - lo)))
        s = octaves[-1] * 2


def joined(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one task that meet, put together before they are shuffled."""
    out: list[tuple[int, int, int]] = []
    for q, a, b in sorted(fragments):
        if out and out[-1][0] == q and a <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((q, a, b))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run (start, length, period) holds after its first period."""
    gone = np.zeros(len(words) + 1, int)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0))


def solved(docs: DataFrame, plant: bool, tile: int = TILE) -> DataFrame:
    """A row for each document: its words, joined by blanks, and fragments where it has any, else the digest of its words as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                seen: dict[bytes, int] = {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                if plant:
                    ids = planted(ids, doc)
                found = joined(list(fragments_of(ids, tile))) if len(ids) >= LEAST else []
                first = list(seen)
                said = b" ".join(first[i] for i in ids)
                out.append((row, doc, len(words), said.decode() if found else hashlib.sha256(said).hexdigest(), [dict(zip("period a b".split(), f, strict=True)) for f in found] or None))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("period", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["row", "doc_id", "n", "text", "fragments"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SOLVED)


def stitched(fragments: DataFrame) -> DataFrame:
    """runs (row, start, length, period) of fragments (row, period, a, b): those of a document and period that meet are one."""
    by = Window.partitionBy("row", "period").orderBy("a", "b")
    before = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = fragments.withColumn("_new", F.coalesce((F.col("a") > before).cast("int"), F.lit(1)))
    each = cut.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "period", "_run").agg(F.min("a").alias("start"), F.max("b").alias("b"))
    runs = each.select("row", "start", (F.col("b") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def document_runs(docs: DataFrame, plant: bool = False, tile: int = TILE) -> DataFrame:
    """The runs of each document (doc_id, start, length, period), from words numbered from 0."""
    rows = Scratch(docs.sparkSession, "periodic").save(solved(docs, plant, tile), "solved")
    runs = stitched(rows.where("fragments is not null").select("row", F.explode("fragments").alias("f")).select("row", "f.*"))
    return rows.select("row", "doc_id").join(runs.hint("merge"), "row").drop("row")


def periodic_runs(docs: DataFrame, plant: bool = True, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, of the run with the greatest length / period its start, length, period and
    exponent_milli, then runs_sha256 and collapsed_sha256. ``plant`` first repeats words of some documents by the rule of planted().

    A null or empty text, and one without words, has no run, four nulls and digests of nothing. Texts are read whole, and what
    a task holds of a long one beside its words is a tile. Rows that repeat a doc_id, or have none, are documents of their own. Of runs
    with equal exponents the first counts, then the one of smaller period. Exponents are compared as a whole and a fraction, exactly
    up to 2^27 words. An empty table gives no rows; other columns are ignored.

    Only fragments, and the words of documents that have any, are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "periodic")
    rows = scratch.save(solved(docs, plant, tile), "solved")
    fragments = rows.where("fragments is not null").select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    runs = F.array_sort(F.collect_list(F.struct("start", "period", "length")))  # a document's runs
    rank = F.struct(F.floor(F.col("length") / F.col("period")), (F.col("length") % F.col("period")) / F.col("period"), -F.col("start"), -F.col("period"))
    found = stitched(fragments).groupBy("row").agg(runs.alias("runs"), F.max_by(F.struct("start", "length", "period"), rank).alias("top"))
    found = scratch.save(found, "runs")
    named = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.lit("\n"))
    digests = F.coalesce(F.sha2(named, 256), F.sha2(F.lit(""), 256)).alias("runs_sha256")
    met = rows.where("fragments is not null").select("row", "doc_id", "text").join(found.hint("merge"), "row", "left")
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("(1000 * top.length) div top.period").alias("exponent_milli")
    ready = met.select("doc_id", F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"), *top, milli, digests, "text", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256"]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_kept(text.as_py().encode().split(), [(r["start"], r["length"], r["period"]) for r in runs or []]) for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], [*names, "collapsed_sha256"])

    periodic = ready.select(*names, "text", "runs").mapInArrow(collapse, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    none = F.lit(None).cast("long")
    others = rows.where("fragments is null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"), none.alias("exponent_milli"), F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("text").alias("collapsed_sha256"))
    return periodic.unionByName(others)
