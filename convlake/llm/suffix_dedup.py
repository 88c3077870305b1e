"""Suffix-array dedup: a suffix sort by hash comparisons.

A byte goes if a 100-byte string that covers it also starts earlier (a smaller doc_id, or the same document). The
strings that can repeat but for those settled as wholes (see repeats.py) are dealt out by their anchors; there the
suffixes that start them are sorted by mergesort. A comparison finds the common extension of two suffixes by
binary search over prefix polynomial hashes, and the byte after it decides. Neighbours that share 100 bytes are equal
strings, which is verified byte by byte; all but the earliest of a run of neighbours go. Segments of a hot anchor are
sorted slice by slice as they lie, and of each slice only the earliest of equal strings are sorted against the other slices' in a
second round, dealt out by their contents: no task gathers an anchor, and a string comes at most once a slice. Before, the strings meet
by their hashes alone, as most are in one slice only and needn't be moved with their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import PrefixHashes, Search, Units, by_bucket, mix, parcels, remove_repeats, unpacked

WINDOW, GRAM = 100, 24
#: So many segments are sorted at once; whole groups of anchors that aren't hot always.
CHUNK = 8_000
#: About so many strings of hot anchors go to one bucket.
BUCKET = 200_000


class Suffixes:
    """Suffixes of one text, compared up to ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.hashes = PrefixHashes(Units("bytes").byte[text])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at x and y have in common, up to depth."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.depth)
        while len(x) and (low < high).any():
            half = (low + high + 1) // 2
            same = self.hashes.of(x, x + half) == self.hashes.of(y, y + half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether x sorts before y; equal ones as ``ties`` says."""
        common = self.extension(x, y)
        inside = common < self.depth
        step = np.where(inside, common, 0)
        return np.where(inside, self.text[x + step] < self.text[y + step], ties)

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal by hash and, for those, byte by byte."""
        out = self.extension(x, y) == self.depth
        at, reach = np.flatnonzero(out), np.arange(self.depth)
        for part in range(0, len(at), 20_000):
            k = at[part : part + 20_000]
            out[k] = (self.text[x[k, None] + reach] == self.text[y[k, None] + reach]).all(axis=1)
        return out

    def merge_sort(self, group: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``at`` within their groups (equal groups stand together); all merges of a level at once.

        An element's place in the merge of two runs is its own place plus how many of the other run come before it,
        found by binary search.
        """
        order = np.arange(len(at))
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, int)
        size = np.diff(np.append(edge, len(at)))
        begin, end = np.repeat(edge, size), np.repeat(edge + size, size)
        width = 1
        while width < size.max(initial=0):
            place = np.arange(len(at)) - begin
            left = place // width % 2 == 0
            other = begin + (place // (2 * width)) * 2 * width + np.where(left, width, 0)
            low = np.minimum(other, end)
            high = np.minimum(low + np.where(left, width, np.minimum(width, end - low)), end)
            start = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                # a later run's equal elements come after, an earlier run's before
                mine, theirs = at[order[open_]], at[order[mid]]
                less = np.where(left[open_], self.before(theirs, mine, False), self.before(theirs, mine, True))
                low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
            home = begin + (place // (2 * width)) * 2 * width
            target = home + place % width + (low - start)
            after = np.empty_like(order)
            after[target] = order
            order, width = after, 2 * width
        return order


def later(key: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Which strings (``window`` bytes of ``text`` from ``start``) of a group ``key`` also start earlier, by (doc, th, at)."""
    out = np.zeros(len(key), bool)
    by = np.lexsort((at, th, doc, key))
    twice = np.concatenate([[False], key[by[1:]] == key[by[:-1]]]) if len(by) else np.zeros(0, bool)
    by = by[twice | np.append(twice[1:], False)] if len(by) else by
    key, doc, th, at, start = key[by], doc[by], th[by], at[by], start[by]
    suffixes = Suffixes(text, window)
    order = suffixes.merge_sort(key, start)  # stable, so equal strings stay in the documents' order
    same = np.zeros(len(order), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) if len(order) else same[1:]
    k = np.flatnonzero(same)
    same[k] = suffixes.same(start[order[k - 1]], start[order[k]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    first = order[head]
    out[by[order[same & ((doc[first] != doc[order]) | (th[first] != th[order]) | (at[first] != at[order]))]]] = True
    return out


class Strings:
    """All strings of segments (group, doc, th, at, p, body), in the segments' order."""

    def __init__(self, rows: list[tuple], window: int):
        group, doc, th, at, p = (np.array(c, np.int64) for c in zip(*[r[:5] for r in rows], strict=True))
        lengths = np.array([len(r[5]) for r in rows])
        self.text = np.frombuffer(b"".join(r[5] for r in rows) + bytes(window), np.uint8)
        many = lengths - window + 1
        self.of = np.repeat(np.arange(len(rows)), many)
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start, self.at = (np.cumsum(lengths) - lengths)[self.of] + inside, at[self.of] + inside
        self.doc, self.th, self.window = doc[self.of], th[self.of], window
        # equal strings have their anchors at equal places, so each such place is a group of its own
        _, number = np.unique(group, return_inverse=True)
        self.gone = later(number[self.of] * (1 << 20) + p[self.of] - inside + (1 << 19), self.doc, self.th, self.at, self.text, self.start, window)

    def spans(self) -> list[np.ndarray]:
        """doc, th, a, b of what goes; neighbours in a segment are one span."""
        k = np.flatnonzero(self.gone)
        fresh = np.concatenate([[True], (self.of[k[1:]] != self.of[k[:-1]]) | (k[1:] != k[:-1] + 1)]) if len(k) else np.zeros(0, bool)
        first, last = k[fresh], k[np.append(fresh[1:], True)] if len(k) else k
        return [self.doc[first], self.th[first].astype(np.int32), self.at[first].astype(np.int32), (self.at[last] + self.window).astype(np.int32)]


def place_of(window: int) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("th", "<i4"), ("at", "<i4"), ("text", "u1", (window,))])


#: Columns of a parcel of strings by their hashes: hash, doc, th, start of the segment, start in the segment.
NAMED = ("<i8", "<i8", "<i4", "<i4", "<i2")


def _hashes(text: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    return mix(PrefixHashes(Units("bytes").byte[text]).of(start, start + window))


def _slices(window: int, buckets: int):
    """Of slices of segments what goes, as spans, and the strings that stay, by bucket of their hashes, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["doc", "th", "a", "b", "bucket", "strings"]

        def done() -> Iterator[pa.RecordBatch]:
            strings = Strings(held, window)
            spans = [pa.array(c) for c in strings.spans()]
            yield pa.RecordBatch.from_arrays([*spans, pa.nulls(len(spans[0]), pa.int32()), pa.nulls(len(spans[0]), pa.binary())], names)
            stay = np.flatnonzero(~strings.gone)
            own = np.array([r[3] for r in held], np.int64)[strings.of[stay]]
            key = _hashes(strings.text, strings.start[stay], window)
            columns = [key.view(np.int64), strings.doc[stay], strings.th[stay], own, strings.at[stay] - own]
            found, blobs = parcels((key % np.uint64(buckets)).astype(np.int32), columns, NAMED)
            none = [pa.nulls(len(found), k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("g", "doc", "th", "at", "p", "body")], strict=True):
                held.append(row)
                if len(held) >= CHUNK // 2:
                    yield from done()
                    held = []
        if held:
            yield from done()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each bucket, of rows (bucket, strings) in their buckets' order."""
    at, held = None, []
    for batch in batches:
        for bucket, strings in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != at and held:
                yield held
                held = []
            at = bucket
            held.append(strings)
    if held:
        yield held


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (bucket, strings), whole buckets together: places of strings whose hash another string has."""
    for blobs in _by_bucket(batches):
        key, *places = unpacked(blobs, NAMED)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.sort(order[np.append(same, False) | np.append(False, same)])
        yield pa.RecordBatch.from_arrays([pa.array(c[again].astype(k)) for c, k in zip(places, ("i8", "i4", "i4", "i4"), strict=True)], ["doc", "th", "at", "k"])


def _told(window: int, buckets: int):
    """From segments (doc, th, at, body, ks) the strings that start at ks in them, bytes and all, packed by bucket of their contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ks = batch.column("body").to_pylist(), batch.column("ks").to_pylist()
            text = np.frombuffer(b"".join(body), np.uint8)
            many, size = np.array([len(k) for k in ks], np.int64), np.array([len(b) for b in body], np.int64)
            k = np.concatenate([np.array(k, np.int64) for k in ks]) if ks else np.zeros(0, np.int64)
            start = np.repeat(np.cumsum(size) - size, many) + k
            order, parts = by_bucket((_hashes(text, start, window) % np.uint64(buckets)).astype(np.int32))
            packed = np.zeros(len(start), place_of(window))
            for name in ("doc", "th", "at"):
                packed[name] = np.repeat(batch.column(name).to_numpy(), many)
            packed["at"] += k.astype(np.int32)
            if len(start):
                packed["text"] = np.lib.stride_tricks.sliding_window_view(text, window)[start]
            packed = packed[order]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([packed[lo:hi].tobytes() for _, lo, hi in parts], pa.binary())], ["bucket", "strings"])

    return run


def _between_slices(window: int):
    """From (bucket, strings), whole buckets together: spans of strings that another slice has earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches):
            x = np.frombuffer(b"".join(blobs), place_of(window))
            text, start = np.ascontiguousarray(x["text"]).reshape(-1), np.arange(len(x)) * window
            text = np.concatenate([text, np.zeros(window, np.uint8)])
            key = PrefixHashes(Units("bytes").byte[text]).of(start, start + window).view(np.int64)
            x = x[later(key, *[x[c].astype(np.int64) for c in ("doc", "th", "at")], text, start, window)]
            x = np.sort(x[["doc", "th", "at"]], order=["doc", "th", "at"])
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["th"]), pa.array(x["at"]), pa.array(x["at"] + np.int32(window))], ["doc", "th", "a", "b"])

    return run


def sort_hot(segments: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Spans of hot segments (g, doc, th, at, p, body), in two rounds of suffix sorts. Only strings whose hash comes from two slices
    are in the second with their bytes."""
    buckets = max(1, segments.count() * window // BUCKET)
    slices = segments.mapInArrow(_slices(window, buckets), "doc long, th int, a int, b int, bucket int, strings binary")
    slices = scratch.save(slices, "slices")
    together = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    met = together(slices.where("bucket is not null").select("bucket", "strings")).mapInArrow(_met, "doc long, th int, at int, k int")
    met = scratch.save(met.groupBy("doc", "th", "at").agg(F.collect_list("k").alias("ks")), "met")  # a segment's own
    told = segments.select("doc", "th", "at", "body").hint("merge").join(met, ["doc", "th", "at"]).mapInArrow(_told(window, buckets), "bucket int, strings binary")
    return slices.where("bucket is null").select("doc", "th", "a", "b").unionByName(together(told).mapInArrow(_between_slices(window), "doc long, th int, a int, b int"))


def _sort(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in Strings(rows, window).spans()], ["doc", "th", "a", "b"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("g", "doc", "th", "at", "p", "body")], strict=True):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return run


def sort_suffixes(window: int):
    def compare(segments: DataFrame, scratch: Scratch) -> DataFrame:
        named = segments.select(F.col("m").alias("g"), "doc", "th", "at", "p", "body", "hot")
        met = named.where("not hot").drop("hot").repartition("g").sortWithinPartitions("g")
        sorted_ = met.mapInArrow(_sort(window), "doc long, th int, a int, b int")
        spans = scratch.save(sorted_.unionByName(sort_hot(named.where("hot").drop("hot"), window, scratch)), "spans")
        scratch.drop("segments", "slices", "met")
        return spans

    return compare


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; remove_repeats says what odd rows give."""
    return remove_repeats(docs, Search("bytes", window, gram, True), sort_suffixes(window)).withColumnRenamed("n_units", "n_bytes")
