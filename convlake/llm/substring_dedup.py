"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted in Spark.

A word goes if a window that covers it also starts in a document with a smaller doc_id. Windows whose anchor stands
once are unique and aren't counted (see repeats.py); those that are left get a 128-bit Rabin-Karp hash each, Spark
takes the smallest document of each hash, and the repeated windows merge into maximal spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import PrefixHashes, Search, mix, remove_repeats

WINDOW, GRAM = 50, 14


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th, at, body = (batch.column(c).to_pylist() for c in ("doc", "th", "at", "body"))
            for part in range(0, len(body), 2_000):
                parts = [np.frombuffer(b, np.uint64) for b in body[part : part + 2_000]]
                lengths = np.array([len(x) for x in parts])
                units, first = np.concatenate(parts), np.cumsum(lengths) - lengths
                many = lengths - window + 1
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(first, many) + inside
                h1, h2 = (mix(PrefixHashes(units, k).of(start, start + window)).view(np.int64) for k in (0, 1))
                own = slice(part, part + 2_000)
                columns = [h1, h2, *[np.repeat(np.array(x[own], np.int64), many) for x in (doc, th, at)]]
                columns[4] = (columns[4] + inside).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c if k != 3 else c.astype(np.int32)) for k, c in enumerate(columns)], ["h1", "h2", "doc", "th", "a"])

    return run


def count_windows(window: int):
    def compare(segments: DataFrame, scratch: Scratch) -> DataFrame:
        rows = segments.select("doc", "th", "at", "body").mapInArrow(_windows(window), "h1 long, h2 long, doc long, th int, a int")
        least = rows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
        least = scratch.save(least, "windows")
        return rows.hint("merge").join(least, ["h1", "h2"]).where("doc > least").select("doc", "th", "a", (F.col("a") + window).alias("b"))

    return compare


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 for each row; remove_repeats says what odd rows give."""
    return remove_repeats(docs, Search("words", window, gram, False), count_windows(window)).withColumnRenamed("n_units", "n_words")
