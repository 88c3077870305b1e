"""Queries on a log as a bucketed table: the documents of a source, texts included, are written once and sought in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as S
from .keep import kept
from .queries import DOCS, query
from .seeks import SeekableLog

KEYS = "k AS (SELECT session_id, id FROM l WHERE id % 50 = 0 UNION ALL SELECT session_id, max(id) + 7 FROM l GROUP BY 1)"


def sought(s: SparkSession, d: str) -> tuple[SeekableLog, DataFrame]:
    """The log as a table, and keys in it: every fiftieth id of a session, and one beyond its end."""
    log = SeekableLog(s, buckets=32).add(S.document_logs(s, d))
    ids = log.rows().select("session_id", "id")
    return log, kept(ids.where("id % 50 = 0").unionByName(ids.groupBy("session_id").agg((F.max("id") + 7).alias("id"))))


@query(f"WITH l AS ({DOCS}), {KEYS} SELECT l.session_id, l.id, l.doc_id, length(l.text) AS n FROM l JOIN k ON l.id = k.id AND l.session_id IS NOT DISTINCT FROM k.session_id")
def s7_seek(s, d):
    log, keys = sought(s, d)
    return log.get(keys).select("session_id", "id", "doc_id", F.length("text").cast("long").alias("n"))


@query(f"WITH l AS ({DOCS}), {KEYS} SELECT k.session_id, k.id FROM k WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = k.id AND l.session_id IS NOT DISTINCT FROM k.session_id)")
def s7_seek_absent(s, d):
    log, keys = sought(s, d)
    return log.absent(keys).select("session_id", "id")


@query(f"WITH l AS ({DOCS}), {KEYS} SELECT DISTINCT l.session_id, l.id, l.doc_id, length(l.text) AS n FROM l JOIN k ON l.id BETWEEN k.id - 9 AND k.id AND l.session_id IS NOT DISTINCT FROM k.session_id")
def s8_seek_ranges(s, d):
    """The ten records that end with each key."""
    log, keys = sought(s, d)
    wishes = keys.select("session_id", (F.col("id") - 9).alias("first"), F.col("id").alias("last"))
    return log.ranges(wishes).select("session_id", "id", "doc_id", F.length("text").cast("long").alias("n"))


@query(f"WITH l AS ({DOCS}) SELECT session_id, id, doc_id, length(text) AS n FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 40")
def s10_seek_page(s, d):
    return SeekableLog(s, buckets=32).add(S.document_logs(s, d)).page(40).select("session_id", "id", "doc_id", F.length("text").cast("long").alias("n"))
