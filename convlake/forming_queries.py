"""Queries on memories that merges form, and on the pyramid's relations over their edges."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking as C
from . import forming as G
from . import plans as K
from . import pyramid as M
from . import selection as Z
from . import sources as S
from .keep import kept
from .queries import DIGEST, DOCS, PYRAMID, chunk_sql, priced, query

ONES = chunk_sql(DOCS, 600, 1) + PYRAMID.format(k=2)[: PYRAMID.format(k=2).index(",\nm2 AS")]


def merged_sql(level: int, group: str) -> str:
    """CTEs of the memories (l) and edges (x) that a rule's groups ``group`` (session_id, id, grp) form of level ``level``."""
    n = level + 1
    return f""", y{n} AS (SELECT l.session_id, g.grp, min("first") AS "first", max("last") AS "last", {DIGEST.format(t="string_agg(text, ' ' ORDER BY \"first\", l.id)")} AS text FROM l{level} l JOIN {group} g USING (session_id, id) GROUP BY 1, 2),
z{n} AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "first", "last") - 1 AS id, ceil(length(text) / 3.0::DOUBLE)::BIGINT AS tokens FROM y{n}),
l{n} AS (SELECT session_id, {n} AS level, id, "first", "last", text, tokens FROM z{n}), x{n} AS (SELECT z.session_id, {n} AS level, z.id, {level} AS member_level, g.id AS member FROM z{n} z JOIN {group} g USING (session_id, grp))"""


def runs_sql(k: int, levels: int) -> str:
    out = ONES + """, l1 AS (SELECT session_id, 1 AS level, id, "first", "last", text, ceil(length(text) / 3.0::DOUBLE)::BIGINT AS tokens FROM m1 WHERE id % 8 <> 7), x1 AS (SELECT session_id, 1 AS level, id, 0 AS member_level, id AS member FROM l1)"""
    for n in range(1, levels):
        out += f""", a{n} AS (SELECT *, coalesce(("first" > lag("last") OVER w + 1)::INT, 1) AS brk FROM l{n} WINDOW w AS (PARTITION BY session_id ORDER BY "first", "last", id)),
b{n} AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY "first", "last", id) AS run, max("last") OVER (PARTITION BY session_id) AS live FROM a{n}),
d{n} AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY "first", "last", id) - 1 AS k, count(*) OVER (PARTITION BY session_id, run) AS n, max("last") OVER (PARTITION BY session_id, run) AS fin FROM b{n}),
g{n} AS (SELECT session_id, id, run || ':' || k // {k} AS grp FROM d{n} WHERE k < n - n % {k} OR n % {k} >= 2 AND fin < live)""" + merged_sql(n, f"g{n}")
    return out + all_sql(levels)


def tokens_sql(least: int, target: int, levels: int) -> str:
    out = ONES + """, l1 AS (SELECT session_id, 1 AS level, id, "first", "last", text, ceil(length(text) / 3.0::DOUBLE)::BIGINT AS tokens FROM m1), x1 AS (SELECT session_id, 1 AS level, id, 0 AS member_level, id AS member FROM l1)"""
    for n in range(1, levels):
        done = f"v.t >= {target} AND v.n >= {least}"
        out += f""", v{n} AS (SELECT session_id, id, 0::BIGINT AS grp, tokens AS t, 1 AS n FROM l{n} WHERE id = 0
 UNION ALL SELECT l.session_id, l.id, CASE WHEN {done} THEN v.grp + 1 ELSE v.grp END, CASE WHEN {done} THEN l.tokens ELSE v.t + l.tokens END, CASE WHEN {done} THEN 1 ELSE v.n + 1 END FROM v{n} v JOIN l{n} l ON l.session_id = v.session_id AND l.id = v.id + 1),
g{n} AS (SELECT session_id, id, grp FROM v{n} SEMI JOIN (SELECT session_id, grp FROM v{n} GROUP BY 1, 2 HAVING max(t) >= {target} AND max(n) >= {least}) USING (session_id, grp))""" + merged_sql(n, f"g{n}")
    return out + all_sql(levels)


def all_sql(levels: int) -> str:
    some = lambda c: " UNION ALL ".join(f"SELECT * FROM {c}{n}" for n in range(1, levels + 1))
    return f", mem AS ({some('l')}), edg AS ({some('x')})"


#: A merge holds two memories at least, so no session of fewer than 2^32 chunks has a level above this one.
LEVELS = 32
RUNS = runs_sql(2, 5)  # runs of seven chunks at most, whatever the session's length
TOKENS = tokens_sql(2, 250, LEVELS)
#: A lift in each session over 15,000 raw tokens.
LIFTED = TOKENS + f""", esc AS (SELECT session_id FROM c GROUP BY 1 HAVING sum(raw) > 15000), fr AS (SELECT mem.* FROM mem SEMI JOIN esc USING (session_id) ANTI JOIN edg ON edg.session_id = mem.session_id AND edg.member_level = mem.level AND edg.member = mem.id),
be AS (SELECT *, sum(tokens) OVER w AS t, row_number() OVER w AS k FROM (SELECT *, max(level) OVER (PARTITION BY session_id) AS top FROM fr) WHERE level < top WINDOW w AS (PARTITION BY session_id ORDER BY "first", level DESC, id)),
li AS (SELECT *, max(level) OVER (PARTITION BY session_id) + 1 AS up FROM (SELECT *, min(k) FILTER (t >= 120 AND k >= 2) OVER (PARTITION BY session_id) AS ful FROM be) WHERE k <= ful),
lm AS (SELECT session_id, up AS level, (SELECT count(*) FROM mem WHERE mem.session_id = li.session_id AND mem.level = li.up) AS id, min("first") AS "first", max("last") AS "last", {DIGEST.format(t="string_agg(text, ' ' ORDER BY \"first\", level, id)")} AS text FROM li GROUP BY session_id, up),
mem2 AS (SELECT * FROM mem UNION ALL SELECT *, ceil(length(text) / 3.0::DOUBLE)::BIGINT FROM lm), edg2 AS (SELECT * FROM edg UNION ALL SELECT lm.session_id, lm.level, lm.id, li.level, li.id FROM lm JOIN li USING (session_id))"""


def close_sql(edges: str = "edg") -> str:
    """The closure of edges as CTE cl (session_id, chunk_id, level, id)."""
    return f""", cl AS (SELECT session_id, member AS chunk_id, level, id FROM {edges} WHERE member_level = 0 UNION ALL SELECT cl.session_id, cl.chunk_id, e.level, e.id FROM cl JOIN {edges} e ON e.session_id = cl.session_id AND e.member_level = cl.level AND e.member = cl.id)"""


def small_chunks(s: SparkSession, d: str) -> DataFrame:
    return kept(C.close_chunks(priced(S.document_logs(s, d)), 600, 1))


def formed(s: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, and the memories and edges that a rule forms over them."""
    chunks = small_chunks(s, d)
    ones = kept(M.mint_l1(S.document_logs(s, d), chunks))
    if kind == "runs":
        memories, edges = G.form(ones.where("id % 8 <> 7"), G.by_run(2))
    else:
        memories, edges = G.form(ones, G.by_tokens(2, 250))
        if kind == "lifts":
            large = chunks.groupBy("session_id").agg(F.sum("raw").alias("n")).where("n > 15000").select("session_id")
            memories, edges = G.added(memories, edges, kept(G.lift(memories, edges, large, 2, 120)))
    return chunks, kept(memories), kept(edges)


for kind, sql, suffix in (("runs", RUNS, ""), ("tokens", TOKENS, ""), ("lifts", LIFTED, "2")):
    name = {"runs": "m3_form_by_run", "tokens": "m4_form_by_tokens", "lifts": "m5_form_lifted"}[kind]
    query(sql + f" SELECT * FROM mem{suffix}", name)(partial(lambda s, d, kind: formed(s, d, kind)[1], kind=kind))
    query(sql + f" SELECT * FROM edg{suffix}", f"{name}_edges")(partial(lambda s, d, kind: formed(s, d, kind)[2], kind=kind))
    query(sql + close_sql(f"edg{suffix}") + " SELECT session_id, chunk_id, level, id AS ancestor FROM cl", f"m7_closure_of_{kind}")(partial(lambda s, d, kind: K.closure(formed(s, d, kind)[2]), kind=kind))
    query(sql + close_sql(f"edg{suffix}") + " SELECT session_id, level, id, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM cl GROUP BY 1, 2, 3", f"m9_chunks_of_{kind}")(partial(lambda s, d, kind: K.chunks_of(*formed(s, d, kind)[1:]).select("session_id", "level", "id", "first_chunk", "last_chunk"), kind=kind))


@query(LIFTED + " SELECT session_id, level, id, member_level, member FROM edg2 WHERE member_level > 0")
def m8_members_of_lifts(s, d):
    return K.members(formed(s, d, "lifts")[2])


@query(LIFTED + " SELECT m.* FROM mem2 m ANTI JOIN edg2 e ON e.session_id = m.session_id AND e.member_level = m.level AND e.member = m.id WHERE m.\"last\" < 30")
def m10_unmerged_of_lifts(s, d):
    _, memories, edges = formed(s, d, "lifts")
    return K.unmerged(memories, edges, 30)


@query(LIFTED + " SELECT session_id, max(level) AS level FROM mem2 GROUP BY 1")
def m11_max_level_of_lifts(s, d):
    return M.max_level(formed(s, d, "lifts")[1])


@query(LIFTED + """, ct AS (SELECT session_id, chunk_id AS id, string_agg(text, ' ' ORDER BY o.id) AS text FROM o GROUP BY 1, 2), n AS (SELECT session_id, 0 AS level, id, id AS ord, text FROM ct UNION ALL SELECT session_id, level, id, "first", text FROM mem2)
SELECT a.session_id, a.level, a.id, string_agg(n.text, chr(10) ORDER BY n.ord, n.text) AS text FROM edg2 a JOIN edg2 b ON b.session_id = a.session_id AND b.level = a.member_level AND b.id = a.member JOIN n ON n.session_id = b.session_id AND n.level = b.member_level AND n.id = b.member GROUP BY 1, 2, 3""")
def m12_source_text_of_lifts(s, d):
    chunks, memories, edges = formed(s, d, "lifts")
    return Z.merge_source_text(M.chunk_texts(S.document_logs(s, d), chunks), memories, edges)


@query(RUNS + """, q AS (SELECT session_id, id // 3 AS run, level, id FROM mem WHERE level = 2), stale AS (SELECT DISTINCT q.session_id, run FROM q JOIN edg ON edg.session_id = q.session_id AND edg.member_level = q.level AND edg.member = q.id) SELECT q.* FROM q ANTI JOIN stale USING (session_id, run)""")
def m13_live_quarantine_of_runs(s, d):
    _, memories, edges = formed(s, d, "runs")
    return Z.live_quarantine(memories.where("level = 2").select("session_id", F.floor(F.col("id") / 3).cast("long").alias("run"), "level", "id"), edges)


@query(LIFTED + close_sql("edg2") + """, t AS (SELECT c.session_id, c.chunk_id, c.raw, (1 + c.chunk_id % 3)::INT AS level, cl.id FROM c LEFT JOIN cl ON cl.session_id = c.session_id AND cl.chunk_id = c.chunk_id AND cl.level = 1 + c.chunk_id % 3)
SELECT t.session_id, CASE WHEN t.id IS NULL THEN 'raw:' || chunk_id ELSE 'recall:' || t.level || ':' || t.id END AS unit, min(chunk_id) AS first_chunk, min(coalesce(m.tokens, raw)) AS tokens FROM t LEFT JOIN mem2 m ON m.session_id = t.session_id AND m.level = t.level AND m.id = t.id GROUP BY 1, 2""")
def k1_layout_of_lifts(s, d):
    chunks, memories, edges = formed(s, d, "lifts")
    return Z.layout(chunks.select("session_id", "chunk_id", (1 + F.col("chunk_id") % 3).cast("int").alias("level"), "raw"), memories, edges)
