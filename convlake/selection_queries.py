"""Queries on plans, work and merges; registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chunking as C
from . import plans as K
from . import selection as Z
from . import sources as S
from .block_queries import TAKEN
from .queries import CONV, CONV_PYRAMID, DOCS, SHARD, chunk_sql, conv_chunks, conv_memories, conv_tree, doc_chunks, priced, query

SPAN = "(2 ** (level - 1))::BIGINT"
COST = """, below AS (SELECT session_id, 1 AS level, chunk_id AS id, raw AS cost FROM c UNION ALL SELECT session_id, level + 1, id // 2, tokens FROM m),
k AS (SELECT session_id, level, id, sum(cost) AS cost FROM below GROUP BY 1, 2, 3), grow AS (SELECT m.*, k.cost - m.tokens AS growth FROM m JOIN k USING (session_id, level, id))"""
FREE = CONV_PYRAMID + TAKEN + ", u AS (SELECT m.* FROM m ANTI JOIN e USING (session_id, level, id))"


@query(CONV_PYRAMID + """, t AS (SELECT session_id, chunk_id, raw, (chunk_id % 3)::INT AS level, CASE WHEN chunk_id % 3 > 0 THEN chunk_id // (2 ** (chunk_id % 3 - 1))::BIGINT END AS id FROM c)
SELECT t.session_id, CASE WHEN m.tokens IS NULL THEN 'raw:' || chunk_id ELSE 'recall:' || t.level || ':' || t.id END AS unit, min(chunk_id) AS first_chunk, min(coalesce(m.tokens, raw)) AS tokens FROM t LEFT JOIN m USING (session_id, level, id) GROUP BY 1, 2""")
def k1_layout(s, d):
    chunks, memories, edges = conv_tree(s, d)
    return Z.layout(chunks.select("session_id", "chunk_id", (F.col("chunk_id") % 3).cast("int").alias("level"), "raw"), memories, edges)


@query(FREE + COST + f""", tot AS (SELECT session_id, sum(tokens)::BIGINT AS before FROM u GROUP BY 1),
r AS (SELECT g.session_id, g.growth, tot.before, tot.before + sum(growth) OVER w AS t, row_number() OVER w AS n FROM grow g JOIN tot USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY (id + 1) * {SPAN} DESC, level DESC)),
f AS (SELECT session_id, sum(growth)::BIGINT AS g, count(*) AS n FROM (SELECT *, max(t) OVER (PARTITION BY session_id ORDER BY n) AS worst FROM r) WHERE worst <= 300 GROUP BY 1)
SELECT tot.session_id, before, before + coalesce(g, 0) AS after, coalesce(n, 0) AS unfolds FROM tot LEFT JOIN f USING (session_id)""")
def k6_unfold_to_target(s, d):
    chunks, memories, edges = conv_tree(s, d)
    return Z.unfold_to_target(chunks, memories, K.unmerged(memories, edges), edges, 300)


def prefix_sql(rows: str, start: str) -> str:
    left = f"SELECT *, {start} - coalesce(sum(growth) OVER (PARTITION BY session_id ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM {rows}"
    return f"(SELECT * FROM (SELECT *, min(lft) OVER (PARTITION BY session_id ORDER BY level, rank ROWS UNBOUNDED PRECEDING) AS low FROM ({left})) WHERE low > 200)"


@query(CONV_PYRAMID + COST + f""", lv AS (SELECT session_id, chunk_id, 1 + chunk_id % 2 AS cap, row_number() OVER (PARTITION BY session_id ORDER BY (chunk_id * 7) % 5, chunk_id) AS rank FROM c),
b AS (SELECT session_id, sum(raw)::BIGINT AS before FROM c GROUP BY 1),
g AS (SELECT grow.session_id, grow.level, grow.id, min(growth)::BIGINT AS growth, min(lv.cap) AS cap, min(lv.rank) AS rank, min(b.before) AS before FROM grow JOIN lv ON lv.session_id = grow.session_id AND lv.chunk_id // {SPAN} = grow.id JOIN b ON b.session_id = grow.session_id GROUP BY 1, 2, 3),
adm AS (SELECT * FROM g WHERE cap >= level), one AS {prefix_sql("adm", "before")},
nw AS (SELECT b.session_id, b.before - coalesce(sum(growth), 0) AS now FROM b LEFT JOIN one USING (session_id) GROUP BY b.session_id, b.before),
past AS (SELECT g.*, now FROM g JOIN nw USING (session_id) ANTI JOIN one ON one.session_id = g.session_id AND one.level = g.level AND one.id = g.id WHERE now > 220), two AS {prefix_sql("past", "now")}
SELECT session_id, level, id, growth AS saving, 'within' AS phase FROM one UNION ALL SELECT session_id, level, id, growth, 'past' FROM two""")
def k7_coarsen(s, d):
    chunks, memories, edges = conv_tree(s, d)
    chunks = chunks.withColumn("cap", 1 + F.col("chunk_id") % 2).withColumn("salience", (F.col("chunk_id") * 7) % 5)
    return Z.coarsen(chunks, memories, edges, 220, 200)


@query("""WITH a AS (SELECT user_id::VARCHAR AS session_id, sum(ceil(value)) FILTER (event_type = 'click') AS now, count(*) FILTER (event_type = 'view')::DOUBLE AS now_loss, sum(ceil(value)) FILTER (event_type = 'purchase') AS ideal, count(*) FILTER (event_type = 'error')::DOUBLE AS ideal_loss, sum(ceil(value)) FILTER (event_type = 'signup') AS cost, sum(ceil(value)) FILTER (event_type = 'view') AS part, count(*) FILTER (event_type = 'click')::DOUBLE AS part_loss FROM events GROUP BY 1),
s AS (SELECT session_id, coalesce(now, 0) AS now, now_loss, coalesce(ideal, 0) AS ideal, ideal_loss, coalesce(cost, 0) AS cost, coalesce(part, 0) AS part, part_loss FROM a),
b AS (SELECT *, now BETWEEN 100 AND 400 AND now_loss - ideal_loss <= 0.35::DOUBLE * greatest(1, ideal_loss) AS held, part <= 400 AND part_loss - ideal_loss <= 0.35::DOUBLE * greatest(1, ideal_loss) AS fits FROM s),
x AS (SELECT *, CASE WHEN held THEN 'hold' WHEN cost <= 150 THEN 'ideal' WHEN fits THEN 'suffix' WHEN part > 400 THEN 'infeasible' ELSE 'quality-gap' END AS branch FROM b)
SELECT session_id, branch, CASE branch WHEN 'hold' THEN now WHEN 'suffix' THEN part ELSE ideal END::BIGINT AS tokens FROM x""")
def k10_adopt(s, d):
    spent = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.ceil("value"))), F.lit(0)).cast("long")
    seen = lambda kind: F.count_if(F.col("event_type") == kind).cast("double")
    stats = S.table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        spent("click").alias("now"), seen("view").alias("now_loss"), spent("purchase").alias("ideal"), seen("error").alias("ideal_loss"),
        spent("signup").alias("cost"), spent("view").alias("part"), seen("click").alias("part_loss"),
    )
    return Z.adopt(stats, 400, 100, 150, 0.35)


@query(CONV_PYRAMID + """, f AS (SELECT session_id, 1 AS level, id FROM m WHERE level = 1 AND id < 2)
SELECT * FROM f UNION ALL SELECT session_id, 0, chunk_id FROM c WHERE chunk_id > coalesce((SELECT max(id) FROM f WHERE f.session_id = c.session_id), -1)""")
def k13_carry_frontier(s, d):
    ones = conv_memories(s, d).where("level = 1").select("session_id", "level", "id", F.col("id").alias("last_chunk"))
    compiles = ones.where("id < 1").withColumn("compile_id", F.lit(1)).unionByName(ones.where("id < 2").withColumn("compile_id", F.lit(2)))
    return Z.carry_frontier(compiles, conv_chunks(s, d))


@query(CONV_PYRAMID + """, r AS (SELECT session_id, max(chunk_id) - 1 AS reach FROM c GROUP BY 1), x AS (SELECT c.session_id, c.raw, m.tokens FROM c JOIN r USING (session_id) JOIN m ON m.session_id = c.session_id AND m.level = 1 AND m.id = c.chunk_id WHERE chunk_id % 2 = 0 AND chunk_id <= reach)
SELECT session_id, count(*) AS replaced, count(*) AS shown, sum(raw - tokens)::BIGINT AS saved FROM x GROUP BY 1""")
def k14_fold_diff(s, d):
    """Before, all chunks but the newest stand raw; after, every second one is its memory."""
    chunks = conv_chunks(s, d)
    raw = chunks.select("session_id", F.lit(0).alias("level"), F.col("chunk_id").alias("id"), F.col("chunk_id").alias("last_chunk"), F.col("raw").alias("tokens"))
    ones = conv_memories(s, d).where("level = 1 and id % 2 = 0").select("session_id", "level", "id", F.col("id").alias("last_chunk"), "tokens")
    newest = chunks.groupBy("session_id").agg(F.max("chunk_id").alias("_n"))
    return Z.fold_diff(raw.join(newest, "session_id").where("id < _n").drop("_n"), raw.where("id % 2 = 1").unionByName(ones))


@query(FREE + f""", w1 AS (SELECT *, id * {SPAN} AS a, (id + 1) * {SPAN} - 1 AS b FROM u), g AS (SELECT *, lag(b) OVER w AS pb, lag(level) OVER w AS pl FROM w1 WINDOW w AS (PARTITION BY session_id ORDER BY a)),
z AS (SELECT session_id, max(chunk_id) AS e FROM c GROUP BY 1) SELECT g.session_id, bool_and(a = coalesce(pb, -1) + 1) AND max(b) = min(e) AS whole, NOT bool_or(coalesce(level > pl, false)) AS falling FROM g JOIN z USING (session_id) GROUP BY 1""")
def k17_frontier_guarantees(s, d):
    chunks, memories, edges = conv_tree(s, d)
    return Z.frontier_guarantees(K.chunks_of(K.unmerged(memories, edges), edges), chunks)


# --- work


@query(chunk_sql(DOCS, 3000, 4) + """, esc AS (SELECT session_id FROM c GROUP BY 1 HAVING sum(raw) > 8400), f AS (SELECT session_id, chunk_id, chunk_id - row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) AS g FROM c SEMI JOIN esc USING (session_id) WHERE chunk_id % 3 <> 0 AND chunk_id > 1)
SELECT session_id, min(chunk_id) AS "first", max(chunk_id) AS "last" FROM f GROUP BY session_id, g""")
def d2_demand_runs(s, d):
    chunks = doc_chunks(s, d)
    have = chunks.where("chunk_id % 3 = 0").select("session_id", F.lit(1).alias("level"), F.col("chunk_id").alias("id"))
    over = K.over_budget(chunks.groupBy("session_id").agg(F.sum("raw").alias("total")), 8000, 0.05).where("over")
    return Z.demand_runs(chunks, have, C.raw_zone(chunks, 2, 0), over.select("session_id"))


OWNED = """, o AS (SELECT session_id, chunk_id AS memory, "first" + chunk_id % 2 AS a, "last" + chunk_id % 2 AS b FROM c WHERE chunk_id % 3 <> 2),
cov AS (SELECT c.session_id, c.chunk_id, min(o.memory) AS memory, bool_or(o.a = c."first" AND o.b = c."last") AS exact FROM c JOIN o ON o.session_id = c.session_id AND o.a <= c."last" AND c."first" <= o.b GROUP BY 1, 2)"""


def coverage(s, d):
    spans = K.chunk_spans(doc_chunks(s, d))
    odd = F.col("chunk_id") % 2
    owned = spans.where("chunk_id % 3 <> 2").select("session_id", F.col("chunk_id").alias("memory"), (F.col("first") + odd).alias("first"), (F.col("last") + odd).alias("last"), "ordinal")
    return Z.covered_by_l1(spans, owned)


@query(chunk_sql(DOCS, 3000, 4) + OWNED + " SELECT * FROM cov")
def d8_covered_by_l1(s, d):
    return coverage(s, d)


@query(chunk_sql(DOCS, 3000, 4) + OWNED + " SELECT session_id, chunk_id, memory FROM cov WHERE NOT exact")
def d9_overlap_blocked(s, d):
    return Z.overlap_blocked(coverage(s, d))


RUN = """, f AS (SELECT session_id, 1 AS level, chunk_id AS id, "first", "last", max("last") OVER (PARTITION BY session_id) AS live FROM c), g AS (SELECT *, coalesce(("first" > lag("last") OVER w + 1)::INT, 1) AS brk FROM f WHERE id % 4 <> 3 WINDOW w AS (PARTITION BY session_id ORDER BY "first")),
h AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY "first") AS run FROM g), i AS (SELECT *, count(*) OVER w AS n, max("last") OVER w AS e, row_number() OVER (PARTITION BY session_id, run ORDER BY "first") AS k, min("first") OVER w AS s FROM h WINDOW w AS (PARTITION BY session_id, run)),
due AS (SELECT session_id, level, id, s AS "first", run::BIGINT AS run FROM i WHERE n >= 3 AND k <= 3 OR n = 2 AND e < live)"""


def due_merges(s, d):
    ones = doc_chunks(s, d).select("session_id", F.lit(1).alias("level"), F.col("chunk_id").alias("id"), "first", "last")
    return Z.merge_by_run(ones, ones.where("id % 4 = 3"), 3)


@query(chunk_sql(DOCS, 3000, 4) + RUN + " SELECT * FROM due")
def m3_merge_by_run(s, d):
    return due_merges(s, d)


@query(chunk_sql(DOCS, 3000, 4) + RUN + OWNED + """, t AS (SELECT session_id, 1 AS level, "first", 'L1:' || chunk_id AS target FROM c ANTI JOIN cov USING (session_id, chunk_id) WHERE chunk_id > 0
UNION ALL SELECT session_id, 2, min("first"), 'L2:' || string_agg(id::VARCHAR, '+' ORDER BY id) FROM due GROUP BY session_id, run)
SELECT * FROM t WHERE target <> 'L1:5' AND NOT (target = 'L2:0+1+2' AND session_id = 'src0')""")
def d5_work(s, d):
    chunks = doc_chunks(s, d)
    every = chunks.select("session_id").distinct()
    done, stalled = every.withColumn("target", F.lit("L1:5")), every.where("session_id = 'src0'").withColumn("target", F.lit("L2:0+1+2"))
    return Z.work(chunks, due_merges(s, d), C.raw_zone(chunks, 1, 0), coverage(s, d), done, stalled)


@query(f"""WITH sh AS ({SHARD}), x AS (SELECT session_id, 'g' || id AS grp, id || ':' || (piece // 2) AS work, length(slice) AS tokens FROM sh), one AS (SELECT session_id, work, grp, sum(tokens)::BIGINT AS portion FROM x GROUP BY 1, 2, 3),
w AS (SELECT session_id, grp, sum(tokens)::BIGINT AS whole FROM x GROUP BY 1, 2) SELECT session_id, work, grp AS "group", portion, whole FROM one JOIN w USING (session_id, grp) WHERE whole >= 2 * portion""")
def d10_reading_stretch(s, d):
    shards = C.shard(priced(S.document_logs(s, d)), 500)
    leaves = shards.select("session_id", F.concat("id", F.lit(":"), F.floor(F.col("piece") / 2)).alias("work"), F.concat(F.lit("g"), "id").alias("group"), F.length("slice").cast("long").alias("tokens"))
    return Z.reading_stretch(leaves, leaves, 2)


@query(CONV_PYRAMID + """, ct AS (SELECT session_id, chunk_id AS id, string_agg(text, ' ' ORDER BY o.id) AS text FROM o GROUP BY 1, 2), n AS (SELECT session_id, 0 AS level, id, text FROM ct UNION ALL SELECT session_id, level, id, text FROM m)
SELECT m.session_id, m.level, m.id, string_agg(n.text, chr(10) ORDER BY n.id) AS text FROM m JOIN n ON n.session_id = m.session_id AND n.level = m.level - 2 AND n.id // (CASE WHEN m.level = 2 THEN 2 ELSE 4 END) = m.id WHERE m.level > 1 GROUP BY 1, 2, 3""")
def m12_merge_source_text(s, d):
    owned = C.owner_of(S.conversations(s, d), conv_chunks(s, d).select("session_id", "chunk_id", "first", "last")).where("chunk_id is not null")
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))  # a chunk's messages
    texts = owned.groupBy("session_id", "chunk_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return Z.merge_source_text(texts, *conv_tree(s, d)[1:])


@query(CONV_PYRAMID + TAKEN + """, q AS (SELECT session_id, id // 3 AS run, level, id FROM m WHERE level = 1), stale AS (SELECT DISTINCT session_id, run FROM q SEMI JOIN e USING (session_id, level, id)) SELECT q.* FROM q ANTI JOIN stale USING (session_id, run)""")
def m13_live_quarantine(s, d):
    _, memories, edges = conv_tree(s, d)
    runs = memories.where("level = 1").select("session_id", F.floor(F.col("id") / 3).cast("long").alias("run"), "level", "id")
    return Z.live_quarantine(runs, edges)
