"""More queries on blocks, requests, frontiers and streams' batch forms; registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import blocks as B
from . import ledger as L
from . import plans as K
from . import pricing as P
from . import requests as R
from . import selection as Z
from . import sources as S
from . import streaming as X
from . import turns as T
from .block_queries import PROPS, SALIENCE, TAKEN, TYPE_TOKENS, event_messages, per_kind
from .queries import CONV, CONV_PYRAMID, DOCS, chunk_sql, conv_tree, doc_chunks, query

SECOND = per_kind("ceil(length(json(props)::VARCHAR) / 2.3::DOUBLE) + 20", "ceil(length(props) / 2.3::DOUBLE)", "1600", PROPS, "600", PROPS)
HALF = "floor({x}) + ({x} - floor({x}) >= 0.5)::INT"


@query(f"WITH p AS (SELECT event_id AS id, {TYPE_TOKENS} * 1.25::DOUBLE AS a, ({SECOND}) * 1.25::DOUBLE AS b FROM events) SELECT id, ({HALF.format(x='a')} + {HALF.format(x='b')})::BIGINT AS tokens FROM p")
def p10_store_tokens(s, d):
    return event_messages(s, d).select("id", P.store_tokens(B.block_prices(F.col("content")), 1.25).alias("tokens"))


@query(f"SELECT event_id AS id, (length(event_type) + {per_kind('length(props)', 'length(props)', '400', 'length(props)', '0', 'length(props)')}) // 4 AS tokens FROM events")
def p6_flat_tokens_of_blocks(s, d):
    return event_messages(s, d).select("id", B.flat_tokens_of(F.col("content")).alias("tokens"))


@query(f"SELECT event_id AS id, {SALIENCE} AS salience FROM events")
def p11_content_salience(s, d):
    return event_messages(s, d).select("id", B.content_salience(F.col("content")).alias("salience"))


def nested(s, d):
    """Each event as a result of two parts: its properties as text, then an image on every third."""
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.when(F.col("event_id") % 2 == 0, 900.0).alias("stamp"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"))
    text = F.struct(F.lit("text").alias("type"), F.col("props").alias("text"), F.lit(None).cast("double").alias("stamp"), F.lit(None).cast("long").alias("bytes"))
    parts = F.when(F.col("event_id") % 3 == 0, F.array(text, image)).otherwise(F.array(text))
    return S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.array(B.block("tool_result", parts=parts)).alias("content"))


@query(f"SELECT event_id AS id, ({PROPS} + CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 900 ELSE 1600 END ELSE 0 END)::DOUBLE AS raw FROM events")
def p9_nested_results(s, d):
    return nested(s, d).select("id", F.aggregate(B.block_prices(F.col("content")), F.lit(0.0), lambda a, x: a + x).alias("raw"))


@query("""WITH RECURSIVE i AS (SELECT user_id::VARCHAR AS session_id, event_id AS id, floor(value * 1000)::BIGINT AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 3 = 0),
r AS (SELECT session_id, id, k, CASE WHEN b <= 90000 THEN b ELSE 0 END AS t, b <= 90000 AS fits FROM i WHERE k = 1 UNION ALL SELECT i.session_id, i.id, i.k, CASE WHEN r.t + i.b <= 90000 THEN r.t + i.b ELSE r.t END, r.t + i.b <= 90000 FROM r JOIN i ON i.session_id = r.session_id AND i.k = r.k + 1)
SELECT session_id, id, 0 AS pos, 1 AS part, fits AS kept FROM r""")
def t8_cap_nested_images(s, d):
    parts = nested(s, d).select("session_id", "id", F.posexplode("content").alias("pos", "b")).select("session_id", "id", "pos", F.posexplode("b.parts").alias("part", "p"))
    return R.cap_nested_images(parts.where("p.type = 'image'").select("session_id", "id", "pos", "part", F.col("p.bytes").alias("bytes")), 90_000)


@query("SELECT conv_id::VARCHAR AS session_id, sum(strlen(text))::BIGINT AS estimate, sum(strlen(text))::BIGINT + 512 + 128 * count(*) AS bound, sum(strlen(text))::BIGINT + 1012 + 128 * count(*) AS needed, sum(strlen(text))::BIGINT + 1012 + 128 * count(*) <= 4000 AS admitted FROM conversations GROUP BY 1")
def t18_admitted_and_rejected(s, d):
    sized = S.conversations(s, d).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return R.admit_request(sized, 500, 4000)


@query("""WITH a AS (SELECT user_id * 400 + event_id % 400 AS target, event_id AS id, CASE event_type WHEN 'click' THEN 'tool_use' WHEN 'error' THEN 'max_tokens' ELSE 'end_turn' END AS stop, CASE WHEN event_type = 'view' THEN ' ' ELSE props END AS text FROM events),
n AS (SELECT *, row_number() OVER w AS k, bool_and(stop = 'tool_use') OVER w AS tools, stop = 'end_turn' AND trim(text) = '' AS blank FROM a WINDOW w AS (PARTITION BY target ORDER BY id)),
m AS (SELECT *, coalesce(bool_or(blank) OVER (PARTITION BY target ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prose FROM n)
SELECT target, arg_max(CASE WHEN stop = 'end_turn' AND NOT blank THEN 'none' WHEN prose THEN 'none' WHEN blank THEN 'prose' WHEN tools AND k = 1 THEN 'no tools' WHEN tools AND k = 2 THEN 'tools dropped' ELSE 'variant' END, id) AS rung, count(*) AS tries FROM m GROUP BY 1""")
def t15_next_rung(s, d):
    kind = F.col("event_type")
    calls = S.table(s, d, "events").select((F.col("user_id") * 400 + F.col("event_id") % 400).alias("target"), F.col("event_id").alias("id"), F.when(kind == "click", "tool_use").when(kind == "error", "max_tokens").otherwise("end_turn").alias("stop"), F.when(kind == "view", " ").otherwise(F.col("props")).alias("text"))
    return T.next_rung(calls)


@query(f"WITH l AS (SELECT *, id % 3 = 1 AS result FROM ({CONV})), t AS (SELECT *, sum((participant = 'user' AND NOT result)::INT) OVER (PARTITION BY session_id ORDER BY id)::BIGINT AS turn FROM l) SELECT session_id, turn, min(id) AS \"first\", max(id) AS \"last\" FROM t GROUP BY 1, 2")
def t20_turns_without_results(s, d):
    return L.turns_of(S.conversations(s, d).withColumn("tool_result", F.col("id") % 3 == 1))


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'tool_use' WHEN 3 THEN 'refusal' ELSE 'pause' END AS stop FROM events")
def f2_stop_reason(s, d):
    said = F.element_at(F.array(*map(F.lit, ("stop", "length", "tool_calls", "content_filter", "pause"))), (F.col("user_id") % 5 + 1).cast("int"))
    body = F.concat(F.lit('{"choices":[{"finish_reason":"'), said, F.lit('"}]}'))
    return S.table(s, d, "events").select("event_id", K.stop_reason(body).alias("stop"))


@query("SELECT user_id::VARCHAR AS session_id, 'all' AS purpose, event_id AS id, sum(CASE WHEN event_type = 'purchase' THEN ceil(value)::BIGINT END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events")
def f10_costs_until_known(s, d):
    """A cost is known for purchases alone; the total is null until the first."""
    cost = F.when(F.col("event_type") == "purchase", F.ceil("value")).cast("long")
    rows = S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.lit("all").alias("purpose"), F.col("event_id").alias("id"), cost.alias("tokens"))
    return L.running_totals(rows).drop("tokens")


@query(CONV_PYRAMID + TAKEN + """, u AS (SELECT m.* FROM m ANTI JOIN e USING (session_id, level, id) WHERE level > 1), h AS (SELECT session_id, unnest(range(id * (2 ** (level - 1))::BIGINT, (id + 1) * (2 ** (level - 1))::BIGINT)) AS chunk_id FROM u),
r AS (SELECT session_id, sum(raw)::BIGINT AS raw FROM c ANTI JOIN h USING (session_id, chunk_id) GROUP BY 1), t AS (SELECT session_id, sum(tokens)::BIGINT AS recalls FROM u GROUP BY 1)
SELECT session_id, coalesce(raw, 0) AS raw, coalesce(recalls, 0) AS recalls, coalesce(raw, 0) + coalesce(recalls, 0) AS total, 420 AS most, coalesce(raw, 0) + coalesce(recalls, 0) > 420 AS over FROM (SELECT DISTINCT session_id FROM c) LEFT JOIN r USING (session_id) LEFT JOIN t USING (session_id)""")
def k12_budget_breakdown(s, d):
    chunks, memories, edges = conv_tree(s, d)
    shown = K.unmerged(memories, edges).where("level > 1")
    raw = chunks.join(K.uncovered(chunks, K.chunks_of(shown, edges)).hint("merge"), ["session_id", "chunk_id"], "left_semi").groupBy("session_id").agg(F.sum("raw").alias("raw"))
    told = shown.groupBy("session_id").agg(F.sum("tokens").alias("recalls"))
    parts = chunks.select("session_id").distinct().join(raw, "session_id", "left").join(told, "session_id", "left").na.fill(0)
    return K.over_budget(parts.withColumn("total", F.col("raw") + F.col("recalls")), 400, 0.05)


@query(chunk_sql(DOCS, 3000, 4) + """, f AS (SELECT session_id, k AS compile_id, CASE WHEN chunk_id % 3 < k THEN 1 ELSE 0 END AS level, chunk_id AS id, CASE WHEN chunk_id % 3 < k THEN 40 ELSE raw END AS tokens FROM c, range(3) t(k)),
x AS (SELECT a.session_id, b.compile_id, a.tokens - b.tokens AS saved FROM f a JOIN f b ON b.session_id = a.session_id AND b.id = a.id AND b.compile_id = a.compile_id + 1 AND b.level <> a.level)
SELECT session_id, compile_id, count(*) AS replaced, count(*) AS shown, sum(saved)::BIGINT AS saved FROM x GROUP BY 1, 2""")
def k14_fold_diffs(s, d):
    """Three compiles: none folded, then every third chunk, then two of three."""
    chunks = doc_chunks(s, d).withColumn("compile_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    folded = F.col("chunk_id") % 3 < F.col("compile_id")
    return Z.fold_diffs(chunks.select("session_id", "compile_id", folded.cast("int").alias("level"), F.col("chunk_id").alias("id"), F.col("chunk_id").alias("last_chunk"), F.when(folded, 40).otherwise(F.col("raw")).alias("tokens")))


@query(CONV_PYRAMID + TAKEN + """, u AS (SELECT m.* FROM m ANTI JOIN e USING (session_id, level, id)), t AS (SELECT session_id, sum(tokens)::BIGINT AS total, bool_or(level = 1) AS ones FROM u GROUP BY 1)
SELECT session_id, total BETWEEN 100 AND 400 AS inside, NOT (total BETWEEN 100 AND 400) OR NOT ones AS kept FROM t""")
def k17_held_in_band(s, d):
    """After, what stands at level 1 is gone."""
    _, memories, edges = conv_tree(s, d)
    shown = K.unmerged(memories, edges)
    totals = shown.groupBy("session_id").agg(F.sum("tokens").alias("total"))
    return Z.held_in_band(shown, shown.where("level > 1"), totals, 400.0, 0.25)


@query(chunk_sql(DOCS, 3000, 4) + """, f AS (SELECT session_id, 1 AS level, chunk_id AS id, "first", "last", count(*) OVER (PARTITION BY session_id) AS n FROM c WHERE chunk_id % 4 <> 3), nw AS (SELECT * FROM f WHERE n >= 3 AND "last" - "first" <= 5),
g AS (SELECT *, coalesce(("first" <> lag("last") OVER v + 1)::INT, 1) AS b FROM nw WINDOW v AS (PARTITION BY session_id ORDER BY "first")), h AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY "first") AS run FROM g),
i AS (SELECT *, count(*) OVER r AS m, row_number() OVER (PARTITION BY session_id, run ORDER BY "first") AS k, min("first") OVER r AS s, max(run) OVER (PARTITION BY session_id) AS newest FROM h WINDOW r AS (PARTITION BY session_id, run)),
j AS (SELECT *, min(CASE WHEN m >= 3 OR m >= 2 AND run < newest THEN run END) OVER (PARTITION BY session_id) AS pick FROM i) SELECT session_id, level, id, s AS "first", run::BIGINT AS run FROM j WHERE run = pick AND k <= 3""")
def m3_merge_first_run(s, d):
    ones = doc_chunks(s, d).select("session_id", F.lit(1).alias("level"), F.col("chunk_id").alias("id"), "first", "last")
    return Z.merge_first_run(ones, ones.where("id % 4 = 3"), 3, 5)


USAGE = "SELECT user_id::VARCHAR AS session_id, ts, ceil(value)::BIGINT AS tokens FROM events"


def usage_rows(s, d):
    return S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("at"), F.ceil("value").cast("long").alias("tokens"))


@query(f"WITH u AS ({USAGE}), w AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM u) SELECT session_id, start, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM w GROUP BY 1, 2")
def x5_sliding_usage(s, d):
    return X.usage_windows(usage_rows(s, d), "2 hours", "10 minutes", "1 hour")


@query(f"WITH u AS ({USAGE}), f AS (SELECT *, coalesce((ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT, 1) AS fresh FROM u WINDOW w AS (PARTITION BY session_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM f) SELECT session_id, min(ts) AS start, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM g GROUP BY session_id, k")
def x5_session_usage(s, d):
    return X.usage_sessions(usage_rows(s, d))
