"""Queries on messages of blocks, and more of the pyramid, the plans and the ledgers; registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import plans as K
from . import sources as S
from . import turns as T
from .admission import admit
from .ledger import input_bound, ledger
from .queries import ATTEMPTS, CONV, CONV_PYRAMID, DOCS, attempts, chunk_sql, conv_chunks, conv_memories, conv_tree, doc_chunks, priced, query, tokens_sql


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a message of two blocks: its type as text, then a call, a result, an image, reasoning or text."""
    e, kind = S.table(spark, d, "events"), F.col("event_type")
    odd = F.col("event_id") % 2 == 1
    second = (
        F.when(kind == "click", B.block("tool_use", id=F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("t"), "event_id")), name=kind, input=F.col("props")))
        .when(kind == "view", B.block("tool_result", id=F.concat(F.lit("t"), F.col("event_id") - 1), text=F.col("props")))
        .when(kind == "signup", B.block("image", bytes=F.floor(F.col("value") * 1000)))
        .when(kind == "error", B.block("thinking", text=F.when(odd, F.col("props")).otherwise(""), signature=F.lit("s")))
        .otherwise(B.block("text", text=F.col("props")))
    )
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.array(B.block("text", text=kind), second).alias("content"))


def per_kind(click: str, view: str, signup: str, odd: str, even: str, other: str) -> str:
    return f"CASE event_type WHEN 'click' THEN {click} WHEN 'view' THEN {view} WHEN 'signup' THEN {signup} WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN {odd} ELSE {even} END ELSE {other} END"


TYPE_TOKENS, PROPS = tokens_sql("event_type"), tokens_sql("props")
QUARTER, JSON = "ceil(length(props) / 4.0::DOUBLE)::BIGINT", "length(json(props)::VARCHAR)"
RAW = f"({TYPE_TOKENS} + {per_kind(f'ceil({JSON} / 2.3::DOUBLE) + 20', 'ceil(length(props) / 2.3::DOUBLE)', '1600', PROPS, '600', PROPS)})::DOUBLE"
ONLY = f"ceil(length(event_type) / 4.0::DOUBLE)::BIGINT + {per_kind(f'ceil({JSON} / 4.0::DOUBLE)::BIGINT + 20', QUARTER, '0', QUARTER, '0', QUARTER)}"
APART = per_kind(JSON, "length(props)", "6400", "0", "0", "0")
WHOLE = f"length(event_type) + {per_kind(JSON, 'length(props)', '6400', 'length(props)', '0', 'length(props)')}"
SALIENCE = f"greatest(0.2::DOUBLE, 1 - 0.8::DOUBLE * least(1.0::DOUBLE, ({APART}) / ({WHOLE})::DOUBLE))"
BYTES = "CASE WHEN event_type = 'signup' THEN floor(value * 1000)::BIGINT ELSE 0 END"


@query("""WITH v AS (SELECT event_id, (1 + event_id % 9973)::VARCHAR AS m, event_id % 43 - 14 AS e FROM events), n AS (SELECT event_id, length(m) + e AS n, length(rtrim(m, '0')) AS k FROM v)
SELECT event_id, 6 + CASE WHEN k <= n AND n <= 21 THEN n WHEN n > 0 AND n <= 21 THEN k + 1 WHEN n > -6 AND n <= 0 THEN k + 2 - n ELSE k + (k > 1)::BIGINT + 2 + length(abs(n - 1)::VARCHAR) END AS n FROM n""")
def p4_numbers(s, d):
    """Numbers from 1e-14 to 1e32 in exponent form."""
    number = F.concat(1 + F.col("event_id") % 9973, F.lit("e"), F.col("event_id") % 43 - 14)
    return S.table(s, d, "events").select("event_id", B.json_len(F.concat(F.lit('{"v": '), number, F.lit("}"))).cast("long").alias("n"))


@query(f"SELECT event_id, {JSON} AS n FROM events")
def p4_json_len(s, d):
    return S.table(s, d, "events").select("event_id", B.json_len(F.col("props")).alias("n"))


@query(f"SELECT event_id AS id, event_type || {per_kind("''", "''", "chr(10) || '[image]'", "''", "''", 'chr(10) || props')} AS text FROM events")
def p5_text_of(s, d):
    return event_messages(s, d).select("id", B.text_of(F.col("content")).alias("text"))


@query(f"SELECT event_id AS id, {ONLY} AS tokens FROM events")
def p7_text_only_tokens(s, d):
    return B.message_price(event_messages(s, d)).select("id", F.col("text_only").alias("tokens"))


@query(f"SELECT event_id AS id, {RAW} AS raw FROM events")
def p9_raw_tokens(s, d):
    return B.message_price(event_messages(s, d)).select("id", "raw")


@query(f"SELECT event_id AS id, {BYTES} AS image_bytes FROM events")
def p12_image_bytes(s, d):
    return event_messages(s, d).select("id", B.image_bytes(F.col("content")).alias("image_bytes"))


@query(f"SELECT user_id::VARCHAR AS session_id, event_id AS id, {per_kind("'text,tool_use'", "'text,tool_result'", "'image,text'", "'text,thinking'", "'text,thinking'", "'text'")} AS kinds, {RAW} AS raw, (event_type = 'signup')::BIGINT AS images, {BYTES} AS image_bytes, {ONLY} AS text_only, {SALIENCE} AS salience FROM events")
def p14_message_price(s, d):
    return B.message_price(event_messages(s, d)).withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT event_id AS id, (2 - (event_type = 'click' AND event_id % 10 = 0)::INT)::BIGINT AS good FROM events")
def p15_well_formed(s, d):
    return event_messages(s, d).select("id", F.size(F.filter("content", B.well_formed)).cast("long").alias("good"))


@query(f"SELECT event_id AS id, {per_kind("'text,tool_use'", "'text,tool_result'", "'text,image'", "'text'", "'text'", "'text,text'")} AS kinds FROM events")
def p16_strip_reasoning(s, d):
    return event_messages(s, d).select("id", F.array_join(F.transform(B.strip_reasoning(F.col("content")), lambda b: b["type"]), ",").alias("kinds"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN props ELSE 'm' || event_id END AS text FROM events")
def p19_answer(s, d):
    return event_messages(s, d).select("id", B.answer(F.slice("content", 2, 1), F.concat(F.lit("m"), "id")).alias("text"))


@query(f"SELECT conv_id, turn, {tokens_sql('role')} + {tokens_sql('text')} AS tokens FROM conversations")
def p24_request_overhead(s, d):
    return S.table(s, d, "conversations").select("conv_id", "turn", B.request_overhead(F.col("role"), F.col("text")).alias("tokens"))


@query("SELECT event_id, nullif(ceil(value)::BIGINT + CASE WHEN event_type = 'click' THEN user_id + length(props) ELSE 0 END, 0) AS n FROM events")
def p29_usage_input(s, d):
    provider = F.when(F.col("event_type") == "click", "Bedrock").otherwise(F.col("event_type"))
    return S.table(s, d, "events").select("event_id", B.usage_input(provider, F.ceil("value").cast("long"), F.col("user_id"), F.length("props")).cast("long").alias("n"))


@query(f"""WITH RECURSIVE i AS (SELECT user_id::VARCHAR AS session_id, event_id AS id, {BYTES} AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'signup'),
r AS (SELECT session_id, id, k, (b <= 120000)::INT AS n, CASE WHEN b <= 120000 THEN b ELSE 0 END AS t, b <= 120000 AS fits FROM i WHERE k = 1 UNION ALL
SELECT i.session_id, i.id, i.k, r.n + (r.n < 3 AND r.t + i.b <= 120000)::INT, CASE WHEN r.n < 3 AND r.t + i.b <= 120000 THEN r.t + i.b ELSE r.t END, r.n < 3 AND r.t + i.b <= 120000 FROM r JOIN i ON i.session_id = r.session_id AND i.k = r.k + 1)
SELECT session_id, id FROM r WHERE fits""")
def w5_admit(s, d):
    messages = event_messages(s, d).withColumn("bytes", B.image_bytes(F.col("content")))
    images = messages.where(F.exists("content", lambda b: b["type"] == "image"))
    return admit(images, 3, 120_000)


# --- chunks, pyramid, plans


@query(chunk_sql(DOCS, 3000, 4) + ' SELECT session_id, chunk_id, "first", "last", row_number() OVER (PARTITION BY session_id, "first", "last" ORDER BY chunk_id) - 1 AS ordinal FROM c')
def c5_chunk_spans(s, d):
    return K.chunk_spans(doc_chunks(s, d))


@query(chunk_sql(CONV, 100, 2) + ' SELECT session_id, chunk_id, raw FROM c')
def c8_chunk_raw(s, d):
    return K.chunk_raw(priced(S.conversations(s, d)), conv_chunks(s, d))


@query(chunk_sql(DOCS, 3000, 4) + f""", dem AS (SELECT source AS session_id, 2 AS a, 6 AS b FROM documents GROUP BY 1)
SELECT c.session_id, c.chunk_id FROM c JOIN dem USING (session_id) WHERE c."last" >= dem.a AND c."first" <= dem.b""")
def d3_demanded(s, d):
    ranges = S.document_logs(s, d).select("session_id").distinct().select("session_id", F.lit(2).alias("first"), F.lit(6).alias("last"))
    return K.demanded(doc_chunks(s, d), ranges)


@query("""WITH q AS (SELECT user_id AS key, min(event_id) AS "at" FROM events WHERE event_type = 'view' GROUP BY 1),
n AS (SELECT user_id AS key, min(event_id) AS "at" FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT key FROM q) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1)
SELECT key, "at", 0 AS fresh FROM q UNION ALL SELECT key, "at", 1 FROM n""")
def d4_enqueue(s, d):
    e = S.table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), "event_type")
    some = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    queue = some("view").groupBy("key").agg(F.min("at").alias("at"))
    return K.enqueue(queue, some("click"), some("purchase").select("key"))


TAKEN = ", e AS (SELECT DISTINCT session_id, level - 1 AS level, unnest([id * 2, id * 2 + 1]) AS id FROM m WHERE level > 1)"


@query(CONV_PYRAMID + ' SELECT session_id, level, id, unnest([id * 2, id * 2 + 1]) AS member FROM m WHERE level > 1')
def m8_members(s, d):
    return K.members(conv_tree(s, d)[2]).drop("member_level")


@query(CONV_PYRAMID + ' SELECT session_id, level, id, id * (2 ** (level - 1))::BIGINT AS first_chunk, (id + 1) * (2 ** (level - 1))::BIGINT - 1 AS last_chunk FROM m')
def m9_chunks_of(s, d):
    return K.chunks_of(*conv_tree(s, d)[1:]).select("session_id", "level", "id", "first_chunk", "last_chunk")


@query(CONV_PYRAMID + ' SELECT session_id, chunk_id, level, chunk_id // (2 ** (level - 1))::BIGINT AS ancestor FROM (SELECT session_id, level, id, unnest(range(id * (2 ** (level - 1))::BIGINT, (id + 1) * (2 ** (level - 1))::BIGINT)) AS chunk_id FROM m)')
def m7_closure(s, d):
    return K.closure(conv_tree(s, d)[2])


@query(CONV_PYRAMID + TAKEN + ' SELECT m.session_id, m.level, m.id, m."last", m.tokens FROM m ANTI JOIN e USING (session_id, level, id) WHERE m."last" < 6')
def m10_unmerged(s, d):
    return K.unmerged(*conv_tree(s, d)[1:], 6).select("session_id", "level", "id", "last", "tokens")


@query(CONV_PYRAMID + """, r AS (SELECT session_id, id, sum(tokens) OVER w AS t, row_number() OVER w AS k FROM m WHERE level = 1 WINDOW w AS (PARTITION BY session_id ORDER BY id)),
z AS (SELECT session_id, min(k) AS k FROM r WHERE t >= 150 AND k >= 2 GROUP BY 1) SELECT r.session_id, r.id FROM r JOIN z ON z.session_id = r.session_id AND r.k <= z.k""")
def m4_merge_by_tokens(s, d):
    return K.first_group(conv_memories(s, d).where("level = 1"), ["id"], 2, 150).select("session_id", "id")


@query(CONV_PYRAMID + TAKEN + """, u AS (SELECT m.* FROM m ANTI JOIN e USING (session_id, level, id)), b AS (SELECT * FROM u QUALIFY level < max(level) OVER (PARTITION BY session_id)),
r AS (SELECT session_id, level, id, sum(tokens) OVER w AS t, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY session_id ORDER BY "first")),
z AS (SELECT session_id, min(k) AS k FROM r WHERE t >= 60 AND k >= 1 GROUP BY 1) SELECT r.session_id, r.level, r.id FROM r JOIN z ON z.session_id = r.session_id AND r.k <= z.k""")
def m5_lift(s, d):
    return K.lift(*conv_tree(s, d)[1:], 1, 60).select("session_id", "level", "id")


@query(CONV_PYRAMID + """ SELECT session_id, level, id, CASE WHEN "last" - "first" > 3 * 2 ** greatest(0, level - 3) THEN 'too wide' END AS reason FROM m""")
def m6_span_guard(s, d):
    return K.span_guard(conv_memories(s, d), 3, 2).select("session_id", "level", "id", "reason")


@query(chunk_sql(DOCS, 3000, 4) + " SELECT session_id, sum(raw)::BIGINT AS total, 8400 AS most, sum(raw) > 8400 AS over FROM c GROUP BY 1")
def k12_over_budget(s, d):
    totals = doc_chunks(s, d).groupBy("session_id").agg(F.sum("raw").alias("total"))
    return K.over_budget(totals, 8000, 0.05)


@query(CONV_PYRAMID + " SELECT c.session_id, c.chunk_id FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.session_id = c.session_id AND m.level > 1 AND m.\"first\" <= c.\"first\" AND m.\"last\" >= c.\"last\") AND chunk_id % 5 <> 4")
def k16_assert_coverage(s, d):
    chunks, memories, edges = conv_tree(s, d)
    return K.uncovered(chunks, K.chunks_of(memories.where("level > 1"), edges), chunks.where("chunk_id % 5 = 4"))


# --- ledgers


@query("""WITH a AS (SELECT user_id::VARCHAR AS session_id, event_id AS id, event_type AS target, CASE WHEN event_id % 3 = 0 THEN 'refusal' ELSE 'retry' END AS outcome, event_id // 200 AS messages FROM events),
n AS (SELECT session_id, max(id) // 200 AS now, arg_max(outcome, id) AS last FROM a GROUP BY 1)
SELECT session_id, target, bool_or(last = 'refusal') OR count(*) FILTER (messages = now) >= 2 AS blocked FROM a JOIN n USING (session_id) GROUP BY 1, 2""")
def f6_blocked(s, d):
    tried = S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("target"), F.when(F.col("event_id") % 3 == 0, "refusal").otherwise("retry").alias("outcome"), F.floor(F.col("event_id") / 200).cast("long").alias("messages"))
    lengths = tried.groupBy("session_id").agg(F.max("messages").alias("messages"))
    return K.blocked(tried, lengths, 2)


@query(f"WITH a AS ({ATTEMPTS}) SELECT target, count(*) AS failures, count(DISTINCT id % 5) AS shapes FROM a WHERE kind = 'fail' GROUP BY 1 HAVING count(*) >= 5 OR count(DISTINCT id % 5) >= 3")
def f7_quarantine(s, d):
    return K.quarantine(attempts(s, d).withColumn("request", F.col("id") % 5), 5)


@query("SELECT user_id AS target, event_id AS id, CASE WHEN event_id % 7 <> 0 THEN 'mint' ELSE 'fail' END AS kind, CASE WHEN event_id % 7 = 0 THEN 'stale' END AS reason FROM events")
def f8_discard_stale(s, d):
    e = S.table(s, d, "events").select(F.col("user_id").alias("target"), F.col("event_id").alias("id"), F.lit("mint").alias("kind"), F.lit(None).cast("string").alias("reason"), (F.col("event_id") % 7).alias("version"))
    return K.discard_stale(e.withColumn("now", F.when(F.col("version") == 0, 1).otherwise(F.col("version"))))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'retryable' WHEN user_id % 5 = 1 THEN 'final' WHEN user_id % 5 = 2 THEN 'retryable' WHEN user_id % 5 = 3 THEN 'ok' ELSE 'malformed' END AS class FROM events")
def f2_classify_response(s, d):
    status = F.element_at(F.array(*map(F.lit, (503, 404, 429, 200, 200))), (F.col("user_id") % 5 + 1).cast("int"))
    body = F.when(F.col("user_id") % 5 == 3, F.concat(F.lit('{"choices":[{"finish_reason":"stop","message":{"content":"'), "event_type", F.lit('"}}]}'))).otherwise(F.col("props"))
    return S.table(s, d, "events").select("event_id", K.classify_response(status, body).alias("class"))


# --- turns


def events_said(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.col("event_type").alias("participant"), F.col("props").alias("text"), (F.col("event_type") == "click").alias("tool_use"))


SAID = "SELECT user_id::VARCHAR AS session_id, event_id AS id, event_type AS participant, props AS text, event_type = 'click' AS tool_use FROM events"


@query(f"""WITH l AS ({SAID}), f AS (SELECT *, (participant IS DISTINCT FROM lag(participant) OVER (PARTITION BY session_id ORDER BY id))::INT AS c FROM l), t AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY id)::BIGINT AS turn FROM f)
SELECT session_id, turn, min(participant) AS participant, min(id) AS "first", max(id) AS "last", string_agg(text, ' | ' ORDER BY id) AS text FROM t GROUP BY 1, 2""")
def t2_collapse_turns(s, d):
    return T.collapse_turns(events_said(s, d), " | ")


@query("""WITH u AS (SELECT user_id, 't' || event_id AS call FROM events WHERE event_type = 'click' AND event_id % 10 <> 0), r AS (SELECT user_id, 't' || (event_id - 1) AS call FROM events WHERE event_type = 'view'),
k AS (SELECT e.*, CASE event_type WHEN 'click' THEN event_id % 10 <> 0 AND (user_id, 't' || event_id) IN (SELECT (user_id, call) FROM r) WHEN 'view' THEN (user_id, 't' || (event_id - 1)) IN (SELECT (user_id, call) FROM u) ELSE true END AS ok FROM events e)
SELECT user_id::VARCHAR AS session_id, event_id AS id, ok::BIGINT AS kept, NOT ok AS omitted FROM k""")
def t3_drop_unpaired_tools(s, d):
    tools = event_messages(s, d).select("session_id", "id", F.posexplode(F.slice("content", 2, 1)).alias("pos", "b"))
    return T.drop_unpaired_tools(tools.select("session_id", "id", "pos", "b.type", F.col("b.id").alias("call")))


LEFT = f"l AS ({SAID}), k AS (SELECT l.session_id, l.id FROM l JOIN (SELECT session_id, max(id) FILTER (NOT tool_use) AS z FROM l GROUP BY 1) x ON x.session_id = l.session_id AND l.id <= x.z)"


@query(f"WITH {LEFT} SELECT session_id, id FROM k")
def t6_drop_trailing_calls(s, d):
    return T.drop_trailing_calls(events_said(s, d)).select("session_id", "id")


@query(f"WITH {LEFT} SELECT n.session_id, n.id IS NOT DISTINCT FROM z.id AS kept FROM (SELECT session_id, max(id) AS id FROM l GROUP BY 1) n LEFT JOIN (SELECT session_id, max(id) AS id FROM k GROUP BY 1) z USING (session_id)")
def t7_newest_kept(s, d):
    log = events_said(s, d)
    return T.newest_kept(log, T.drop_trailing_calls(log))


FREE = CONV_PYRAMID + TAKEN + ", u AS (SELECT m.* FROM m ANTI JOIN e USING (session_id, level, id))"


@query(FREE + ' SELECT session_id, min("first") - 1 AS before, max(CASE WHEN level > 1 THEN "first" END) AS above, max("first") AS newest FROM u GROUP BY 1')
def t10_cache_seams(s, d):
    return T.cache_seams(K.unmerged(*conv_tree(s, d)[1:]).withColumn("pos", F.col("first")))


@query(FREE + """, i AS (SELECT session_id, "first" AS id, tokens + 50 AS b, row_number() OVER (PARTITION BY session_id ORDER BY "first" DESC) AS k FROM u),
r AS (SELECT session_id, id, k, CASE WHEN b <= 220 THEN b ELSE 0 END AS t, b <= 220 AS fits FROM i WHERE k = 1 UNION ALL
SELECT i.session_id, i.id, i.k, CASE WHEN r.t + i.b <= 220 THEN r.t + i.b ELSE r.t END, r.t + i.b <= 220 FROM r JOIN i ON i.session_id = r.session_id AND i.k = r.k + 1)
SELECT session_id, id FROM r WHERE fits""")
def t11_recall_within_budget(s, d):
    return T.recall_within_budget(K.unmerged(*conv_tree(s, d)[1:]).select("session_id", F.col("first").alias("id"), "tokens"), 220)


@query(f"""WITH a AS ({ATTEMPTS.replace("'stale'", "'tool_call'")}), n AS (SELECT *, coalesce(sum((kind = 'fail')::INT) OVER (PARTITION BY target ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tries, lag(reason) OVER (PARTITION BY target ORDER BY id) AS was FROM a)
SELECT target, id, tries, greatest(8000, floor(60000 * 0.5::DOUBLE ** least(4, tries) + 0.5::DOUBLE)::BIGINT) AS budget, was IS NOT DISTINCT FROM 'tool_call' AND tries >= 2 AS drop_tools FROM n""")
def t15_next_attempt(s, d):
    return T.next_attempt(attempts(s, d).replace("stale", "tool_call", "reason"), 60_000)


@query("SELECT conv_id::VARCHAR AS session_id, sum(strlen(text))::BIGINT + 512 + 128 * count(*) AS bound FROM conversations GROUP BY 1")
def t17_input_bound(s, d):
    sized = S.conversations(s, d).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    return sized.select("session_id", input_bound(F.col("n"), F.col("b")).alias("bound"))


@query(chunk_sql(CONV, 100, 2) + ", f AS (SELECT session_id, min(CASE WHEN chunk_id % 3 = 1 THEN chunk_id END) AS f FROM c GROUP BY 1) SELECT c.session_id, coalesce(sum(CASE WHEN chunk_id >= f THEN CASE WHEN chunk_id % 3 = 1 THEN 10 ELSE raw END END), 0)::BIGINT AS cost FROM c JOIN f USING (session_id) GROUP BY 1")
def k2_kv_cost(s, d):
    before = conv_chunks(s, d).select("session_id", F.col("chunk_id").alias("pos"), F.concat(F.lit("c"), "chunk_id").alias("unit"), F.col("raw").alias("tokens"))
    folded = F.col("pos") % 3 == 1
    after = before.select("session_id", "pos", F.when(folded, F.concat(F.lit("m"), "pos")).otherwise(F.col("unit")).alias("unit"), F.when(folded, 10).otherwise(F.col("tokens")).alias("tokens"))
    return T.kv_cost(before, after)


@query(CONV_PYRAMID + ' SELECT session_id, sum(0.5::DOUBLE * greatest(0, level - (id % 2)))::DOUBLE AS misallocation FROM m GROUP BY 1')
def k4_misallocation(s, d):
    return T.misallocation(conv_memories(s, d).select("session_id", "level", (F.col("id") % 2).alias("cap"), F.lit(0.5).alias("salience")))


@query(f"""WITH a AS ({ATTEMPTS}), x AS (SELECT * FROM a UNION ALL SELECT target, 1000000000, 'clear', NULL FROM a WHERE target % 2 = 0 GROUP BY 1)
SELECT target, count(*) FILTER (kind = 'fail' AND reason = 'refusal' AND id > z) AS attempts FROM (SELECT *, coalesce(max(CASE WHEN kind = 'clear' THEN id END) OVER (PARTITION BY target), -1) AS z FROM x) GROUP BY 1""")
def f9_clear_debt(s, d):
    log = attempts(s, d)
    owed = log.where("target % 2 = 0").select("target").distinct()
    return ledger(K.clear_debt(log, owed, 1_000_000_000)).select("target", "attempts")


@query("SELECT user_id::VARCHAR AS session_id, max(event_id) AS id, arg_max(ceil(value)::BIGINT, event_id) AS tokens FROM events WHERE event_type = 'view' GROUP BY 1")
def f11_last_prompt(s, d):
    usage = S.table(s, d, "events").where("event_type = 'view'").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.ceil("value").cast("long").alias("tokens"))
    return K.last_prompt(usage)


@query("WITH u AS (SELECT user_id::VARCHAR AS session_id, event_id AS id FROM events WHERE event_type = 'view'), c AS (SELECT user_id::VARCHAR AS session_id, max(event_id) AS c FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT u.session_id, u.id FROM u JOIN c USING (session_id) WHERE u.id >= c.c")
def f11_unlearnt(s, d):
    e = S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), "event_type")
    compiles = e.where("event_type = 'purchase'").select("session_id", F.col("id").alias("compile_id"))
    return K.unlearnt(e.where("event_type = 'view'").drop("event_type"), compiles)
