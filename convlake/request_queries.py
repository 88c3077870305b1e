"""Queries on requests and tasks; registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import blocks as B
from . import chunking as C
from . import plans as K
from . import requests as R
from . import sources as S
from .block_queries import BYTES, TAKEN, event_messages, per_kind
from .queries import CONV, CONV_PYRAMID, conv_chunks, conv_memories, conv_tree, query


@query("""SELECT doc_id, CASE WHEN (length(text) + length(lang)) // 4 <= 50 THEN text || '|' || lang ELSE left(text, 200) || CASE WHEN length(text) > 200 THEN chr(10) || chr(10) || '[truncated — original was ' || ceil(length(text) / 4.0::DOUBLE)::BIGINT || ' tokens]' ELSE '' END
|| CASE WHEN length(text) >= 200 THEN '' ELSE '|' || left(lang, 200 - length(text)) || CASE WHEN length(lang) > 200 - length(text) THEN chr(10) || chr(10) || '[truncated — original was ' || ceil(length(lang) / 4.0::DOUBLE)::BIGINT || ' tokens]' ELSE '' END END END AS text FROM documents""")
def p13_truncate_blocks(s, d):
    content = F.array(B.block("text", text=F.col("text")), B.block("image", bytes=F.lit(5)), B.block("text", text=F.col("lang")))
    texts = F.filter(R.truncate_blocks(content, 50), lambda b: b["type"] == "text")
    return S.table(s, d, "documents").select("doc_id", F.array_join(F.transform(texts, lambda b: b["text"]), "|").alias("text"))


@query(f"SELECT event_id AS id, 'text:' || event_type || ' ' || {per_kind(repr('tool_use:') + ' || props', repr('tool_result:') + ' || props', repr('image:') + ' || (floor(value * 1000)::BIGINT // 1024)', repr('thinking:') + ' || props', repr('thinking:'), repr('text:') + ' || props')} AS brief FROM events")
def p22_brief(s, d):
    return event_messages(s, d).select("id", F.array_join(R.brief(F.col("content")), " ").alias("brief"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'They asked at ' || turn || ': ' || text WHEN 'assistant' THEN 'I said: ' || text END AS prompt FROM conversations")
def p27_render_prompt(s, d):
    templates = {"user": "They asked at {turn}: {text}", "assistant": "I said: {text}"}
    return R.render_prompt(S.table(s, d, "conversations"), templates, "role", ["turn", "text"]).select("conv_id", "turn", "prompt")


@query("""WITH c AS (SELECT user_id::VARCHAR AS session_id, event_id // 5000 AS turn, event_id, row_number() OVER (PARTITION BY user_id, event_id // 5000 ORDER BY event_id) AS k, event_type || CASE WHEN EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.event_id = e.event_id + 1 AND r.user_id = e.user_id AND r.event_id // 5000 = e.event_id // 5000) THEN ' (failed)' ELSE '' END AS s FROM events e WHERE event_type = 'click'),
g AS (SELECT session_id, turn, string_agg(s, ' · ' ORDER BY k) FILTER (k <= 20) AS calls, greatest(count(*) - 20, 0) AS more FROM c GROUP BY 1, 2)
SELECT a.session_id, a.turn, a.said, coalesce(calls, '') AS calls, coalesce(more, 0) AS more FROM (SELECT user_id::VARCHAR AS session_id, event_id // 5000 AS turn, arg_max(props, event_id) FILTER (event_type = 'purchase' AND trim(props) <> '') AS said FROM events GROUP BY 1, 2) a LEFT JOIN g USING (session_id, turn)""")
def p28_turn_summary(s, d):
    kind = F.col("event_type")
    rows = S.table(s, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.floor(F.col("event_id") / 5000).cast("long").alias("turn"), F.col("event_id").alias("id"),
        F.when(kind == "click", "tool_use").when(kind == "view", "tool_result").when(kind == "purchase", "text").otherwise("image").alias("type"),
        F.when(kind == "purchase", F.col("props")).alias("text"), F.when(kind == "click", F.col("event_id")).otherwise(F.col("event_id") - 1).alias("call"), kind.alias("name"), F.lit(True).alias("failed"),
    )
    return R.turn_summary(rows)


IMAGES = f"SELECT user_id::VARCHAR AS session_id, event_id AS id, ceil(value)::BIGINT + CASE WHEN event_type = 'signup' THEN 1600 ELSE 0 END AS tokens, event_type = 'signup' AS image, {BYTES} AS bytes FROM events"


def image_log(s, d):
    image = F.col("event_type") == "signup"
    return S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), (F.ceil("value") + F.when(image, 1600).otherwise(0)).cast("long").alias("tokens"), image.alias("image"), F.when(image, F.floor(F.col("value") * 1000)).otherwise(0).cast("long").alias("bytes"))


def kept_sql(source: str, count: int, size: int) -> str:
    fits = f"r.n < {count} AND r.t + i.b <= {size}"
    return f"""i AS (SELECT session_id, id, bytes AS b, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS k FROM {source}),
r AS (SELECT session_id, id, k, (b <= {size})::INT AS n, CASE WHEN b <= {size} THEN b ELSE 0 END AS t, b <= {size} AS fits FROM i WHERE k = 1 UNION ALL
SELECT i.session_id, i.id, i.k, r.n + ({fits})::INT, CASE WHEN {fits} THEN r.t + i.b ELSE r.t END, {fits} FROM r JOIN i ON i.session_id = r.session_id AND i.k = r.k + 1)"""


@query(f"""WITH RECURSIVE l AS ({IMAGES}), dp AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM l), im AS (SELECT * FROM dp WHERE image AND d <= 5000), {kept_sql("im", 3, 120000)}
SELECT l.session_id, l.id, l.tokens - CASE WHEN l.image AND r.id IS NULL THEN 1591 ELSE 0 END AS tokens FROM l LEFT JOIN (SELECT session_id, id FROM r WHERE fits) r ON r.session_id = l.session_id AND r.id = l.id""")
def w6_post_strip_tokens(s, d):
    return R.post_strip_tokens(image_log(s, d), 5000, 3, 120_000)


SEVERAL = "SELECT user_id::VARCHAR AS session_id, event_id AS id, pos, CASE WHEN pos = 0 THEN 900 ELSE 1600 END AS raw, floor(value * 100)::BIGINT * (pos + 1) AS bytes FROM events, (SELECT unnest([0, 1, 2]) AS pos) WHERE pos < event_id % 4"


@query(f"""WITH RECURSIVE l AS ({IMAGES}), dp AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM l),
v AS ({SEVERAL}), i AS (SELECT v.*, row_number() OVER (PARTITION BY v.session_id ORDER BY v.id DESC, pos) AS k FROM v JOIN dp ON dp.session_id = v.session_id AND dp.id = v.id WHERE d <= 20000),
r AS (SELECT session_id, id, pos, k, (bytes <= 90000)::INT AS n, CASE WHEN bytes <= 90000 THEN bytes ELSE 0 END AS t, bytes <= 90000 AS fits FROM i WHERE k = 1 UNION ALL
SELECT i.session_id, i.id, i.pos, i.k, r.n + (r.n < 20 AND r.t + i.bytes <= 90000)::INT, CASE WHEN r.n < 20 AND r.t + i.bytes <= 90000 THEN r.t + i.bytes ELSE r.t END, r.n < 20 AND r.t + i.bytes <= 90000 FROM r JOIN i ON i.session_id = r.session_id AND i.k = r.k + 1),
g AS (SELECT v.session_id, v.id, sum(raw - 9) AS gone FROM v LEFT JOIN r ON r.session_id = v.session_id AND r.id = v.id AND r.pos = v.pos AND fits WHERE r.id IS NULL GROUP BY 1, 2)
SELECT l.session_id, l.id, (l.tokens - coalesce(gone, 0))::BIGINT AS tokens FROM l LEFT JOIN g USING (session_id, id)""")
def w6_stripped_prices(s, d):
    """Up to three images a message."""
    images = S.table(s, d, "events").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("pos < event_id % 4")
    images = images.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), "pos", F.when(F.col("pos") == 0, 900).otherwise(1600).alias("raw"), (F.floor(F.col("value") * 100) * (F.col("pos") + 1)).cast("long").alias("bytes"))
    return R.stripped_prices(image_log(s, d), images, 20_000, 20, 90_000)


@query(f"""WITH l AS ({IMAGES}), t AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY id DESC) AS t FROM l), z AS (SELECT session_id, coalesce(max(CASE WHEN t > 3000 THEN id END) + 1, 0) AS tail FROM t GROUP BY 1)
SELECT session_id, id, tokens - CASE WHEN image AND id < tail THEN 1600 ELSE 0 END AS tokens FROM l JOIN z USING (session_id)""")
def w8_live_price(s, d):
    log = image_log(s, d)
    return R.live_price(log, C.tail_start(log.withColumn("tool_result", F.lit(False)), 3000))


@query(f"SELECT user_id::VARCHAR AS session_id, event_id AS id, 0::BIGINT AS part, CASE WHEN event_type = 'purchase' THEN 'User' ELSE 'agent' END AS participant, {per_kind(repr('text,tool_use'), repr('text'), repr('text,image'), repr('text,thinking'), repr('text,thinking'), repr('text,text'))} AS kinds FROM events UNION ALL SELECT user_id::VARCHAR, event_id, 1, 'user', 'tool_result' FROM events WHERE event_type = 'view'")
def t1_split_mixed_turns(s, d):
    who = F.when(F.get("content", F.lit(0))["text"] == "purchase", "User").otherwise("agent")
    blocks = event_messages(s, d).select("session_id", "id", who.alias("participant"), F.posexplode("content").alias("pos", "b"))
    return R.split_mixed_turns(blocks.select("session_id", "id", "participant", "pos", "b.type"))


@query(f"WITH RECURSIVE l AS ({IMAGES}), im AS (SELECT * FROM l WHERE image), {kept_sql('im', 1000000000, 90000)} SELECT session_id, id, fits AS kept FROM r")
def t8_cap_images(s, d):
    return R.cap_images(image_log(s, d).where("image").select("session_id", "id", "bytes"), 90_000)


@query(f"WITH l AS ({CONV}), x AS (SELECT session_id, min(CASE WHEN id % 4 = 3 THEN id END) AS f, max(id) AS z FROM l GROUP BY 1) SELECT session_id, least(1, z) AS head, coalesce(f, z + 1) - 1 AS same, z AS \"last\" FROM x")
def t9_cache_marks(s, d):
    after = S.conversations(s, d).select("session_id", F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("key"))
    return R.cache_marks(after.withColumn("key", F.when(F.col("pos") % 4 == 3, "old").otherwise(F.col("key"))), after, 2)


REQUEST = CONV_PYRAMID + """, tg AS (SELECT o.session_id, min(o.id) AS "first", string_agg(o.text, ' ' ORDER BY o.id) AS text FROM o JOIN (SELECT session_id, max(chunk_id) AS chunk_id FROM c GROUP BY 1) n USING (session_id, chunk_id) GROUP BY 1),
b AS (SELECT p.session_id, p.id, p.text FROM p JOIN tg ON tg.session_id = p.session_id AND p.id < tg."first"), rc AS (SELECT m.* FROM m JOIN tg USING (session_id) WHERE m.level = 1 AND m.id % 2 = 0 AND m."first" >= 1 AND m."last" < tg."first"),
q AS (SELECT session_id, 1 AS section, id AS ord, text FROM b WHERE id < 1 UNION ALL SELECT session_id, 2, "first", text FROM rc UNION ALL SELECT session_id, 3, id, text FROM b WHERE id >= 1 AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.session_id = b.session_id AND b.id BETWEEN rc."first" AND rc."last")
UNION ALL SELECT session_id, 4, 0, '[chunk]' FROM tg UNION ALL SELECT session_id, 5, 0, text FROM tg UNION ALL SELECT session_id, 6, 0, 'Summarize.' FROM tg)"""


def newest_request(s, d):
    log, chunks = S.conversations(s, d), conv_chunks(s, d)
    newest = chunks.groupBy("session_id").agg(F.max("chunk_id").alias("chunk_id"))
    owned = C.owner_of(log, chunks.select("session_id", "chunk_id", "first", "last")).join(newest, ["session_id", "chunk_id"], "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))  # a chunk's messages
    target = owned.groupBy("session_id").agg(F.min("id").alias("first"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return R.assemble(log, conv_memories(s, d).where("level = 1 and id % 2 = 0"), target, 1, "[chunk]", "Summarize.")


@query(REQUEST + " SELECT * FROM q")
def t12_assemble_l1(s, d):
    return newest_request(s, d)


@query(REQUEST + " SELECT * FROM q WHERE section >= 4 OR session_id::INT % 2 = 1")
def t14_source_only(s, d):
    refused = S.conversations(s, d).where("cast(session_id as int) % 2 = 0").select("session_id")
    return R.source_only(newest_request(s, d), refused)


@query(CONV_PYRAMID + TAKEN + """, u AS (SELECT m.* FROM m ANTI JOIN e USING (session_id, level, id)), v AS (SELECT session_id, level AS l, id AS i, row_number() OVER (PARTITION BY session_id ORDER BY "last" DESC) AS variant FROM u WHERE level > 1 QUALIFY variant <= 2)
SELECT u.session_id, variant, level, id FROM u JOIN v USING (session_id) WHERE NOT (level = l AND id = i) UNION ALL SELECT session_id, variant, l - 1, unnest([i * 2, i * 2 + 1]) FROM v""")
def t16_recall_variants(s, d):
    _, memories, edges = conv_tree(s, d)
    return R.recall_variants(K.unmerged(memories, edges), K.members(edges), 2)


# --- tasks


def tasks(s, d, last: int, owner):
    rows = S.table(s, d, "conversations").where(F.col("turn") <= last)
    comments = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("author"), "text")))
    made = rows.groupBy("conv_id").agg(comments.alias("comments"))
    return made.select((F.col("conv_id") % 3).alias("board"), (F.col("conv_id") % 4).alias("column"), F.concat("conv_id", F.lit("-t.md")).alias("file"), F.col("conv_id").alias("number"), owner.alias("owner"), "comments")


@query("""WITH a AS (SELECT conv_id % 3 AS board, conv_id || '-t.md' AS file, CASE conv_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' END AS owner, CASE conv_id % 2 WHEN 0 THEN 'user' END AS was, turn, role, text FROM conversations), m AS (SELECT *, min(turn) OVER (PARTITION BY file) <= 2 AS old FROM a)
SELECT DISTINCT board, file, owner AS "to", 'handed' AS what, NULL AS text FROM m WHERE owner IS NOT NULL AND owner IS DISTINCT FROM CASE WHEN old THEN was END AND owner <> 'assistant'
UNION ALL SELECT board, file, owner, 'comment', text FROM m WHERE owner IS NOT NULL AND turn > 2 AND role <> owner""")
def f16_task_changes(s, d):
    before = tasks(s, d, 2, F.when(F.col("conv_id") % 2 == 0, "user"))
    after = tasks(s, d, 1_000_000, F.when(F.col("conv_id") % 3 == 0, "user").when(F.col("conv_id") % 3 == 1, "assistant"))
    return R.task_changes(before, after, "assistant")


@query("""SELECT conv_id % 3 AS board, conv_id % 4 AS "column", string_agg(conv_id || '-t.md:' || n, ',' ORDER BY conv_id) AS tasks FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1, 2""")
def f17_board_view(s, d):
    return R.board_view(tasks(s, d, 1_000_000, F.lit("user")))
