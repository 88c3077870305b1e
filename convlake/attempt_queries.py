"""Queries on what is asked next, what a turn's end says, and posts that a limit refuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ledger as L
from . import plans as K
from . import repair as Y
from . import requests as R
from . import selection as Z
from . import sources as S
from . import turns as T
from .block_queries import TAKEN
from .keep import kept
from .pricing import recall_label
from .queries import CHANNEL, CONV, CONV_PYRAMID, conv_memories, conv_tree, posts, query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def said_sql(template: str, **fields: str) -> str:
    """A template of TEMPLATES in SQL."""
    text = quoted(R.TEMPLATES[template])
    for name, value in fields.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


def seen_sql(reading: bool) -> str:
    raw, deep = (quoted(R.SEEN[reading, r]) for r in (True, False))
    return f"CASE WHEN level = 2 THEN {raw} ELSE replace({deep}, '{{shown}}', (level - 2)::VARCHAR) END"


NUMBERS = {"target_tokens": "'200'", "total_tokens": "coalesce(reading::VARCHAR, '')"}
ASKED = f"""CASE WHEN level = 1 AND reading IS NOT NULL THEN {said_sql("reading_l1", **NUMBERS)} WHEN level = 1 THEN {said_sql("l1_chunk", **NUMBERS)}
WHEN reading IS NOT NULL THEN {said_sql("reading_merge", **NUMBERS, target_level="level::VARCHAR", seen_description=seen_sql(True))} ELSE {said_sql("merge", **NUMBERS, target_level="level::VARCHAR", seen_description=seen_sql(False))} END"""


@query(CONV_PYRAMID + f""", t AS (SELECT session_id, level, id, text, CASE WHEN tokens % 3 = 0 THEN tokens * 10 END AS reading, CASE WHEN tokens % 4 > 0 THEN 'Before: ' || "first" END AS pre, tokens % 5 = 0 AS bare FROM m)
SELECT session_id, level, id, CASE WHEN level > 1 THEN 'prefix+one-level-deeper' WHEN bare THEN 'source-only' ELSE 'six-section' END AS scope,
concat_ws(chr(10) || chr(10), CASE WHEN NOT (level = 1 AND bare) THEN pre END, CASE WHEN level = 1 THEN {quoted(R.TEMPLATES["marker"])} END, nullif(text, ''), {ASKED}) AS "user" FROM t""")
def p27_memory_requests(s, d):
    tokens = F.col("tokens")
    targets = conv_memories(s, d).select("session_id", "level", "id", F.col("text").alias("source"), F.when(tokens % 4 > 0, F.concat(F.lit("Before: "), "first")).alias("prefix"), F.when(tokens % 3 == 0, tokens * 10).alias("reading_tokens"), (tokens % 5 == 0).alias("source_only"))
    return R.memory_requests(targets, 200).select("session_id", "level", "id", "scope", "user")


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS session_id, event_id // 2000 AS turn, event_id, event_type, props, user_id, CASE event_id % 5 WHEN 0 THEN 'bash' WHEN 1 THEN 'edit' WHEN 2 THEN 'web_search' WHEN 3 THEN 'message' ELSE 'read' END AS name, repeat(props, (event_id % 12)::INT) AS line FROM events),
c AS (SELECT session_id, turn, event_id, CASE name WHEN 'bash' THEN '$ ' || CASE WHEN length(line) > 80 THEN left(line, 80) || '…' ELSE line END WHEN 'edit' THEN 'edit ' || props WHEN 'web_search' THEN 'web_search “' || props || '”' ELSE name END
|| CASE WHEN EXISTS (SELECT 1 FROM e r WHERE r.event_type = 'view' AND r.event_id = e.event_id + 1 AND r.session_id = e.session_id AND r.turn = e.turn) THEN ' (failed)' ELSE '' END AS s, row_number() OVER (PARTITION BY session_id, turn ORDER BY event_id) AS k FROM e WHERE event_type = 'click' AND name <> 'message'),
g AS (SELECT session_id, turn, string_agg(s, ' · ' ORDER BY k) FILTER (k <= 20) AS ran, greatest(count(*) - 20, 0) AS more FROM c GROUP BY 1, 2), q AS (SELECT session_id, turn, arg_max(props, event_id) FILTER (event_type = 'purchase' AND trim(props) <> '') AS said FROM e GROUP BY 1, 2)
SELECT q.session_id, q.turn, coalesce(said, {quoted(R.SILENT)}) || CASE WHEN ran IS NULL THEN '' ELSE chr(10) || chr(10) || 'What Ada ran this turn: ' || ran || CASE WHEN more > 0 THEN ' · and ' || more || ' more' ELSE '' END END AS text FROM q LEFT JOIN g USING (session_id, turn)""")
def p28_turn_ended(s, d):
    kind, n = F.col("event_type"), F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("bash", "edit", "web_search", "message", "read")]), (n % 5 + 1).cast("int"))
    line = F.concat(F.expr("repeat(props, cast(event_id % 12 as int))"), F.lit("\nexit"))
    rows = S.table(s, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.floor(n / 2000).cast("long").alias("turn"), n.alias("id"), F.lit(0).alias("pos"), F.when(kind == "view", "user").otherwise("assistant").alias("participant"),
        F.when(kind == "click", "tool_use").when(kind == "view", "tool_result").when(kind == "purchase", "text").otherwise("image").alias("type"), F.when(kind == "purchase", F.col("props")).alias("text"),
        F.when(kind == "click", n).otherwise(n - 1).alias("call"), name.alias("name"), F.to_json(F.struct(line.alias("command"), F.col("props").alias("path"), F.col("props").alias("query"))).alias("input"), F.lit(True).alias("failed"),
    )
    return R.turn_ended(rows, "Ada")


@query(f"""WITH RECURSIVE p AS (SELECT event_id, {CHANNEL} AS channel, user_id, epoch_us(ts) AS t, 1 + user_id % 3 AS cap, row_number() OVER (PARTITION BY {CHANNEL}, user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT p.*, [t] AS made, true AS accepted, NULL::BIGINT AS frees FROM p WHERE k = 1
 UNION ALL SELECT event_id, channel, user_id, t, cap, k, CASE WHEN len(live) < cap THEN list_append(live, t) ELSE live END, len(live) < cap, CASE WHEN len(live) >= cap THEN live[len(live) - cap + 1] + 86400000000 END
 FROM (SELECT p.*, list_filter(w.made, lambda x: x >= p.t - 86400000000) AS live FROM w JOIN p ON p.channel = w.channel AND p.user_id = w.user_id AND p.k = w.k + 1))
SELECT event_id, accepted, greatest(0, cap - len(made)) AS remaining, frees FROM w""")
def f13_accepted_posts(s, d):
    made = L.accepted_posts(posts(s, d), 1 + F.col("session_id") % 3)
    return made.select("event_id", "accepted", "remaining", F.unix_micros("frees").alias("frees"))


@query(CONV_PYRAMID + """, s AS (SELECT session_id, sum(tokens)::BIGINT AS now, max(id) AS newest FROM m WHERE level = 1 GROUP BY 1), t AS (SELECT session_id, sum(raw)::BIGINT AS total FROM c GROUP BY 1), l AS (SELECT DISTINCT session_id FROM m WHERE level = 2),
g AS (SELECT m.session_id, c.raw - m.tokens AS g FROM m JOIN s ON s.session_id = m.session_id AND m.id = s.newest AND m.level = 1 JOIN c ON c.session_id = m.session_id AND c.chunk_id = m.id)
SELECT t.session_id, total > 260 AND now > 180 AND l.session_id IS NOT NULL AS stopped_folding, (total > 260 OR total < 160) AND coalesce(now + g <= 180, false) AS stopped_unfolding FROM t LEFT JOIN s USING (session_id) LEFT JOIN l ON l.session_id = t.session_id LEFT JOIN g ON g.session_id = t.session_id""".replace(", l AS (SELECT DISTINCT", ", lv AS (SELECT DISTINCT").replace("l.session_id IS NOT NULL", "lv.session_id IS NOT NULL").replace("LEFT JOIN l ON l.session_id", "LEFT JOIN lv ON lv.session_id"))
def k17_stop_rules(s, d):
    """Every chunk is shown by its memory; the window is 260, a fold's target 180, and below 160 memories open."""
    chunks, memories, edges = conv_tree(s, d)
    carried = chunks.groupBy("session_id").agg(F.sum("raw").alias("total"))
    return Z.stop_rules(carried, memories.where("level = 1"), chunks, memories, edges, 260.0, 80 / 260, 160 / 260)


@query("""WITH a AS (SELECT user_id * 400 + event_id % 400 AS target, event_id AS id, CASE event_type WHEN 'click' THEN 'tool_use' WHEN 'error' THEN 'max_tokens' WHEN 'signup' THEN 'refusal' ELSE 'end_turn' END AS stop, CASE WHEN event_type = 'view' THEN ' ' ELSE props END AS text FROM events),
n AS (SELECT *, row_number() OVER w AS k, bool_and(stop = 'tool_use') OVER w AS tools, stop = 'end_turn' AND trim(text) = '' AS blank FROM a WINDOW w AS (PARTITION BY target ORDER BY id)),
m AS (SELECT *, coalesce(bool_or(blank) OVER (PARTITION BY target ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prose FROM n),
r AS (SELECT target, arg_max(CASE WHEN stop = 'end_turn' AND NOT blank THEN 'none' WHEN prose THEN 'none' WHEN blank THEN 'prose' WHEN tools AND k = 1 THEN 'no tools' WHEN tools AND k = 2 THEN 'tools dropped' ELSE 'variant' END, id) AS rung, count(*) AS tries, count(*) - 1 - least(2, count(*) FILTER (tools)) AS tried, target % 3 AS most FROM m GROUP BY 1)
SELECT target, CASE WHEN rung = 'variant' AND tried >= most THEN 'exhausted' ELSE rung END AS rung, CASE WHEN rung = 'variant' AND tried < most THEN tried + 1 END AS variant, tries FROM r""")
def t15_rung_of_variants(s, d):
    kind = F.col("event_type")
    calls = S.table(s, d, "events").select((F.col("user_id") * 400 + F.col("event_id") % 400).alias("target"), F.col("event_id").alias("id"), F.when(kind == "click", "tool_use").when(kind == "error", "max_tokens").when(kind == "signup", "refusal").otherwise("end_turn").alias("stop"), F.when(kind == "view", " ").otherwise(F.col("props")).alias("text"))
    return T.next_rung(calls, calls.select("target", (F.col("target") % 3).alias("variants")).distinct())


REQUEST = CONV_PYRAMID + TAKEN + """, u AS (SELECT m.*, row_number() OVER (PARTITION BY session_id ORDER BY "first") - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n FROM m ANTI JOIN e USING (session_id, level, id)),
rq AS (SELECT session_id, 2 * k AS pos, '[CM] Recall memory ' || level || ':' || id || '.' AS text, level, id FROM u UNION ALL SELECT session_id, 2 * k + 1, text, level, id FROM u
 UNION ALL SELECT p.session_id, 2 * u.n, p.text, NULL, NULL FROM p JOIN (SELECT session_id, max(n) AS n FROM u GROUP BY 1) u USING (session_id) WHERE p.id = (SELECT max(id) FROM p q WHERE q.session_id = p.session_id)),
sz AS (SELECT session_id, sum(strlen(text))::BIGINT AS b, count(*) AS t FROM rq GROUP BY 1), pa AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "last" DESC) AS o FROM u WHERE level > 1),
ch AS (SELECT pa.session_id, pa.level, pa.id, pa."last", 2 * pa.k AS pos, sum(strlen('[CM] Recall memory ' || m.level || ':' || m.id || '.') + strlen(m.text))::BIGINT AS nb, any_value(strlen('[CM] Recall memory ' || pa.level || ':' || pa.id || '.') + strlen(pa.text)) AS ob FROM pa JOIN m ON m.session_id = pa.session_id AND m.level = pa.level - 1 AND m.id // 2 = pa.id GROUP BY ALL),
bd AS (SELECT ch.*, sz.b - ob + nb + 512 + 128 * (sz.t + 2) AS bound, sz.b + 512 + 128 * sz.t AS base FROM ch JOIN sz USING (session_id)),
av AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "last" DESC, pos DESC) AS variant FROM bd WHERE CASE WHEN session_id::INT % 2 = 0 THEN bound ELSE 700 + greatest(1, bound - base) END + 300 <= 3000 QUALIFY variant <= 2)"""


def newest_requests(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each session's recalls of its unmerged memories, then its newest message; even sessions have no count of their provider."""
    _, memories, edges = conv_tree(s, d)
    by = Window.partitionBy("session_id").orderBy("first")
    shown = K.unmerged(memories, edges).withColumn("k", F.row_number().over(by) - 1)
    pair = F.explode(F.array(F.struct(F.lit(0).alias("k"), recall_label(F.concat_ws(":", "level", "id")).alias("t")), F.struct(F.lit(1).alias("k"), F.col("text").alias("t"))))
    text = lambda df, pos, said, level, number: df.select("session_id", pos.cast("long").alias("pos"), F.lit(0).alias("part"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("call"), said.alias("text"), level.alias("level"), number.alias("id"))
    recalls = text(shown.withColumn("_q", pair), 2 * F.col("k") + F.col("_q.k"), F.col("_q.t"), F.col("level"), F.col("id"))
    count = shown.groupBy("session_id").agg(F.count("*").alias("n"))
    newest = S.last(S.conversations(s, d)).join(count.hint("merge"), "session_id")
    request = kept(recalls.unionByName(text(newest, 2 * F.col("n"), F.col("text"), F.lit(None).cast("int"), F.lit(None).cast("long"))))
    budgets = count.select("session_id", F.when(F.col("session_id").cast("int") % 2 == 1, 700).alias("provider"), F.lit(300).alias("reserve"), F.lit(3000).alias("budget"))
    return request, memories, edges, budgets


@query(REQUEST + " SELECT session_id, variant, level, id, pos, bound FROM av")
def t16_admitted_variants(s, d):
    return R.admitted_variants(*newest_requests(s, d), 2)


@query(REQUEST + """, rs AS (SELECT av.session_id, av.variant, rq.pos AS a, 0 AS b, 0 AS c, rq.text FROM av JOIN rq USING (session_id) WHERE rq.pos < av.pos OR rq.pos > av.pos + 1
UNION ALL SELECT av.session_id, av.variant, av.pos, m."first", x.c, CASE x.c WHEN 0 THEN '[CM] Recall memory ' || m.level || ':' || m.id || '.' ELSE m.text END FROM av JOIN m ON m.session_id = av.session_id AND m.level = av.level - 1 AND m.id // 2 = av.id, (VALUES (0), (1)) x(c))
SELECT session_id, variant, row_number() OVER (PARTITION BY session_id, variant ORDER BY a, b, c) - 1 AS pos, text FROM rs""")
def t16_variant_requests(s, d):
    request, memories, edges, budgets = newest_requests(s, d)
    variants = kept(R.admitted_variants(request, memories, edges, budgets, 2))
    return R.variant_requests(request, memories, edges, variants).select("session_id", "variant", "pos", "text")


@query(f"""WITH RECURSIVE l AS ({CONV}), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS k, CASE WHEN length(text) % 5 = 0 THEN 'call:' || id END AS key, participant = 'assistant' AS a FROM l WHERE id > 0),
tr AS (SELECT session_id, 2 * id + length(text) % 2 AS "at", a, key, CASE length(text) % 3 WHEN 0 THEN text WHEN 1 THEN 'The user said:' || chr(10) || text ELSE text || '.' END AS t, length(text) % 7 = 0 AS sys FROM (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 'call:' || id END AS key, participant = 'assistant' AS a FROM l)),
w AS (SELECT session_id, 0::BIGINT AS k, 1000000::BIGINT AS e FROM l GROUP BY 1
 UNION ALL SELECT w.session_id, n.k, coalesce((SELECT max(tr."at") FROM tr WHERE tr.session_id = n.session_id AND tr.a = n.a AND tr."at" < w.e AND CASE WHEN n.key IS NOT NULL THEN tr.key = n.key ELSE trim(n.text) <> '' AND (tr.t = n.text OR ends_with(tr.t, chr(10) || n.text)) END), w.e) FROM w JOIN n ON n.session_id = w.session_id AND n.k = w.k + 1),
m AS (SELECT session_id, min(e) AS matched FROM w GROUP BY 1 HAVING min(e) < 1000000)
SELECT session_id, matched, coalesce((SELECT max("at") FROM tr WHERE tr.session_id = m.session_id AND tr."at" <= matched AND NOT sys), 0) AS start FROM m""")
def t19_align_transcript(s, d):
    """The transcript has each message, some with a line before it or a sign after it, and some a place later; the log lacks the first."""
    n = F.length("text")
    rows = S.conversations(s, d).select("session_id", "id", (F.col("participant") == "assistant").alias("assistant"), F.when(n % 5 == 0, F.concat(F.lit("call:"), "id")).alias("key"), "text")
    theirs = F.when(n % 3 == 0, F.col("text")).when(n % 3 == 1, F.concat(F.lit("The user said:\n"), "text")).otherwise(F.concat("text", F.lit(".")))
    keys = F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>"))
    transcript = rows.select("session_id", (2 * F.col("id") + n % 2).cast("long").alias("at"), "assistant", keys.alias("keys"), F.array(theirs).alias("texts"), (n % 7 == 0).alias("system"), F.lit(False).alias("results"))
    return Y.align_transcript(rows.where("id > 0"), transcript)
