"""The registered queries of the library, each with the SQL that DuckDB holds it against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking as C
from . import ledger as L
from . import plans as K
from . import pricing as P
from . import pyramid as M
from . import sources as S
from . import streaming as X
from .keep import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CONV = "SELECT conv_id::VARCHAR AS session_id, turn AS id, role AS participant, text FROM conversations"
DOCS = "SELECT source AS session_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id, lang AS participant, text, doc_id FROM documents"
CLASS = r"""[\x{7f}-\x{10ffff}{}\[\]":_/=`]"""
FORKS = """SELECT * FROM (VALUES ('src0.a', 'src0', 3), ('src0.b', 'src0.a', 2), ('src1.a', 'src1', 5)) AS t(session_id, parent_id, "at")"""


def tokens_sql(t: str) -> str:
    n = f"least(length({t}), 2000)"
    return f"(CASE WHEN length({t}) > 0 THEN ceil(length({t}) / (CASE WHEN ({n} - length(regexp_replace(left({t}, 2000), '{CLASS}', '', 'g'))) / {n}::DOUBLE > 0.12::DOUBLE THEN 2.3::DOUBLE ELSE 2.9::DOUBLE END)) ELSE 0 END)::BIGINT"


def chunk_sql(log: str, target: int, least: int) -> str:
    """CTEs l (log), p (priced) and c (closed chunks)."""
    done = f"w.t >= {target} AND w.n >= {least}"
    return f"""WITH RECURSIVE l AS ({log}), p AS (SELECT session_id, id, text, participant, {tokens_sql("text")} AS tokens FROM l),
w AS (SELECT session_id, id, tokens, 0::BIGINT AS chunk_id, tokens AS t, 1 AS n FROM p WHERE id = 0 UNION ALL
 SELECT p.session_id, p.id, p.tokens, CASE WHEN {done} THEN w.chunk_id + 1 ELSE w.chunk_id END, CASE WHEN {done} THEN p.tokens ELSE w.t + p.tokens END, CASE WHEN {done} THEN 1 ELSE w.n + 1 END
 FROM w JOIN p ON p.session_id = w.session_id AND p.id = w.id + 1),
c AS (SELECT session_id, chunk_id, min(id) AS "first", max(id) AS "last", sum(tokens)::BIGINT AS raw FROM w GROUP BY 1, 2 HAVING max(t) >= {target} AND max(n) >= {least})"""


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def priced(log: DataFrame) -> DataFrame:
    return log.select("session_id", "id", "participant", "text", P.density_tokens(F.col("text")).alias("tokens"), F.lit(False).alias("tool_use"), F.lit(False).alias("tool_result"))


def events_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.row_number().over(S.Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("id"), (kind == "click").alias("tool_use"), (kind == "view").alias("tool_result"), F.ceil("value").cast("long").alias("tokens"))


EVENTS = "SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS id, event_type = 'click' AS tool_use, event_type = 'view' AS tool_result, ceil(value)::BIGINT AS tokens FROM events"


def forks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src0.a", "src0", 3), ("src0.b", "src0.a", 2), ("src1.a", "src1", 5)], "session_id string, parent_id string, at long")


# --- sources


@query(f"WITH l AS ({CONV}) SELECT session_id, max(id) AS id, arg_max(text, id) AS text FROM l GROUP BY 1")
def s4_last(s, d):
    return S.last(S.conversations(s, d))


@query(f"WITH l AS ({CONV}) SELECT session_id, min(id) AS id, arg_min(text, id) AS text FROM l GROUP BY 1")
def s5_first(s, d):
    return S.first(S.conversations(s, d))


@query(f"WITH l AS ({CONV}) SELECT session_id, max(id) + 1 AS n FROM l GROUP BY 1")
def s6_count(s, d):
    return S.count(S.conversations(s, d))


@query(f"WITH l AS ({DOCS}) SELECT session_id, id, doc_id FROM l WHERE id IN (3, 1000000)")
def s7_get(s, d):
    log = S.document_logs(s, d)
    keys = log.select("session_id").distinct().withColumn("id", F.explode(F.array(F.lit(3).cast("long"), F.lit(1000000).cast("long"))))
    return S.get(log.select("session_id", "id", "doc_id"), keys)[0]


@query(f"WITH l AS ({DOCS}) SELECT session_id, id, doc_id FROM l WHERE id BETWEEN 2 AND 9")
def s8_span(s, d):
    return S.span(S.document_logs(s, d), 2, 9).select("session_id", "id", "doc_id")


@query(f"WITH l AS ({DOCS}) SELECT session_id, id, doc_id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM l")
def s9_backwards(s, d):
    return S.document_logs(s, d).select("session_id", "id", "doc_id", F.row_number().over(S.newest_first()).cast("long").alias("back"))


@query(f"WITH l AS ({DOCS}) SELECT session_id, id, doc_id FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 5")
def s10_page(s, d):
    return S.page(S.document_logs(s, d), 5).select("session_id", "id", "doc_id")


@query(f"WITH l AS ({CONV}), e AS (SELECT session_id, max(id) AS e FROM l GROUP BY 1) SELECT session_id, e.e + row_number() OVER (PARTITION BY session_id ORDER BY l.id) AS id, l.id AS was FROM l JOIN e USING (session_id)")
def s3_append(s, d):
    log = S.conversations(s, d)
    return S.append_ids(log, log.select("session_id", F.col("id").alias("was")), "was").select("session_id", "id", "was")


FORK_SQL = f"""WITH RECURSIVE l AS ({DOCS}), f AS ({FORKS}), seen AS (
SELECT session_id, session_id AS ancestor, NULL::BIGINT AS cut FROM (SELECT session_id FROM l UNION SELECT session_id FROM f)
UNION ALL SELECT s.session_id, f.parent_id, least(s.cut, f."at") FROM seen s JOIN f ON f.session_id = s.ancestor)
SELECT s.session_id, l.session_id AS owner, l.id, l.participant FROM seen s JOIN l ON l.session_id = s.ancestor WHERE s.cut IS NULL OR l.id <= s.cut"""


@query(FORK_SQL)
def s11_resolve_forks(s, d):
    return S.resolve_forks(S.document_logs(s, d), forks(s))


@query(chunk_sql(DOCS, 3000, 4) + f", f AS ({FORKS}) SELECT f.session_id, 0 AS level, count(*) FILTER (c.\"last\" <= f.\"at\") AS shared FROM f JOIN c ON c.session_id = f.parent_id GROUP BY 1, 2")
def s12_fork_shared_counts(s, d):
    return S.fork_shared_counts(doc_chunks(s, d).select("session_id", F.lit(0).alias("level"), "last"), forks(s))


@query(f"WITH l AS ({DOCS}) SELECT session_id, id, doc_id FROM l WHERE id >= 4 AND id <= 6")
def s10_page_range(s, d):
    return S.page(S.document_logs(s, d), start=4, stop=6).select("session_id", "id", "doc_id")


@query(f"WITH l AS ({DOCS}) SELECT k.session_id, k.id FROM (SELECT DISTINCT session_id, unnest([3, 1000000]) AS id FROM l) k ANTI JOIN l USING (session_id, id)")
def s7_absent_keys(s, d):
    log = S.document_logs(s, d).select("session_id", "id")
    keys = log.select("session_id").distinct().withColumn("id", F.explode(F.array(F.lit(3).cast("long"), F.lit(1000000).cast("long"))))
    return S.get(log, keys)[1]


@query(chunk_sql(DOCS, 3000, 4) + f", f AS ({FORKS}) SELECT f.session_id AS fork, c.chunk_id AS pos, 0 AS level, c.chunk_id AS id FROM f JOIN c ON c.session_id = f.parent_id WHERE c.chunk_id < (SELECT count(*) FROM c q WHERE q.session_id = f.parent_id AND q.\"last\" <= f.\"at\")")
def s12_surviving_prefix(s, d):
    chunks = kept(doc_chunks(s, d))
    items = chunks.select("session_id", F.lit(0).alias("level"), "last")
    shared = S.fork_shared_counts(items, forks(s)).join(forks(s).select("session_id", "parent_id"), "session_id").select(F.col("session_id").alias("fork"), F.col("parent_id").alias("session_id"), "level", "shared")
    return S.surviving_prefix(chunks.select("session_id", F.col("chunk_id").alias("pos"), F.lit(0).alias("level"), F.col("chunk_id").alias("id")), shared)


@query(f"WITH l AS ({DOCS}), f AS ({FORKS}) SELECT l.session_id, count(*) AS messages, f.parent_id, f.\"at\"::BIGINT AS \"at\" FROM l LEFT JOIN f USING (session_id) GROUP BY ALL")
def s13_session_catalog(s, d):
    return S.catalog(S.document_logs(s, d), forks(s))


# --- prices


def column_query(name: str, log: str, make: Callable[[Column], Column], sql: str, source: str = "documents") -> None:
    """A rule applied to every text of a table."""
    key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[source]
    query(f"SELECT {key}, {sql.replace("{t}", text)} AS x FROM {source}", name)(lambda s, d: S.table(s, d, source).select(key, make(F.col(text)).alias("x")))


column_query("p1_utf16_len", DOCS, P.utf16_len, "length({t})")
column_query("p3_trim_js", DOCS, P.trim_js, r"trim({t}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(5760) || chr(8192) || chr(8232) || chr(8233) || chr(12288) || chr(65279))")
column_query("p6_flat_tokens", DOCS, P.flat_tokens, "ceil(length({t}) / 4.0::DOUBLE)::BIGINT")
column_query("p8_density_tokens", DOCS, P.density_tokens, tokens_sql("{t}"))
column_query("p2_round_half_up", DOCS, lambda t: P.round_half_up(F.length(t) / 8.0), "(floor(length({t}) / 8.0::DOUBLE) + (length({t}) / 8.0::DOUBLE - floor(length({t}) / 8.0::DOUBLE) >= 0.5)::INT)::BIGINT")
column_query("p2_round_half_even", DOCS, lambda t: P.round_half_even(F.length(t) / 8.0), "round_even(length({t}) / 8.0::DOUBLE, 0)::BIGINT")
column_query("p25_digest_eighth", DOCS, lambda t: P.digest_words(t, None), "array_to_string(list_slice(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> ''), 1, greatest(40, len(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> '')) // 8)), ' ')")
column_query("p17_strip_thinking", DOCS, lambda t: P.strip_thinking(F.concat(F.lit(" <thinking>a\n</thinking>\n"), t)), "regexp_replace(' <thinking>a' || chr(10) || '</thinking>' || chr(10) || {t}, '^\\s*<thinking>.*?</thinking>\\s*', '', 'si')")
column_query("p23_repeats_tail", DOCS, lambda t: P.repeats_tail(t, 12), "length({t}) > 12 AND contains(left({t}, length({t}) - 12), right({t}, 12))")
column_query("p25_digest_words", DOCS, P.digest_words, "array_to_string(list_slice(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> ''), 1, 40), ' ')")
column_query("p26_halve_source", DOCS, P.halve_source, "array_to_string(list_slice(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> ''), len(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> '')) // 2 + 1, 1000000000), ' ')")


@query("SELECT doc_id, ceil(length('[CM] Recall memory ' || doc_id || '.') / 4.0::DOUBLE)::BIGINT + ceil(length(text) / 4.0::DOUBLE)::BIGINT AS tokens FROM documents")
def p18_recall_tokens(s, d):
    return S.table(s, d, "documents").select("doc_id", P.recall_tokens(F.col("doc_id"), F.col("text")).alias("tokens"))


@query("SELECT doc_id, '[CM] Recall memory ' || doc_id || '.' AS label, text AS body FROM documents")
def p20_recall_pair(s, d):
    return S.table(s, d, "documents").select("doc_id", P.recall_label(F.col("doc_id")).alias("label"), F.col("text").alias("body"))


@query("SELECT conv_id, turn, sha256('{\"role\":\"' || role || '\",\"n\":' || length(text) || '}') AS digest FROM conversations")
def p21_digest(s, d):
    return S.table(s, d, "conversations").select("conv_id", "turn", F.sha2(F.to_json(F.struct("role", F.length("text").alias("n"))), 256).alias("digest"))


@query(f"""WITH b AS (SELECT page_id, html || chr(10) || url AS t FROM pages),
x AS (SELECT page_id, length(t) AS n, list_sum(list_transform(string_split(t, '```')[2:], lambda p, i: CASE WHEN i % 2 = 1 THEN length(p) ELSE 0 END)) AS fenced,
list_sum(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: regexp_full_match(l, 'https?://\\S+')), lambda l: length(l))) AS links FROM b)
SELECT page_id, CASE WHEN n <= 0 THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, 1 - 0.8::DOUBLE * least(1.0::DOUBLE, (coalesce(fenced, 0) + coalesce(links, 0)) / n::DOUBLE)) END AS salience FROM x""")
def p11_salience(s, d):
    text = F.concat("html", F.lit("\n"), "url")
    return S.table(s, d, "pages").select("page_id", P.salience(text).alias("salience"))


# --- windows and chunks


def doc_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.close_chunks(priced(S.document_logs(s, d)), 3000, 4)


def conv_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.close_chunks(priced(S.conversations(s, d)), 100, 2)


@query(f"WITH e AS ({EVENTS}), t AS (SELECT session_id, row_number() OVER w AS k, sum(tokens) OVER w AS t FROM e WINDOW w AS (PARTITION BY session_id ORDER BY id)) SELECT session_id, min(CASE WHEN t > 300 THEN k END) - 1 AS inside FROM t GROUP BY 1")
def w1_crossing(s, d):
    return C.crossing(events_log(s, d), 300)


@query(f"""WITH e AS ({EVENTS}), t AS (SELECT session_id, id, sum(tokens) OVER w AS t, coalesce(lag(tool_use) OVER w, false) AS call, count(*) OVER (PARTITION BY session_id) AS n FROM e WINDOW w AS (PARTITION BY session_id ORDER BY id))
SELECT session_id, coalesce(min(CASE WHEN t > 300 THEN id END) - arg_min(call::INT, CASE WHEN t > 300 THEN id END), max(n)) AS head_end FROM t GROUP BY 1""")
def w2_head_end(s, d):
    return C.head_end(events_log(s, d), 300)


@query(f"""WITH e AS ({EVENTS}), t AS (SELECT session_id, id, sum(tokens) OVER (PARTITION BY session_id ORDER BY id DESC) AS t, coalesce(lead(tool_result) OVER (PARTITION BY session_id ORDER BY id), false) AS answer FROM e)
SELECT session_id, coalesce(max(CASE WHEN t > 300 THEN id END) + 1 - arg_max(answer::INT, CASE WHEN t > 300 THEN id END), 0) AS tail_start FROM t GROUP BY 1""")
def w3_tail_start(s, d):
    return C.tail_start(events_log(s, d), 300)


@query(chunk_sql(DOCS, 3000, 4) + """ SELECT session_id, chunk_id, "first", "last", raw FROM c
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) <= 1 OR coalesce(sum(raw) OVER (PARTITION BY session_id ORDER BY chunk_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6000 OR chunk_id % 4 = 2""")
def w4_raw_zone(s, d):
    chunks = kept(doc_chunks(s, d))
    return C.raw_zone(chunks, 1, 6000, chunks.where("chunk_id % 4 = 2"))


@query(chunk_sql(DOCS, 3000, 4) + ' SELECT session_id, chunk_id, "first", "last", raw FROM c')
def c1_close_chunks(s, d):
    return doc_chunks(s, d)


@query(chunk_sql(CONV, 100, 2) + ' SELECT session_id, chunk_id, "first", "last", raw FROM c')
def c1_close_chunks_conversations(s, d):
    return conv_chunks(s, d)


SHARD = f"""WITH l AS ({DOCS}), p AS (SELECT session_id, id, text, {tokens_sql("text")} AS tokens FROM l),
q AS (SELECT *, ceil(tokens / 500.0::DOUBLE)::INT AS pieces, length(text) // ceil(tokens / 500.0::DOUBLE)::INT AS share FROM p WHERE tokens > 1000), r AS (SELECT *, unnest(range(pieces))::INT AS piece FROM q)
SELECT session_id, id, piece, pieces, CASE WHEN piece < pieces - 1 THEN substring(text, piece * share + 1, share) ELSE substring(text, piece * share + 1) END AS slice FROM r"""


@query(SHARD)
def c3_shard(s, d):
    return C.shard(priced(S.document_logs(s, d)), 500)


RUNS = f"WITH e AS (SELECT session_id, id FROM ({EVENTS}) WHERE NOT tool_use), g AS (SELECT session_id, id, id - row_number() OVER (PARTITION BY session_id ORDER BY id) AS g FROM e), r AS (SELECT session_id, g, min(id) AS \"first\", max(id) AS \"last\", count(*) AS n FROM g GROUP BY 1, 2)"


@query(RUNS + ' SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY "first") AS run, "first", "last", n FROM r')
def c4_runs(s, d):
    return C.runs(events_log(s, d).where("not tool_use").select("session_id", "id"))


@query(chunk_sql(DOCS, 3000, 4) + ' SELECT p.session_id, p.id, c.chunk_id FROM p LEFT JOIN c ON c.session_id = p.session_id AND p.id BETWEEN c."first" AND c."last"')
def c9_owner_of(s, d):
    return C.owner_of(S.document_logs(s, d).select("session_id", "id"), doc_chunks(s, d))


@query(chunk_sql(DOCS, 3000, 4) + ' SELECT s.session_id, coalesce(max(c."last") + 1, 0) AS open_start FROM (SELECT DISTINCT session_id FROM p) s LEFT JOIN c USING (session_id) GROUP BY 1')
def c10_open_start(s, d):
    return C.open_start(S.document_logs(s, d), doc_chunks(s, d))


# --- derived work, pyramid, selection

DIGEST = "array_to_string(list_slice(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> ''), 1, 40), ' ')"
PYRAMID = f""", o AS (SELECT p.session_id, c.chunk_id, p.id, p.text FROM p JOIN c ON c.session_id = p.session_id AND p.id BETWEEN c."first" AND c."last"),
m1 AS (SELECT session_id, 1 AS level, chunk_id AS id, min(id) AS "first", max(id) AS "last", {DIGEST.format(t="string_agg(text, ' ' ORDER BY id)")} AS text FROM o GROUP BY session_id, chunk_id),
m2 AS (SELECT session_id, 2 AS level, id // {{k}} AS id, min("first") AS "first", max("last") AS "last", {DIGEST.format(t="string_agg(text, ' ' ORDER BY id)")} AS text FROM m1 GROUP BY session_id, id // {{k}} HAVING count(*) = {{k}}),
m3 AS (SELECT session_id, 3 AS level, id // {{k}} AS id, min("first") AS "first", max("last") AS "last", {DIGEST.format(t="string_agg(text, ' ' ORDER BY id)")} AS text FROM m2 GROUP BY session_id, id // {{k}} HAVING count(*) = {{k}}),
m AS (SELECT *, ceil(length(text) / 3.0::DOUBLE)::BIGINT AS tokens FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3))"""
CONV_PYRAMID = chunk_sql(CONV, 100, 2) + PYRAMID.format(k=2)


def conv_memories(s: SparkSession, d: str) -> DataFrame:
    return M.merge_by_count(kept(M.mint_l1(S.conversations(s, d), conv_chunks(s, d))), 2)


def conv_tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, memories and edges, each computed once."""
    chunks = kept(conv_chunks(s, d))
    memories = kept(M.merge_by_count(kept(M.mint_l1(S.conversations(s, d), chunks)), 2))
    return chunks, memories, kept(K.count_edges(memories, 2))


@query(CONV_PYRAMID + " SELECT * FROM m WHERE level = 1")
def m1_mint_l1(s, d):
    return M.mint_l1(S.conversations(s, d), conv_chunks(s, d))


@query(CONV_PYRAMID + " SELECT * FROM m")
def m2_merge_by_count(s, d):
    return conv_memories(s, d)


@query(CONV_PYRAMID + " SELECT session_id, max(level) AS level FROM m GROUP BY 1")
def m11_max_level(s, d):
    return M.max_level(conv_memories(s, d))


@query(CONV_PYRAMID + ' SELECT level, count(*) AS n FROM m GROUP BY 1')
def k15_profile(s, d):
    return M.profile(conv_memories(s, d))


@query(chunk_sql(DOCS, 3000, 4) + ", h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id DESC) AS k FROM c) SELECT session_id, chunk_id, \"first\", \"last\", raw FROM h WHERE (k > 2 OR chunk_id % 5 = 1) AND chunk_id % 3 <> 0")
def d1_l1_due(s, d):
    chunks = kept(doc_chunks(s, d))
    have = chunks.where("chunk_id % 3 = 0").select("session_id", F.lit(1).alias("level"), F.col("chunk_id").alias("id"))
    return M.l1_due(chunks, have, 2, chunks.where("chunk_id % 5 = 1"))


@query(chunk_sql(CONV, 100, 2) + ' SELECT p.session_id, c.chunk_id, sum(length(trim(p.text)))::BIGINT AS chars FROM p JOIN c ON c.session_id = p.session_id AND p.id BETWEEN c."first" AND c."last" GROUP BY 1, 2 HAVING sum(length(trim(p.text))) < 600 AND bool_and(length(p.text) % 4 <> 0)')
def d6_quiet_stub(s, d):
    log = S.conversations(s, d).withColumn("text_only", F.length("text") % 4 != 0)
    return M.quiet_stub(log, conv_chunks(s, d), 600)


PINS = f"SELECT l.session_id, l.id FROM ({DOCS}) l JOIN labels USING (doc_id) WHERE quality = 1"


@query(chunk_sql(DOCS, 3000, 4) + f', pin AS ({PINS}) SELECT session_id, chunk_id, "first", "last", raw FROM c WHERE EXISTS (SELECT 1 FROM pin WHERE pin.session_id = c.session_id AND pin.id BETWEEN c."first" AND c."last")')
def d7_protected_chunks(s, d):
    pins = S.document_logs(s, d).join(S.table(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return M.protected_chunks(doc_chunks(s, d), pins.select("session_id", F.col("id").alias("first"), F.col("id").alias("last")))


BAND = "(SELECT count(*) FROM range(31) t(i) WHERE floor(n_chars / 50) >= 3::DOUBLE ** i)"


@query(f"SELECT doc_id, CASE WHEN lang = 'de' THEN -1 ELSE {BAND} END AS band FROM documents")
def k3_age_band(s, d):
    return S.table(s, d, "documents").select("doc_id", M.age_band("n_chars", 50, 3, F.col("lang") == "de").cast("long").alias("band"))


FOLD = CONV_PYRAMID + """, below AS (SELECT session_id, 0 AS level, chunk_id AS id, raw AS cost FROM c UNION ALL SELECT session_id, level, id, tokens FROM m),
g AS (SELECT session_id, level + 1 AS level, CASE WHEN level = 0 THEN id ELSE id // 2 END AS id, sum(cost) AS members FROM below GROUP BY 1, 2, 3),
s AS (SELECT m.session_id, m.level, m."first", g.members - m.tokens AS saving FROM m JOIN g USING (session_id, level, id)),
b AS (SELECT session_id, sum(raw)::BIGINT AS before FROM c GROUP BY 1),
r AS (SELECT s.*, b.before, b.before - coalesce(sum(saving) OVER (PARTITION BY session_id ORDER BY level, "first" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM s JOIN b USING (session_id)),
q AS (SELECT *, min(lft) OVER (PARTITION BY session_id ORDER BY level, "first" ROWS UNBOUNDED PRECEDING) AS lowest FROM r),
f AS (SELECT session_id, sum(saving)::BIGINT AS saved, count(*) AS folds FROM q WHERE before > 400 AND lowest > 360 GROUP BY 1)
SELECT b.session_id, b.before, b.before - coalesce(f.saved, 0) AS after, coalesce(f.folds, 0) AS folds FROM b LEFT JOIN f USING (session_id)"""


@query(FOLD)
def flagship_fold(s, d):
    chunks, memories, edges = conv_tree(s, d)
    return M.fold_to_target(chunks, memories, edges, 400, 0.1)


QUERIES["k5_fold_to_target"], ORACLES["k5_fold_to_target"] = QUERIES["flagship_fold"], FOLD


# --- ledgers, limits, turns

ATTEMPTS = "SELECT user_id * 8 + event_id % 8 AS target, event_id AS id, CASE event_type WHEN 'signup' THEN 'clear' WHEN 'purchase' THEN 'mint' ELSE 'fail' END AS kind, CASE event_type WHEN 'error' THEN 'provider_error' WHEN 'view' THEN 'refusal' WHEN 'click' THEN 'stale' END AS reason FROM events"
LEDGER = f"""WITH a AS ({ATTEMPTS}), c AS (SELECT *, coalesce(max(CASE WHEN kind = 'clear' THEN id END) OVER (PARTITION BY target), -1) AS clr FROM a),
e AS (SELECT *, id > clr AND kind = 'fail' AS live FROM c), b AS (SELECT *, coalesce(max(CASE WHEN live AND reason = 'refusal' THEN id END) OVER (PARTITION BY target), -1) AS brk FROM e),
led AS (SELECT target, count(*) FILTER (live AND reason = 'refusal') AS attempts, count(*) FILTER (live AND reason = 'provider_error' AND id > brk) AS streak,
arg_max(reason, id) FILTER (live) AS "last", bool_or(kind IN ('clear', 'mint')) AS cleared FROM b GROUP BY 1)"""


def attempts(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "purchase", "mint").otherwise("fail")
    reason = F.when(F.col("event_type") == "error", "provider_error").when(F.col("event_type") == "view", "refusal").when(F.col("event_type") == "click", "stale")
    return S.table(s, d, "events").select((F.col("user_id") * 8 + F.col("event_id") % 8).alias("target"), F.col("event_id").alias("id"), kind.alias("kind"), reason.alias("reason"))


@query(LEDGER + " SELECT * FROM led")
def f3_ledger(s, d):
    return L.ledger(attempts(s, d))


@query(LEDGER + " SELECT * FROM led WHERE NOT cleared AND (attempts >= 1 OR streak >= 1)")
def f4_stalled(s, d):
    return L.stalled(L.ledger(attempts(s, d)), 1, 1)


@query(LEDGER + " SELECT *, CASE WHEN \"last\" = 'provider_error' AND streak < 2 THEN 'transient' WHEN \"last\" IS NOT NULL AND attempts >= 3 THEN 'terminal' WHEN \"last\" = 'refusal' THEN 'retry' WHEN \"last\" = 'provider_error' THEN 'transient' ELSE 'none' END AS action FROM led")
def f5_policy(s, d):
    return L.policy(L.ledger(attempts(s, d)), 3, 2)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'provider_error' WHEN value < 2 THEN 'refusal' WHEN event_type = 'click' THEN 'tool_call'
WHEN length(trim(CASE WHEN event_type = 'signup' THEN ' ' ELSE props END)) = 0 THEN 'empty' WHEN value > 30 THEN 'truncated' END AS reason FROM events""")
def f1_gate(s, d):
    e, kind = S.table(s, d, "events"), F.col("event_type")
    stop = F.when(F.col("value") < 2, "refusal").when(kind == "click", "tool_use").when(F.col("value") > 30, "max_tokens").otherwise("end_turn")
    return e.select("event_id", L.gate(F.when(kind == "error", "provider_error"), stop, kind == "click", F.when(kind == "signup", " ").otherwise(F.col("props"))).alias("reason"))


@query("SELECT user_id::VARCHAR AS session_id, event_type AS purpose, event_id AS id, sum(ceil(value)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY event_id)::BIGINT AS total FROM events")
def f10_usage_totals(s, d):
    costs = S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("purpose"), F.col("event_id").alias("id"), F.ceil("value").cast("long").alias("tokens"))
    return L.running_totals(costs).drop("tokens")


@query("SELECT event_type AS purpose, sum(ceil(value)::BIGINT)::BIGINT AS tokens, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def f10_usage_rollup(s, d):
    return S.table(s, d, "events").rollup(F.col("event_type").alias("purpose")).agg(F.sum(F.ceil("value")).cast("long").alias("tokens"), F.count("*").alias("n"))


ARMS = """WITH e AS (SELECT user_id, event_id, event_type = 'view' AS arm, value FROM events WHERE event_type = 'view' OR event_type IN ('click', 'purchase') AND value > 0),
s AS (SELECT *, lag(arm) OVER w AS was, lag(value) OVER w AS armed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT user_id, event_id, value / armed AS r FROM s WHERE NOT arm AND was AND armed > 0)"""


def usage(s: SparkSession, d: str) -> DataFrame:
    """Views arm what they rendered; clicks and purchases report."""
    kind = F.col("event_type")
    rows = S.table(s, d, "events").where(kind.isin("view", "click", "purchase"))
    return rows.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.when(kind == "view", F.col("value")).alias("armed"), F.when(kind != "view", F.col("value")).alias("reported"))


@query(ARMS + """, b AS (SELECT * FROM r WHERE r BETWEEN 0.6::DOUBLE AND 1.8::DOUBLE)
SELECT user_id::VARCHAR AS session_id, list_reduce(list_prepend(1.0::DOUBLE, list(r ORDER BY event_id)), lambda m, x: least(1.8::DOUBLE, greatest(0.6::DOUBLE, m + 0.2::DOUBLE * (x * m - m)))) AS multiplier, count(*) AS samples FROM b GROUP BY user_id""")
def f12_calibrate(s, d):
    return L.calibrate(usage(s, d))


def posts(s: SparkSession, d: str) -> DataFrame:
    """A channel for each kind of event and ten users."""
    channel = F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 10))
    return S.table(s, d, "events").select("event_id", channel.alias("channel"), F.col("user_id").alias("session_id"), F.col("ts").alias("at"))


@query("""WITH p AS (SELECT *, 2 + user_id % 3 AS cap, count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS used,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS k FROM events)
SELECT a.event_id, a.used, greatest(0, a.cap - a.used) AS remaining, (epoch_us(CASE WHEN a.used < a.cap THEN a.ts ELSE b.ts + INTERVAL 1 DAY END)) AS next_free FROM p a LEFT JOIN p b ON b.event_type = a.event_type AND b.user_id = a.user_id AND b.k = a.k - a.cap + 1""")
def f13_rate_limit(s, d):
    out = L.rate_limit(posts(s, d), 2 + F.col("session_id") % 3)
    return out.select("event_id", "used", "remaining", F.unix_micros(F.col("next_free").cast("timestamp")).alias("next_free"))


CHANNEL = "event_type || '-' || user_id // 10"
MEMBERS = f"SELECT DISTINCT {CHANNEL} AS channel, user_id AS session_id, user_id % 2 = 0 AS inputs FROM events"


@query(f"WITH m AS ({MEMBERS}) SELECT e.event_id, m.session_id AS \"to\" FROM events e JOIN m ON m.channel = {CHANNEL} AND m.inputs AND m.session_id <> e.user_id")
def f14_fan_out(s, d):
    members = posts(s, d).select("channel", "session_id", (F.col("session_id") % 2 == 0).alias("inputs")).distinct()
    return L.fan_out(posts(s, d), members).select("event_id", "to")


@query(f"WITH m AS ({MEMBERS}) SELECT channel, count(*) AS n, string_agg(session_id::VARCHAR, ',' ORDER BY session_id) AS members FROM m GROUP BY 1")
def f15_channel_listing(s, d):
    members = posts(s, d).select("channel", "session_id").distinct()
    return members.groupBy("channel").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("session_id")), ",").alias("members"))


@query(f"WITH a AS ({ATTEMPTS}) SELECT reason, reason = 'provider_error' AS retryable, count(*) AS n FROM a WHERE kind = 'fail' GROUP BY ALL")
def f18_reasons_histogram(s, d):
    rows = attempts(s, d).where("kind = 'fail'").withColumn("retryable", F.col("reason") == "provider_error")
    return rows.groupBy("reason", "retryable").agg(F.count("*").alias("n"))


@query("SELECT conv_id::VARCHAR AS session_id, count(*) AS n, sum(strlen(text))::BIGINT + 512 + 128 * count(*) AS bound, sum(strlen(text))::BIGINT + 512 + 128 * count(*) + 500 <= 4000 AS admitted FROM conversations GROUP BY 1")
def t18_admit_request(s, d):
    sized = S.conversations(s, d).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    bound = L.input_bound(F.col("n"), F.col("b"))
    return sized.select("session_id", "n", bound.alias("bound"), (bound + 500 <= 4000).alias("admitted"))


@query(f"WITH l AS ({CONV}), t AS (SELECT *, sum((participant = 'user')::INT) OVER (PARTITION BY session_id ORDER BY id)::BIGINT AS turn FROM l) SELECT session_id, turn, min(id) AS \"first\", max(id) AS \"last\" FROM t GROUP BY 1, 2")
def t20_turns_of(s, d):
    return L.turns_of(S.conversations(s, d))


@query("SELECT user_id::VARCHAR AS session_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, sum(ceil(value)::BIGINT)::BIGINT AS tokens, count(*) AS n FROM events GROUP BY 1, 2")
def x5_usage_windows(s, d):
    usage = S.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("at"), F.ceil("value").cast("long").alias("tokens"))
    return X.usage_windows(usage)


from . import attempt_queries, block_queries, forming_queries, more_queries, nesting_queries, planning_queries, repair_queries, request_queries, seek_queries, selection_queries  # noqa: E402,F401  register their own
