"""Queries on events as messages whose second block is wrapped in up to three results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nesting as N
from . import sources as S
from .pricing import store_tokens
from .queries import query, tokens_sql

# A leaf by event_id % 3: an image (stamped where the id is even), a text, a result of text that every tenth event leaves without its call.
WRAP = '{"type":"tool_result","toolUseId":"t","content":['
IMAGE = '{"type":"image","source":{"type":"url","url":"u"}'
LEAF = f"""CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN '{IMAGE},"tokenEstimate":900}}' ELSE '{IMAGE}}}' END
WHEN 1 THEN '{{"type":"text","text":' || q || '}}' ELSE CASE WHEN event_id % 10 = 0 THEN '{{"type":"tool_result","content":' ELSE '{{"type":"tool_result","toolUseId":"t","content":' END || q || '}}' END"""
MADE = f"WITH j AS (SELECT *, to_json(props::VARCHAR)::VARCHAR AS q FROM events), e AS (SELECT *, event_id % 4 AS d, {LEAF} AS leaf FROM j)"
LEAF_PRICE = f"CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 900 ELSE 1600 END WHEN 1 THEN {tokens_sql('props')} ELSE ceil(length(props) / 2.3::DOUBLE) END"


def messages(s: SparkSession, d: str) -> DataFrame:
    quoted = F.expr("substr(to_json(struct(props AS q)), 6, length(to_json(struct(props AS q))) - 6)")
    leaf = F.expr(LEAF)
    wrapped = F.concat(F.expr(f"repeat('{WRAP}', cast(event_id % 4 AS int))"), leaf, F.expr("repeat(']}', cast(event_id % 4 AS int))"))
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text")))
    return S.table(s, d, "events").withColumn("q", quoted).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.concat(F.lit("["), said, F.lit(","), wrapped, F.lit("]")).alias("content"))


@query(f"{MADE} SELECT event_id AS id, d AS depth, ({tokens_sql('event_type')} + {LEAF_PRICE})::DOUBLE AS raw, 0 AS cut FROM e")
def p9_any_depth(s, d):
    return N.nested_prices(messages(s, d)).select("id", F.col("depth").cast("long").alias("depth"), "raw", "cut")


@query(f"{MADE} SELECT event_id AS id, least(d, 2) AS depth, ({tokens_sql('event_type')} + CASE WHEN d = 3 THEN 0 ELSE {LEAF_PRICE} END)::DOUBLE AS raw, (d = 3)::BIGINT AS cut FROM e")
def p9_two_levels(s, d):
    """As above, with what lies below two levels unread and counted."""
    return N.nested_prices(messages(s, d), 2).select("id", F.col("depth").cast("long").alias("depth"), "raw", "cut")


@query(f"""{MADE}, w AS (SELECT *, CASE WHEN d > 0 THEN 2 + (d - 1) * {len(WRAP) + 2} + length(leaf) WHEN event_id % 3 = 0 THEN 6400 ELSE length(props) END AS n FROM e)
SELECT event_id AS id, CASE WHEN d = 0 AND event_id % 3 = 1 THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, 1 - 0.8::DOUBLE * (n / (n + length(event_type))::DOUBLE)) END AS salience FROM w""")
def p11_any_depth(s, d):
    return N.nested_salience(messages(s, d)).select("id", "salience")


@query(f"{MADE} SELECT event_id AS id, 2 - (event_id % 3 = 2 AND event_id % 10 = 0)::BIGINT AS good, event_type || CASE WHEN d = 0 AND event_id % 3 = 0 THEN chr(10) || '[image]' WHEN d = 0 AND event_id % 3 = 1 THEN chr(10) || props ELSE '' END AS text FROM e")
def p15_any_depth(s, d):
    return N.nested_prices(messages(s, d)).select("id", "good", "text")


@query(f"""{MADE}, s AS (SELECT event_id AS id, {tokens_sql('event_type')} * 1.25::DOUBLE AS a, ({LEAF_PRICE}) * 1.25::DOUBLE AS b FROM e)
SELECT id, (floor(a) + (a - floor(a) >= 0.5)::INT + floor(b) + (b - floor(b) >= 0.5)::INT)::BIGINT AS tokens FROM s""")
def p10_any_depth(s, d):
    """Rounded for each of a message's blocks, whatever is inside."""
    return N.nested_prices(messages(s, d)).select("id", store_tokens(F.col("prices"), 1.25).alias("tokens"))
