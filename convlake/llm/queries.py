"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .licenses import licence_digest
from .mixing import mix_sources
from .packing import pack
from .periodic_runs import periodic_runs
from .sharding import shard_digest
from .simhash import simhash_dedup
from .spelling_variants import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"), 40)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).drop("text_sha256")


def llm_queries() -> dict[str, Query]:
    first = (op1_sharding, op2_embedding_dedup, op3_simhash_dedup, op4_mixing, op5_licenses, op6_substring_dedup, op7_packing)
    return {f.__name__: f for f in (*first, op8_toxicity, op9_suffix_dedup, op10_exact_dedup, op11_spelling_variants, op12_periodic_runs, op13_token_counts)}


def llm_oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6, "op10_exact_dedup": OP10, "op11_spelling_variants": OP11, "op12_periodic_runs": OP12}


OP10 = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
n AS (SELECT doc_id, i, md5(string_agg(w, ' ') OVER f) AS h, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
first AS (SELECT h, min(doc_id) AS least FROM n WHERE n = 50 GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i, 1 AS g FROM n JOIN first USING (h) WHERE n = 50 AND doc_id > least),
c AS (SELECT doc_id, i, w, coalesce(max(g) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS g FROM x LEFT JOIN gone USING (doc_id, i)),
r AS (SELECT *, g = 1 AND coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM c),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (g = 1) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (g = 0), '')) AS kept_sha256 FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of code points below 2048, as UTF-8, a bit at a time: DuckDB has no function for it."""
    octets = f"flatten(list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192::BIGINT + unicode(c) // 64, 128::BIGINT + unicode(c) % 64] END))"
    ops = f"flatten(list_transform({octets}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {ops}), lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"


OP11 = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
l AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY 1, 2),
h AS (SELECT w, n, {crc32_sql("doc_id || ':' || w")} AS h FROM l),
c AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT AS n FROM c WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT w, n, i, left(w, i::INT - 1) || substring(w, i::INT + 1) AS d FROM v, unnest(range(1, length(w) + 1)) AS t(i)),
p AS (SELECT a.w, b.w AS o, b.n FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.w <> b.w UNION SELECT d.w, v.w, v.n FROM d JOIN v ON v.w = d.d UNION SELECT v.w, d.w, d.n FROM d JOIN v ON v.w = d.d),
b AS (SELECT w, count(*) AS n_near, min(struct_pack(n := -n, o := encode(o))) AS b FROM p GROUP BY 1),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.b.n >= 2 * v.n THEN decode(b.b.o) END AS form, CASE WHEN -b.b.n >= 2 * v.n THEN -b.b.n END AS form_n FROM v LEFT JOIN b USING (w)),
g AS (SELECT w, w AS root, form FROM f UNION ALL SELECT g.w, f.w, f.form FROM g JOIN f ON f.w = g.form)
SELECT f.w AS word, n, n_near, f.form, form_n, root FROM f JOIN (SELECT w, root FROM g WHERE form IS NULL) USING (w)
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS plant, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 % 8 + 3 AS k FROM d),
x AS (SELECT doc_id, n, i, CASE WHEN plant AND i >= a THEN w[(a + (i - a) % (1 + (n - a) // k) + 1)::INT] ELSE w[i::INT + 1] END AS w FROM e, unnest(range(n)) AS t(i)),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM q),
s AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS l FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, a AS "start", l AS length, min(q) AS period FROM s GROUP BY doc_id, a, l),
o AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(a := "start", l := length, q := period) ORDER BY length::DOUBLE / period DESC, "start", period) AS t,
 sha256(string_agg("start" || ',' || length || ',' || period || chr(10), '' ORDER BY "start", period)) AS runs_sha256 FROM r GROUP BY 1),
z AS (SELECT DISTINCT doc_id, unnest(range("start" + period, "start" + length)) AS i FROM r),
c AS (SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM x ANTI JOIN z USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, t.a AS "start", t.l AS length, t.q AS period, 1000 * t.l // t.q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)
"""
