"""Queries on whole plans: conversations' pyramids, bands by age, and budgets that follow from what a session holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import planning as N
from . import pyramid as M
from .keep import kept
from .queries import CONV_PYRAMID, conv_tree, query
from .repair_queries import UP, project_sql
from .selection_queries import COST


def folds_sql(rows: str, start: str) -> str:
    left = f"SELECT *, {start} - coalesce(sum(growth) OVER (PARTITION BY session_id ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM {rows}"
    return f"(SELECT * FROM (SELECT *, min(lft) OVER (PARTITION BY session_id ORDER BY level, rank ROWS UNBOUNDED PRECEDING) AS low FROM ({left})) WHERE low > target)"


#: One round, as windows here aren't negative: cl leaves with band and rank, fo folded groups, op those that open again, ic the ideal cut.
IDEAL = (
    CONV_PYRAMID
    + UP
    + COST
    + f""", bt AS (SELECT session_id, sum(raw)::BIGINT AS before, max(chunk_id) AS newest FROM c GROUP BY 1),
bu AS (SELECT session_id, 100 + before % 7 * 40 AS "window", (100 + before % 7 * 40) * 9 // 10 AS target, before % 5 * 60 AS reach FROM bt),
cl AS (SELECT up.*, CASE WHEN newest - chunk_id < 1 THEN 0 ELSE floor(log2(newest - chunk_id) + 0.000001::DOUBLE)::INT + 1 END AS cap, (raw % 5 + 1) / 5::DOUBLE AS salience FROM up JOIN bt USING (session_id)),
ra AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY salience, chunk_id) AS r FROM cl),
gr AS (SELECT grow.session_id, grow.level, grow.id, min(growth)::BIGINT AS growth, min(ra.cap) AS cap, min(ra.r) AS rank, min(bt.before) AS before, min(bu.target) AS target, min(bu."window") AS win FROM grow JOIN ra ON ra.session_id = grow.session_id AND ra.chunk_id // (2 ** (grow.level - 1))::BIGINT = grow.id JOIN bt ON bt.session_id = grow.session_id JOIN bu ON bu.session_id = grow.session_id GROUP BY 1, 2, 3),
adm AS (SELECT * FROM gr WHERE cap >= level), f1 AS {folds_sql("adm", "before")},
n1 AS (SELECT bt.session_id, bt.before - coalesce(sum(growth), 0) AS now FROM bt LEFT JOIN f1 USING (session_id) GROUP BY bt.session_id, bt.before),
pst AS (SELECT gr.*, now FROM gr JOIN n1 USING (session_id) ANTI JOIN f1 ON f1.session_id = gr.session_id AND f1.level = gr.level AND f1.id = gr.id WHERE now > win), f2 AS {folds_sql("pst", "now")},
fo AS (SELECT session_id, level, id, growth FROM f1 UNION ALL SELECT session_id, level, id, growth FROM f2),
n2 AS (SELECT bt.session_id, bt.before - coalesce(sum(growth), 0) AS now, any_value(bu."window") AS win, any_value(bu.target) AS target FROM bt JOIN bu USING (session_id) LEFT JOIN fo USING (session_id) GROUP BY bt.session_id, bt.before),
rs AS (SELECT fo.*, par.id IS NULL AS top, row_number() OVER (PARTITION BY fo.session_id ORDER BY fo.level DESC, fo.id DESC) AS k FROM fo LEFT JOIN fo par ON par.session_id = fo.session_id AND par.level = fo.level + 1 AND par.id = fo.id // 2),
rk AS (SELECT session_id, 0::BIGINT AS k, now AS t, []::VARCHAR[] AS opened, false AS take, 0 AS level, 0::BIGINT AS id FROM n2
 UNION ALL SELECT session_id, k, CASE WHEN take THEN t + growth ELSE t END, CASE WHEN take THEN list_append(opened, level || ':' || id) ELSE opened END, take, level, id FROM (
  SELECT rs.*, rk.t, rk.opened, (rs.top OR list_contains(rk.opened, (rs.level + 1) || ':' || (rs.id // 2))) AND rk.t < n2.target AND rk.t + rs.growth <= n2.win AND abs(rk.t + rs.growth - n2.target) < abs(rk.t - n2.target) AS take FROM rk JOIN rs ON rs.session_id = rk.session_id AND rs.k = rk.k + 1 JOIN n2 ON n2.session_id = rk.session_id)),
sh AS (SELECT fo.* FROM fo ANTI JOIN (SELECT * FROM rk WHERE take) y ON y.session_id = fo.session_id AND y.level = fo.level AND y.id = fo.id),
ic AS (SELECT cl.*, CASE WHEN EXISTS (SELECT 1 FROM sh WHERE sh.session_id = cl.session_id AND sh.level = 3 AND sh.id = a3) THEN 3 WHEN EXISTS (SELECT 1 FROM sh WHERE sh.session_id = cl.session_id AND sh.level = 2 AND sh.id = a2) THEN 2
 WHEN EXISTS (SELECT 1 FROM sh WHERE sh.session_id = cl.session_id AND sh.level = 1 AND sh.id = a1) THEN 1 ELSE 0 END AS lv FROM cl)"""
)


def units_sql(cut: str, key: str) -> str:
    """What a cut (session_id, chunk_id, raw, lv) renders: unit, tokens and its place."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p) AS pos FROM (SELECT {', '.join(f'x.{k.strip()}' for k in key.split(','))}, CASE WHEN lv > 0 THEN lv || ':' || chunk_id // (2 ** (lv - 1))::BIGINT ELSE 'r' || chunk_id END AS unit,
min(chunk_id) AS p, any_value(CASE WHEN lv > 0 THEN m.tokens ELSE raw END) AS tokens FROM {cut} x LEFT JOIN m ON m.session_id = x.session_id AND m.level = x.lv AND m.id = x.chunk_id // (2 ** greatest(0, x.lv - 1))::BIGINT GROUP BY ALL)"""


def cost_sql(units: str, key: str) -> str:
    return f"""SELECT {key}, coalesce(sum(tokens) FILTER (pos >= f), 0) AS cost FROM (SELECT z.*, min(z.pos) FILTER (z.unit IS DISTINCT FROM un.unit) OVER (PARTITION BY {', '.join('z.' + k.strip() for k in key.split(','))}) AS f FROM {units} z LEFT JOIN un ON un.session_id = z.session_id AND un.pos = z.pos) GROUP BY {key}"""


#: The carried cut shows the memory of every chunk but the two newest; pl is what each session adopts, and how.
PLAN = (
    IDEAL
    + ", ca AS (SELECT cl.* , CASE WHEN chunk_id < newest - 1 THEN 1 ELSE 0 END AS lv FROM cl JOIN bt USING (session_id))"
    + project_sql("nw", "ca")
    + f""", un AS ({units_sql("nw", "session_id")}), ui AS ({units_sql("ic", "session_id")}), ki AS ({cost_sql("ui", "session_id")}),
ch AS (SELECT ic.*, nw.lv AS was, CASE WHEN ic.lv <> nw.lv THEN sum((ic.lv <> nw.lv)::INT) OVER (PARTITION BY ic.session_id ORDER BY ic.chunk_id) - 1 END AS k, count(*) FILTER (ic.lv <> nw.lv) OVER (PARTITION BY ic.session_id) AS n FROM ic JOIN nw USING (session_id, chunk_id)),
bo AS (SELECT session_id, k AS "at", chunk_id AS f FROM ch WHERE k IS NOT NULL UNION ALL SELECT DISTINCT session_id, n, NULL FROM ch),
pb AS (SELECT ch.session_id, bo."at", ch.chunk_id, ch.raw, ch.a1, ch.a2, ch.a3, ch.cap, ch.salience, CASE WHEN ch.chunk_id >= bo.f THEN ch.lv ELSE ch.was END AS lv FROM bo JOIN ch USING (session_id))"""
    + project_sql("pa", "pb", 'session_id, "at"')
    + f""", ua AS ({units_sql("pa", 'session_id, "at"')}), ka AS ({cost_sql("ua", 'session_id, "at"')}),
be AS (SELECT session_id, min("at") AS "at" FROM ka JOIN bu USING (session_id) WHERE cost <= reach GROUP BY 1), pp AS (SELECT pa.* FROM pa JOIN be USING (session_id, "at")),
lo AS (SELECT session_id, sum(salience * greatest(0, lv - cap)) AS x FROM {{cut}} GROUP BY 1),
st AS (SELECT bu.*, (SELECT sum(tokens) FROM un WHERE un.session_id = bu.session_id) AS now, (SELECT sum(salience * greatest(0, lv - cap)) FROM nw WHERE nw.session_id = bu.session_id) AS now_loss,
 (SELECT sum(tokens) FROM ui WHERE ui.session_id = bu.session_id) AS ideal, (SELECT sum(salience * greatest(0, lv - cap)) FROM ic WHERE ic.session_id = bu.session_id) AS ideal_loss, (SELECT cost FROM ki WHERE ki.session_id = bu.session_id) AS ideal_cost,
 (SELECT sum(tokens) FROM ua JOIN be USING (session_id, "at") WHERE ua.session_id = bu.session_id) AS part, (SELECT sum(salience * greatest(0, lv - cap)) FROM pp WHERE pp.session_id = bu.session_id) AS part_loss, (SELECT cost FROM ka JOIN be USING (session_id, "at") WHERE ka.session_id = bu.session_id) AS part_cost,
 (SELECT count(*) FROM up WHERE up.session_id = bu.session_id AND a1 IS NULL) AS bare FROM bu),
br AS (SELECT *, CASE WHEN now BETWEEN target AND "window" AND now_loss - ideal_loss <= 0.35::DOUBLE * greatest(1, ideal_loss) THEN 'hold' WHEN ideal_cost <= reach THEN 'ideal' WHEN part <= "window" AND part_loss - ideal_loss <= 0.35::DOUBLE * greatest(1, ideal_loss) THEN 'suffix'
 WHEN part > "window" THEN 'infeasible' ELSE 'quality-gap' END AS branch FROM st),
pl AS (SELECT session_id, branch, CASE branch WHEN 'hold' THEN now WHEN 'suffix' THEN part ELSE ideal END::BIGINT AS tokens, CASE branch WHEN 'hold' THEN 0 WHEN 'suffix' THEN part_cost ELSE ideal_cost END::BIGINT AS cost,
 CASE branch WHEN 'hold' THEN now_loss WHEN 'suffix' THEN part_loss ELSE ideal_loss END AS loss, branch NOT IN ('hold', 'suffix') AND ideal > "window" AS escalated, CASE WHEN branch NOT IN ('hold', 'suffix') AND ideal > "window" THEN bare ELSE 0 END AS demanded FROM br)""".replace("lo AS (SELECT session_id, sum(salience * greatest(0, lv - cap)) AS x FROM {cut} GROUP BY 1),\n", "")
)


def plan_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    chunks, memories, edges = conv_tree(s, d)
    newest = F.max("chunk_id").over(Window.partitionBy("session_id"))
    chunks = kept(chunks.withColumn("newest", newest).withColumn("cap", M.age_band(F.col("newest") - F.col("chunk_id"), 1, 2)).withColumn("salience", (F.col("raw") % 5 + 1) / 5))
    carried = chunks.select("session_id", "chunk_id", F.when(F.col("chunk_id") < F.col("newest") - 1, 1).otherwise(0).alias("level"))
    before = chunks.groupBy("session_id").agg(F.sum("raw").alias("_b"))
    window = 100 + F.col("_b") % 7 * 40
    budgets = kept(before.select("session_id", window.alias("window"), F.floor(window * 9 / 10).alias("target"), (F.col("_b") % 5 * 60).alias("reach")))
    return chunks.drop("newest"), memories, edges, carried, budgets


@query(IDEAL + " SELECT session_id, chunk_id, lv AS level FROM ic")
def k7_ideal_cut(s, d):
    chunks, memories, edges, _, budgets = plan_inputs(s, d)
    return N.ideal_cut(chunks, memories, edges, budgets)


@query(PLAN + " SELECT * FROM pl")
def k10_plan(s, d):
    chunks, memories, edges, carried, budgets = plan_inputs(s, d)
    return N.plan(chunks, memories, edges, carried, budgets, 0.35)[1]


@query(PLAN + """ SELECT session_id, chunk_id, CASE branch WHEN 'hold' THEN nw.lv WHEN 'suffix' THEN pp.lv ELSE ic.lv END AS level FROM pl JOIN ic USING (session_id) JOIN nw USING (session_id, chunk_id) JOIN pp USING (session_id, chunk_id)""")
def k10_plan_cut(s, d):
    chunks, memories, edges, carried, budgets = plan_inputs(s, d)
    return N.plan(chunks, memories, edges, carried, budgets, 0.35)[0]
