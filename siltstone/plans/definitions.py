"""Queries of workflow definitions and of earlier cases: checks, layers, differences, two-step caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import flow, records
from siltstone.plans.registry import query
from siltstone.session import materialize

c = F.col

_GRAPH = """s AS (SELECT l_orderkey AS graph, l_linenumber AS node, min(l_partkey) AS part, max(l_quantity) AS qty, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
d AS (SELECT graph, node, node - 1 AS needs FROM s UNION SELECT graph, node, node + 1 FROM s WHERE part % 40 = 0 UNION SELECT graph, node, node - 2 FROM s WHERE part % 3 = 0),
e AS (SELECT DISTINCT d.graph, d.needs AS up, d.node AS down FROM d JOIN s a ON a.graph = d.graph AND a.node = d.needs),
r(graph, node, reach) AS (SELECT graph, up, down FROM e UNION SELECT r.graph, r.node, e.down FROM r JOIN e ON e.graph = r.graph AND e.up = r.reach),
p AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM e WHERE e.graph = s.graph AND e.down = s.node) AS entry, NOT EXISTS (SELECT 1 FROM e WHERE e.graph = s.graph AND e.up = s.node) AS terminal, EXISTS (SELECT 1 FROM r WHERE r.graph = s.graph AND r.node = s.node AND r.reach = s.node) AS in_cycle FROM s),
g AS (SELECT *, entry OR EXISTS (SELECT 1 FROM r JOIN p q ON q.graph = r.graph AND q.node = r.node AND q.entry WHERE r.graph = p.graph AND r.reach = p.node) AS reached,
 EXISTS (SELECT 1 FROM r JOIN s m ON m.graph = r.graph AND m.node = r.reach AND m.flag = 'N' WHERE r.graph = p.graph AND r.node = p.node) AS merged FROM p)"""


def _graph(t):
    """Stages and dependencies made of the lines of orders; some go back, so that there are cycles."""
    stages = t.lineitem.groupBy(c("l_orderkey").alias("graph"), c("l_linenumber").alias("node")).agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("qty"), F.max("l_returnflag").alias("flag"))
    stages = materialize(stages, "stages")
    needs = F.array_compact(F.array(c("node") - 1, F.when(c("part") % 40 == 0, c("node") + 1), F.when(c("part") % 3 == 0, c("node") - 2)))
    return stages, stages.select("graph", "node", F.explode(needs).alias("needs"))


_CHECKS = {
    "acyclic": "bool_and(NOT in_cycle)", "entry_reaches_all": "bool_or(entry) AND bool_and(reached)", "ends_reached": "bool_and(NOT terminal OR reached)", "texts_present": "bool_and(qty > 1)", "has_stage": "true",
    "actions_valid": "bool_and(part % 101 <> 0)", "modes_valid": "bool_and(part % 103 <> 0 AND qty < 50)", "items_merge": "bool_and(flag <> 'R' OR merged)", "reviewers_exist": "bool_and(node < 7)", "hub_manages": "graph % 2 = 0",
}


@query("o153_ten_checks", f"WITH RECURSIVE {_GRAPH} " + " UNION ALL ".join(f"SELECT graph, '{k}' AS check, {v} AS ok FROM g GROUP BY graph" for k, v in _CHECKS.items()))
def _(t):
    stages, deps = _graph(t)
    part = c("part")
    stages = stages.select(
        "graph", "node", (c("flag") == "R").alias("per_item"), (c("flag") == "N").alias("is_merge"), F.lit("do").alias("instructions"), F.when(c("qty") > 1, "look").otherwise(" ").alias("self_check"), F.lit("ok").alias("acceptance"),
        F.when(part % 101 == 0, "platform_write:").when(part % 2 == 0, "read").otherwise("platform_write:x").alias("action"), F.when(part % 103 == 0, "never").otherwise("auto").alias("mode"),
        (49 - c("qty")).alias("sla"), F.lit(0).alias("ack"), F.lit(None).cast("int").alias("idle"))
    definitions = t.lineitem.select(c("l_orderkey").alias("graph")).distinct().withColumn("hub_role", F.when(c("graph") % 2 == 0, "boss").otherwise("writer"))
    roles = t.spark.createDataFrame([("boss", True), ("writer", False)], "role string, management boolean")
    return flow.definition_checks(definitions, stages, deps, stages.select("graph", F.when(c("node") < 7, "writer").otherwise("nobody").alias("role")), roles)


@query("o176_layers_or_sequence", f"""WITH RECURSIVE {_GRAPH}, b AS (SELECT graph FROM p GROUP BY 1 HAVING bool_or(in_cycle)),
w(graph, node, layer) AS (SELECT graph, node, 0 FROM p WHERE entry AND graph NOT IN (SELECT graph FROM b) UNION SELECT w.graph, e.down, layer + 1 FROM w JOIN e ON e.graph = w.graph AND e.up = w.node)
SELECT p.graph, p.node, CASE WHEN p.graph IN (SELECT graph FROM b) THEN row_number() OVER (PARTITION BY p.graph ORDER BY p.node) - 1 ELSE m.layer END AS layer, entry, terminal, in_cycle FROM p LEFT JOIN (SELECT graph, node, max(layer) AS layer FROM w GROUP BY ALL) m ON m.graph = p.graph AND m.node = p.node""")
def _(t):
    stages, deps = _graph(t)
    return flow.placed_stages(stages.select("graph", "node", c("node").alias("seq")), deps)


@query("o154_definition_diff", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT k, change, CASE WHEN change = 'changed' THEN concat_ws(',', CASE WHEN s THEN 'status' END, CASE WHEN p THEN 'priority' END) ELSE '' END AS fields FROM (SELECT coalesce(a.k, b.k) AS k, a.status IS DISTINCT FROM b.status AS s, a.priority IS DISTINCT FROM b.priority AS p,
CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL""")
def _(t):
    rows = t.orders.select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"), "o_totalprice")
    new = rows.where("priority <> '5-LOW'").withColumn("status", F.when(c("o_totalprice") > 300000, "F").otherwise(c("status"))).withColumn("priority", F.when(c("k") % 5 != 0, c("priority")))
    out = flow.definition_diff(rows.where("status <> 'P'"), new, ["k"], ["status", "priority"])
    return out.select("k", "change", F.array_join("fields", ",").alias("fields"))


@query("o082_memory_picks", """WITH q AS (SELECT p_partkey AS asked, p_partkey % 25 AS brand FROM part), k AS (SELECT s_suppkey AS "case", s_nationkey AS brand, s_acctbal > 5000 AS kind FROM supplier),
f AS (SELECT asked, "case", kind FROM q JOIN k USING (brand) WHERE "case" <> asked QUALIFY row_number() OVER (PARTITION BY asked, kind ORDER BY "case") <= 3),
h AS (SELECT asked, kind, count(*) AS held FROM f GROUP BY ALL),
n AS (SELECT asked, "case", kind, row_number() OVER (PARTITION BY asked, kind ORDER BY sim DESC, "case") AS n FROM (SELECT l_partkey AS asked, l_suppkey AS "case", max(l_discount) * 5 AS sim FROM lineitem GROUP BY ALL) JOIN k USING ("case") JOIN q USING (asked) WHERE sim >= 0.3 AND q.brand <> k.brand AND "case" <> asked QUALIFY n <= 2)
SELECT asked, "case", false AS cross_brand FROM f UNION ALL SELECT asked, "case", true FROM n LEFT JOIN h USING (asked, kind) WHERE n + coalesce(held, 0) <= 3""")
def _(t):
    asked = t.part.select(c("p_partkey").alias("asked"), (c("p_partkey") % 25).cast("string").alias("brand"), F.concat(F.lit("u"), "p_partkey").alias("url"))
    cases = t.supplier.select(c("s_suppkey").alias("case"), c("s_nationkey").cast("string").alias("brand"), F.concat(F.lit("u"), "s_suppkey").alias("url"), F.when(c("s_acctbal") > 5000, "adopted").otherwise("rejected").alias("decision"), c("s_suppkey").alias("place"))
    sims = t.lineitem.groupBy(c("l_partkey").alias("asked"), c("l_suppkey").alias("case")).agg((F.max("l_discount") * 5).alias("sim"))
    return records.memory_picks(asked, cases, sims)
