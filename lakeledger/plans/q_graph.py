"""Queries over lineage graphs."""

from pyspark.sql import functions as F

from lakeledger.operators import graph as g
from lakeledger.plans.registry import query

# Starting points that users have: what feeds everything, what was delivered, what had an anomaly.
_ROOTS = "SELECT 'o1' AS org_id, 'region:' || CAST(r_regionkey AS STRING) AS name FROM {region} UNION ALL SELECT 'o2', 'nation:' || CAST(n_nationkey AS STRING) FROM {nation}"
_DELIVERED = "SELECT 'o1' AS org_id, 'order:' || CAST(o_orderkey AS STRING) AS name FROM {orders} UNION ALL SELECT 'o2', 'nation:' || CAST(n_nationkey AS STRING) FROM {nation}"
_ABNORMAL = "SELECT DISTINCT org_id, dataset AS name FROM {v_anomalies}"


def _down(starts):
    return f"""starts AS ({starts}), down(org_id, start, node, depth) AS (
  SELECT e.org_id, e.source, e.target, 1 FROM {{v_edges}} e JOIN starts s ON s.org_id = e.org_id AND s.name = e.source
  UNION SELECT d.org_id, d.start, e.target, d.depth + 1 FROM down d JOIN {{v_edges}} e ON e.org_id = d.org_id AND e.source = d.node WHERE d.depth < 10)"""


_UP = f"""starts AS ({_DELIVERED}), up(org_id, start, node, depth) AS (
  SELECT e.org_id, e.target, e.source, 1 FROM {{v_edges}} e JOIN starts s ON s.org_id = e.org_id AND s.name = e.target
  UNION SELECT d.org_id, d.start, e.source, d.depth + 1 FROM up d JOIN {{v_edges}} e ON e.org_id = d.org_id AND e.target = d.node WHERE d.depth < 10)"""


@query("g1_downstream", f"WITH RECURSIVE {_down(_ROOTS)} SELECT org_id, start AS source, node AS dataset, min(depth) AS depth FROM down GROUP BY ALL")
def _(t):
    return g.downstream(t("v_edges"), t.sql(_ROOTS))


@query("g2_upstream", f"WITH RECURSIVE {_UP} SELECT org_id, start AS target, node AS dataset, min(depth) AS depth FROM up GROUP BY ALL")
def _(t):
    return g.upstream(t("v_edges"), t.sql(_DELIVERED))


@query("u3_closure_distinct", f"WITH RECURSIVE {_down(_ROOTS)} SELECT org_id, depth, count(*) AS pairs FROM (SELECT org_id, start, node, CAST(min(depth) AS INT) AS depth FROM down GROUP BY ALL) x GROUP BY ALL")
def _(t):
    return g.downstream(t("v_edges"), t.sql(_ROOTS)).groupBy("org_id", "depth").agg(F.count("*").alias("pairs"))


@query("a13_downstream_count", f"WITH RECURSIVE {_down(_ABNORMAL)} SELECT org_id, start AS source, count(DISTINCT node) AS downstream_count FROM down GROUP BY ALL")
def _(t):
    return g.downstream_count(g.downstream(t("v_edges"), t.sql(_ABNORMAL)))


_ONE = "SELECT 'o1' AS org_id, 'region:' || CAST(r_regionkey AS STRING) AS name FROM {region} WHERE r_regionkey = 1"


@query("o2_order_closure", f"WITH RECURSIVE {_down(_ONE)} SELECT node AS dataset, min(depth) AS depth FROM down GROUP BY node ORDER BY 2, 1")
def _(t):
    return g.order_closure(g.downstream(t("v_edges"), t.sql(_ONE))).select("dataset", "depth")


# columns that a change is asked about: those that joins rest on; columns whose origin is asked: aggregates
_KEYS = "SELECT DISTINCT org_id, source_dataset AS dataset, source_column AS column_name FROM {v_column_edges} WHERE transform_type = 'JOIN'"
_SUMS = "SELECT DISTINCT org_id, target_dataset AS dataset, target_column AS column_name FROM {v_column_edges} WHERE transform_type = 'AGGREGATE'"


def _col(near, far):
    return f"""starts AS ({_KEYS if near == 'source' else _SUMS}), nodes(org_id, sd, sc, d, c, depth) AS (
  SELECT org_id, dataset, column_name, dataset, column_name, 0 FROM starts
  UNION SELECT n.org_id, n.sd, n.sc, e.{far}_dataset, e.{far}_column, n.depth + 1 FROM nodes n JOIN {{v_column_edges}} e
    ON e.org_id = n.org_id AND e.{near}_dataset = n.d AND e.{near}_column = n.c WHERE n.depth < 9),
 closure AS (SELECT n.org_id, sd AS start_dataset, sc AS start_column, e.{far}_dataset AS dataset, e.{far}_column AS "column", e.transform_type, e.expression, min(n.depth) + 1 AS depth
  FROM nodes n JOIN {{v_column_edges}} e ON e.org_id = n.org_id AND e.{near}_dataset = n.d AND e.{near}_column = n.c GROUP BY ALL)"""


@query("g3_column_downstream", f"WITH RECURSIVE {_col('source', 'target')} SELECT * FROM closure")
def _(t):
    return g.column_closure(t("v_column_edges"), t.sql(_KEYS))


@query("g3_column_upstream", f"WITH RECURSIVE {_col('target', 'source')} SELECT * FROM closure")
def _(t):
    return g.column_closure(t("v_column_edges"), t.sql(_SUMS), direction="upstream")


_IMPACT = """per AS (SELECT org_id, start_dataset, start_column, dataset, count(*) AS n_rows, count(*) FILTER (depth = 1) AS direct, max(depth) AS md, count(DISTINCT "column") AS nc FROM closure GROUP BY ALL),
 imp AS (SELECT org_id, start_dataset, start_column, CAST(sum(direct) AS BIGINT) AS direct_dependents, CAST(sum(n_rows - direct) AS BIGINT) AS transitive_dependents,
  count(*) AS total_datasets_affected, CAST(sum(n_rows) AS BIGINT) AS total_columns_affected, CAST(sum(nc) AS BIGINT) AS distinct_columns_affected, max(md) AS max_depth FROM per GROUP BY ALL)"""


@query("g4_impact_analysis", f"""WITH RECURSIVE {_col('source', 'target')}, {_IMPACT}
 SELECT *, CASE WHEN total_datasets_affected >= 5 OR total_columns_affected >= 10 THEN 'CRITICAL' WHEN total_datasets_affected >= 3 OR total_columns_affected >= 5 THEN 'HIGH'
  WHEN total_datasets_affected >= 2 OR total_columns_affected >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS criticality FROM imp""")
def _(t):
    return g.impact_analysis(t("v_column_edges"), t.sql(_KEYS))


@query("a5_impact_rollup", f"""WITH RECURSIVE {_col('source', 'target')}
 SELECT org_id, start_dataset, start_column, dataset, count(*) AS n_rows, count(*) FILTER (depth = 1) AS direct, max(depth) AS max_depth, string_agg(DISTINCT "column", ',' ORDER BY "column") AS columns FROM closure GROUP BY ALL""")
def _(t):
    return g.impacted_datasets(g.column_closure(t("v_column_edges"), t.sql(_KEYS))).withColumn("columns", F.array_join("columns", ","))


@query("j14_impact_types", f"""WITH RECURSIVE {_col('source', 'target')}, types AS (SELECT org_id, source_dataset AS name, min(transform_type) AS dataset_type FROM {{v_column_edges}} WHERE transform_type <> 'DIRECT' GROUP BY ALL)
 SELECT c.org_id, start_dataset, start_column, dataset, max(depth) AS max_depth, any_value(dataset_type) AS dataset_type FROM closure c LEFT JOIN types y ON y.org_id = c.org_id AND y.name = c.dataset GROUP BY ALL""")
def _(t):
    e = t("v_column_edges")
    types = e.filter("transform_type <> 'DIRECT'").groupBy("org_id", F.col("source_dataset").alias("name")).agg(F.min("transform_type").alias("dataset_type"))
    return g.impacted_datasets(g.column_closure(e, t.sql(_KEYS)), types).select("org_id", "start_dataset", "start_column", "dataset", "max_depth", "dataset_type")


@query("o3_order_impact", f"""WITH RECURSIVE {_col('source', 'target')} SELECT org_id, start_dataset, dataset, max(depth) AS max_depth FROM closure GROUP BY ALL ORDER BY 4, 1, 2, 3""")
def _(t):
    i = g.impacted_datasets(g.column_closure(t("v_column_edges"), t.sql(_KEYS)))
    return i.groupBy("org_id", "start_dataset", "dataset").agg(F.max("max_depth").alias("max_depth")).orderBy("max_depth", "org_id", "start_dataset", "dataset")


_BOTH = """WITH RECURSIVE dn(node, depth) AS (SELECT target, 1 FROM {v_edges} WHERE org_id = 'o1' AND source = 'customer:1'
    UNION SELECT e.target, depth + 1 FROM dn JOIN {v_edges} e ON e.org_id = 'o1' AND e.source = dn.node WHERE depth < 10),
  upw(node, depth) AS (SELECT source, 1 FROM {v_edges} WHERE org_id = 'o1' AND target = 'customer:1'
    UNION SELECT e.source, depth + 1 FROM upw JOIN {v_edges} e ON e.org_id = 'o1' AND e.target = upw.node WHERE depth < 10),
  nodes AS (SELECT 'customer:1' AS name, 'self' AS role, 0 AS depth UNION ALL SELECT node, 'downstream', min(depth) FROM dn GROUP BY node UNION ALL SELECT node, 'upstream', min(depth) FROM upw GROUP BY node),
  inner_edges AS (SELECT source, target FROM {v_edges} WHERE org_id = 'o1' AND source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes))"""


def _around(t):
    return g.lineage_graph(t("v_edges"), "o1", "customer:1")


@query("g5_lineage_graph", _BOTH + " SELECT name, role, depth FROM nodes UNION ALL SELECT source, '-> ' || target, -1 FROM inner_edges")
def _(t):
    nodes, edges = _around(t)
    shown = edges.select(F.col("source").alias("name"), F.concat(F.lit("-> "), "target").alias("role"), F.lit(-1).alias("depth"))
    return nodes.select("name", "role", "depth").unionByName(shown)


@query("a15_lineage_counts", _BOTH + " SELECT role AS counter, count(*) AS n FROM nodes WHERE role <> 'self' GROUP BY role UNION ALL SELECT 'edges', count(*) FROM inner_edges")
def _(t):
    return g.lineage_counts(*_around(t))


@query("j6_edges_within", "SELECT org_id, source, target FROM {v_edges} e WHERE EXISTS (SELECT 1 FROM {v_datasets} d WHERE d.org_id = e.org_id AND d.name = e.source AND d.dataset_type <> 's3') AND EXISTS (SELECT 1 FROM {v_datasets} d WHERE d.org_id = e.org_id AND d.name = e.target AND d.dataset_type <> 's3')")
def _(t):
    return g.edges_within(t("v_edges"), t("v_datasets").filter("dataset_type <> 's3'")).select("org_id", "source", "target")


_CB = """WITH RECURSIVE dn(d, c, depth) AS (SELECT DISTINCT 'd9', 'c1', 0 UNION SELECT e.target_dataset, e.target_column, depth + 1 FROM dn JOIN {v_column_edges} e ON e.org_id = 'o2' AND e.source_dataset = dn.d AND e.source_column = dn.c WHERE depth < 10),
  upw(d, c, depth) AS (SELECT DISTINCT 'd9', 'c1', 0 UNION SELECT e.source_dataset, e.source_column, depth + 1 FROM upw JOIN {v_column_edges} e ON e.org_id = 'o2' AND e.target_dataset = upw.d AND e.target_column = upw.c WHERE depth < 10),
  nodes AS (SELECT 'd9' AS dataset, 'c1' AS "column", 'self' AS role, 0 AS depth UNION ALL SELECT d, c, 'downstream', min(depth) FROM dn WHERE depth > 0 GROUP BY ALL UNION ALL SELECT d, c, 'upstream', min(depth) FROM upw WHERE depth > 0 GROUP BY ALL),
  inner_edges AS (SELECT source_dataset, source_column, target_dataset, target_column FROM {v_column_edges} e WHERE org_id = 'o2' AND EXISTS (SELECT 1 FROM nodes n WHERE n.dataset = e.source_dataset AND n."column" = e.source_column) AND EXISTS (SELECT 1 FROM nodes n WHERE n.dataset = e.target_dataset AND n."column" = e.target_column))"""


@query("g6_column_graph", _CB + """ SELECT dataset, "column", role, depth FROM nodes UNION ALL SELECT source_dataset, source_column, target_dataset || '.' || target_column, -1 FROM inner_edges""")
def _(t):
    nodes, edges = g.column_graph(t("v_column_edges"), "o2", "d9", "c1")
    shown = edges.select(
        F.col("source_dataset").alias("dataset"), F.col("source_column").alias("column"), F.concat_ws(".", "target_dataset", "target_column").alias("role"), F.lit(-1).alias("depth")
    )
    return nodes.select("dataset", "column", "role", "depth").unionByName(shown)


@query("j5_edges_within_columns", """WITH s AS (SELECT DISTINCT org_id, source_dataset, source_column FROM {v_column_edges} WHERE transform_type = 'JOIN')
 SELECT e.org_id, e.source_dataset, e.source_column, e.target_dataset, e.target_column FROM {v_column_edges} e
 WHERE EXISTS (SELECT 1 FROM s WHERE s.org_id = e.org_id AND s.source_dataset = e.source_dataset AND s.source_column = e.source_column)
   AND EXISTS (SELECT 1 FROM s WHERE s.org_id = e.org_id AND s.source_dataset = e.target_dataset AND s.source_column = e.target_column)""")
def _(t):
    e = t("v_column_edges")
    cols = e.filter("transform_type = 'JOIN'").select("org_id", F.col("source_dataset").alias("dataset"), F.col("source_column").alias("column"))
    return g.edges_within_columns(e, cols).select("org_id", "source_dataset", "source_column", "target_dataset", "target_column")


@query("g7_dataset_column_edges", "SELECT * FROM {v_column_edges} WHERE org_id = 'o1' AND (source_dataset = 'd4' OR target_dataset = 'd4')")
def _(t):
    return g.dataset_column_edges(t("v_column_edges"), "o1", "d4")


_LC = """SELECT org_id, source_dataset AS dataset, source_column AS "column" FROM {v_column_edges} UNION SELECT org_id, target_dataset, target_column FROM {v_column_edges}"""


@query("g8_lineage_columns", _LC)
def _(t):
    return g.lineage_columns(t("v_column_edges"))


@query("u1_columns_per_dataset", f"SELECT org_id, dataset, count(*) AS n FROM ({_LC}) x GROUP BY ALL")
def _(t):
    return g.lineage_columns(t("v_column_edges")).groupBy("org_id", "dataset").agg(F.count("*").alias("n"))


_RAW_E = """SELECT 'o' || CAST(1 + user_id % 2 AS STRING) AS org_id, event_type AS source, CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'ghost' ELSE 'error' END AS target,
  'j' || CAST(user_id AS STRING) AS job_id, 'name' || CAST(user_id % 3 AS STRING) AS job_name FROM {events}"""


@query("u7_clean_edges", f"""WITH raw AS ({_RAW_E}) SELECT org_id, source, target, min(job_id) AS job_id FROM raw r
 WHERE source <> target AND EXISTS (SELECT 1 FROM {{v_datasets}} d WHERE d.org_id = r.org_id AND d.name = r.source) AND EXISTS (SELECT 1 FROM {{v_datasets}} d WHERE d.org_id = r.org_id AND d.name = r.target) GROUP BY org_id, source, target""")
def _(t):
    return g.clean_edges(t.sql(_RAW_E), t("v_datasets")).drop("job_name")
