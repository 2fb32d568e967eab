"""Queries: schema versions and their differences."""

from pyspark.sql import functions as F

from lakeledger.operators import plan_lineage as pl
from lakeledger.operators import schema_diff as sd
from lakeledger.operators import schema_history as sh
from lakeledger.plans.registry import query
from lakeledger.sources.eventlog import event_tables
from lakeledger.sources.payloads import parse_schema_ingest

_SNAP = """snap AS (SELECT org_id, dataset, captured_at, string_agg(name || ':' || type || ':' || CAST(nullable AS VARCHAR), ',' ORDER BY pos) AS txt,
   sha256(string_agg(name || ':' || type || ':' || CAST(nullable AS VARCHAR), ',' ORDER BY pos)) AS h FROM {v_snapshot_fields} GROUP BY ALL),
 seq AS (SELECT *, lag(h) OVER (PARTITION BY org_id, dataset ORDER BY captured_at) AS ph FROM snap),
 ver AS (SELECT *, row_number() OVER w AS version_no, lead(valid_from) OVER w AS valid_to, lag(valid_from) OVER w AS prev_from FROM
   (SELECT org_id, dataset, h, min(captured_at) AS valid_from, any_value(txt) AS txt FROM snap GROUP BY ALL) x WINDOW w AS (PARTITION BY org_id, dataset ORDER BY valid_from, h)),
 newf AS (SELECT v.org_id, v.dataset, v.version_no, f.name, f.type, f.nullable, f.pos FROM ver v JOIN {v_snapshot_fields} f ON f.org_id = v.org_id AND f.dataset = v.dataset AND f.captured_at = v.valid_from),
 sides AS (SELECT coalesce(n.org_id, o.org_id) AS org_id, coalesce(n.dataset, o.dataset) AS dataset, coalesce(n.version_no, o.version_no + 1) AS version_no, coalesce(n.name, o.name) AS name,
   o.type AS ot, n.type AS nt, o.nullable AS onl, n.nullable AS nnl, o.pos AS op, n.pos AS np FROM newf n FULL JOIN newf o ON o.org_id = n.org_id AND o.dataset = n.dataset AND o.version_no = n.version_no - 1 AND o.name = n.name
   WHERE EXISTS (SELECT 1 FROM ver v WHERE v.org_id = coalesce(n.org_id, o.org_id) AND v.dataset = coalesce(n.dataset, o.dataset) AND v.version_no = coalesce(n.version_no, o.version_no + 1) AND v.version_no > 1))"""
_CHG = """chg AS (SELECT org_id, dataset, version_no, name AS field, 'ADDED' AS change, 1 AS level, 'Added field: ' || name || ' (' || nt || ')' AS description FROM sides WHERE ot IS NULL
  UNION ALL SELECT org_id, dataset, version_no, name, 'REMOVED', 3, 'Removed field: ' || name FROM sides WHERE nt IS NULL
  UNION ALL SELECT org_id, dataset, version_no, name, 'TYPE_CHANGED', CASE WHEN ot = 'int' AND nt = 'bigint' THEN 2 ELSE 3 END, 'Type changed: ' || name || ' (' || ot || ' → ' || nt || ')' FROM sides WHERE ot <> nt
  UNION ALL SELECT org_id, dataset, version_no, name, 'NULLABILITY_CHANGED', CASE WHEN nnl THEN 1 ELSE 3 END, 'Nullability changed: ' || name || CASE WHEN nnl THEN ' (not null → nullable)' ELSE ' (nullable → not null)' END FROM sides WHERE onl <> nnl
  UNION ALL SELECT org_id, dataset, version_no, name, 'REORDERED', 2, 'Field reordered: ' || name || ' (position ' || op || ' → ' || np || ')' FROM sides WHERE op <> np)"""
_KEYS = ["org_id", "dataset", "version_no"]


def _t(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _s(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _snap(t):
    return sh.snapshots_from_fields(t("v_snapshot_fields"))


def _versions(t):
    return sh.build_schema_versions(_snap(t))


def _pairs(t):
    return sd.version_pairs(_versions(t))


def _text(c="fields"):
    return F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["name"], f["type"], f["nullable"].cast("string"))), ",")


@query("e1_snapshot_log", f"""WITH {_SNAP}, msg AS (SELECT 'o1' AS org_id, 'cust' || (o_custkey % 200) AS dataset, (CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400)) AS at_,
   'id:' || CASE WHEN o_orderkey % 3 = 0 THEN 'int' ELSE 'bigint' END || ':true' || CASE WHEN o_orderkey % 3 = 2 THEN ',email:string:false' ELSE '' END AS txt FROM {{orders}})
 SELECT org_id, dataset, {_t('captured_at')} AS captured_at, h AS schema_hash FROM snap UNION ALL SELECT org_id, dataset, {_t('at_')}, max(sha256(txt)) FROM msg GROUP BY org_id, dataset, at_
 UNION ALL SELECT 'o1', dataset, {_t("TIMESTAMP '2023-11-14 22:13:20' + to_seconds(k)")}, max(sha256(txt)) FROM (SELECT o_orderkey AS k, 'tab' || (o_custkey % 50) AS dataset, 'id:bigint:true,total:double:true,flag:string:true' AS txt FROM {{orders}} WHERE o_orderkey % 2 = 0 OR o_orderkey % 6 = 3
   UNION ALL SELECT o_orderkey, 'nn:8020:out' || (o_custkey % 50), 'ref:string:true,id2:bigint:true' FROM {{orders}} WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'side' || (o_custkey % 10), 'k:bigint:true,run:double:true' FROM {{orders}} WHERE o_orderkey % 6 = 1) w GROUP BY dataset, k""")
def _(t):
    msgs = parse_schema_ingest(t("v_schema_payload_json"))[0]
    x = event_tables(t.staged_log("sql_start"))
    wrote = pl.written_snapshots(pl.query_schemas(pl.plan_nodes(x["plans"], partitions=x.partitions("sql_start"))), F.lit("o1"))
    log = sh.snapshot_log(msgs, wrote, _snap(t))
    return log.select("org_id", "dataset", _s("captured_at").alias("captured_at"), "schema_hash")


@query("e2_schema_hash_changes", f"WITH {_SNAP} SELECT org_id, dataset, {_t('captured_at')} AS captured_at, h AS schema_hash, ph AS previous_hash, coalesce(h <> ph, true) AS changed FROM seq")
def _(t):
    return sh.with_schema_hash(_snap(t)).select("org_id", "dataset", _s("captured_at").alias("captured_at"), "schema_hash", "previous_hash", "changed")


@query("e3_schema_versions", f"WITH {_SNAP} SELECT org_id, dataset, version_no, h AS schema_hash, txt AS fields, {_t('valid_from')} AS valid_from, {_t('valid_to')} AS valid_to FROM ver")
def _(t):
    return _versions(t).select(*_KEYS, "schema_hash", _text().alias("fields"), _s("valid_from").alias("valid_from"), _s("valid_to").alias("valid_to"))


@query("e3_schema_versions_reopened", f"WITH {_SNAP} SELECT org_id, dataset, row_number() OVER w AS version_no, h AS schema_hash, {_t('captured_at')} AS valid_from, {_t('lead(captured_at) OVER w')} AS valid_to FROM seq WHERE ph IS NULL OR ph <> h WINDOW w AS (PARTITION BY org_id, dataset ORDER BY captured_at)")
def _(t):
    v = sh.build_schema_versions(_snap(t), reopen=True)
    return v.select(*_KEYS, "schema_hash", _s("valid_from").alias("valid_from"), _s("valid_to").alias("valid_to"))


@query("w3_scd2_intervals", f"WITH {_SNAP} SELECT org_id, dataset, count(*) AS n, CAST(sum(CASE WHEN valid_to IS NULL THEN 0 ELSE epoch(valid_to) - epoch(valid_from) END) AS BIGINT) AS closed_seconds FROM ver GROUP BY ALL")
def _(t):
    v = _versions(t)
    secs = F.unix_seconds("valid_to") - F.unix_seconds("valid_from")
    return v.groupBy("org_id", "dataset").agg(F.count("*").alias("n"), F.sum(F.coalesce(secs, F.lit(0))).alias("closed_seconds"))


@query("w4_previous_schema", f"WITH {_SNAP} SELECT org_id, dataset, {_t('captured_at')} AS captured_at, h AS schema_hash, ph AS previous_hash, ptxt AS previous_fields FROM (SELECT *, lag(txt) OVER (PARTITION BY org_id, dataset ORDER BY captured_at) AS ptxt FROM seq) x WHERE ph IS NULL OR ph <> h")
def _(t):
    p = sh.with_previous(_snap(t))
    return p.select("org_id", "dataset", _s("captured_at").alias("captured_at"), "schema_hash", "previous_hash", F.when(F.col("previous_hash").isNotNull(), _text("previous_fields")).alias("previous_fields"))


@query("w6_version_no", f"WITH {_SNAP} SELECT org_id, dataset, {_t('captured_at')} AS captured_at, CAST(sum(CASE WHEN ph IS NULL OR ph <> h THEN 1 ELSE 0 END) OVER (PARTITION BY org_id, dataset ORDER BY captured_at) AS BIGINT) AS version_no FROM seq")
def _(t):
    return sh.with_version_no(_snap(t)).select("org_id", "dataset", _s("captured_at").alias("captured_at"), "version_no")


@query("u4_field_sets", f"WITH {_SNAP} SELECT org_id, dataset, version_no, count(*) FILTER (ot IS NULL) AS added, count(*) FILTER (nt IS NULL) AS removed, count(*) FILTER (ot IS NOT NULL AND nt IS NOT NULL) AS common FROM sides GROUP BY ALL")
def _(t):
    s = sd.field_sets(_pairs(t), _KEYS)
    o, n = F.col("old").isNull(), F.col("new").isNull()
    return s.groupBy(*_KEYS).agg(F.count_if(o).alias("added"), F.count_if(n).alias("removed"), F.count_if(~o & ~n).alias("common"))


@query("e4_diff_fields", f"WITH {_SNAP}, {_CHG} SELECT org_id, dataset, version_no, field, change, description FROM chg")
def _(t):
    return sd.diff_fields(_pairs(t), _KEYS).select(*_KEYS, "field", "change", "description")


@query("e5_change_severity", f"WITH {_SNAP}, {_CHG} SELECT change, CASE level WHEN 3 THEN 'Breaking' WHEN 2 THEN 'Warning' ELSE 'NonBreaking' END AS severity, count(*) AS n FROM chg GROUP BY ALL")
def _(t):
    return sd.diff_fields(_pairs(t), _KEYS).groupBy("change", "severity").agg(F.count("*").alias("n"))


@query("e6_widening", f"WITH {_SNAP} SELECT ot AS old_type, nt AS new_type, ot = 'int' AND nt = 'bigint' AS widening, count(*) AS n FROM sides WHERE ot <> nt GROUP BY ALL")
def _(t):
    s = sd.field_sets(_pairs(t), _KEYS).filter("old.type <> new.type")
    w = sd.is_widening(F.col("old.type"), F.col("new.type"))
    return s.groupBy(F.col("old.type").alias("old_type"), F.col("new.type").alias("new_type"), w.alias("widening")).agg(F.count("*").alias("n"))


@query("e7_diff_summary", f"""WITH {_SNAP}, {_CHG}, g AS (SELECT org_id, dataset, version_no, bool_or(level = 3) AS b, bool_or(level = 2) AS w, count(*) AS n FROM chg GROUP BY ALL)
 SELECT v.org_id, v.dataset, v.version_no, coalesce(b, false) AS has_breaking, coalesce(w, false) AS has_warnings, coalesce(n, 0) AS n_changes, coalesce(n, 0) = 0 AS is_identical, CASE WHEN b THEN 'Breaking' WHEN w THEN 'Warning' ELSE 'NonBreaking' END AS overall_severity
 FROM ver v LEFT JOIN g USING (org_id, dataset, version_no) WHERE v.version_no > 1""")
def _(t):
    p = _pairs(t)
    return sd.schema_diff_summary(p, sd.diff_fields(p, _KEYS), _KEYS)


@query("o4_order_changes", f"WITH {_SNAP}, {_CHG} SELECT org_id, dataset, version_no, field, change, level FROM chg ORDER BY level DESC, field, change")
def _(t):
    return sd.order_changes(sd.diff_fields(_pairs(t), _KEYS)).select(*_KEYS, "field", "change", "level")


_SVC = """svc AS (SELECT org_id, dataset, version_no, name, 0 AS sec, 0 AS place, 'Column added: ' || name || ' (' || nt || ')' AS text FROM sides WHERE ot IS NULL
  UNION ALL SELECT org_id, dataset, version_no, name, 1, 1, 'Column removed: ' || name || ' (was ' || ot || ')' FROM sides WHERE nt IS NULL
  UNION ALL SELECT org_id, dataset, version_no, name, 2, 2, 'Type changed: ' || name || ' (' || ot || ' -> ' || nt || ')' FROM sides WHERE ot <> nt
  UNION ALL SELECT org_id, dataset, version_no, name, 2, CASE WHEN nnl THEN 3 ELSE 4 END, 'Nullability changed: ' || name || CASE WHEN nnl THEN ' (NOT NULL -> NULLABLE)' ELSE ' (NULLABLE -> NOT NULL)' END FROM sides WHERE onl <> nnl),
 sg AS (SELECT org_id, dataset, version_no, string_agg(text, ' | ' ORDER BY sec, name, place) AS changes, count(*) AS n,
   CASE WHEN count(*) FILTER (place > 0) > 0 THEN 'BREAKING' ELSE 'NON_BREAKING' END AS ct, """ + ", ".join(
    f"coalesce(list(name ORDER BY name) FILTER (place = {i}), []) AS l{i}" for i in range(5)
) + """ FROM svc GROUP BY ALL)"""


def _part(i, one, many):
    q = f"array_to_string([chr(39) || x || chr(39) for x in l{i}], ', ')"
    return f"CASE WHEN len(l{i}) = 1 THEN ' {one[0]}' || {q} || '{one[1]}' WHEN len(l{i}) > 1 THEN ' ' || replace('{many}', '#', CAST(len(l{i}) AS VARCHAR)) || {q} ELSE '' END"


_DESC = (
    "CASE WHEN ct = 'BREAKING' THEN '⚠️ Breaking schema changes detected that may impact downstream consumers.' ELSE 'Schema has been extended with new columns.' END || "
    + " || ".join([
        _part(0, ("Added 1 new column: ", ""), "Added # new columns: "),
        _part(1, ("Removed column ", ""), "Removed # columns: "),
        _part(2, ("Data type changed for column ", ""), "Data types changed for # columns: "),
        _part(4, ("Column ", " no longer accepts null values"), "# columns no longer accept null values: "),
        _part(3, ("Column ", " now accepts null values"), "# columns now accept null values: "),
    ])
)


@query("e8_schema_change_anomalies", f"""WITH {_SNAP}, {_SVC} SELECT v.org_id, v.dataset, v.version_no, coalesce(ct, 'UNCHANGED') AS change_type, CASE WHEN ct = 'BREAKING' THEN 'CRITICAL' WHEN ct IS NOT NULL THEN 'WARNING' END AS severity,
  CAST(coalesce(n, 0) AS BIGINT) AS deviation, changes FROM ver v LEFT JOIN sg USING (org_id, dataset, version_no) WHERE v.version_no > 1""")
def _(t):
    a = sd.schema_change_anomalies(_pairs(t), _KEYS)
    return a.select(*_KEYS, "change_type", "severity", F.col("deviation").cast("bigint").alias("deviation"), F.array_join("changes", " | ").alias("changes"))


@query("e9_change_description", f"WITH {_SNAP}, {_SVC} SELECT org_id, dataset, version_no, 'Schema ' || replace(lower(ct), '_', '-') || ': ' || {_DESC} AS message FROM sg")
def _(t):
    return sd.schema_change_anomalies(_pairs(t), _KEYS).filter("message IS NOT NULL").select(*_KEYS, "message")


@query("e10_version_diff", f"""WITH {_SNAP}, ch AS (SELECT org_id, dataset, 1 AS from_version, max(version_no) AS to_version FROM ver GROUP BY ALL HAVING max(version_no) > 1),
 o AS (SELECT ch.*, f.name, f.type, f.nullable FROM ch JOIN newf f ON f.org_id = ch.org_id AND f.dataset = ch.dataset AND f.version_no = ch.from_version),
 n AS (SELECT ch.*, f.name, f.type, f.nullable FROM ch JOIN newf f ON f.org_id = ch.org_id AND f.dataset = ch.dataset AND f.version_no = ch.to_version)
 SELECT coalesce(o.org_id, n.org_id) AS org_id, coalesce(o.dataset, n.dataset) AS dataset, count(*) FILTER (o.name IS NULL) AS added_count, count(*) FILTER (n.name IS NULL) AS removed_count,
  count(*) FILTER (o.type <> n.type OR o.nullable <> n.nullable) AS modified_count, coalesce(bool_or(n.name IS NULL OR o.type <> n.type OR (o.nullable AND NOT n.nullable)), false) AS is_breaking
 FROM o FULL JOIN n ON o.org_id = n.org_id AND o.dataset = n.dataset AND o.name = n.name GROUP BY ALL""")
def _(t):
    v = _versions(t)
    chosen = v.groupBy("org_id", "dataset").agg(F.min("version_no").alias("from_version"), F.max("version_no").alias("to_version")).filter("to_version > from_version")
    p = sd.chosen_pairs(v, chosen)
    return sd.schema_version_diff(p, ["org_id", "dataset"])


_JSONROW = """SELECT 'o1' AS org_id, event_type AS dataset, ts, chr(123) || '"id": ' || CAST(event_id AS STRING) || CASE WHEN user_id % 3 = 0 THEN ', "score": ' || CAST(CAST(value AS DECIMAL(10,2)) AS STRING) ELSE '' END ||
  CASE WHEN day(ts) > 10 THEN ', "tag": "' || event_type || '"' ELSE '' END || ', "flag": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "ref": ' || CASE WHEN event_id % 50 = 0 THEN 'null' ELSE CAST(user_id AS STRING) END || chr(125) AS value FROM {events}"""


@query("e12_infer_snapshots", """WITH k AS (SELECT event_type AS dataset, date_trunc('day', ts) AS d, event_id, user_id, day(ts) AS dd FROM {events}), n AS (SELECT dataset, d, count(*) AS n FROM k GROUP BY ALL),
 f AS (SELECT dataset, d, 'id' AS name, 'bigint' AS type, count(*) AS c FROM k GROUP BY ALL UNION ALL SELECT dataset, d, 'score', 'double', count(*) FROM k WHERE user_id % 3 = 0 GROUP BY ALL UNION ALL SELECT dataset, d, 'tag', 'string', count(*) FROM k WHERE dd > 10 GROUP BY ALL
   UNION ALL SELECT dataset, d, 'flag', 'boolean', count(*) FROM k GROUP BY ALL UNION ALL SELECT dataset, d, 'ref', 'bigint', count(*) FILTER (event_id % 50 <> 0) FROM k GROUP BY ALL)
 SELECT dataset, strftime(d, '%Y-%m-%d') AS day, string_agg(name || ':' || type || ':' || CAST(c < n AS VARCHAR), ',' ORDER BY name) AS fields FROM f JOIN n USING (dataset, d) GROUP BY ALL""")
def _(t):
    s = sh.infer_snapshots(t.sql(_JSONROW))
    return s.select("dataset", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), _text().alias("fields"))


_DS = "SELECT 'o1' AS org_id, 'u' || CAST(user_id AS STRING) AS name, min(event_type) AS dataset_type FROM {events} GROUP BY user_id"


@query("e13_current_schemas", f"WITH {_SNAP} SELECT v.org_id, v.dataset, v.txt AS fields, {_t('valid_from')} AS valid_from FROM ver v JOIN ({_DS}) d ON d.org_id = v.org_id AND d.name = v.dataset WHERE valid_to IS NULL")
def _(t):
    c = sh.current_schemas(_versions(t), t.sql(_DS))
    return c.select("org_id", "dataset", _text().alias("fields"), _s("valid_from").alias("valid_from"))


@query("j3_current_schema_view", f"WITH {_SNAP} SELECT dataset, h AS schema_hash FROM ver v JOIN ({_DS}) d ON d.name = v.dataset WHERE valid_to IS NULL")
def _(t):
    return sh.current_schemas(_versions(t), t.sql(_DS)).select("dataset", "schema_hash")


@query("o5_schema_history", f"WITH {_SNAP} SELECT org_id, dataset, version_no, h AS schema_hash FROM ver QUALIFY row_number() OVER (PARTITION BY org_id, dataset ORDER BY valid_from DESC, h DESC) <= 3")
def _(t):
    return sh.schema_history(_versions(t), 3).select(*_KEYS, "schema_hash")


@query("j11_schema_as_of", f"WITH {_SNAP} SELECT e.event_id, v.version_no, v.h AS schema_hash FROM {{events}} e LEFT JOIN ver v ON v.dataset = 'u' || e.user_id AND v.valid_from <= e.ts AND (v.valid_to IS NULL OR e.ts < v.valid_to)")
def _(t):
    times = t("events").select("event_id", F.lit("o1").alias("org_id"), F.concat(F.lit("u"), "user_id").alias("dataset"), F.col("ts").cast("timestamp").alias("at"))
    return sh.schema_as_of(_versions(t), times).select("event_id", "version.version_no", "version.schema_hash")


@query("m8_append_versions", f"WITH {_SNAP} SELECT org_id, dataset, h AS schema_hash, {_t('valid_from')} AS valid_from, {_t('valid_to')} AS valid_to FROM ver")
def _(t):
    s = _snap(t)
    cut = F.col("captured_at") < F.lit("2024-01-12").cast("timestamp")
    return sh.append_schema_versions(sh.build_schema_versions(s.filter(cut)), s.filter(~cut)).select(
        "org_id", "dataset", "schema_hash", _s("valid_from").alias("valid_from"), _s("valid_to").alias("valid_to")
    )


@query("e11_leaf_fields", """WITH b AS (SELECT o_orderkey AS k, 'f' || (o_custkey % 100) AS n FROM {orders})
 SELECT k, 'id' AS path, 'bigint' AS type FROM b UNION ALL SELECT k, 'user.' || n, 'int' FROM b UNION ALL SELECT k, 'user.tags.element', 'decimal(10,2)' FROM b UNION ALL SELECT k, 'meta.key', 'string' FROM b UNION ALL SELECT k, 'meta.value.a-b', 'double' FROM b UNION ALL SELECT k, 'meta.value.c', 'timestamp' FROM b""")
def _(t):
    f = lambda n, ty: F.struct(F.lit(n).alias("name"), ty.alias("type"), F.lit(True).alias("nullable"))
    user = F.concat(F.lit("struct<f"), (F.col("o_custkey") % 100).cast("string"), F.lit(":int,tags:array<decimal(10,2)>>"))
    s = t("orders").select(
        F.col("o_orderkey").alias("k"),
        F.array(f("id", F.lit("bigint")), f("user", user), f("meta", F.lit("map<string,struct<`a-b`:double,c:timestamp>>"))).alias("fields"),
    )
    return sh.explode_leaf_fields(s).select("k", "path", "type")
