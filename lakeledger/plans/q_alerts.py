"""Queries: rule matching, repeat suppression, outbox."""

from pyspark.sql import functions as F

from lakeledger.operators import alerts as al
from lakeledger.operators import graph as g
from lakeledger.plans.q_graph import _ABNORMAL, _down
from lakeledger.plans.registry import query

_MATCH = """m AS (SELECT a.anomaly_id, a.org_id, a.dataset, a.anomaly_type, a.severity, a.detected_at, r.rule_id, r.channel_type, r.subject_template, r.deduplication_minutes FROM {v_anomalies} a JOIN {v_rules} r
  ON r.enabled AND (r.org_id IS NULL OR r.org_id = a.org_id) AND (r.anomaly_type IS NULL OR r.anomaly_type = a.anomaly_type) AND (r.severity IS NULL OR r.severity = a.severity)
  AND (r.dataset_pattern IS NULL OR r.dataset_pattern = '*' OR (r.dataset_pattern LIKE '%*' AND starts_with(a.dataset, rtrim(r.dataset_pattern, '*'))) OR r.dataset_pattern = a.dataset))"""
_GREEDY = _MATCH + """,
 u AS (SELECT rule_id, org_id, dataset, anomaly_type, epoch_us(detected_at) AS t, CAST(any_value(deduplication_minutes) AS BIGINT) * 60000000 AS w, min(anomaly_id) AS first_id FROM m GROUP BY ALL),
 nx AS MATERIALIZED (SELECT a.rule_id, a.org_id, a.dataset, a.anomaly_type, a.t, min(b.t) AS nt FROM u a JOIN u b ON a.rule_id = b.rule_id AND a.org_id = b.org_id AND a.dataset = b.dataset AND a.anomaly_type = b.anomaly_type AND b.t >= a.t + a.w GROUP BY ALL),
 sent(rule_id, org_id, dataset, anomaly_type, t) AS (SELECT rule_id, org_id, dataset, anomaly_type, min(t) FROM u GROUP BY ALL UNION ALL SELECT s.rule_id, s.org_id, s.dataset, s.anomaly_type, nx.nt FROM sent s JOIN nx USING (rule_id, org_id, dataset, anomaly_type, t)),
 d AS (SELECT m.*, CASE WHEN u.first_id = m.anomaly_id AND EXISTS (SELECT 1 FROM sent s WHERE s.rule_id = m.rule_id AND s.org_id = m.org_id AND s.dataset = m.dataset AND s.anomaly_type = m.anomaly_type AND s.t = u.t) THEN 'SENT' ELSE 'DEDUPLICATED' END AS status
   FROM m JOIN u ON u.rule_id = m.rule_id AND u.org_id = m.org_id AND u.dataset = m.dataset AND u.anomaly_type = m.anomaly_type AND u.t = epoch_us(m.detected_at))"""


def _matches(t):
    return al.match_rules(t("v_anomalies"), t("v_rules"))


@query("r1_match_rules", f"WITH {_MATCH} SELECT rule_id, anomaly_id, org_id, dataset, channel_type FROM m")
def _(t):
    return _matches(t).select("rule_id", "anomaly_id", "org_id", "dataset", "channel_type")


@query("j9_matches_per_rule", f"WITH {_MATCH} SELECT rule_id, dataset, count(*) AS n FROM m GROUP BY ALL")
def _(t):
    return _matches(t).groupBy("rule_id", "dataset").agg(F.count("*").alias("n"))


@query("r2_match_exact", """SELECT r.rule_id, a.anomaly_id FROM {v_anomalies} a JOIN {v_rules} r ON r.enabled AND (r.dataset_pattern IS NULL OR r.dataset_pattern = a.dataset)
  AND (r.anomaly_type IS NULL OR r.anomaly_type = a.anomaly_type) AND (r.severity IS NULL OR r.severity = a.severity)""")
def _(t):
    return al.match_rules(t("v_anomalies"), t("v_rules"), wildcard=False, by_org=False).select("rule_id", "anomaly_id")


@query("r3_dedup_alerts", f"WITH RECURSIVE {_GREEDY} SELECT rule_id, anomaly_id, status FROM d")
def _(t):
    return al.dedup_alerts(_matches(t)).select("rule_id", "anomaly_id", "status")


@query("r4_alert_outbox", f"""WITH RECURSIVE {_down(_ABNORMAL)}, {_GREEDY} SELECT rule_id, anomaly_id, channel_type, CASE status WHEN 'SENT' THEN 'PENDING' ELSE status END AS status,
  CASE WHEN subject_template IS NULL THEN '[' || severity || '] Data Anomaly: ' || dataset ELSE severity || ' on ' || dataset || ' (' || anomaly_type || ')' END AS subject,
  CAST(coalesce(dc.n, 0) AS BIGINT) AS downstream_count FROM d LEFT JOIN (SELECT org_id, start, count(DISTINCT node) AS n FROM down GROUP BY ALL) dc ON dc.org_id = d.org_id AND dc.start = d.dataset""")
def _(t):
    counts = g.downstream_count(g.downstream(t("v_edges"), t.sql(_ABNORMAL)))
    out = al.alert_outbox(al.dedup_alerts(_matches(t)), counts)
    return out.select("rule_id", "anomaly_id", "channel_type", "status", "subject", "downstream_count")


@query("r5_alert_status", """SELECT anomaly_id, CASE WHEN status = 'OPEN' AND EXISTS (SELECT 1 FROM {v_alert_history} h WHERE h.anomaly_id = a.anomaly_id AND h.status = 'SENT') THEN 'ALERTED' ELSE status END AS status FROM {v_anomalies} a""")
def _(t):
    return al.apply_alert_status(t("v_anomalies"), t("v_alert_history")).select("anomaly_id", "status")


# all rules, those for any severity narrowed to the highest
_STRICT = "(SELECT * REPLACE (coalesce(severity, 'CRITICAL') AS severity) FROM {v_rules})"


@query("r6_unmatched_anomalies", f"WITH {_MATCH.replace('{v_rules}', _STRICT)}, z AS (SELECT DISTINCT anomaly_id FROM m) SELECT anomaly_id FROM {{v_anomalies}} a WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.anomaly_id = a.anomaly_id)")
def _(t):
    strict = t("v_rules").withColumn("severity", F.coalesce("severity", F.lit("CRITICAL")))
    return al.unmatched_anomalies(t("v_anomalies"), strict).select("anomaly_id")


@query("j13_recent_sent", f"""WITH {_MATCH}, h AS (SELECT a.rule_id, b.dataset, b.anomaly_type, a.sent_at FROM {{v_alert_history}} a JOIN {{v_anomalies}} b ON a.anomaly_id = b.anomaly_id WHERE a.status = 'SENT')
 SELECT rule_id, anomaly_id FROM m WHERE EXISTS (SELECT 1 FROM h WHERE h.rule_id = m.rule_id AND h.dataset = m.dataset AND h.anomaly_type = m.anomaly_type AND h.sent_at <= m.detected_at AND h.sent_at > m.detected_at - to_minutes(m.deduplication_minutes))""")
def _(t):
    names = t("v_anomalies").select("anomaly_id", "dataset", "anomaly_type")
    h = t("v_alert_history").drop("dataset").join(names, "anomaly_id")
    return al.recent_sent(_matches(t), h).select("rule_id", "anomaly_id")
