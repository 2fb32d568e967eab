"""Queries: lists, lookups, views, paging."""

from pyspark.sql import functions as F

from lakeledger.operators import listing as li
from lakeledger.plans.registry import query

_AS_OF = "2024-01-31 00:00:00"


def _s(*cols):
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in cols]


def _d(*cols):
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in cols)


@query("p1_list_datasets", f"SELECT name, dataset_type, location, {_d('updated_at')} FROM (SELECT * FROM {{v_datasets}} WHERE org_id = 'o1' AND dataset_type = 's3' ORDER BY updated_at DESC, name LIMIT 100 OFFSET 20) x")
def _(t):
    return li.list_datasets(t("v_datasets"), "o1", "s3", 100, 20).select("name", "dataset_type", "location", *_s("updated_at"))


@query("p2_get_dataset", f"SELECT name, dataset_type, location, {_d('created_at', 'updated_at')} FROM {{v_datasets}} WHERE org_id = 'o1' AND name = 'customer:8'")
def _(t):
    return li.get_dataset(t("v_datasets"), "o1", "customer:8").select("name", "dataset_type", "location", *_s("created_at", "updated_at"))


@query("p3_metric_series", f"SELECT dataset, {_d('ts')}, row_count, byte_size FROM (SELECT * FROM {{v_metrics}} WHERE org_id = 'o1' AND dataset = 'view' AND ts > TIMESTAMP '{_AS_OF}' - INTERVAL 168 HOUR ORDER BY ts DESC, job_id LIMIT 1000) x")
def _(t):
    return li.metric_series(t("v_metrics"), "o1", "view", _AS_OF).select("dataset", *_s("ts"), "row_count", "byte_size")


@query("p4_list_anomalies", f"SELECT anomaly_id, dataset, severity, status, {_d('detected_at')} FROM (SELECT * FROM {{v_anomalies}} WHERE org_id = 'o1' AND dataset = 'click' AND severity = 'WARNING' AND status = 'OPEN' AND detected_at > TIMESTAMP '{_AS_OF}' - INTERVAL 720 HOUR ORDER BY detected_at DESC, anomaly_id DESC LIMIT 100 OFFSET 10) x")
def _(t):
    a = li.list_anomalies(t("v_anomalies"), "o1", _AS_OF, "click", "WARNING", "OPEN", 720, 100, 10)
    return a.select("anomaly_id", "dataset", "severity", "status", *_s("detected_at"))


@query("p5_get_anomaly", "SELECT anomaly_id, dataset, anomaly_type, severity, status FROM {v_anomalies} WHERE anomaly_id = 77")
def _(t):
    return li.get_by_id(t("v_anomalies"), "anomaly_id", 77).select("anomaly_id", "dataset", "anomaly_type", "severity", "status")


@query("p6_list_jobs", f"SELECT app_id, job_name, status, partition_key, {_d('started_at')}, duration_ms FROM (SELECT *, CAST(epoch_ms(ended_at) - epoch_ms(started_at) AS BIGINT) AS duration_ms FROM {{v_job_runs}} WHERE org_id = 'o1' AND upper(status) = 'SUCCESS' AND job_name ILIKE '%urg%' AND partition_key LIKE '%country=N1%' AND started_at > TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 20000 HOUR ORDER BY started_at DESC, app_id LIMIT 50 OFFSET 5) x")
def _(t):
    j = li.list_jobs(t("v_job_runs"), "o1", "2001-08-01 00:00:00", "Success", "urg", None, "N1", 20000, 50, 5)
    return j.select("app_id", "job_name", "status", "partition_key", *_s("started_at"), "duration_ms")


@query("p7_get_job", "SELECT app_id, job_name, status, partition_key, rows_written FROM {v_job_runs} WHERE app_id = 'app-42'")
def _(t):
    return li.get_by_id(t("v_job_runs"), "app_id", "app-42").select("app_id", "job_name", "status", "partition_key", "rows_written")


@query("p8_alert_history", f"SELECT alert_id, rule_id, rule_name, status, {_d('sent_at')} FROM (SELECT h.*, r.rule_name FROM {{v_alert_history}} h JOIN {{v_rules}} r USING (rule_id) WHERE (r.org_id = 'o1' OR r.org_id IS NULL) AND h.status = 'SENT' AND h.sent_at > TIMESTAMP '{_AS_OF}' - INTERVAL 500 HOUR ORDER BY sent_at DESC, alert_id DESC LIMIT 100) x")
def _(t):
    h = li.list_alert_history(t("v_alert_history"), t("v_rules"), "o1", _AS_OF, 500, "SENT")
    return h.select("alert_id", "rule_id", "rule_name", "status", *_s("sent_at"))


@query("p9_alert_rules", "SELECT rule_id, rule_name, dataset_pattern, enabled FROM {v_rule_book} WHERE (org_id = 'o2' OR org_id IS NULL) AND enabled")
def _(t):
    return li.list_alert_rules(t("v_rule_book"), "o2", True).select("rule_id", "rule_name", "dataset_pattern", "enabled")


@query("p10_recent_anomalies", f"SELECT anomaly_id, dataset, anomaly_type, severity, {_d('detected_at')} FROM {{v_anomalies}} WHERE detected_at > TIMESTAMP '{_AS_OF}' - INTERVAL 168 HOUR")
def _(t):
    return li.recent_anomalies(t("v_anomalies"), _AS_OF).select("anomaly_id", "dataset", "anomaly_type", "severity", *_s("detected_at"))


@query("p12_active_rules", "SELECT rule_id, org_id FROM {v_rule_book} WHERE enabled AND (org_id = 'o1' OR org_id IS NULL)")
def _(t):
    return li.list_alert_rules(t("v_rule_book"), "o1", True).select("rule_id", "org_id")


@query("j1_lineage_graph_view", "SELECT e.org_id, e.source, e.target, s.dataset_type AS source_type, d.dataset_type AS target_type, e.job_name FROM {v_edges} e JOIN {v_datasets} s ON s.org_id = e.org_id AND s.name = e.source JOIN {v_datasets} d ON d.org_id = e.org_id AND d.name = e.target")
def _(t):
    v = li.lineage_graph_view(t("v_edges"), t("v_datasets"))
    return v.select("org_id", "source", "target", "source_type", "target_type", "job_name")


@query("j2_scoped_metrics", f"SELECT m.org_id, m.dataset, d.dataset_type, {_d('m.ts').replace('AS m.ts', 'AS ts')}, m.row_count FROM {{v_metrics}} m JOIN {{v_datasets}} d ON d.org_id = m.org_id AND d.name = m.dataset")
def _(t):
    return li.scoped_metrics(t("v_metrics"), t("v_datasets")).select("org_id", "dataset", "dataset_type", *_s("ts"), "row_count")


@query("o1_page", "SELECT app_id, job_name FROM (SELECT * FROM {v_job_runs} ORDER BY started_at DESC, app_id LIMIT 25 OFFSET 100) x")
def _(t):
    return li.page(t("v_job_runs"), [F.desc("started_at"), F.asc("app_id")], 25, 100).select("app_id", "job_name")


@query("o6_sort_jobs", "SELECT app_id, job_name, rows_written FROM {v_job_runs} ORDER BY lower(job_name) DESC, app_id")
def _(t):
    return li.sort_jobs(t("v_job_runs"), "job_name", False).select("app_id", "job_name", "rows_written")
