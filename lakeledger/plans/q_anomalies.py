"""Queries over load metrics."""

from pyspark.sql import functions as F

from lakeledger.operators import anomalies as an
from lakeledger.plans.registry import query

_SCOPED = """
scoped AS (SELECT *, CASE WHEN partition_key <> '' AND partition_key <> 'UNKNOWN' THEN 'partition'
                          WHEN job_name <> '' THEN 'job' ELSE 'dataset' END AS scope_kind,
                  CASE WHEN partition_key <> '' AND partition_key <> 'UNKNOWN' THEN partition_key
                       WHEN job_name <> '' THEN job_name ELSE '' END AS scope_value FROM {v_metrics}),
stats AS (SELECT r.org_id, r.dataset, r.job_id, r.ts, r.row_count, r.byte_size, r.scope_kind, r.scope_value,
                 count(h.ts) AS hist_count, avg(h.row_count) AS mean_row_count, stddev_samp(h.row_count) AS std_row_count,
                 avg(h.byte_size) AS mean_byte_size, stddev_samp(h.byte_size) AS std_byte_size
          FROM scoped r LEFT JOIN {v_metrics} h
            ON h.org_id = r.org_id AND h.dataset = r.dataset AND h.ts <= r.ts AND h.ts > r.ts - INTERVAL 30 DAY
           AND (r.job_id IS NULL OR h.job_id <> r.job_id)
           AND (r.scope_kind = 'dataset' OR (r.scope_kind = 'job' AND h.job_name = r.scope_value)
                OR (r.scope_kind = 'partition' AND h.partition_key = r.scope_value))
          GROUP BY ALL)
"""
_FOUND = """
found AS (
 SELECT org_id, dataset, job_id, ts, 'row_count' AS measure, CAST(row_count AS DOUBLE) AS cur, mean_row_count AS mean, coalesce(std_row_count, 0) AS std, scope_kind, scope_value, hist_count FROM stats WHERE hist_count >= 5
 UNION ALL
 SELECT org_id, dataset, job_id, ts, 'byte_size', CAST(byte_size AS DOUBLE), mean_byte_size, coalesce(std_byte_size, 0), scope_kind, scope_value, hist_count FROM stats WHERE hist_count >= 5),
hits AS (SELECT *, CASE WHEN cur > mean + 3 * std THEN 'up' WHEN cur < greatest(0, mean - 3 * std) THEN 'down' END AS way FROM found)
"""


def _hits(measure):
    up, down = ("RowCountSpike", "RowCountDrop") if measure == "row_count" else ("VolumeSpike", "VolumeDrop")
    return f"""WITH {_SCOPED}, {_FOUND}
SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, scope_kind, scope_value, CAST(hist_count AS BIGINT) AS hist_count,
       CASE way WHEN 'up' THEN '{up}' ELSE '{down}' END AS anomaly_type, CASE way WHEN 'up' THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
       cur AS current_value, round(mean, 6) AS expected_value, round(CASE WHEN mean > 0 THEN abs(cur - mean) / mean ELSE 1.0 END, 6) AS deviation
FROM hits WHERE way IS NOT NULL AND measure = '{measure}'"""


def _ts(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _shown(df):
    return df.select(
        "org_id", "dataset", "job_id", _ts(), "scope_kind", "scope_value", "hist_count", "anomaly_type", "severity",
        "current_value", F.round("expected_value", 6).alias("expected_value"), F.round("deviation", 6).alias("deviation"),
    )


@query("n2_row_count_anomalies", _hits("row_count"))
def _(t):
    return _shown(an.detect_row_count_anomalies(t("v_metrics")))


@query("n3_volume_anomalies", _hits("byte_size"))
def _(t):
    return _shown(an.detect_volume_anomalies(t("v_metrics")))


@query("n1_history_stats", f"""WITH {_SCOPED} SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, scope_kind, scope_value,
  CAST(hist_count AS BIGINT) AS hist_count, round(mean_row_count, 5) AS mean_row_count, round(std_row_count, 5) AS std_row_count,
  round(mean_byte_size, 2) AS mean_byte_size FROM stats""")
def _(t):
    s = an.history_stats(t("v_metrics"))
    return s.select(
        "org_id", "dataset", "job_id", _ts(), "scope_kind", "scope_value", "hist_count", F.round("mean_row_count", 5).alias("mean_row_count"),
        F.round("std_row_count", 5).alias("std_row_count"), F.round("mean_byte_size", 2).alias("mean_byte_size"),
    )


@query("n4_deviation", f"""WITH {_SCOPED}, {_FOUND} SELECT org_id, dataset, measure, way,
  count(*) AS n, round(sum(CASE WHEN mean > 0 THEN abs(cur - mean) / mean ELSE 1.0 END), 5) AS total_deviation
  FROM hits WHERE way IS NOT NULL GROUP BY ALL""")
def _(t):
    d = an.detect(t("v_metrics"))
    return d.groupBy(
        "org_id", "dataset",
        F.when(F.col("anomaly_type").like("Row%"), "row_count").otherwise("byte_size").alias("measure"),
        F.when(F.col("anomaly_type").like("%Spike"), "up").otherwise("down").alias("way"),
    ).agg(F.count("*").alias("n"), F.round(F.sum("deviation"), 5).alias("total_deviation"))


@query("n5_scope", f"WITH {_SCOPED} SELECT org_id, dataset, scope_kind, scope_value, count(*) AS n FROM scoped GROUP BY ALL")
def _(t):
    return an.with_scope(t("v_metrics")).groupBy("org_id", "dataset", "scope_kind", "scope_value").agg(F.count("*").alias("n"))


@query("n6_percentile_bounds", f"""WITH {_SCOPED}, b AS (SELECT org_id, dataset, scope_kind, scope_value, quantile_cont(row_count, 0.05) AS lo, quantile_cont(row_count, 0.95) AS hi
  FROM scoped WHERE row_count IS NOT NULL GROUP BY ALL)
  SELECT s.org_id, s.dataset, s.job_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, s.row_count, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound
  FROM scoped s JOIN b USING (org_id, dataset, scope_kind, scope_value) WHERE s.row_count < lo OR s.row_count > hi""")
def _(t):
    p = an.percentile_bounds(t("v_metrics"))
    return p.select("org_id", "dataset", "job_id", _ts(), "row_count", F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"))


@query("n7_drop_ratio", f"""WITH {_SCOPED} SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CASE WHEN row_count > mean_row_count + 3 * coalesce(std_row_count, 0) THEN 'RowCountSpike' ELSE 'RowCountDrop' END AS anomaly_type
  FROM stats WHERE hist_count >= 5 AND (row_count > mean_row_count + 3 * coalesce(std_row_count, 0)
    OR row_count < greatest(0, mean_row_count - 3 * coalesce(std_row_count, 0)) OR row_count < mean_row_count * 0.5)""")
def _(t):
    return an.detect_row_count_anomalies(t("v_metrics"), drop_ratio=0.5).select("org_id", "dataset", "job_id", _ts(), "anomaly_type")


@query("n9_comparison", """SELECT anomaly_id, round(actual_value, 6) AS actual_value, round(expected_value, 6) AS expected_value,
  round(CASE WHEN expected_value = 0 THEN 0 ELSE (actual_value - expected_value) / expected_value * 100 END, 4) AS percent_change FROM {v_anomalies}""")
def _(t):
    c = an.comparison(t("v_anomalies"))
    return c.select("anomaly_id", F.round("actual_value", 6).alias("actual_value"), F.round("expected_value", 6).alias("expected_value"), F.round("percent_change", 4).alias("percent_change"))


@query("j10_range_join_history", f"""WITH {_SCOPED} SELECT org_id, dataset, scope_kind, CAST(sum(hist_count) AS BIGINT) AS joined_rows,
  count(*) AS n, round(sum(mean_row_count), 3) AS sum_of_means FROM stats GROUP BY ALL""")
def _(t):
    return an.history_stats_by_join(t("v_metrics")).groupBy("org_id", "dataset", "scope_kind").agg(
        F.sum("hist_count").alias("joined_rows"), F.count("*").alias("n"), F.round(F.sum("mean_row_count"), 3).alias("sum_of_means")
    )


_MSG = f"""WITH {_SCOPED}, {_FOUND}, w AS (SELECT *, CASE scope_kind WHEN 'partition' THEN ' in partition ''' || scope_value || '''' WHEN 'job' THEN ' for job ''' || scope_value || '''' ELSE '' END AS ctx FROM hits WHERE way IS NOT NULL)
SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, measure,
  CASE WHEN measure = 'row_count' THEN 'Row count ' || CASE way WHEN 'up' THEN 'spike' ELSE 'drop' END || ctx || ': ' || CAST(CAST(cur AS BIGINT) AS VARCHAR) || ' (Expected ~' || CAST(CAST(round_even(mean, 0) AS BIGINT) AS VARCHAR) || ', >3.0σ)'
  ELSE 'Volume ' || CASE way WHEN 'up' THEN 'spike' ELSE 'drop' END || ctx || ': ' || (CASE WHEN cur < 1024 THEN printf('%.1fB', cur) WHEN cur < 1048576 THEN printf('%.1fKB', cur / 1024) ELSE printf('%.1fMB', cur / 1048576) END)
    || ' (Expected ~' || (CASE WHEN mean < 1024 THEN printf('%.1fB', mean) WHEN mean < 1048576 THEN printf('%.1fKB', mean / 1024) ELSE printf('%.1fMB', mean / 1048576) END) || ')' END AS message FROM w"""


@query("f18_anomaly_message", _MSG)
def _(t):
    d = an.detect(t("v_metrics"))
    return d.select(
        "org_id", "dataset", "job_id", _ts(), F.when(F.col("anomaly_type").like("Row%"), "row_count").otherwise("byte_size").alias("measure"), "message"
    )


_EVERY = _SCOPED.replace("AND (r.job_id IS NULL OR h.job_id <> r.job_id)", "")


@query("w5_rolling_history", f"""WITH {_EVERY} SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, scope_kind, CAST(hist_count AS BIGINT) AS hist_count,
  round(mean_row_count, 5) AS mean_row_count, round(std_row_count, 5) AS std_row_count FROM stats""")
def _(t):
    s = an.history_stats(t("v_metrics"), measures=("row_count",), exclude_own_job=False)
    return s.select(
        "org_id", "dataset", "job_id", _ts(), "scope_kind", "hist_count", F.round("mean_row_count", 5).alias("mean_row_count"), F.round("std_row_count", 5).alias("std_row_count")
    )
