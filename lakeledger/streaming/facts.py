"""Streams that keep fact tables: ingest, schema versions, anomalies, alerts.

Every micro-batch writes to a folder named after its id and overwrites that folder if it is
run again, so a batch retried after a failure leaves no double rows. Tables that hold the
latest row per key keep the changes and settle them when read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lakeledger.functions.schema_text import schema_hash
from lakeledger.operators import tables as tb
from lakeledger.operators.alerts import dedup_alerts, match_rules
from lakeledger.operators.anomalies import history_stats, judge
from lakeledger.operators.ordered import join_null_safe
from lakeledger.operators.schema_history import scd2_intervals
from lakeledger.sources.payloads import parse_ingest, parse_schema_ingest


def _write(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")


def _per_batch(stream: DataFrame, root: str, name: str, fn: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{root}/_progress/{name}")


def run_available(writer: DataStreamWriter) -> None:
    """Work off what is there, then stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def stream_ingest(raw: DataFrame, root: str) -> DataStreamWriter:
    """Messages (org_id, received_at, value) to fact tables under ``root``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = parse_ingest(batch)
        good = good.persist()
        for table, rows in tb.explode_payload(good).items():
            _write(rows, root, table, batch_id)
        _write(bad, root, "unreadable", batch_id)
        good.unpersist()
        batch.unpersist()

    return _per_batch(raw, root, "ingest", step)


def read_facts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The fact tables a ``stream_ingest`` keeps, latest rows settled."""
    t = {n: spark.read.parquet(f"{root}/{n}").drop("batch") for n in ("datasets", "edges", "column_edges", "jobs", "metrics", "anomalies")}
    none = t["datasets"].limit(0).select(
        "org_id", "name", "dataset_type", "location", F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at")
    )
    return {
        **t,
        "datasets": tb.upsert_datasets(none, t["datasets"]),
        "edges": tb.upsert_edges(None, t["edges"]),
        "column_edges": tb.upsert_column_edges(None, t["column_edges"]),
        "jobs": tb.latest_jobs(None, t["jobs"]),
    }


#: Hashed parts of a stream's state; a batch reads back only the parts its keys fall into.
PARTS = 256


def _part(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


def _log_state(rows: DataFrame, root: str, table: str, batch_id: int, keys: list[str]) -> None:
    """Add what a batch changed to a state log; nothing older is written again."""
    ordered = rows.withColumn("part", _part(*keys)).repartitionByRange("part").sortWithinPartitions("part")
    ordered.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")  # files and row groups hold a range of parts


def _known(batch: DataFrame, root: str, table: str, batch_id: int, keys: list[str]) -> DataFrame | None:
    """State rows of earlier batches for the keys of this one, None at the start."""
    if batch_id == 0:
        return None
    touched = [r[0] for r in batch.select(_part(*keys).alias("part")).distinct().collect()]  # at most PARTS numbers
    log = batch.sparkSession.read.parquet(f"{root}/{table}").filter((F.col("batch") < batch_id) & F.col("part").isin(touched))
    return join_null_safe(log.drop("batch", "part"), batch.select(*keys).distinct(), keys, "left_semi")


_VERSION = ["org_id", "dataset", "schema_hash"]


def stream_schema_versions(raw: DataFrame, root: str) -> DataStreamWriter:
    """Schema messages to a log of versions: each schema when first seen, or seen earlier than known.

    The log grows with schema changes, not with messages; ``read_versions`` gives the table.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        snaps, _ = parse_schema_ingest(batch)
        snaps = snaps.withColumn("schema_hash", schema_hash(F.col("fields")))
        first = snaps.groupBy(*_VERSION).agg(F.min("captured_at").alias("valid_from"), F.min_by("fields", "captured_at").alias("fields")).persist()
        known = _known(first, root, "versions", batch_id, _VERSION)
        if known is not None:
            old = known.groupBy(*_VERSION).agg(F.min("valid_from").alias("_seen"))
            changed = join_null_safe(first, old, _VERSION).filter("_seen IS NULL OR valid_from < _seen").drop("_seen")
        else:
            changed = first
        _log_state(changed, root, "versions", batch_id, _VERSION)
        first.unpersist()

    return _per_batch(raw, root, "schema_versions", step)


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """The version table that a ``stream_schema_versions`` keeps: org_id, dataset, schema_hash, fields, valid_from, valid_to."""
    log = spark.read.parquet(f"{root}/versions").drop("batch", "part")
    first = log.groupBy(*_VERSION).agg(F.min("valid_from").alias("valid_from"), F.min_by("fields", "valid_from").alias("fields"))
    return scd2_intervals(first)


def stream_anomalies(metrics: DataFrame, root: str, days: int = 30, sigma: float = 3.0, min_points: int = 5) -> DataStreamWriter:
    """Judge each load as it arrives against the loads stored so far (T5).

    Metrics are stored by month; a batch reads back only the months its history spans. Loads that
    come in time order get the verdict the batch operator gives.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("month", F.trunc("ts", "month")).persist()
        first, last, month = batch.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts")), F.max("month")).first()
        if first is not None:
            spread = batch.repartition("month", F.pmod(F.hash("org_id", "dataset", "job_id"), F.lit(32)))
            spread.write.mode("overwrite").partitionBy("month").parquet(f"{root}/loads/batch={batch_id}")
            known = batch.drop("month").withColumn("_new", F.lit(True))
            if batch_id > 0:
                past = spark.read.parquet(f"{root}/loads").filter((F.col("batch") < batch_id) & (F.col("month") <= F.lit(month)))
                oldest = F.date_sub(F.lit(first), days + 1)
                past = past.join(batch.select("org_id", "dataset").distinct(), ["org_id", "dataset"], "left_semi")
                past = past.filter((F.col("month") >= F.trunc(oldest, "month")) & (F.to_date("ts") >= oldest) & (F.to_date("ts") <= F.lit(last)))
                known = known.unionByName(past.drop("month", "batch").withColumn("_new", F.lit(False)))
            new = history_stats(known, days).filter("_new").drop("_new")
            _write(judge(new, sigma=sigma, min_points=min_points), root, "anomalies", batch_id)
        batch.unpersist()

    return _per_batch(metrics, root, "anomalies", step)


def stream_match_rules(anomalies: DataFrame, read_rules: Callable[[], DataFrame], root: str) -> DataStreamWriter:
    """Match arriving anomalies with the rules as they stand at that batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _write(match_rules(batch, read_rules()), root, "matches", batch_id)

    return _per_batch(anomalies, root, "matches", step)


def stream_dedup(matches: DataFrame, root: str) -> DataStreamWriter:
    """SENT or DEDUPLICATED for arriving matches; the last SENT times per group are the state.

    The state enters the batch as the group's first match, so the batch operator carries on
    where the last batch ended. What is older than the last SENT came too late to be judged: LATE.
    """
    group = ["rule_id", "org_id", "dataset", "anomaly_type"]

    def step(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c != "status"]
        batch = batch.select(*cols)
        state = _known(batch, root, "last_sent", batch_id, group)
        if state is None:
            state = batch.select(*group, F.col("detected_at").alias("last_sent"), "deduplication_minutes").limit(0)
        state = state.groupBy(*group).agg(F.max("last_sent").alias("last_sent"), F.max("deduplication_minutes").alias("deduplication_minutes"))
        seen = join_null_safe(batch, state.select(*group, "last_sent"), group)
        late = seen.filter("detected_at < last_sent").select(*cols, F.lit("LATE").alias("status"))
        same = seen.filter("detected_at = last_sent").select(*cols, F.lit("DEDUPLICATED").alias("status"))
        fresh = seen.filter("last_sent IS NULL OR detected_at > last_sent").select(*cols, F.lit(False).alias("_seed"))
        # the last SENT of each group goes in as its first match, marked so that it can be told apart
        seeds = state.select(*group, F.col("last_sent").alias("detected_at"), "deduplication_minutes", F.lit(True).alias("_seed"))
        both = fresh.withColumn("_id", F.struct(F.lit(False).alias("s"), F.col("anomaly_id").cast("string").alias("i"), F.lit(None).cast("string").alias("g")))
        own = F.struct(F.lit(True).alias("s"), F.lit(None).cast("string").alias("i"), F.to_json(F.struct(*group)).alias("g"))
        both = both.unionByName(seeds.withColumn("_id", own), allowMissingColumns=True)
        judged = dedup_alerts(both.withColumnsRenamed({"anomaly_id": "_given"}).withColumnRenamed("_id", "anomaly_id"))
        judged = judged.filter("NOT _seed").drop("_seed", "anomaly_id").withColumnRenamed("_given", "anomaly_id")
        decided = judged.select(*cols, "status").unionByName(same).unionByName(late).persist()
        _write(decided, root, "alerts", batch_id)
        sent = decided.filter("status = 'SENT'").groupBy(*group).agg(F.max("detected_at").alias("last_sent"), F.max("deduplication_minutes").alias("deduplication_minutes"))
        _log_state(sent, root, "last_sent", batch_id, group)
        decided.unpersist()

    return _per_batch(matches, root, "dedup", step)
