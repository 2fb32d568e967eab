"""Spark event logs as tables: applications, jobs, stages, tasks, SQL executions.

Logs may be rolled into several files and compressed with zstd, as Spark does by default, or with
a codec Hadoop reads. Raise ``spark.sql.maxPlanStringLength`` and ``spark.sql.debug.maxToStringFields`` in the
watched applications so that plan texts are whole.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import or_

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.functions.units import parse_memory_mb
from lakeledger.runtime import ship

_SQL = "org.apache.spark.sql.execution.ui."
# Event names.
EVENTS = {
    "app_start": "SparkListenerApplicationStart",
    "app_end": "SparkListenerApplicationEnd",
    "environment": "SparkListenerEnvironmentUpdate",
    "job_start": "SparkListenerJobStart",
    "job_end": "SparkListenerJobEnd",
    "stage": "SparkListenerStageCompleted",
    "task": "SparkListenerTaskEnd",
    "sql_start": _SQL + "SparkListenerSQLExecutionStart",
    "sql_end": _SQL + "SparkListenerSQLExecutionEnd",
    "accums": _SQL + "SparkListenerDriverAccumUpdates",
    "replans": _SQL + "SparkListenerSQLAdaptiveExecutionUpdate",
}
# Counter name -> place in a task's metrics.
TASK_COUNTERS = {
    "rows_read": "`Input Metrics`.`Records Read`",
    "bytes_read": "`Input Metrics`.`Bytes Read`",
    "rows_written": "`Output Metrics`.`Records Written`",
    "bytes_written": "`Output Metrics`.`Bytes Written`",
    "execution_time_ms": "`Executor Run Time`",
    "executor_cpu_time_ns": "`Executor CPU Time`",
    "jvm_gc_time_ms": "`JVM GC Time`",
    "executor_deserialize_time_ms": "`Executor Deserialize Time`",
    "executor_deserialize_cpu_time_ns": "`Executor Deserialize CPU Time`",
    "result_serialization_time_ms": "`Result Serialization Time`",
    "result_size_bytes": "`Result Size`",
    "memory_bytes_spilled": "`Memory Bytes Spilled`",
    "disk_bytes_spilled": "`Disk Bytes Spilled`",
    "peak_execution_memory": "`Peak Execution Memory`",
    "shuffle_remote_bytes_read": "`Shuffle Read Metrics`.`Remote Bytes Read`",
    "shuffle_local_bytes_read": "`Shuffle Read Metrics`.`Local Bytes Read`",
    "shuffle_remote_bytes_read_to_disk": "`Shuffle Read Metrics`.`Remote Bytes Read To Disk`",
    "shuffle_fetch_wait_time_ms": "`Shuffle Read Metrics`.`Fetch Wait Time`",
    "shuffle_records_read": "`Shuffle Read Metrics`.`Total Records Read`",
    "shuffle_remote_blocks_fetched": "`Shuffle Read Metrics`.`Remote Blocks Fetched`",
    "shuffle_local_blocks_fetched": "`Shuffle Read Metrics`.`Local Blocks Fetched`",
    "shuffle_write_bytes": "`Shuffle Write Metrics`.`Shuffle Bytes Written`",
    "shuffle_write_time_ns": "`Shuffle Write Metrics`.`Shuffle Write Time`",
    "shuffle_records_written": "`Shuffle Write Metrics`.`Shuffle Records Written`",
}


def _ddl(paths: list[str]) -> str:
    """A struct type with a bigint at each dotted path."""
    tree: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        tree.setdefault(head, []).extend([rest] if rest else [])
    return "struct<" + ",".join(f"{h}:{_ddl(sub) if sub else 'bigint'}" for h, sub in tree.items()) + ">"


#: Levels of a plan's tree below its top that are searched for commands.
LEVELS = 4


def _plan_info(levels: int) -> str:
    """Type of a plan's tree down to a level; commands stand on top or close to it."""
    below = f",children:array<{_plan_info(levels - 1)}>" if levels else ""
    return f"struct<nodeName:string,metrics:array<struct<name:string,accumulatorId:bigint,metricType:string>>{below}>"


def _commands(info: Column, levels: int = LEVELS) -> Column:
    """Name and metrics of the commands in a plan, siblings in their order."""
    plain = lambda n: F.struct(n["nodeName"].alias("name"), n["metrics"].alias("metrics"))
    level, found = F.array(info), []
    for k in range(levels + 1):
        found.append(F.transform(level, plain))
        if k < levels:
            level = F.flatten(F.transform(level, lambda n: F.coalesce(n["children"], F.from_json(F.lit("[]"), f"array<{_plan_info(levels - k - 1)}>"))))  # noqa: B023
    return F.filter(F.concat(*found), lambda n: n["name"].startswith("Execute ") | n["name"].rlike("^(?:AppendData|Overwrite|Replace|Atomic|CreateTableAs)"))


SCHEMAS = {
    "app_start": "`App Name` string, `App ID` string, Timestamp bigint, User string",
    "app_end": "Timestamp bigint",
    "environment": "`Spark Properties` map<string,string>",
    "job_start": "`Job ID` bigint, `Submission Time` bigint, `Stage IDs` array<bigint>, Properties map<string,string>",
    "job_end": "`Job ID` bigint, `Completion Time` bigint, `Job Result` struct<Result:string,Exception:struct<Message:string>>",
    "stage": "`Stage Info` struct<`Stage ID`:bigint,`Stage Attempt ID`:bigint,`Stage Name`:string,`Number of Tasks`:bigint,"
    "`Submission Time`:bigint,`Completion Time`:bigint,`Failure Reason`:string>",
    "task": "`Stage ID` bigint, `Stage Attempt ID` bigint, `Task Info` struct<`Task ID`:bigint,`Executor ID`:string,Locality:string,"
    "Failed:boolean,`Launch Time`:bigint,`Finish Time`:bigint>, `Task Metrics` " + _ddl(list(TASK_COUNTERS.values())),
    "sql_start": "executionId bigint, rootExecutionId bigint, description string, physicalPlanDescription string, time bigint, sparkPlanInfo " + _plan_info(LEVELS),
    "sql_end": "executionId bigint, time bigint, errorMessage string",
    "accums": "executionId bigint, accumUpdates array<array<bigint>>",
    "replans": "executionId bigint, sparkPlanInfo " + _plan_info(LEVELS),
}


def log_of(path: Column) -> Column:
    """The log a file belongs to: the folder of a rolled log, else the file itself."""
    folder = F.regexp_extract(path, r"^(.*/eventlog_v2_[^/]+)/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(path)


def _unpacked(batches):
    """Lines of zstd files; one that is still being written ends where it breaks off."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            held, rows = b"", []
            reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
            while chunk := reader.read(1 << 22):
                *lines, held = (held + chunk).split(b"\n")
                rows = [x.decode() for x in lines if x]
                if rows:
                    yield pd.DataFrame({"path": [path] * len(rows), "value": rows})
            if held:
                yield pd.DataFrame({"path": [path], "value": [held.decode()]})


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their log as ``log_id``; the files of a rolled log are one."""
    file = F.col("_metadata.file_path")
    plain = spark.read.text(path, recursiveFileLookup=True).filter(~file.rlike(r"\.zstd$|/appstatus_[^/]*$")).select(log_of(file).alias("log_id"), "value")
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zstd").load(path)
    lines = packed.select("path", "content").mapInPandas(_unpacked, "path string, value string")
    return plain.unionByName(lines.select(log_of(F.col("path")).alias("log_id"), "value"))


# Fixed value: how many files of a partitioned write a task may hold open; beyond that it sorts its rows.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def stage_event_log(lines: DataFrame, path: str, kinds: Collection[str] = ()) -> DataFrame:
    """Split the lines by event in one pass, so that each table then reads only its own; events of some ``kinds`` if any are named.

    Without this every table scans all lines; worth it for logs beyond a few files. A task holds a file of each
    event open, so it sorts no lines.
    """
    spark = lines.sparkSession
    event = F.get_json_object("value", "$.Event")
    if kinds:
        # a line that neither spells the name of an event nor escapes letters is sooner missed than read
        spelt = [F.col("value").contains(x) for x in (*(EVENTS[k] for k in kinds), "\\u")]
        event = F.when(reduce(or_, spelt), event)
    # inline makes and reads each line once; a filter on a plain column would do both again
    read = F.inline(F.array(F.struct("value", event.alias("event"))))
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, len(EVENTS))
    try:
        lines.select("log_id", read).filter(F.col("event").isin(*(EVENTS[k] for k in kinds or EVENTS))).write.partitionBy("event").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)
    return spark.read.parquet(path)


def _ms(c: str | Column) -> Column:
    return F.timestamp_millis(F.col(c) if isinstance(c, str) else c)


def events(lines: DataFrame, kind: str, fields: str | None = None) -> DataFrame:
    """Parsed events of one kind: log_id and the event's fields, or those of ``fields``."""
    event = F.col("event") if "event" in lines.columns else F.get_json_object("value", "$.Event")
    # inline reads each line once; plain field access would parse it again for every field
    return lines.filter(event == EVENTS[kind]).select("log_id", F.inline(F.array(F.from_json("value", fields or SCHEMAS[kind]))))


#: Events, with texts of some kilobytes each, that one task sorts.
DEALT = 20_000


class EventTables(dict):
    """Application, job, stage, task and SQL tables of any number of logs, each made when asked for."""

    def __init__(self, lines: DataFrame):
        super().__init__()
        self.lines = lines

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(self, f"_{name}")()
        return self[name]

    def partitions(self, kind: str) -> int:
        """In how many parts to deal out the events of a kind; staged lines are counted off their files' footers."""
        event = F.col("event") if "event" in self.lines.columns else F.get_json_object("value", "$.Event")
        return 1 + self.lines.filter(event == EVENTS[kind]).count() // DEALT

    def _apps(self) -> DataFrame:
        start = events(self.lines, "app_start").select("log_id", F.col("App ID").alias("app_id"), F.col("App Name").alias("app_name"), _ms("Timestamp").alias("started_at"))
        return start.join(events(self.lines, "app_end").select("log_id", _ms("Timestamp").alias("ended_at")), "log_id", "left")

    def _environment(self) -> DataFrame:
        conf = lambda k: F.col("Spark Properties")[k]
        return events(self.lines, "environment").select(
            "log_id",
            parse_memory_mb(F.coalesce(conf("spark.executor.memory"), F.lit("1g"))).alias("executor_memory_mb"),
            F.coalesce(conf("spark.executor.cores"), F.lit("1")).cast("int").alias("executor_cores"),
        )

    def _jobs(self) -> DataFrame:
        props = lambda k: F.col("Properties")[k]
        return events(self.lines, "job_start").select(
            "log_id", F.col("Job ID").alias("job_id"), _ms("Submission Time").alias("started_at"), F.col("Stage IDs").alias("stage_ids"),
            props("spark.lakeledger.job.name").alias("custom_name"), props("spark.job.description").alias("description"),
            props("callSite.short").alias("call_site"), props("spark.app.name").alias("app_name"), props("spark.app.id").alias("app_id"),
            props("spark.sql.execution.id").try_cast("bigint").alias("execution_id"),
            props("spark.sql.execution.root.id").try_cast("bigint").alias("root_execution_id"),
        )

    def _job_ends(self) -> DataFrame:
        return events(self.lines, "job_end").select(
            "log_id", F.col("Job ID").alias("job_id"), _ms("Completion Time").alias("ended_at"), F.col("Job Result.Result").alias("result"),
            F.col("Job Result.Exception.Message").alias("error"),
        )

    def _stages(self) -> DataFrame:
        return events(self.lines, "stage").select(
            "log_id", F.col("Stage Info.Stage ID").alias("stage_id"), F.col("Stage Info.Stage Attempt ID").alias("stage_attempt_id"),
            F.col("Stage Info.Stage Name").alias("stage_name"), F.col("Stage Info.Number of Tasks").alias("num_tasks"),
            _ms(F.col("Stage Info.Submission Time")).alias("started_at"), _ms(F.col("Stage Info.Completion Time")).alias("ended_at"),
            F.col("Stage Info.Failure Reason").alias("failure_reason"),
        )

    def _tasks(self) -> DataFrame:
        return events(self.lines, "task").select(
            "log_id", F.col("Stage ID").alias("stage_id"), F.col("Stage Attempt ID").alias("stage_attempt_id"),
            F.col("Task Info.Task ID").alias("task_id"), F.col("Task Info.Executor ID").alias("executor_id"),
            F.col("Task Info.Locality").alias("locality"), F.coalesce("Task Info.Failed", F.lit(False)).alias("failed"),
            F.col("Task Metrics").isNotNull().alias("has_metrics"), *[F.expr(f"`Task Metrics`.{p}").alias(c) for c, p in TASK_COUNTERS.items()],
        )

    def _sql(self) -> DataFrame:
        return events(self.lines, "sql_start").select(
            "log_id", F.col("executionId").alias("execution_id"), F.coalesce("rootExecutionId", "executionId").alias("root_execution_id"),
            "description", F.col("physicalPlanDescription").alias("plan_text"), _ms("time").alias("started_at"),
            _commands(F.col("sparkPlanInfo")).alias("commands"),
        )

    def _plans(self) -> DataFrame:
        # the tree of a plan is as long as its text; nothing is made of it here
        start = events(self.lines, "sql_start", SCHEMAS["sql_start"].partition(", sparkPlanInfo ")[0])
        return start.select(
            "log_id", F.col("executionId").alias("execution_id"), F.coalesce("rootExecutionId", "executionId").alias("root_execution_id"),
            "description", F.col("physicalPlanDescription").alias("plan_text"), _ms("time").alias("started_at"),
        )

    def _sql_end(self) -> DataFrame:
        return events(self.lines, "sql_end").select(
            "log_id", F.col("executionId").alias("execution_id"), _ms("time").alias("ended_at"), F.nullif("errorMessage", F.lit("")).alias("error")
        )

    def _replans(self) -> DataFrame:
        return events(self.lines, "replans").select("log_id", F.col("executionId").alias("execution_id"), _commands(F.col("sparkPlanInfo")).alias("commands"))

    def _accums(self) -> DataFrame:
        update = events(self.lines, "accums").select("log_id", F.col("executionId").alias("execution_id"), F.explode("accumUpdates").alias("u"))
        return update.select("log_id", "execution_id", F.try_element_at("u", F.lit(1)).alias("accumulator_id"), F.try_element_at("u", F.lit(2)).alias("value"))


def event_tables(lines: DataFrame) -> EventTables:
    """Tables ``apps environment jobs job_ends stages tasks sql plans sql_end replans accums`` of the logs' lines.

    ``sql`` holds the commands of a plan with their metrics, ``plans`` is ``sql`` without them, ``replans`` those of plans changed while they
    run, ``accums`` the values of the metrics.
    """
    return EventTables(lines)


ship(__name__)
