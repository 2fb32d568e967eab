"""Named queries over the given tables, each with its check in plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeledger.plans.inputs import VIEWS
from lakeledger.runtime import scratch
from lakeledger.sources.eventlog import stage_event_log

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STAGED: dict[tuple[str, str, frozenset[str]], str] = {}
# views of long messages, and the key by which the rows of a table are dealt out, if a join on it follows
_TEXT_VIEWS = {VIEWS["v_payload_json"]: {"orders": []}, VIEWS["v_schema_payload_json"]: {"orders": []}, VIEWS["v_event_lines"]: {"customer": [], "orders": []}, VIEWS["v_task_lines"]: {"lineitem": ["l_orderkey"]}}
#: Rows of a table whose messages one task makes.
MESSAGES = 50_000
_REF = re.compile(r"\{(\w+)\}")


class Tables:
    """The given tables and the fact views derived from them, for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir, self._seen = spark, sf_dir.rstrip("/"), {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._seen[name] = self.sql(VIEWS[name])
        return self._seen[name]

    def staged_log(self, *kinds: str) -> DataFrame:
        """The derived event log, split by event once per session and folder.

        All lines are read; a query that asks for events of some ``kinds`` only keeps no others.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, frozenset(kinds))
        whole = (*key[:2], frozenset())
        if whole not in _STAGED and key not in _STAGED:
            path = scratch(self.spark, "event-log")
            stage_event_log(self("v_event_lines"), path, kinds)
            _STAGED[key] = path
        return self.spark.read.parquet(_STAGED[whole if whole in _STAGED else key])

    def sql(self, text: str) -> DataFrame:
        deps = {d: self(d) for d in sorted(set(_REF.findall(text)))}
        for d, key in _TEXT_VIEWS.get(text, {}).items():
            deps[d] = dealt(deps[d], *key)
        return self.spark.sql(text, **deps)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows in equal parts by their number: a message is many times the row it is made from, so bytes tell little.

    With a ``key`` they are dealt out by it, as a join on that key asks, which then needs no shuffle of its own.
    """
    return df.repartition(1 + df.count() // MESSAGES, *key)


def duck_sql(text: str) -> str:
    """``text`` with ``{view}`` references resolved to a WITH prefix."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for d in _REF.findall(sql):
            if d in BASE or d in order:
                continue
            visit(VIEWS[d])
            order.append(d)

    visit(text)
    body = _REF.sub(r"\1", text).strip()
    if not order:
        return body
    parts = [f"{v} AS ({_REF.sub(r'\1', VIEWS[v]).strip()})" for v in order]
    lead = "WITH RECURSIVE " if re.match(r"(?is)^with\s+recursive", body) else "WITH "
    rest = re.sub(r"(?is)^with\s+(recursive\s+)?", ", ", body, count=1)
    return lead + ", ".join(parts) + (" " if rest.startswith(", ") else "\n") + rest


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, where one exists, its SQL twin."""

    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck_sql(sql)
        return fn

    return deco
