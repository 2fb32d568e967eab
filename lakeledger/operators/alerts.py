"""What to alert on: rule matching, repeat suppression, outbox."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.functions.naming import alert_subject
from lakeledger.operators.ordered import as_of, carried
from lakeledger.runtime import checkpoint, ship

_SALTS = 32
_GROUP = ["rule_id", "org_id", "dataset", "anomaly_type"]


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled")


def _lookup(name: Column) -> Column:
    """Every (kind, key) under which a rule may name this dataset."""
    prefix = F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.struct(F.lit("prefix").alias("kind"), F.left(name, n).alias("key")))
    fixed = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("exact").alias("kind"), name.alias("key")))
    return F.concat(fixed, prefix)


def match_rules(anomalies: DataFrame, rules: DataFrame, wildcard: bool = True, by_org: bool = True) -> DataFrame:
    """Anomalies with each active rule that applies (R1; R2 with ``wildcard=False``).

    A pattern is nothing or ``*`` for all, ``abc*`` for a prefix, else an exact name. The
    pattern test is an equi-join: distinct dataset names are looked up under their
    prefixes, salted so that rules for all datasets do not meet in one task.
    """
    r = active_rules(rules)
    p = F.coalesce(F.nullif("dataset_pattern", F.lit("")), F.lit("*")) if wildcard else F.col("dataset_pattern")
    if wildcard:
        kind = F.when(p == "*", "all").when(p.endswith("*"), "prefix").otherwise("exact")
        key = F.when(p == "*", "").when(p.endswith("*"), F.left(p, F.length(p) - 1)).otherwise(p)
    else:
        kind = F.when(p.isNull(), "all").otherwise("exact")
        key = F.coalesce(p, F.lit(""))
    keep = [c for c in r.columns if c not in ("org_id", "dataset_pattern", "enabled", "anomaly_type", "severity")]
    salted = r.select(
        *keep, kind.alias("kind"), key.alias("key"),
        F.col("org_id").alias("_rule_org"), F.col("anomaly_type").alias("_rule_type"), F.col("severity").alias("_rule_sev"),
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"),
    )
    names = anomalies.select("org_id", "dataset").distinct()
    names = names.withColumn("salt", F.pmod(F.hash("org_id", "dataset"), F.lit(_SALTS)))
    keyed = names.select("org_id", "dataset", "salt", F.explode(_lookup(F.col("dataset"))).alias("k")).select("org_id", "dataset", "salt", "k.*")
    applies = keyed.join(salted, ["kind", "key", "salt"])
    if by_org:
        applies = applies.filter(F.col("_rule_org").isNull() | (F.col("_rule_org") == F.col("org_id")))
    applies = applies.drop("kind", "key", "salt", "_rule_org")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    type_ok = blank("_rule_type") | blank("anomaly_type") | (F.col("_rule_type") == F.col("anomaly_type"))
    sev_ok = blank("_rule_sev") | (F.col("_rule_sev") == F.col("severity"))
    return anomalies.join(applies, ["org_id", "dataset"]).filter(type_ok & sev_ok).drop("_rule_type", "_rule_sev")


def unmatched_anomalies(anomalies: DataFrame, rules: DataFrame) -> DataFrame:
    """Anomalies no rule applies to."""
    return anomalies.join(match_rules(anomalies, rules).select("anomaly_id"), "anomaly_id", "left_anti")


# --- repeat suppression (R3) -----------------------------------------------------------
#
# Per (rule, dataset, type) a match is SENT unless the last SENT one is less than the
# rule's window old. Each decision rests on earlier ones, but the chain of SENT times is
# sparse: one step per window. The timeline is cut into blocks of many windows. Inside a
# block every possible first SENT leads to a known last SENT, and only the times within
# one window of the block's start (and the first after it) can be first. So blocks are
# solved side by side, the true first of each block is found among the possible ones by
# pointer doubling, and the blocks then mark their chain. No task holds a whole group.

_WINDOWS_PER_BLOCK = 48


def _whole_blocks(batches):
    """Re-cut a stream sorted by (grp, blk, t) so that no block is split between frames."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = (pdf["grp"] == pdf["grp"].iloc[-1]) & (pdf["blk"] == pdf["blk"].iloc[-1])
        cut = int(np.argmax(last.to_numpy()))
        if held and (cut or (held[-1]["grp"].iloc[-1], held[-1]["blk"].iloc[-1]) != (pdf["grp"].iloc[0], pdf["blk"].iloc[0])):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


class _Frame:
    """Blocks of one frame on a common axis: times count from their block's start."""

    def __init__(self, pdf: pd.DataFrame):
        new = (pdf["grp"] != pdf["grp"].shift()) | (pdf["blk"] != pdf["blk"].shift())
        self.block = (new.cumsum() - 1).to_numpy()
        self.firsts = np.flatnonzero(new.to_numpy())
        self.w = pdf["w"].to_numpy()
        self.start = pdf["blk"].to_numpy() * self.w * _WINDOWS_PER_BLOCK
        self.span = int(self.w.max()) * (_WINDOWS_PER_BLOCK + 2)
        self.axis = self.block * self.span + (pdf["t"].to_numpy() - self.start)
        n = len(pdf)
        nxt = np.maximum(np.searchsorted(self.axis, self.axis + self.w), np.arange(n) + 1)
        inside = np.append(self.block, -1)[nxt] == self.block
        self.next = np.where(inside, nxt, np.arange(n))


def _block_exits(batches):
    """Times that may be their block's first SENT, each with the last SENT it leads to."""
    for pdf in _whole_blocks(batches):
        f = _Frame(pdf)
        last = np.arange(len(pdf))
        while (f.next[last] != last).any():
            last = f.next[last]
        early = pdf["t"].to_numpy() < f.start + f.w
        after = np.searchsorted(f.axis, f.block[f.firsts] * f.span + f.w[f.firsts])
        after = after[(after < len(pdf)) & (np.append(f.block, -1)[after] == f.block[f.firsts])]
        early[after] = True
        out = pdf.loc[early, ["grp", "w", "blk", "t"]]
        yield out.assign(last_t=pdf["t"].to_numpy()[last][early])


def _true_firsts(exits: DataFrame) -> DataFrame:
    """The first SENT of every block: (grp, blk, entry).

    After the last SENT that one possible first leads to comes the earliest possible first at
    least a window later. So the possible firsts form chains; the one that begins at a group's
    earliest time is marked by doubling the steps, with joins on single times only.
    """
    at = lambda c: F.timestamp_micros(c)
    facts = exits.select("grp", at(F.col("t")).alias("ts"), F.lit(1).alias("side"), F.col("t").alias("to"), F.lit(None).cast("bigint").alias("t"))
    asks = exits.select("grp", at(F.col("last_t") + F.col("w")).alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("to"), "t")
    found = carried(facts.unionByName(asks), ["grp"], "ts", ["side"], "to", "next", forward=True)
    steps = checkpoint(found.filter("side = 0 AND next IS NOT NULL").select("grp", "t", "next"))
    marked = checkpoint(exits.groupBy("grp").agg(F.min("t").alias("t")))
    while not steps.isEmpty():
        reached = marked.join(steps, ["grp", "t"]).select("grp", F.col("next").alias("t"))
        marked = checkpoint(marked.unionByName(reached).distinct())
        then = steps.select("grp", F.col("t").alias("next"), F.col("next").alias("_then"))
        steps = checkpoint(steps.join(then, ["grp", "next"]).select("grp", "t", F.col("_then").alias("next")))
    return marked.join(exits, ["grp", "t"]).select("grp", "blk", F.col("t").alias("entry"))


def _mark_chain(batches):
    """The SENT rows of every block, from its first."""
    for pdf in _whole_blocks(batches):
        f = _Frame(pdf)
        keep = np.zeros(len(pdf), dtype=bool)
        cur = np.flatnonzero((pdf["t"] == pdf["entry"]).to_numpy())
        while len(cur):
            keep[cur] = True
            step = f.next[cur]
            cur = step[step != cur]
        yield pdf.loc[keep, ["rule_id", "first_id"]]


def dedup_alerts(matches: DataFrame) -> DataFrame:
    """Add ``status``: SENT or DEDUPLICATED (R3). DEDUPLICATED rows do not extend the window."""
    matches = matches.drop("status")
    types = dict(matches.dtypes)
    minutes = F.coalesce("deduplication_minutes", F.lit(60)).cast("bigint")
    m = matches.select("rule_id", "anomaly_id", F.unix_micros("detected_at").alias("t"), (minutes * 60_000_000).alias("w"), F.to_json(F.struct(*_GROUP)).alias("grp"))
    m = m.filter("w > 0").withColumn("blk", F.floor(F.col("t") / (F.col("w") * _WINDOWS_PER_BLOCK)).cast("bigint"))
    times = checkpoint(m.groupBy("grp", "rule_id", "w", "blk", "t").agg(F.min("anomaly_id").alias("first_id")))

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "t")

    exits = by_block(times.select("grp", "w", "blk", "t")).mapInPandas(_block_exits, "grp string, w bigint, blk bigint, t bigint, last_t bigint")
    chain = by_block(times.join(_true_firsts(checkpoint(exits)), ["grp", "blk"]))
    sent = chain.mapInPandas(_mark_chain, f"rule_id {types['rule_id']}, first_id {types['anomaly_id']}")
    sent = sent.withColumnsRenamed({"first_id": "anomaly_id"}).withColumn("_sent", F.lit(True))
    out = matches.join(sent, ["rule_id", "anomaly_id"], "left")
    is_sent = F.col("_sent").isNotNull() | (minutes <= 0)
    return out.withColumn("status", F.when(is_sent, "SENT").otherwise("DEDUPLICATED")).drop("_sent")


def recent_sent(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Matches that already have a SENT alert of the same rule, dataset and type in their window.

    ``history``: rule_id, dataset, anomaly_type, sent_at, status. The latest SENT at or before
    a match is found by an as-of lookup, not by a range join.
    """
    h = history.filter("status = 'SENT'").select("rule_id", "dataset", "anomaly_type", "sent_at", F.col("sent_at").alias("last_sent"))
    m = as_of(matches, h, ["rule_id", "dataset", "anomaly_type"], "detected_at", "sent_at", "last_sent")
    age = F.unix_micros("detected_at") - F.unix_micros("last_sent")
    return m.filter(age < F.coalesce("deduplication_minutes", F.lit(60)) * F.lit(60_000_000).cast("bigint"))


def alert_outbox(decided: DataFrame, downstream_counts: DataFrame | None = None) -> DataFrame:
    """Rows to deliver or to log: PENDING for what is to be sent, else DEDUPLICATED."""
    status = F.when(F.col("status") == "SENT", "PENDING").otherwise(F.col("status"))
    out = decided.select(
        "rule_id", "anomaly_id", "org_id", "dataset", "anomaly_type", "severity", "channel_type",
        alert_subject(F.col("subject_template"), F.col("dataset"), F.col("anomaly_type"), F.col("severity")).alias("subject"),
        status.alias("status"),
    )
    if downstream_counts is None:
        return out
    d = downstream_counts.select("org_id", F.col("source").alias("dataset"), "downstream_count")
    return out.join(d, ["org_id", "dataset"], "left").na.fill(0, ["downstream_count"])


def apply_alert_status(anomalies: DataFrame, history: DataFrame) -> DataFrame:
    """OPEN anomalies become ALERTED once an alert for them was SENT."""
    sent = history.filter("status = 'SENT'").select("anomaly_id").distinct().withColumn("_sent", F.lit(True))
    a = anomalies.join(sent, "anomaly_id", "left")
    new = F.when((F.col("status") == "OPEN") & F.col("_sent"), "ALERTED").otherwise(F.col("status"))
    return a.withColumn("status", new).drop("_sent")


ship(__name__)
