"""Schema snapshots, versions over time, and lookups in them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.functions.schema_text import FIELDS, schema_hash
from lakeledger.operators.ordered import as_of, carried, join_null_safe, neighbours, running_sums
from lakeledger.operators.tables import latest_per_key
from lakeledger.runtime import checkpoint, ship

_KEY = ["org_id", "dataset"]


def snapshots_from_fields(fields: DataFrame) -> DataFrame:
    """One row per snapshot out of one row per field (pos, name, type, nullable)."""
    f = F.struct("pos", "name", "type", "nullable")
    g = fields.groupBy("org_id", "dataset", "captured_at").agg(F.array_sort(F.collect_list(f)).alias("_f"))
    plain = F.transform("_f", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable")))
    return g.select("org_id", "dataset", "captured_at", plain.alias("fields"))


def snapshot_log(*origins: DataFrame) -> DataFrame:
    """Snapshots of several origins (messages, event logs, data) as one log.

    Where two origins saw one dataset at the same moment the earlier argument wins; of several
    schemas that one origin gives for it, the one of the greatest hash.
    """
    cols = ["org_id", "dataset", "captured_at", "fields"]
    every = [o.select(*cols, F.lit(-i).alias("_rank")) for i, o in enumerate(origins)]
    log = reduce(DataFrame.unionByName, every).withColumn("schema_hash", schema_hash(F.col("fields")))
    return latest_per_key(log, ["org_id", "dataset", "captured_at"], ["_rank", "schema_hash"]).drop("_rank")


def with_schema_hash(snapshots: DataFrame) -> DataFrame:
    """Add the hash, the previous hash and whether the schema changed."""
    s = snapshots.withColumn("schema_hash", schema_hash(F.col("fields")))
    s = carried(s, _KEY, "captured_at", ["schema_hash"], "schema_hash", "previous_hash")
    return s.withColumn("changed", F.coalesce(F.col("previous_hash") != F.col("schema_hash"), F.lit(True)))


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before, with the fields of that one."""
    s = snapshots.withColumn("schema_hash", schema_hash(F.col("fields"))).withColumn("_s", F.struct("schema_hash", "fields"))
    s = carried(s, _KEY, "captured_at", ["schema_hash"], "_s", "_p")
    s = s.withColumns({"previous_hash": F.col("_p.schema_hash"), "previous_fields": F.col("_p.fields")}).drop("_s", "_p")
    return s.filter("previous_hash IS NULL OR previous_hash <> schema_hash")


def with_version_no(snapshots: DataFrame) -> DataFrame:
    """Number each run of equal schemas per dataset."""
    s = with_schema_hash(snapshots).withColumn("version_no", F.col("changed").cast("bigint"))
    return running_sums(s, _KEY, "captured_at", ["schema_hash"], ["version_no"])


def scd2_intervals(versions: DataFrame) -> DataFrame:
    """Add ``valid_to``: the next version's ``valid_from``."""
    v = versions.withColumn("_from", F.col("valid_from"))
    return carried(v, _KEY, "valid_from", ["schema_hash"], "_from", "valid_to", forward=True).drop("_from")


def build_schema_versions(snapshots: DataFrame, reopen: bool = False) -> DataFrame:
    """Versions with validity and the fields of the version before.

    By default a schema opens a version only the first time a dataset shows it, so
    A, B, A leaves B current (B2). ``reopen=True`` opens one at every change.
    """
    if reopen:
        first = with_previous(snapshots).select(*_KEY, F.col("captured_at").alias("valid_from"), "schema_hash", "fields")
    else:
        s = snapshots.withColumn("schema_hash", schema_hash(F.col("fields")))
        first = s.groupBy(*_KEY, "schema_hash").agg(F.min("captured_at").alias("valid_from"), F.min_by("fields", "captured_at").alias("fields"))
    v = first.withColumn("_s", F.struct("schema_hash", "fields", "valid_from"))
    v = neighbours(v, _KEY, "valid_from", ["schema_hash"], "_s")
    return v.select(
        *_KEY, F.col("number").alias("version_no"), "schema_hash", "fields", "valid_from", F.col("following.valid_from").alias("valid_to"),
        F.col("previous.schema_hash").alias("previous_hash"), F.col("previous.fields").alias("previous_fields"),
    )


def append_schema_versions(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The version table after new snapshots: unknown schemas are added, the open version closed (M8).

    ``current``: org_id, dataset, schema_hash, fields, valid_from, valid_to.
    """
    s = snapshots.select(*_KEY, schema_hash(F.col("fields")).alias("schema_hash"), "fields", F.col("captured_at").alias("valid_from"))
    both = current.select(*s.columns).unionByName(s)
    first = both.groupBy(*_KEY, "schema_hash").agg(F.min("valid_from").alias("valid_from"), F.min_by("fields", "valid_from").alias("fields"))
    return scd2_intervals(first)


def current_schemas(versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """The open version of each known dataset."""
    d = datasets.select("org_id", F.col("name").alias("dataset"), "dataset_type")
    return versions.filter("valid_to IS NULL").join(d, _KEY)


def schema_history(versions: DataFrame, n: int = 10) -> DataFrame:
    """The latest ``n`` versions per dataset."""
    w = Window.partitionBy(*_KEY).orderBy(F.desc("valid_from"), F.desc("schema_hash"))
    return versions.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def schema_as_of(versions: DataFrame, times: DataFrame) -> DataFrame:
    """The version valid at each (org_id, dataset, at)."""
    v = versions.withColumn("version", F.struct("version_no", "schema_hash", "fields", "valid_from", "valid_to"))
    return as_of(times, v, _KEY, "at", "valid_from", "version")


def infer_snapshots(events: DataFrame, bucket: str = "day") -> DataFrame:
    """Snapshots read off JSON rows: keys and types per (dataset, time bucket).

    ``events``: org_id, dataset, ts, value (JSON object text). A key missing in some row
    of the bucket, or null in it, is nullable. Types are merged by Spark's variant schema.
    """
    spark = events.sparkSession
    b = events.select("org_id", "dataset", F.date_trunc(bucket, "ts").alias("captured_at"), F.try_parse_json("value").alias("v"))
    total = b.groupBy("org_id", "dataset", "captured_at").agg(F.count("*").alias("_rows"))
    keys = spark.sql(
        "SELECT org_id, dataset, captured_at, f.key AS name, f.value AS value FROM {b} b, LATERAL variant_explode(b.v) f", b=b
    )
    g = keys.groupBy("org_id", "dataset", "captured_at", "name").agg(
        F.schema_of_variant_agg("value").alias("_t"), F.count_if(~F.is_variant_null("value")).alias("_set")
    )
    kind = F.lower(F.regexp_replace("_t", r"^DECIMAL\(.*\)$", "double"))
    cols = g.join(total, ["org_id", "dataset", "captured_at"]).select(
        "org_id", "dataset", "captured_at", "name", kind.alias("type"), (F.col("_set") < F.col("_rows")).alias("nullable"), F.col("name").alias("pos")
    )
    return snapshots_from_fields(cols)


# --- leaves of nested types (E11) ------------------------------------------------------


def _split_top(text: str) -> list[str]:
    """Parts of a comma list, commas inside <>, () or backticks left alone."""
    parts, depth, quoted, cur = [], 0, False, []
    for ch in text:
        quoted ^= ch == "`"
        if not quoted:
            depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0 and not quoted:
            parts.append("".join(cur).strip())
            cur = []
        else:
            cur.append(ch)
    parts.append("".join(cur).strip())
    return [p for p in parts if p]


def type_leaves(text: str) -> list[tuple[str, str]]:
    """(path, type) of every leaf of a type text; the path of a plain type is empty."""
    t = text.strip()
    for head in ("struct<", "array<", "map<"):
        if t.startswith(head) and t.endswith(">"):
            inner = t[len(head) : -1]
            if head == "array<":
                kids = [("element", inner)]
            elif head == "map<":
                pair = _split_top(inner)
                kids = [("key", pair[0]), ("value", ",".join(pair[1:]) or "unknown")]
            else:
                kids = []
                for f in _split_top(inner):
                    if f.startswith("`") and "`" in f[1:]:
                        name, rest = f[1 : f.index("`", 1)], f[f.index("`", 1) + 1 :].lstrip(" :")
                    else:
                        name, _, rest = f.partition(":")
                    kids.append((name.strip(), rest.strip() or "unknown"))
            return [(f"{n}.{p}" if p else n, leaf) for n, sub in kids for p, leaf in type_leaves(sub)]
    return [("", t)]


def _leaf_rows(batches):
    for pdf in batches:
        rows = [(t, i, p, leaf) for t in pdf["type"] for i, (p, leaf) in enumerate(type_leaves(t))]
        yield pd.DataFrame(rows, columns=["type", "leaf_no", "leaf_path", "leaf_type"])


def explode_leaf_fields(snapshots: DataFrame) -> DataFrame:
    """One row per leaf field, so that drift below the top level shows.

    Only nested types are parsed, and each distinct one once.
    """
    keep = [c for c in snapshots.columns if c != "fields"]
    f = snapshots.select(*keep, F.posexplode(F.col("fields").cast(FIELDS)).alias("pos", "f")).select(*keep, "pos", "f.*")
    plain = f.filter(~F.col("type").contains("<"))
    plain = plain.select(*keep, "pos", F.lit(0).cast("bigint").alias("leaf_no"), F.col("name").alias("path"), "type", "nullable")
    nested = f.filter(F.col("type").contains("<"))
    leaves = nested.select("type").distinct().mapInPandas(_leaf_rows, "type string, leaf_no bigint, leaf_path string, leaf_type string")
    path = F.when(F.col("leaf_path") == "", F.col("name")).otherwise(F.concat_ws(".", "name", "leaf_path"))
    got = join_null_safe(nested, leaves, ["type"], "inner")
    return plain.unionByName(got.select(*keep, "pos", "leaf_no", path.alias("path"), F.col("leaf_type").alias("type"), "nullable"))


ship(__name__)
