"""Names and texts: tables in plan text, job names, alert subjects, expression kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of anomaly types.
DISPLAY_NAMES = {
    "schema_change": "Schema Change",
    "row_count_anomaly": "Row Count Anomaly",
    "freshness_sla_breach": "Freshness SLA Breach",
    "volume_spike": "Volume Spike",
    "volume_drop": "Volume Drop",
    "null_rate_spike": "Null Rate Spike",
    "completeness_drop": "Completeness Drop",
    "data_drift": "Data Drift",
}
# Function names that make an expression an aggregate.
AGGREGATES = (
    "sum count avg average mean max min first last first_value last_value any_value collect_list collect_set "
    "array_agg stddev stddev_pop stddev_samp std variance var_pop var_samp"
).split()
EXPRESSION_CAP = 3000


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def last_part(name: Column) -> Column:
    """``catalog.db.table`` -> ``table``."""
    return F.substring_index(name, ".", -1)


def table_from_plan(text: Column, full: bool = False) -> Column:
    """Table name in a plan text: three- or two-part in backticks, or dotted under a catalog.

    The last part, or with ``full`` all parts with dots between.
    """
    forms = [(r"`([^`]+)`\.`([^`]+)`\.`([^`]+)`", 3), (r"`([^`]+)`\.`([^`]+)`", 2), (r"(spark_catalog|hive_metastore)\.(default|\w+)\.(\w+)", 3)]
    # a mark that a text does not hold is sooner missed than a form
    quoted = text.contains("`.`")
    marked = [quoted, quoted, text.contains("spark_catalog.") | text.contains("hive_metastore.")]
    if full:
        whole = lambda form, n: F.when(text.rlike(form), F.concat_ws(".", *[F.regexp_extract(text, form, k + 1) for k in range(n)]))
        return F.coalesce(*[F.when(m, whole(form, n)) for m, (form, n) in zip(marked, forms, strict=True)])
    return F.coalesce(*[F.when(m, _first(text, form, n)) for m, (form, n) in zip(marked, forms, strict=True)])


# Option names under which sources print the table they read.
TABLE_OPTIONS = ("dbtable",)
# Relations of systems outside the lake.
FOREIGN = ("JDBC", "Snowflake", "GoogleBigQuery", "Redshift")
# Fixed value: relation of a checkpointed stream source, which prints its table in brackets.
BRACKETED = "CheckpointsV2"


def relation(text: Column) -> Column:
    """A relation in a plan text as ``kind, argument, options``.

    ``SomeRelation[...](argument) key=value, key=value``: the class name up to ``Relation``, what its
    parentheses hold, and the pairs that follow anywhere in the text.
    """
    call = r"(\w+)Relation(?:\[[^\]\n]*\]|[^(\[\n])*\(([^)\n]+)\)"
    keys = F.regexp_extract_all(text, F.lit(r"(\w+)=([^,\]\s]+)"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"(\w+)=([^,\]\s]+)"), F.lit(2))
    return F.struct(_first(text, call).alias("kind"), _first(text, call, 2).alias("argument"), F.arrays_zip(keys.alias("key"), values.alias("value")).alias("options"))


def source_table(text: Column) -> Column:
    """Table read through JDBC or a warehouse connector (S4): a relation's argument, or else its table option.

    Only relations of other systems name a table in their argument.
    """
    r = relation(text)
    # most texts hold none of these words, which is sooner seen than that no pattern is found
    foreign = reduce(lambda a, b: a | b, [text.contains(f"{k}Relation") for k in FOREIGN]) & r["kind"].isin(*FOREIGN)
    option = F.try_element_at(F.filter(r["options"], lambda o: o["key"].isin(*TABLE_OPTIONS)), F.lit(1))["value"]
    any_option = reduce(lambda a, b: a | b, [text.contains(o) for o in TABLE_OPTIONS])
    return F.coalesce(F.when(foreign, r["argument"]), F.when(any_option, option), F.when(text.contains(BRACKETED), _first(text, BRACKETED + r"\s*\[([^,\]\s]+)\]")))


def transform_type(expr: Column) -> Column:
    """DIRECT, AGGREGATE, CASE, FILTER or EXPRESSION by the text of an expression.

    Works on SQL text (``upper(name)``) and on plan text (``upper(name#12)``).
    """
    e = F.trim(expr)
    bare = e.rlike(r"^(?:`[^`]+`|[A-Za-z_]\w*)(?:#\d+L?)?$")
    agg = e.rlike(r"(?i)\b(?:" + "|".join(AGGREGATES) + r")\(")
    case = e.rlike(r"(?i)\bcase\s+when\b|\bif\s*\(")
    boolean = e.rlike(r"(?i)<=>|>=|<=|<>|!=|[<>=]|\band\b|\bor\b")
    return F.when(bare, "DIRECT").when(agg, "AGGREGATE").when(case, "CASE").when(boolean, "FILTER").otherwise("EXPRESSION")


def capped(expr: Column) -> Column:
    """Expression text, cut with ``...`` beyond 3000 characters."""
    return F.when(F.length(expr) > EXPRESSION_CAP, F.concat(F.left(expr, F.lit(EXPRESSION_CAP - 3)), F.lit("..."))).otherwise(expr)


def job_name(custom: Column, description: Column, call_site: Column, app: Column, sql_id: Column) -> Column:
    """Custom name, description, call site, ``app [SQL-id]``, app: the first there is."""
    with_sql = F.concat(app, F.lit(" [SQL-"), sql_id.cast("string"), F.lit("]"))
    return F.coalesce(custom, description, call_site, with_sql, app)


def split_dataset_name(name: Column) -> Column:
    """``bucket:name`` as a struct; a name with ``://`` or no colon has no bucket."""
    has = (F.locate(":", name) > 1) & ~name.contains("://")
    return F.struct(
        F.when(has, F.substring_index(name, ":", 1)).alias("bucket"),
        F.when(has, F.regexp_replace(name, "^[^:]*:", "")).otherwise(F.coalesce(name, F.lit(""))).alias("display_name"),
    )


def alert_subject(template: Column, dataset: Column, anomaly_type: Column, severity: Column) -> Column:
    """Subject line from a template, or the standard one."""
    d = F.coalesce(dataset, F.lit("Unknown"))
    s = F.coalesce(severity, F.lit("INFO"))
    t = F.coalesce(anomaly_type, F.lit("Unknown"))
    filled = F.replace(F.replace(F.replace(template, F.lit("{dataset_name}"), d), F.lit("{anomaly_type}"), t), F.lit("{severity}"), s)
    return F.when(F.coalesce(template, F.lit("")) != "", filled).otherwise(F.concat(F.lit("["), s, F.lit("] Data Anomaly: "), d))


def anomaly_display_name(anomaly_type: Column) -> Column:
    """Readable name of an anomaly type."""
    known = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, anomaly_type), F.initcap(F.replace(anomaly_type, F.lit("_"), F.lit(" "))))
