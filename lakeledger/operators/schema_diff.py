"""Differences between two schemas, judged three ways: library, service and version view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.functions.schema_text import is_widening

# Severity levels.
LEVELS = {"Breaking": 3, "Warning": 2, "NonBreaking": 1}


def field_sets(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new form of every field of every pair side by side (U4).

    ``pairs``: keys, old_fields, new_fields. One shuffle on (keys, field name); a pair
    is never gathered whole. Of a name given twice in one schema the last counts.
    """

    def tagged(c: str, side: int) -> Column:
        some = F.coalesce(F.col(c), F.array().cast("array<struct<name:string,type:string,nullable:boolean>>"))
        return F.transform(
            some,
            lambda f, i: F.named_struct(
                F.lit("side"), F.lit(side), F.lit("pos"), i, F.lit("name"), f["name"], F.lit("type"), f["type"],
                F.lit("nullable"), F.coalesce(f["nullable"], F.lit(True)),
            ),
        )

    f = pairs.select(*keys, F.explode(F.concat(tagged("old_fields", 0), tagged("new_fields", 1))).alias("f")).select(*keys, "f.*")
    one = lambda side: F.max_by(F.struct("pos", "type", "nullable"), F.when(F.col("side") == side, F.col("pos")))
    return f.groupBy(*keys, "name").agg(one(0).alias("old"), one(1).alias("new"))


def _rows(sides: DataFrame, keys: list[str], changes: list[Column]) -> DataFrame:
    found = F.filter(F.array(*changes), lambda c: c.isNotNull())
    return sides.select(*keys, "name", F.explode(found).alias("c")).select(*keys, F.col("name").alias("field"), "c.*")


def _common() -> Column:
    return F.col("old").isNotNull() & F.col("new").isNotNull()


def diff_fields(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed, retyped, renulled and moved fields, each with its severity."""
    old, new = F.col("old"), F.col("new")

    def change(kind: str, severity: Column, text: Column) -> Column:
        level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), severity)
        return F.struct(F.lit(kind).alias("change"), severity.alias("severity"), level.alias("level"), text.alias("description"))

    yes = lambda c: F.when(c, "nullable").otherwise("not null")
    type_severity = F.when(is_widening(old["type"], new["type"]), "Warning").otherwise("Breaking")
    null_severity = F.when(new["nullable"], "NonBreaking").otherwise("Breaking")
    arrow = F.lit(" → ")
    return _rows(
        field_sets(pairs, keys),
        keys,
        [
            F.when(old.isNull(), change("ADDED", F.lit("NonBreaking"), F.concat(F.lit("Added field: "), "name", F.lit(" ("), new["type"], F.lit(")")))),
            F.when(new.isNull(), change("REMOVED", F.lit("Breaking"), F.concat(F.lit("Removed field: "), "name"))),
            F.when(
                _common() & (old["type"] != new["type"]),
                change("TYPE_CHANGED", type_severity, F.concat(F.lit("Type changed: "), "name", F.lit(" ("), old["type"], arrow, new["type"], F.lit(")"))),
            ),
            F.when(
                _common() & (old["nullable"] != new["nullable"]),
                change(
                    "NULLABILITY_CHANGED", null_severity,
                    F.concat(F.lit("Nullability changed: "), "name", F.lit(" ("), yes(old["nullable"]), arrow, yes(new["nullable"]), F.lit(")")),
                ),
            ),
            F.when(
                _common() & (old["pos"] != new["pos"]),
                change(
                    "REORDERED", F.lit("Warning"),
                    F.concat(F.lit("Field reordered: "), "name", F.lit(" (position "), old["pos"].cast("string"), arrow, new["pos"].cast("string"), F.lit(")")),
                ),
            ),
        ],
    )


def order_changes(changes: DataFrame) -> DataFrame:
    """Most severe first."""
    return changes.orderBy(F.desc("level"), "field", "change")


def schema_diff_summary(pairs: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Overall result per pair."""
    g = changes.groupBy(*keys).agg(
        F.bool_or(F.col("level") == 3).alias("has_breaking"), F.bool_or(F.col("level") == 2).alias("has_warnings"), F.count("*").alias("n_changes")
    )
    out = pairs.select(*keys).join(g, keys, "left").na.fill(False, ["has_breaking", "has_warnings"]).na.fill(0, ["n_changes"])
    overall = F.when(F.col("has_breaking"), "Breaking").when(F.col("has_warnings"), "Warning").otherwise("NonBreaking")
    return out.withColumn("is_identical", F.col("n_changes") == 0).withColumn("overall_severity", overall)


def service_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Changes in the service's words, one row each, with their place in the list."""
    old, new = F.col("old"), F.col("new")

    def change(place: int, action: str, severity: str, text: Column, details: Column) -> Column:
        return F.struct(
            F.lit(place).alias("place"), F.lit(action).alias("action"), F.lit(severity).alias("severity"), text.alias("text"), details.alias("details")
        )

    def nulls(frm: str, to: str) -> tuple[Column, Column]:
        return F.concat(F.lit("Nullability changed: "), "name", F.lit(f" ({frm} -> {to})")), F.lit(f"{frm} → {to}")

    renulled = _common() & (old["nullable"] != new["nullable"])
    return _rows(
        field_sets(pairs, keys),
        keys,
        [
            F.when(
                old.isNull(),
                change(0, "COLUMN_ADDED", "info", F.concat(F.lit("Column added: "), "name", F.lit(" ("), new["type"], F.lit(")")), F.concat(F.lit("Type: "), new["type"])),
            ),
            F.when(
                new.isNull(),
                change(1, "COLUMN_REMOVED", "critical", F.concat(F.lit("Column removed: "), "name", F.lit(" (was "), old["type"], F.lit(")")), F.concat(F.lit("Was: "), old["type"])),
            ),
            F.when(
                _common() & (old["type"] != new["type"]),
                change(
                    2, "TYPE_CHANGED", "warning",
                    F.concat(F.lit("Type changed: "), "name", F.lit(" ("), old["type"], F.lit(" -> "), new["type"], F.lit(")")),
                    F.concat(old["type"], F.lit(" → "), new["type"]),
                ),
            ),
            F.when(renulled & new["nullable"], change(3, "NULLABILITY_CHANGED", "info", *nulls("NOT NULL", "NULLABLE"))),
            F.when(renulled & ~new["nullable"], change(4, "NULLABILITY_CHANGED", "critical", *nulls("NULLABLE", "NOT NULL"))),
        ],
    )


def describe_schema_change(change_type: Column, added: Column, removed: Column, retyped: Column, required: Column, relaxed: Column) -> Column:
    """Readable description out of the five lists of column names (E9). The wording is a fixed value."""
    lead = (
        F.when(change_type == "BREAKING", "⚠️ Breaking schema changes detected that may impact downstream consumers.")
        .when(change_type == "NON_BREAKING", "Schema has been extended with new columns.")
        .otherwise("Schema modifications detected.")
    )

    def part(names: Column, one: tuple[str, str], many: tuple[str, str]) -> Column:
        q = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
        count = F.size(names).cast("string")
        plural = F.concat(F.replace(F.lit(many[0]), F.lit("{n}"), count), F.array_join(q, ", "))
        return F.when(F.size(names) == 1, F.concat(F.lit(one[0]), q[0], F.lit(one[1]))).when(F.size(names) > 1, plural)

    return F.concat_ws(
        " ",
        lead,
        part(added, ("Added 1 new column: ", ""), ("Added {n} new columns: ", "")),
        part(removed, ("Removed column ", ""), ("Removed {n} columns: ", "")),
        part(retyped, ("Data type changed for column ", ""), ("Data types changed for {n} columns: ", "")),
        part(required, ("Column ", " no longer accepts null values"), ("{n} columns no longer accept null values: ", "")),
        part(relaxed, ("Column ", " now accepts null values"), ("{n} columns now accept null values: ", "")),
    )


def schema_change_anomalies(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: change type, severity, description, the list of changes.

    Any nullability change counts as breaking (B4). A pair whose fields do not differ, such
    as a mere reorder, is UNCHANGED (B3). What is collected is bounded by the schema's width.
    """
    c = service_changes(pairs, keys)
    # added, removed, then per common column its type change before its nullability change
    place = F.struct(F.least("place", F.lit(2)).alias("section"), "field", "place", "action", "severity", "details", "text")
    names = lambda p: F.array_sort(F.collect_list(F.when(F.col("place") == p, F.col("field"))))
    g = c.groupBy(*keys).agg(
        F.array_sort(F.collect_list(place)).alias("_list"),
        names(0).alias("added"), names(1).alias("removed"), names(2).alias("retyped"), names(3).alias("relaxed"), names(4).alias("required"),
    )
    sizes = pairs.select(*keys, F.size("old_fields").alias("old_count"), F.size("new_fields").alias("new_count"))
    g = sizes.join(g, keys, "left")
    none = F.array().cast("array<string>")
    g = g.withColumns({k: F.coalesce(k, none) for k in ("added", "removed", "retyped", "relaxed", "required")})
    breaking = (F.size("removed") + F.size("retyped") + F.size("relaxed") + F.size("required")) > 0
    n = F.coalesce(F.size("_list"), F.lit(0))
    change_type = (
        F.when(F.col("_list").isNull(), "UNCHANGED").when(breaking, "BREAKING").when(F.size("added") > 0, "NON_BREAKING").otherwise("MODIFICATION")
    )
    g = g.withColumn("change_type", change_type)
    text = describe_schema_change(F.col("change_type"), *[F.col(k) for k in ("added", "removed", "retyped", "required", "relaxed")])
    g = g.withColumn("description", F.when(F.col("change_type") == "UNCHANGED", "").otherwise(text))
    return g.select(
        *keys, "change_type", "description", "old_count", "new_count",
        F.when(F.col("change_type") != "UNCHANGED", "SchemaChange").alias("anomaly_type"),
        F.when(F.col("change_type") == "BREAKING", "CRITICAL").when(F.col("change_type") != "UNCHANGED", "WARNING").alias("severity"),
        F.when(F.col("_list").isNull(), 0).otherwise(n).alias("deviation"),
        F.transform("_list", lambda x: x["text"]).alias("changes"),
        F.transform(
            "_list", lambda x: F.named_struct(F.lit("action"), x["action"], F.lit("column"), x["field"], F.lit("details"), x["details"], F.lit("severity"), x["severity"])
        ).alias("diff"),
        F.when(
            F.col("change_type") != "UNCHANGED",
            F.concat(F.lit("Schema "), F.replace(F.lower("change_type"), F.lit("_"), F.lit("-")), F.lit(": "), "description"),
        ).alias("message"),
    )


def version_pairs(versions: DataFrame) -> DataFrame:
    """Each version with the one before as a pair to compare."""
    v = versions.filter("previous_hash IS NOT NULL AND previous_hash <> schema_hash")
    return v.select("org_id", "dataset", "version_no", F.col("previous_fields").alias("old_fields"), F.col("fields").alias("new_fields"))


def chosen_pairs(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs for chosen (org_id, dataset, from_version, to_version)."""
    f = versions.select("org_id", "dataset", F.col("version_no").alias("from_version"), F.col("fields").alias("old_fields"), F.col("valid_from").alias("from_date"))
    t = versions.select("org_id", "dataset", F.col("version_no").alias("to_version"), F.col("fields").alias("new_fields"), F.col("valid_from").alias("to_date"))
    return chosen.join(f, ["org_id", "dataset", "from_version"]).join(t, ["org_id", "dataset", "to_version"])


def schema_version_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and modified counts of two versions, and whether that breaks readers."""
    old, new = F.col("old"), F.col("new")
    modified = _common() & ((old["type"] != new["type"]) | (old["nullable"] != new["nullable"]))
    breaks = new.isNull() | (_common() & ((old["type"] != new["type"]) | (old["nullable"] & ~new["nullable"])))
    g = field_sets(pairs, keys).groupBy(*keys).agg(
        F.count_if(old.isNull()).alias("added_count"),
        F.count_if(new.isNull()).alias("removed_count"),
        F.count_if(modified).alias("modified_count"),
        F.coalesce(F.bool_or(breaks), F.lit(False)).alias("is_breaking"),
    )
    return g


def version_field_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The single field changes behind ``schema_version_diff``."""
    old, new = F.col("old"), F.col("new")
    modified = _common() & ((old["type"] != new["type"]) | (old["nullable"] != new["nullable"]))
    kind = F.when(old.isNull(), "ADDED").when(new.isNull(), "REMOVED").when(modified, "MODIFIED")
    return field_sets(pairs, keys).withColumn("change_type", kind).filter("change_type IS NOT NULL")
