"""Tool calls in chats: linked to their results, ordered, checked against schemas, canonical.

Calls and results meet by identifier in one hash join. A call comes after the calls it depends on:
its place is its own turn or, where it depends on a later one, that one's place and one step more;
places are raised along dependencies until nothing changes. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import picked
from lakeledger.runtime import checkpoint

#: JSON schema types and what Spark calls a value of each.
TYPES = {
    "string": "STRING",
    "integer": r"BIGINT|DECIMAL\(\d+,0\)",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY<.*",
    "object": "OBJECT<.*",
    "null": "VOID",
}


def link_key(conv: Column, call: Column) -> Column:
    """One text for conversation and call identifier; null without the latter. A null conversation is one of its own."""
    return F.when(call.isNotNull(), F.concat(F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("n")), F.lit("\u0001"), call.cast("string")))


# --- numbers ---------------------------------------------------------------------------
#
# Equal numbers are written alike: up to 38 digits plainly, without an exponent or idle zeros, others as
# 1.5e400. Spark's JSON values hold the first kind exactly and would round the second, so these travel as texts
# that begin with a digest of the text they stand in (nothing in that text can name it), and
# lose quotes and digest again when they are printed.

#: A JSON string, what may be a number, a run of anything else.
_PIECE = r'''(?s)"(?:[^"\\]++|\\.)*+"|-?\d[\d.eE+\-]*+|[^"\d\-]++|.'''
_NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+\-]?\d+)?$"
_PLAIN = 38


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number_mark(text: Column) -> Column:
    """What numbers of more than 38 digits begin with in a text's values."""
    return F.concat(F.lit("#number "), F.md5(text), F.lit(" "))


def _canonical_number(token: Column, mark: Column) -> Column:
    def stripped(x: Column) -> Column:
        digits = F.ltrim(F.concat(x["whole"], x["places"]), F.lit("0"))
        lost = F.length(x["whole"]) + F.length(x["places"]) - F.length(digits)
        return F.struct(x["sign"].alias("sign"), F.rtrim(digits, F.lit("0")).alias("digits"), (F.length(x["whole"]) - lost + x["exponent"]).alias("point"))

    def written(x: Column) -> Column:
        d, point, n = x["digits"], x["point"], F.length(x["digits"])
        within = lambda c: F.greatest(F.least(c, F.lit(_PLAIN)), F.lit(0)).cast("int")
        far = F.concat(d.substr(1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 1 << 30))).otherwise(""), F.lit("e"), (point - 1).cast("string"))
        return (
            F.when(d == "", "0")
            .when((point >= n) & (point <= _PLAIN), F.concat(x["sign"], F.rpad(d, within(point), F.lit("0"))))
            .when((point > 0) & (point < n) & (n <= _PLAIN), F.concat(x["sign"], F.left(d, within(point)), F.lit("."), F.substring(d, within(point) + 1, F.lit(1 << 30))))
            .when((point <= 0) & (n - point <= _PLAIN), F.concat(x["sign"], F.lit("0."), F.repeat(F.lit("0"), within(-point)), d))
            .otherwise(F.concat(F.lit('"'), mark, x["sign"], far, F.lit('"')))
        )

    exponent = F.regexp_extract(token, r"[eE]([+\-]?\d+)$", 1)
    read = F.struct(
        F.when(token.startswith("-"), "-").otherwise("").alias("sign"), F.regexp_extract(token, r"^-?(\d+)", 1).alias("whole"),
        F.regexp_extract(token, r"\.(\d+)", 1).alias("places"), F.when(exponent == "", F.lit(0)).otherwise(exponent.try_cast("bigint")).cast("bigint").alias("exponent"),
    )
    beyond = F.concat(F.lit('"'), mark, F.lower(token), F.lit('"'))
    return F.when(F.length(exponent) > 17, beyond).otherwise(_let(_let(read, stripped), written))


def canonical_numbers(text: Column) -> Column:
    """A JSON text with its numbers in one form each; strings, and what is no JSON number, stay.

    Numbers of more than 38 digits become strings that begin with ``number_mark``; exponents of more than 17
    digits stay as given. Texts in which every number has the form already are left alone.
    """
    def piece(t: Column) -> Column:
        return F.when(t.rlike(r"^-?\d") & t.rlike(_NUMBER), _canonical_number(t, number_mark(text))).otherwise(t)

    return F.when(text.rlike(r"\d[.eE]|\d{19}"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), piece), "")).otherwise(text)


def plain_numbers(json: Column, text: Column) -> Column:
    """Printed JSON with the marked numbers of ``text`` as numbers again."""
    return F.when(text.isNotNull() & json.contains(number_mark(text)), F.regexp_replace(json, F.concat(F.lit('"'), number_mark(text), F.lit('([-0-9.e+]+)"')), F.lit("$1"))).otherwise(json)


def json_value(text: Column) -> Column:
    """The value that a whole text is JSON for, numbers in their one form; null where it is none.

    Spark's parser is content with a value at the start of a text. What follows one cannot fit both inside a
    list and inside an object, so a text that does is one value and no more.
    """
    t = canonical_numbers(text)
    member = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))), "$.v", "variant")
    return F.when(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).isNotNull(), member)


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no blanks and one form for each number; null where it is no JSON."""
    return plain_numbers(F.to_json(json_value(text)), text)


# --- schemas ---------------------------------------------------------------------------


def tool_schemas(
    schemas: DataFrame, tool_col: str = "tool", parameter_col: str = "parameter", type_col: str = "type", required_col: str = "required", allowed_col: str | None = None
) -> DataFrame:
    """One row a tool: types of its parameters, which are required, and which values are allowed.

    A type may name several, as in ``integer|null``; one that is not known, or null, fits all values. ``allowed_col``
    holds the allowed values of a parameter as JSON texts (null: any; texts that are no JSON allow nothing).
    Repeated parameters count once, null ones not at all.
    """
    allowed = F.lit(None).cast("array<string>") if allowed_col is None else F.array_distinct(F.filter(F.transform(F.col(allowed_col), canonical_json), lambda x: x.isNotNull()))
    rows = picked(schemas, tool=tool_col, parameter=parameter_col, type=type_col, required=required_col, allowed=allowed)
    one = rows.groupBy("tool", "parameter").agg(F.min("type").alias("type"), F.coalesce(F.max("required"), F.lit(False)).alias("required"), F.min("allowed").alias("allowed"))
    named = F.col("parameter").isNotNull()
    pairs = F.collect_list(F.when(named, F.struct("parameter", F.coalesce("type", F.lit("")).alias("type"))))
    values = F.collect_list(F.when(named & F.col("allowed").isNotNull(), F.struct("parameter", "allowed")))
    needed = F.sort_array(F.collect_list(F.when(named & F.col("required"), F.col("parameter"))))
    return one.filter("tool IS NOT NULL").groupBy("tool").agg(F.map_from_entries(pairs).alias("types"), needed.alias("needed"), F.map_from_entries(values).alias("allowed"))


def argument_errors(given: Column, types: Column, needed: Column, allowed: Column) -> Column:
    """What is wrong with parsed arguments, in order: no object, missing, unknown, ill-typed and not allowed parameters."""
    fields = F.expr("try_variant_get(parsed, '$', 'map<string,variant>')")
    names = F.sort_array(F.map_keys(fields))
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def fits(n: Column) -> Column:
        value = F.element_at(fields, n)
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        far = F.coalesce(text.startswith(number_mark(given)), F.lit(False))
        # a number of more than 38 digits is whole if its places end before its exponent does
        digits = F.length(F.regexp_extract(text, r"\.(\d+)e", 1))
        whole = F.coalesce(F.regexp_extract(text, r"e(\d+)$", 1).try_cast("decimal(38,0)") >= digits, F.lit(False))
        own = F.when(far & whole, "BIGINT").when(far, "DOUBLE").otherwise(F.schema_of_variant(value))
        return F.coalesce(_let(own, lambda t: F.exists(F.split(F.element_at(types, n), r"\|"), lambda k: F.regexp_like(t, F.concat(F.lit("^("), F.element_at(kind, k), F.lit(")$"))))), F.lit(True))

    known = lambda n: F.map_contains_key(types, n)
    missing = F.transform(F.filter(needed, lambda n: ~F.map_contains_key(fields, n)), lambda n: F.concat(F.lit("missing "), n))
    unknown = F.transform(F.filter(names, lambda n: ~known(n)), lambda n: F.concat(F.lit("unknown "), n))
    wrong = F.transform(F.filter(names, lambda n: known(n) & ~fits(n)), lambda n: F.concat(F.lit("not "), F.element_at(types, n), F.lit(": "), n))
    printed = lambda n: plain_numbers(F.to_json(F.element_at(fields, n)), given)
    barred = F.transform(F.filter(names, lambda n: F.map_contains_key(allowed, n) & ~F.array_contains(F.element_at(allowed, n), printed(n))), lambda n: F.concat(F.lit("not allowed: "), n))
    return (
        F.when(given.isNull(), F.array(F.lit("no arguments")))
        .when(F.col("parsed").isNull(), F.array(F.lit("arguments are not JSON")))
        .when(~F.schema_of_variant("parsed").startswith("OBJECT"), F.array(F.lit("arguments are no object")))
        .when(types.isNull(), F.array(F.lit("unknown tool")))
        .otherwise(F.concat(missing, unknown, wrong, barred))
    )


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``k, turn, step, in_cycle`` of every call: ascending (turn, step) puts each call behind what it depends on.

    ``nodes(k, conv, turn)`` has one row a call, ``edges(k, needs)`` only known calls. Calls on a cycle,
    and those that one would move behind it, have no step. Only chats in which some call depends on a
    later one take rounds. In a round each call looks at what it needs and, through a pointer that
    doubles its reach, at what that depends on in turn, so long chains take few rounds.
    """
    turns = nodes.select(F.col("k").alias("needs"), F.col("turn").alias("need_turn"))
    late = edges.join(turns, "needs").join(nodes, "k").filter("need_turn >= turn").select(F.col("conv").alias("_conv")).distinct()
    moved = checkpoint(nodes.join(late, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi"))
    linked = checkpoint(edges.join(moved.select("k"), "k", "left_semi"))
    most = moved.join(linked.select("k").distinct(), "k", "left_semi").groupBy(F.col("conv").alias("_conv")).agg(F.count("*").alias("most"))
    own = F.struct("turn", F.lit(0).cast("bigint").alias("step"))
    now = moved.join(most, F.col("conv").eqNullSafe(F.col("_conv"))).select("k", own.alias("own"), own.alias("at"), "most")
    now = checkpoint(now.select("*", F.lit(None).cast("string").alias("best"), F.lit(None).cast("string").alias("far"), F.lit(0).cast("bigint").alias("reach")))
    while linked.limit(1).count():
        after = F.struct(F.col("at.turn").alias("turn"), (F.col("at.step") + 1).alias("step"))
        asked = linked.join(now.select(F.col("k").alias("needs"), "at"), "needs")
        first = asked.groupBy("k").agg(F.max(F.struct(after.alias("at"), "needs")).alias("first"))
        beyond = now.select(F.col("k").alias("far"), F.col("at").alias("far_at"), F.col("far").alias("farther"), F.col("reach").alias("more"))
        x = now.join(first, "k", "left").join(beyond, "far", "left")
        far = F.struct(F.col("far_at.turn").alias("turn"), (F.col("far_at.step") + F.col("reach")).alias("step"))
        up = F.greatest(F.col("at"), F.col("first.at"), F.when(F.col("far_at").isNotNull(), far))
        up = F.struct(up["turn"].alias("turn"), F.least(up["step"], F.col("most") + 1).alias("step"))
        x = x.withColumn("up", up).withColumn("open", (F.col("up") > F.col("own")) & (F.col("up.step") <= F.col("most")))
        anew = F.col("far").isNull() | ~F.col("first.needs").eqNullSafe(F.col("best"))
        x = x.withColumn("to", F.when(F.col("open"), F.when(anew, F.col("first.needs")).otherwise(F.coalesce("farther", "far"))))
        x = x.withColumn("by", F.when(anew, F.lit(1)).otherwise(F.least(F.col("reach") + F.when(F.col("farther").isNotNull(), F.col("more")).otherwise(0), F.col("most") + 1)))
        changed = (F.col("up") != F.col("at")) | ~F.col("to").eqNullSafe(F.col("far"))
        now = checkpoint(x.select("k", "own", F.col("up").alias("at"), "most", F.col("first.needs").alias("best"), F.col("to").alias("far"), F.col("by").cast("bigint").alias("reach"), changed.alias("changed")))
        if not now.filter("changed").limit(1).count():
            break
        now = now.drop("changed")
    cyclic = F.col("at.step") > F.col("most")
    done = now.select("k", F.col("at.turn").alias("to"), F.when(~cyclic, F.col("at.step")).alias("step"), cyclic.alias("in_cycle"))
    out = nodes.join(done, "k", "left")
    moved_there = F.col("to").isNotNull()
    return out.select("k", F.coalesce("to", "turn").alias("turn"), F.when(moved_there, F.col("step")).otherwise(F.lit(0)).alias("step"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def link(
    calls: DataFrame,
    results: DataFrame,
    schemas: DataFrame,
    conv_col: str = "conv_id",
    call_col: str = "call_id",
    turn_col: str = "turn",
    tool_col: str = "tool",
    arguments_col: str = "arguments",
    needs_col: str = "depends_on",
    content_col: str = "content",
    allowed_col: str | None = None,
) -> DataFrame:
    """One row for each call, and for each identifier that only results have.

    ``call_turn, result_turn, results`` (how many), ``status`` (linked, no result, no call, no id),
    ``order_turn, order_step, in_cycle``, ``valid, errors`` and ``message``, the exchange as JSON with
    sorted keys, no blanks and one form for each number (fields that are null are left out; numbers are exact whatever
    their size, and whole ones are integers however they were written). Of several results the first by
    turn, then content, is taken. Calls that repeat an identifier share its results and its place, that of the
    first turn; a null turn comes first. Dependencies on unknown calls are errors.
    """
    c = picked(calls, conv=conv_col, call=call_col, call_turn=F.col(turn_col).cast("bigint"), tool=tool_col, arguments=arguments_col, needs=needs_col)
    c = c.withColumn("k", link_key(F.col("conv"), F.col("call")))
    r = picked(results, conv=conv_col, call=call_col, turn=F.col(turn_col).cast("bigint"), content=content_col)
    r = r.withColumn("k", link_key(F.col("conv"), F.col("call")))
    first = F.min(F.struct("turn", "content"))
    by_call = r.filter("k IS NOT NULL").groupBy("k").agg(first.alias("first"), F.count("*").alias("results"), F.min("conv").alias("r_conv"), F.min("call").alias("r_call"))
    # places
    known = c.filter("k IS NOT NULL")
    nodes = checkpoint(known.groupBy("k").agg(F.min("conv").alias("conv"), F.coalesce(F.min("call_turn"), F.lit(-1)).alias("turn")))
    wanted = known.select("k", "conv", F.explode("needs").alias("need")).filter("need IS NOT NULL").select("k", "need", link_key(F.col("conv"), F.col("need")).alias("needs")).distinct()
    there = nodes.select(F.col("k").alias("needs"), F.lit(True).alias("there"))
    wanted = checkpoint(wanted.join(there, "needs", "left"))
    place = places(nodes, wanted.filter("there").select("k", "needs"))
    lost = wanted.filter("there IS NULL").groupBy("k").agg(F.sort_array(F.collect_set(F.concat(F.lit("needs unknown "), F.col("need")))).alias("lost"))
    # one hash join by identifier
    joined = c.join(by_call, "k", "full_outer").join(place.withColumnRenamed("turn", "order_turn").withColumnRenamed("step", "order_step"), "k", "left").join(lost, "k", "left")
    book = checkpoint(tool_schemas(schemas, allowed_col=allowed_col))
    is_call = F.col("call").isNotNull() | F.col("results").isNull()
    rows = joined.join(book, "tool", "left").withColumn("parsed", json_value(F.col("arguments")))
    errors = F.concat(argument_errors(F.col("arguments"), F.col("types"), F.col("needed"), F.col("allowed")), F.coalesce("lost", F.array().cast("array<string>")))
    status = F.when(~is_call, "no call").when(F.col("call").isNull(), "no id").when(F.col("results").isNull(), "no result").otherwise("linked")
    rows = rows.withColumn("is_call", is_call).withColumn("errors", F.when(F.col("is_call"), errors).otherwise(F.array(F.lit("result without call")))).withColumn("status", status)
    conv, call = F.coalesce("conv", "r_conv"), F.coalesce("call", "r_call")
    content = F.coalesce(json_value(F.col("first.content")), F.col("first.content").cast("variant"))
    message = F.to_json(
        F.struct(
            F.when(F.col("is_call"), F.struct(F.col("parsed").alias("arguments"), F.when(F.col("parsed").isNull(), F.col("arguments")).alias("arguments_text"), call.alias("id"), F.col("tool"), F.col("call_turn").alias("turn"))).alias("call"),
            conv.alias("conversation"),
            F.when(F.col("results") > 0, F.struct(content.alias("content"), call.alias("id"), F.col("first.turn").alias("turn"))).alias("result"),
        )
    )
    message = plain_numbers(plain_numbers(message, F.col("arguments")), F.col("first.content"))
    return rows.select(
        conv.alias(conv_col), call.alias(call_col), F.col("tool").alias(tool_col), "call_turn", F.col("first.turn").alias("result_turn"), F.coalesce("results", F.lit(0)).alias("results"), "status",
        "order_turn", "order_step", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), (F.size("errors") == 0).alias("valid"), "errors", message.alias("message"),
    )
