"""Mixing sources to target weights: budgets down a tree, then token prefixes of seeded epochs.

The tree is domain, language, source. A node shares its token budget among its children by weight,
and what a child cannot hold (its tokens times the allowed epochs) goes to its siblings; only when a
whole subtree is full does the rest go to the siblings of its ancestor. Sharing one budget among all
children of a node is a closed form over a running sum, so each level is one window over
aggregated rows. Budgets are exact integers.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import unused
from lakeledger.runtime import checkpoint

TREE = ["domain", "lang", "source"]
#: Leading hex digits of a draw key by which a leaf is cut, coarse to fine: of each cut only the bucket that
#: a prefix ends in is cut further, and in the end ordered row by row.
DIGITS = (2, 4)
_WIDE = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Runs without ASCII white space; none in an empty or null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def weight_of(name: str, weights: Mapping[str, int], default: int) -> Column:
    """Weight of a node by its own name; unlisted names and null get ``default``."""
    return reduce(lambda c, kv: F.when(F.col(name) == kv[0], F.lit(kv[1])).otherwise(c), weights.items(), F.lit(default)).cast("bigint")


def draw_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Place of a document in an epoch's order, the same wherever it is computed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each child from its parent's ``given``, by ``weight`` and limited by ``capacity``.

    Children are filled in order of capacity for weight: one whose even share holds all it has is
    full, and the rest is divided among the others by weight, left-over tokens going to the first
    ones by name. Weight 0 gets nothing.
    """
    name = next(c for c in TREE if c not in parent)
    live = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = live.orderBy(ratio.asc_nulls_last(), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(live)
    c = children.withColumn("_b", F.least(F.col("given"), F.coalesce(total, F.lit(0))))
    c = c.withColumn("_left", F.col("_b") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(after))
    full = (F.col("weight") > 0) & (F.col("capacity").cast("decimal(20,0)") * F.col("_w").cast("decimal(15,0)") <= F.col("weight").cast("decimal(15,0)") * F.col("_left").cast("decimal(20,0)"))
    c = c.withColumn("_full", full)
    rest = F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(live), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(live)
    c = c.withColumn("_rest", rest).withColumn("_open", open_weight)
    even = F.expr("CAST(CAST(weight AS decimal(15,0)) * CAST(_rest AS decimal(20,0)) div CAST(_open AS decimal(15,0)) AS bigint)")
    c = c.withColumn("_even", F.when(F.col("_full") | (F.col("weight") == 0), F.lit(0)).otherwise(even))
    c = c.withColumn("_over", F.col("_rest") - F.sum("_even").over(live))
    named = Window.partitionBy(*parent, "_takes") if parent else Window.partitionBy("_takes")
    c = c.withColumn("_takes", ~F.col("_full") & (F.col("weight") > 0))
    c = c.withColumn("_nth", F.row_number().over(named.orderBy(F.col(name).asc_nulls_first())))
    budget = F.when(F.col("_full"), F.col("capacity")).when(F.col("_takes"), F.col("_even") + F.when(F.col("_nth") <= F.col("_over"), 1).otherwise(0)).otherwise(0)
    return c.withColumn("budget", budget.cast("bigint")).drop("_b", "_left", "_w", "_full", "_rest", "_open", "_even", "_over", "_takes", "_nth")


def budgets(leaves: DataFrame, total: Column, epochs: int, weights: Mapping[str, Mapping[str, int]], default: int = 1) -> DataFrame:
    """Token budget of each leaf: ``domain, lang, source, tokens, docs, budget``.

    ``leaves`` has ``tokens`` and ``docs`` of each leaf, ``total`` is an aggregate over them that
    gives the whole budget, one number that the driver reads. Null is a name of its own.
    """
    rows = leaves.withColumn("capacity", F.col("tokens") * epochs)
    given = rows.agg(total.cast("bigint")).first()[0]
    up = [rows]
    for depth in (2, 1):
        up.append(up[-1].groupBy(*TREE[:depth]).agg(F.sum("capacity").alias("capacity")))
    level = up[2].withColumn("given", F.lit(given))
    for depth in (1, 2, 3):
        name = TREE[depth - 1]
        level = share(level.withColumn("weight", weight_of(name, weights.get(name, {}), default)), TREE[: depth - 1])
        if depth < 3:
            above = level.select(*[F.col(k).alias(f"_{k}") for k in TREE[:depth]], F.col("budget").alias("given"))
            below = up[2 - depth]
            level = below.join(above, _on(below, above, TREE[:depth])).drop(*[f"_{k}" for k in TREE[:depth]])
    return level.select(*TREE, "tokens", "docs", "budget")


def prefix_ends(slim: DataFrame, leaves: DataFrame) -> DataFrame:
    """For each leaf the last draw key of the documents it takes of its begun epoch (none: no row).

    ``slim`` has ``domain, lang, source, key, tokens`` of each document in the leaf's begun epoch,
    ``leaves`` the tokens that are left for it as ``rest``. Sums by bucket of the key find the bucket
    in which the budget ends, finer ones inside it the next, and only the last one is ordered.
    Documents of one key go in together or not at all.
    """
    hidden = [F.col(k).alias(f"_{k}") for k in TREE]
    border = leaves.select(*hidden, F.lit("").alias("_prefix"), F.col("rest").alias("_room"))
    ends: list[DataFrame] = []

    def inside() -> DataFrame:
        near = _on(slim, border, TREE) & F.startswith(slim["key"], border["_prefix"])
        return slim.join(border, near).drop(*[f"_{k}" for k in TREE], "_prefix")

    for digits in DIGITS:
        sums = inside().groupBy(*TREE, F.substring("key", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("sum"), F.max("key").alias("top"), F.first("_room").alias("_room"))
        upto = F.sum("sum").over(Window.partitionBy(*TREE).orderBy("bucket"))
        sums = checkpoint(sums.withColumn("upto", upto))
        ends.append(sums.filter("upto <= _room").groupBy(*TREE).agg(F.max("top").alias("end")))
        ended = sums.filter("upto > _room").groupBy(*TREE).agg(F.min(F.struct("bucket", (F.col("_room") - F.col("upto") + F.col("sum")).alias("room"))).alias("b"))
        border = ended.select(*hidden, F.col("b.bucket").alias("_prefix"), F.col("b.room").alias("_room"))
    keys = inside().groupBy(*TREE, "key").agg(F.sum("tokens").alias("sum"), F.first("_room").alias("_room"))
    run = F.sum("sum").over(Window.partitionBy(*TREE).orderBy("key"))
    ends.append(keys.withColumn("upto", run).filter("upto <= _room").groupBy(*TREE).agg(F.max("key").alias("end")))
    return reduce(DataFrame.unionByName, ends).groupBy(*TREE).agg(F.max("end").alias("end"))


def mix(
    docs: DataFrame,
    domain: Column,
    share_of_tokens: tuple[int, int] = (1, 2),
    epochs: int = 4,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    default: int = 1,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: all columns of ``docs`` and, behind them, ``mix_epoch, mix_domain, mix_tokens``.

    The budget is ``share_of_tokens`` (a fraction) of all tokens. Each leaf takes whole epochs while
    its budget lasts and of the next one the documents that come first in that epoch's seeded order,
    as many as fit; no document is cut. A document therefore appears up to ``epochs`` times. Null
    languages, sources and ids are values like others; texts without tokens cost nothing and come with
    the prefix; rows that repeat an id and a text go in together; an empty table gives an empty one. Where
    ``docs`` has a column called like one of the three, the new one gets underscores behind its name.
    """
    d = domain.cast("string")
    slim = docs.select(d.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), tokens(F.col(text_col)).alias("tokens"))
    slim = checkpoint(slim)
    leaves = slim.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    above, below = share_of_tokens
    whole = F.expr(f"CAST(coalesce(sum(tokens), 0) AS decimal(25,0)) * {above} div {below}")
    planned = checkpoint(budgets(checkpoint(leaves), whole, epochs, weights or {}, default))
    has = F.col("tokens") > 0
    full = F.when(has, F.expr("budget div tokens")).otherwise(0).cast("int")
    planned = planned.withColumn("full", full).withColumn("rest", F.when(has, F.expr("budget % tokens")).otherwise(0))
    begun = planned.select(*[F.col(k).alias(f"_{k}") for k in TREE], "full")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest")))
    begun_rows = slim.join(begun, _on(slim, begun, TREE)).select(*TREE, key.alias("key"), "tokens")
    ends = prefix_ends(begun_rows, planned)
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in TREE], "end")
    plan = planned.join(ends, _on(planned, ends, TREE), "left").select(*[F.col(k).alias(f"_mix_{k}") for k in TREE], F.col("full").alias("_mix_full"), F.col("end").alias("_mix_end"))
    plan = checkpoint(plan)  # one row a leaf, of known size
    met = d.eqNullSafe(plan["_mix_domain"]) & docs[lang_col].eqNullSafe(plan["_mix_lang"]) & docs[source_col].eqNullSafe(plan["_mix_source"])
    place = draw_key(seed, plan["_mix_full"], docs[id_col], docs[text_col])
    rows = docs.join(plan, met)
    last = plan["_mix_full"] + F.when(place <= plan["_mix_end"], F.lit(1)).otherwise(F.lit(0))
    epoch = F.explode(F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>")))
    added = {"mix_epoch": epoch, "mix_domain": plan["_mix_domain"], "mix_tokens": tokens(docs[text_col])}
    return rows.select(*[docs[c] for c in docs.columns], *[c.alias(unused(name, docs.columns)) for name, c in added.items()])
