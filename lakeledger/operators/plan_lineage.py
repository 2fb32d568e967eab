"""Table and column lineage read off the plan texts in event logs.

The unit of lineage is one write. A root execution may make several, each of one or more nested executions;
``plan_nodes`` tells them apart, and inputs, outputs and columns are met within a write.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lakeledger.functions.naming import last_part
from lakeledger.functions.paths import normalise_path
from lakeledger.operators.plan_text import IN_MEMORY, READS, WRITES, Node, attributes, below, clean as _without_ids, dataset, expressions, hands_or_joins, hands_to_write, join_keys, line, listed, rank, read_fields, reference, refs, scanned, sides, target, transform_type, unbracket, written
from lakeledger.operators.plan_types import types_of
from lakeledger.runtime import ship

ship(__name__)

QUERY = ["log_id", "root_execution_id"]
WRITE = [*QUERY, "write_id", "write_no"]
# Paths that a query only reads back from itself.
STAGING = r"/_temporary/|/_checkpoint/|/\.spark-staging-|/_spark_metadata/"


# A line of a plan's tree; every operator line ends in ``(id)``. What may end a text follows Java's ``$``.
_TREE_LINE = re.compile("\\(([0-9]+)\\)(?:\r|\u0085|\u2028|\u2029)?\\Z")
_DEPTH = re.compile(r"[ :+\-]*")
_NODE = re.compile(r"([0-9]+)\)(?: ([^\n]*))?")
_CODEGEN = re.compile(r"\[codegen id : [0-9]+\]")
_NODE_FIELDS = [("node_id", pa.int64()), ("node_name", pa.string()), ("detail", pa.string()), ("place", pa.int32()), ("depth", pa.int32())]


def _texts(plan_text: str) -> Iterator[tuple[int, str, str]]:
    """(id, name, text) of each node of a plan text; its detail follows the first line of the text."""
    for text in ("\n" + plan_text).split("\n\n(")[1:]:
        found = _NODE.match(text)
        if found and (node_id := int(found[1])) < 1 << 63:
            name = found[2] or ""
            yield node_id, (_CODEGEN.sub("", name) if "[codegen" in name else name).strip(" "), text


def parsed_nodes(plan_text: str) -> list[tuple]:
    """(id, name, detail, place, depth) of each node of a plan text; place and depth are those of its line in the tree."""
    at: dict[int, tuple[int, int]] = {}
    drawn = (x for x in plan_text.split("\n\n\n(", 1)[0].split("\n") if x)
    for place, (line, found) in enumerate((x, m) for x in drawn if (m := _TREE_LINE.search(x))):
        at.setdefault(int(found[1]), (place, _DEPTH.match(line).end()))
    return [(node_id, name, text.partition("\n")[2], *at.get(node_id, (None, None))) for node_id, name, text in _texts(plan_text)]


def _values(c: pa.Array) -> list:
    """A column's values; most columns are sooner read as a whole than value by value."""
    if c.null_count == len(c):
        return [None] * len(c)
    return c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) or c.null_count == 0 else c.to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parser(only: str | None):
    """Reads ``nodes``, the write commands that tell a target (``_to``), the table they name (``_name``) and whether files are written (``_files``) off plan texts.

    With ``only``, ``nodes`` are those whose names begin so and all that may be write commands, without their place; with ``COLUMNS``
    those of a plan whose command writes what its child hands on are all its nodes.
    """
    begins = None if only is None else re.compile(only)
    may_write = re.compile(WRITES.removesuffix("$"))

    def read(plan_text: str | None) -> tuple[list, list, str | None, bool]:
        if plan_text is None:
            return [], [], None, False
        if begins is None:
            nodes = parsed_nodes(plan_text)
            commands = [n for n in nodes if may_write.match(n[1])]
            files = any(n[1] == "WriteFiles" for n in nodes)
        else:
            nodes, commands, files = [], [], False
            for node_id, name, text in _texts(plan_text):
                files = files or name == "WriteFiles"
                for into, wanted in ((commands, may_write), (nodes, begins)):
                    if wanted.match(name):
                        into.append((node_id, name, text.partition("\n")[2], None, None))
            if only == COLUMNS and any(hands_to_write(n[1]) for n in commands):
                nodes = parsed_nodes(plan_text)
            else:
                nodes += commands
        to = [(n[0], at[0]) for n in commands if (at := target(n[1], n[2], True))]
        return nodes, sorted(i for i, _ in to), min((table for _, table in to if table is not None), default=None), files

    def listed(lists: tuple[list, ...], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, lists), initial=0), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, to, names, files = zip(*map(read, _values(b.column(b.num_columns - 1))), strict=True) if b.num_rows else ((), (), (), ())
            flat = list(zip(*(n for p in nodes for n in p), strict=True)) or [()] * len(_NODE_FIELDS)
            fields = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(flat, _NODE_FIELDS, strict=True)], [f for f, _ in _NODE_FIELDS])
            found = [listed(nodes, fields), listed(to, pa.array([i for p in to for i in p], pa.int64())), pa.array(names, pa.string()), pa.array(files, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], [*b.schema.names[:-1], "nodes", "_to", "_name", "_files"])

    return run


def _in_writes(nodes: DataFrame) -> DataFrame:
    """Nodes that do not tell the writes of their root apart are all part of one."""
    return nodes if "write_id" in nodes.columns else nodes.withColumns({"write_id": F.col("root_execution_id"), "write_no": F.lit(0)})


_NODE_TYPES = {"execution_id": "bigint", "started": "bigint", "node_id": "bigint", "node_name": "string", "detail": "string", "place": "int", "depth": "int"}


def _of_writes(nodes: DataFrame, read: Callable[[tuple, Iterable], Iterable[tuple]], schema: pa.Schema, columns: str = "", held: int | None = None) -> DataFrame:
    """The rows that ``read`` gives for each root from its (write, nodes) pairs; nodes stand by execution and place.

    Nodes that ``plan_nodes`` dealt out by root stay where they are. Those that only some ``columns`` are asked of have no others.
    """
    x = _in_writes(nodes)
    if "started_at" in x.columns:
        x = x.withColumn("started", F.unix_micros("started_at"))
    asked = set(columns.split() or _NODE_TYPES) & set(x.columns)
    x = x.select(*WRITE, *[F.col(c).cast(t).alias(c) if c in asked else F.lit(None).cast(t).alias(c) for c, t in _NODE_TYPES.items()])
    order = ["write_id", "write_no", *[c for c in ("execution_id", "place") if c in asked]]
    # a window asks for roots that stand together and in order, and for a shuffle only where they do not
    x = x.withColumn("_nth", F.row_number().over(Window.partitionBy(*QUERY).orderBy(*order)))
    n, size = len(WRITE), held or HANDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*map(_values, b.columns), strict=True))
        of_root = lambda some: ((write, [r[n:-1] for r in own]) for write, own in groupby(some, key=lambda r: r[:n]))
        found = (f for root, some in groupby(rows, key=lambda r: r[:2]) for f in read(root, of_root(some)))
        while some := list(islice(found, size)):
            yield _batch(some, schema)

    return x.mapInArrow(run, from_arrow_schema(schema))


#: Rows that are handed on together.
HANDED = 4_096
_WRITE_FIELDS = [("log_id", pa.string()), ("root_execution_id", pa.int64()), ("write_id", pa.int64()), ("write_no", pa.int32())]
_TABLE_FIELDS = [(c, pa.string()) for c in ("name", "table_type", "path", "location")]


def _reads(name: Column) -> Column:
    """Whether a node is a scan, in-memory ones left out."""
    return name.rlike(READS) & ~name.rlike(IN_MEMORY)


def _scans(nodes: list[Node], full_names: bool) -> Iterator[tuple[Node, tuple]]:
    """Scan nodes with the table and path they read."""
    return ((n, at) for n in nodes if (at := scanned(n[3], n[4], full_names)))


def _outputs(nodes: list[Node], full_names: bool) -> list[tuple]:
    """started, rank, table and path of what the commands of a write write, those of the least rank.

    Nested executions of one write name it three ways; the catalog name goes before the path.
    """
    found = [(n[1], rank(n[3], at[0]), *at) for n in nodes if (at := target(n[3], n[4], full_names))]
    best = min((f[1] for f in found), default=None)
    return [f for f in found if f[1] == best]


def _first_started(outputs: list[tuple]) -> dict[tuple, int | None]:
    """Table and path of each output and when it was first started."""
    first: dict[tuple, int | None] = {}
    for started, _, *at in outputs:
        before = first.get(tuple(at))
        first[tuple(at)] = started if before is None else before if started is None else min(before, started)
    return first


def _writes(name: Column, detail: Column) -> Column:
    """Whether a node is a write command that tells its target."""
    return detail.contains("Arguments") & name.rlike(WRITES)


#: What the names of scans begin with, and nothing: for ``plan_nodes``.
SCANS = r"(?:Scan|FileScan|BatchScan|LogicalRelation|RelationV2|DataSourceV2Relation)"
NOTHING = r"(?!)"
#: What ``written_columns``, ``attribute_origins`` and ``query_outputs`` look at: scans, written files and plans that hand on what is written.
COLUMNS = rf"{SCANS}|WriteFiles"


def plan_nodes(sql_events: DataFrame, full_names: bool = False, partitions: int | None = None, only: str | None = None) -> DataFrame:
    """One row per plan node: node_id, node_name, detail, its place and depth in the tree (X2), and the write it is part of.

    A nested execution (one command running another) carries the root it belongs to. ``write_id`` and ``write_no`` tell
    the writes of a root apart (``_with_writes``); a node that is part of several has a row for each. Plans are dealt
    out by root, in as many ``partitions`` as asked: they shrink so much on their way that their bytes there
    tell little of the room they take.

    With ``only``, a pattern that names begin with, just such nodes and the write commands are handed on, without their
    place and depth; the others are left behind where the texts are read.
    """
    plan = [*QUERY, "execution_id", "started_at"]
    n = sql_events.select(*plan, "plan_text")
    nodes = f"array<struct<{','.join(f'{c}:{_NODE_TYPES[c]}' for c, _ in _NODE_FIELDS)}>>"
    n = n.mapInArrow(_parser(only), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema[:-1]) + f", nodes {nodes}, _to array<bigint>, _name string, _files boolean")
    if partitions:
        n = n.repartition(partitions, *QUERY)
    p = _with_writes(n)
    return p.select(*QUERY, "execution_id", "started_at", "_ids", _plan_writes().alias("_same"), F.inline("nodes")).select(
        *QUERY, "execution_id", "started_at", "node_id", "node_name", "detail", "place", "depth", F.inline_outer(F.coalesce("_same", _node_writes()))
    )


def _with_writes(plans: DataFrame) -> DataFrame:
    """Plans (one row per execution with the commands ``_to`` a target) with ``_ids``: the writes they are part of, and their commands.

    In the order of a root's executions, one that names a table and writes no files itself is carried on by
    the next, if that names the same table or a path only: then this is how it writes them. All others
    begin a write. A write is known by its first execution. Executions that write nothing themselves, such as
    the plan around a batch, are part of each write of their root.
    """
    p = plans.withColumn("_writes", F.size("_to") > 0)
    root = Window.partitionBy(*QUERY)
    along = root.orderBy("execution_id")
    before = F.last(F.when(F.col("_writes"), F.struct("_name", "_files")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_before", before)
    last_name = F.col("_before._name")
    carried_on = F.col("_name").isNull() & last_name.isNotNull() | (last_part(F.col("_name")) == last_part(last_name))
    first = F.when(F.col("_writes") & (F.col("_before").isNull() | F.col("_before._files") | ~F.coalesce(carried_on, F.lit(False))), F.col("execution_id"))
    p = p.withColumn("_id", F.when(F.col("_writes"), F.last(first, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))))
    own = F.when(F.col("_writes"), F.struct(F.col("_id").alias("write_id"), F.col("_to").alias("commands"), F.lit(False).alias("all")))
    every = F.transform(F.collect_set(F.when(F.col("_writes"), F.struct("_id", F.size("_to").alias("n")))).over(root), lambda w: F.struct(w["_id"].alias("write_id"), F.transform(F.sequence(F.lit(1), w["n"]), lambda k: k.cast("bigint")).alias("commands"), F.lit(True).alias("all")))
    return p.withColumn("_ids", F.when(F.col("_writes"), F.array(own)).otherwise(every))


def _plan_writes() -> Column:
    """The writes that every node of a plan is part of; null if they are not the same for all its nodes."""
    several = F.exists("_ids", lambda w: ~w["all"] & (F.size(w["commands"]) > 1))
    number = lambda w: F.when(w["all"], F.sequence(F.lit(0), F.size(w["commands"]) - 1)).otherwise(F.array(F.lit(0)))
    of = lambda w: F.transform(number(w), lambda k: F.named_struct(F.lit("write_id"), w["write_id"], F.lit("write_no"), k))
    return F.when(~several, F.array_distinct(F.flatten(F.transform("_ids", of))))


def _node_writes() -> Column:
    """(write_id, write_no) of a node: in a plan of several commands it counts up to the one the node stands below."""
    none = F.lit(0).cast("int")

    def of(w: Column) -> Column:
        below = F.when(F.size(w["commands"]) > 1, F.size(F.filter(w["commands"], lambda c: c < F.col("node_id")))).otherwise(none)
        number = F.when(w["all"], F.sequence(none, F.size(w["commands"]) - 1)).otherwise(F.array(below))
        return F.transform(number, lambda k: F.named_struct(F.lit("write_id"), w["write_id"], F.lit("write_no"), k))

    return F.array_distinct(F.flatten(F.transform("_ids", of)))


def write_nodes(nodes: DataFrame) -> DataFrame:
    """The commands that write: all that ``query_outputs`` and ``execution_writes`` look at."""
    return nodes.filter(_writes(F.col("node_name"), F.col("detail")))


def table_nodes(nodes: DataFrame) -> DataFrame:
    """Scans and the commands that write: all that ``query_inputs`` and ``query_outputs`` look at."""
    return nodes.filter(_reads(F.col("node_name")) | _writes(F.col("node_name"), F.col("detail")))


def execution_writes(nodes: DataFrame) -> DataFrame:
    """``log_id, root_execution_id, execution_id, write_id``: the write that each writing execution is part of."""
    return write_nodes(nodes).select(*QUERY, "execution_id", "write_id").distinct()


def distinct_tables(tables: DataFrame) -> DataFrame:
    """Each table once per write."""
    return tables.select(*WRITE, "name", "table_type", "path", "location").distinct()


def query_inputs(nodes: DataFrame, full_names: bool = False) -> DataFrame:
    """Tables and files read for each write of each query (X3); with ``full_names`` tables keep catalog and database.

    ``write_id`` is null for queries that write nothing.
    """

    def read(_: tuple, writes: Iterable) -> Iterator[tuple]:
        return ((*write, *at) for write, some in writes for at in {reference(*at) for at in {at for _, at in _scans(some, full_names)}})

    return _of_writes(nodes.filter(_reads(F.col("node_name"))), read, pa.schema([*_WRITE_FIELDS, *_TABLE_FIELDS]), "node_name detail")


def query_outputs(nodes: DataFrame, full_names: bool = False) -> DataFrame:
    """Tables and files written by each query, one for each write.

    Nested executions of one write name it three ways; the catalog name goes before the path.
    """

    def read(_: tuple, writes: Iterable) -> Iterator[tuple]:
        # a table is one output whatever the path beside it
        of = lambda outputs: [(started, best, *reference(*at)) for started, best, *at in outputs]
        return ((*write, *at, first) for write, some in writes for at, first in _first_started(of(_outputs(some, full_names))).items())

    found = _of_writes(write_nodes(nodes), read, pa.schema([*_WRITE_FIELDS, *_TABLE_FIELDS, ("started", pa.int64())]), "started node_name detail")
    return found.select(*WRITE, "name", "table_type", "path", "location", F.timestamp_micros("started").alias("started_at"))


def _met(inputs: DataFrame, outputs: DataFrame, how: str) -> DataFrame:
    """Inputs with the ``_names`` and ``_paths`` that their write writes; those it writes itself and staging paths left out.

    Both meet once, by their write; its outputs are few.
    """
    path = normalise_path(F.col("location"))
    o = outputs.groupBy(*WRITE).agg(F.collect_set(F.struct("name")).alias("_names"), F.collect_set(path).alias("_paths"))
    own_path = F.array_contains("_paths", path)
    own_name = (F.col("table_type") == "File") & F.exists("_names", lambda n: n["name"] == F.col("name"))
    i = inputs.filter(~F.coalesce(F.col("location"), F.lit("")).rlike(STAGING)).join(o, WRITE, how)
    return i.filter(~F.coalesce(own_path, F.lit(False)) & ~F.coalesce(own_name, F.lit(False)))


def drop_self_reads(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs without those a write writes itself and without staging paths."""
    return _met(inputs, outputs, "left").select(*inputs.columns)


def query_edges(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every input of a write feeds every output of it."""
    met = _met(inputs, outputs, "inner").select(*QUERY, F.col("name").alias("source"), F.explode("_names").alias("_to"))
    return met.select(*QUERY, "source", F.col("_to.name").alias("target")).distinct()


# --- columns --------------------------------------------------------------------------


def _origins(nodes: list[Node], full_names: bool) -> dict[int, tuple[str, str]]:
    """Dataset and column of each attribute that a scan of a write's plans lists."""
    found: dict[int, tuple[str, str]] = {}
    for n, at in _scans(nodes, full_names):
        name = dataset(*at)
        for column, i, _ in attributes(listed(n[4])):
            # a table named in the logical plan and its scan give the same answer; keep one
            found[i] = min(found.get(i, (name, column)), (name, column))
    return found


def attribute_origins(nodes: DataFrame, full_names: bool = False) -> DataFrame:
    """Which dataset column each expression id of a write's plans stands for."""

    def read(_: tuple, writes: Iterable) -> Iterator[tuple]:
        return ((*write, i, *at) for write, some in writes for i, at in _origins(some, full_names).items())

    schema = pa.schema([*_WRITE_FIELDS, ("expr_id", pa.int64()), ("dataset", pa.string()), ("column", pa.string())])
    return _of_writes(nodes.filter(_reads(F.col("node_name"))), read, schema, "node_name detail")


def _under(write: tuple, nodes: list[Node], wanted: Callable[[str], bool]) -> list[tuple]:
    """Children of the wanted nodes of a write; without a whole key there are none."""
    return [] if None in write else list(below(nodes, wanted))


def written_columns(nodes: DataFrame) -> DataFrame:
    """Columns each write writes, with the expression id behind them."""

    def read(_: tuple, writes: Iterable) -> Iterator[tuple]:
        return ((*write, *c) for write, some in writes for c in {(name, i) for _, name, i, _ in written(some, _under(write, some, hands_to_write))})

    # nodes without a place are handed on by none
    placed = F.col("place").isNotNull() if "place" in nodes.columns else F.lit(False)
    asked = nodes.filter(F.col("write_id").isNotNull() & (placed | (F.col("node_name") == "WriteFiles")))
    return _of_writes(asked, read, pa.schema([*_WRITE_FIELDS, ("column", pa.string()), ("expr_id", pa.int64())]))


# what the facts of a write are: its targets, scan columns, written columns, named expressions, sides of unions, join keys
_TARGET, _ORIGIN, _WRITTEN, _EXPR, _SIDE, _KEY = range(6)
_EDGE = pa.schema([("log_id", pa.string()), ("root_execution_id", pa.int64())] + [(c, pa.string()) for c in ("source_dataset", "source_column", "target_column", "transform_type", "expression", "target_dataset")])


def resolved(facts: list[tuple]) -> set[tuple]:
    """Column edges of one write from its facts (kind, id, name, body, text); each alias is followed once."""
    of = defaultdict(list)
    for kind, *rest in facts:
        of[kind].append(rest)
    best = min((rank for rank, *_ in of[_TARGET]), default=None)
    begun = defaultdict(list)
    for rank, name, path, text in of[_TARGET]:
        if rank == best:
            begun[name, path].append(text)
    target = min((min(filter(None, texts), default=""), name) for (name, _), texts in begun.items())[1] if begun else None
    if target is None:
        return set()
    origins: dict[int, tuple[str, str]] = {}
    for i, name, column, _ in of[_ORIGIN]:
        origins[i] = min(origins.get(i, (name, column)), (name, column))
    names = {name for _, name, _, _ in of[_WRITTEN]}
    aliases = defaultdict(set)
    for i, _, body, kind in of[_EXPR]:
        if i not in origins and set(refs(body)) - {i}:
            aliases[i].add((body, kind))
    for i, _, body, kind in of[_SIDE]:
        aliases[i].add((body, kind))
    clean = lambda body, kind: None if kind == "DIRECT" else _without_ids(body)
    todo = [(True, name, kind, clean(body, kind), r) for i, name, body, kind in of[_EXPR] if name in names for r in refs(body)]
    # written columns that no projection names start from their own id
    todo += [(False, name, "DIRECT", None, i) for i, name, _, _ in of[_WRITTEN]]
    seen, explicit, by_id = set(todo), set(), set()
    while todo:
        named, name, kind, expression, ref = todo.pop()
        if ref in origins:
            (explicit if named else by_id).add((*origins[ref], name, kind, expression))
        for body, how in aliases[ref]:
            for r in refs(body):
                step = (named, name, how if kind == "DIRECT" else kind, clean(body, how) if kind == "DIRECT" else expression, r)
                if r != ref and step not in seen:
                    seen.add(step)
                    todo.append(step)
    explicit |= {(*origins[i], origins[i][1], "JOIN", text) for i, _, _, text in of[_KEY] if i in origins and origins[i][1] in names}
    left = names - {e[2] for e in explicit}
    implicit = {e for e in by_id if e[2] in left}
    left -= {e[2] for e in implicit}
    implicit |= {(d, c, c, "DIRECT", None) for d, c in origins.values() if c in left}
    return {(*e, target) for e in explicit | implicit}


def column_edges(nodes: DataFrame, full_names: bool = False) -> DataFrame:
    """Column-to-column edges of every write.

    Explicit ones follow each written name through the aliases that define it, however many, down to
    scan columns; a union's columns stand for those of all its sides. Join keys that survive give JOIN
    edges; written columns left over pass through by expression id, or else by equal name. Edges
    carry whole expressions; ``capped`` shortens them for display.

    All nodes of a write are read where its plans were dealt to, and its facts resolved in one pass. A write's first output takes the edges (B19).
    """

    def facts(write: tuple, some: list[Node]) -> Iterator[tuple]:
        under = _under(write, some, hands_or_joins)
        # the least text goes first, so an unknown start is empty
        yield from ((_TARGET, best, dataset(table, path), path if table is None else None, None if started is None else f"{started + (1 << 63):020d}") for started, best, table, path in _outputs(some, full_names))
        origins = _origins(some, full_names)
        yield from ((_ORIGIN, i, *at, None) for i, at in origins.items())
        columns = written(some, under)
        yield from ((_WRITTEN, i, name, None, None) for _, name, i, _ in columns)
        # a name that is not written, of a column that a scan gives, explains nothing
        names = {name for _, name, _, _ in columns}
        yield from ((_EXPR, i, name, body, transform_type(body)) for name, i, body in expressions(some) if name in names or i not in origins)
        yield from ((_SIDE, i, None, body, transform_type(body)) for i, body in sides(under))
        yield from ((_KEY, i, None, None, text) for i, text in join_keys(some))

    def read(root: tuple, writes: Iterable) -> Iterator[tuple]:
        return ((*root, *e) for e in {e for write, some in writes for e in resolved(list(facts(write, some)))})

    return _of_writes(nodes.filter("write_id IS NOT NULL"), read, _EDGE)


def uncovered_columns(written: DataFrame, edges: DataFrame) -> DataFrame:
    """Written columns that no edge explains yet."""
    e = edges.select(*WRITE, F.col("target_column").alias("column")).distinct()
    return written.join(e, [*WRITE, "column"], "left_anti")


def implicit_column_edges(written: DataFrame, explicit: DataFrame, by_id: DataFrame, origins: DataFrame) -> DataFrame:
    """DIRECT edges of columns passed through: by expression id, else by equal name."""
    left = uncovered_columns(written, explicit).select(*WRITE, F.col("column").alias("target_column")).distinct()
    one = by_id.join(left, [*WRITE, "target_column"], "left_semi")
    rest = left.join(one.select(*WRITE, "target_column").distinct(), [*WRITE, "target_column"], "left_anti")
    named = origins.select(*WRITE, F.col("dataset").alias("source_dataset"), F.col("column").alias("source_column"), F.col("column").alias("target_column")).distinct()
    two = named.join(rest, [*WRITE, "target_column"], "left_semi")
    two = two.withColumns({"transform_type": F.lit("DIRECT"), "expression": F.lit(None).cast("string")})
    return one.unionByName(two.select(*one.columns))


_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("nullable", pa.bool_())])
_SEEN = pa.schema([*_WRITE_FIELDS, ("dataset", pa.string()), ("side", pa.string()), ("pruned", pa.bool_()), ("at", pa.int64()), ("fields", pa.list_(_FIELD))])


def written_schema(facts: list[tuple]) -> tuple | None:
    """dataset, moment, names and types of what one write wrote, from its facts (kind, id, name, body, text)."""
    target, scanned, bodies, columns = [], {}, defaultdict(list), {}
    for kind, i, name, body, text in facts:
        if kind == _TARGET:
            target.append((i, name))
        elif kind == _ORIGIN:
            scanned[i] = min(scanned.get(i, text), text)
        elif kind == _EXPR:
            bodies[i].append(body)
        else:
            columns[int(text)] = (name, i, body == "true")
    if not target or not columns:
        return None
    at, dataset = min(target)
    listed = [columns[pos] for pos in sorted(columns)]
    types = types_of([i for _, i, _ in listed], scanned, bodies)
    return dataset, at, [name for name, _, _ in listed], [types[i] or ("bigint" if long else "unknown") for _, i, long in listed]


#: Schemas that are handed on together.
SCHEMAS = 4_096


def query_schemas(nodes: DataFrame) -> DataFrame:
    """Schemas seen by each query: what it read (maybe pruned) and what it wrote.

    Rows: query, dataset, side, pruned, captured_at, fields. A scan lists only the columns it needs, so read
    schemas are marked ``pruned``. Written ones list what the write's query hands on, into a catalog of its own too;
    types come from the scans through casts, operators, functions and aggregates (``plan_types``), in one
    pass over the facts of a write. A column whose type the plan does not tell
    (a bare literal; rows handed over without types, as in a micro-batch) is ``unknown``.
    """

    def facts(write: tuple, some: list[Node], types: set[tuple[int, str]]) -> Iterator[tuple]:
        yield from ((_TARGET, at, dataset(*to), None, None) for to, at in _first_started(_outputs(some, False)).items())
        yield from ((_ORIGIN, i, None, None, text) for i, text in types)
        yield from ((_EXPR, i, None, body, None) for _, i, body in expressions(some))
        yield from ((_WRITTEN, i, name, str(long).lower(), pos) for pos, name, i, long in written(some, _under(write, some, hands_to_write)))

    def read(_: tuple, writes: Iterable) -> Iterator[tuple]:
        for write, some in writes:
            types = set()
            for n, at in _scans(some, False):
                if n[4] is not None and "ReadSchema" in n[4]:
                    fields = read_fields(n[4])
                    yield (*write, dataset(*at), "read", True, n[1], _fields(fields))
                    # a scan's own list ties ids to its types
                    of = dict(reversed(fields))
                    types |= {(i, of[c]) for c, i, _ in attributes(unbracket(line(n[4], "Output"))) if c in of}
            if write[2] is not None and (found := written_schema(list(facts(write, some, types)))):
                name, first, names, kinds = found
                yield (*write, name, "write", False, first, _fields(zip(names, kinds, strict=True)))

    found = _of_writes(nodes, read, _SEEN, held=SCHEMAS)
    return found.select(*WRITE, "dataset", "side", "pruned", F.timestamp_micros("at").alias("captured_at"), "fields")


def _fields(named: Iterable[tuple[str, str]]) -> list[dict]:
    return [{"name": name, "type": kind, "nullable": True} for name, kind in named]


def written_snapshots(schemas: DataFrame, org_id: Column) -> DataFrame:
    """What queries wrote as snapshots of their datasets, the third origin of a snapshot log.

    ``schemas`` is what ``query_schemas`` gives; event logs know no organisation, so ``org_id`` tells it. A schema with
    a column of unknown type would look like a change of that type, so it is no snapshot.
    """
    known = schemas.filter((F.col("side") == "write") & ~F.exists("fields", lambda f: f["type"] == "unknown"))
    return known.select(org_id.alias("org_id"), "dataset", "captured_at", "fields").distinct()
