"""Deeply nested semi-structured records as related flat tables, by structural variants.

A bottom-up tree automaton classifies every value: scalars have a state of their own, a list's state is made of those of
its items, an object's of those of its fields. Nothing about the states is fixed beforehand, they are what the records
turn out to hold; absent, null and empty fields are one, a single item in place of a list is a list of one. A record is
accepted where an object has the first level's key with a state that can hold nodes; the levels (``Level``) say under
which keys nodes hold others, and so give an object its type.

A node's state is its structural variant. The nodes are written once, sorted by variant within their tasks, and each
variant has a typed table (``typed_table``): the columns that its state names, with their types. All variants keep
what they have in common (``supertype``): the record's key, the node's type and name, and its positions on every level,
which are the links to its parents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tarnwell.functions.json_scan import decode, objects
from tarnwell.session import materialize
from tarnwell.tables import current_rows, own_name, read_table


@dataclass(frozen=True)
class Level:
    """Nodes of one type: the parent's key that holds them, and what names them.

    ``name`` is the field that holds a node's name; ``texts`` says that a bare text is a node too and its own name;
    ``named`` leaves out nodes without a name, ``lower`` puts names in lower case.
    """

    key: str
    type: str
    name: str | None = None
    texts: bool = False
    named: bool = False
    lower: bool = False


#: The levels of a vision model's reply.
REPLY = (Level("frames", "frame"), Level("subjects", "subject", "class", lower=True), Level("kinds", "kind", "name", texts=True, named=True))

NODE = "node_type string, positions array<bigint>, node_name string, variant string, fields map<string,string>"
#: States of fields -> Spark type of their column.
TYPES = {"text": "string", "number": "double", "boolean": "boolean", "text*": "array<string>", "number*": "array<double>", "boolean*": "array<boolean>"}


def in_text(text: str) -> Iterator[object]:
    """What a text holds: the text that it is in JSON, or the objects that stand in it."""
    bare = text.strip(" \t\r\n﻿")
    if bare[:1] == '"':
        try:
            whole, end = decode(bare)
        except json.JSONDecodeError:
            pass
        else:
            if end == len(bare):
                yield whole
                return
    if "{" in text:
        yield from objects(text)


def find_record(text: str, key: str) -> tuple[dict, str] | None:
    """The record in a text and how it writes ``key``: the first object, outermost first, whose ``key`` can hold nodes.

    Wrappers (objects, lists, texts in texts) are searched to any depth, in order.
    """
    todo: list[Iterator[object]] = [in_text(text)]
    while todo:
        for value in todo[-1]:
            if isinstance(value, dict):
                own = key if key in value else next((k for k in value if k.lower() == key), None)
                if own is not None and (value[own] is None or isinstance(value[own], (dict, list))):
                    return value, own
                todo.append(iter(value.values()))
            elif isinstance(value, list):
                todo.append(iter(value))
            elif isinstance(value, str) and ("{" in value or '"' in value):
                todo.append(in_text(value))
            else:
                continue
            break
        else:
            todo.pop()
    return None


_NULL, _TEXT, _NUMBER, _BOOLEAN, _LIST, _OBJECT = range(6)
_KINDS = {type(None): _NULL, str: _TEXT, int: _NUMBER, float: _NUMBER, bool: _BOOLEAN, list: _LIST, dict: _OBJECT}
_STATES = {str: "text", int: "number", float: "number", bool: "boolean", list: "list", dict: "object"}
#: Layouts and variants that a worker keeps in mind; beyond, it forgets them and derives them again.
KNOWN = 50_000


def _written(value: object) -> str | None:
    kind = type(value)
    if kind is str:
        return value
    if kind is float or kind is int:
        return repr(value)
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None  # deeper than can be written back; the node and its variant are there all the same


@dataclass
class _Layout:
    """How the objects with the same keys and types of values are read; places are those among the object's values."""

    scalars: list[tuple[int, bool]]  # place, and whether it is a text
    names: list[str]
    others: list[tuple[int, str, int]]  # place, name and kind of lists and objects
    child: int  # place of the field that holds nodes, -1 if it has none
    name: int  # place of the node's name, -1 if it has no text as name
    parts: list[tuple[str, str]]  # names and states of the scalars
    variants: dict[tuple, str]  # states of the others -> variant


class Shredder:
    """Turns records to rows of nodes; what it knows of layouts and variants stays from batch to batch."""

    def __init__(self, levels: tuple[Level, ...]) -> None:
        self.levels = levels
        self._forget()

    def _forget(self) -> None:
        self._layouts: dict[tuple, _Layout] = {}
        self._lists: dict[frozenset, str] = {}
        self._known = 0

    def _start(self) -> None:
        if self._known > KNOWN:
            self._forget()
        self.types: list[str] = []
        self.places: list[int] = []
        self.names: list[str] = []
        self.variants: list[str] = []
        self.field_keys: list[str] = []
        self.field_values: list[str | None] = []
        self.field_ends = [0]

    def _list_state(self, items: list) -> str:
        """The state of a list: its items' states but null, each once, and ``*``; empty if it has no others."""
        kinds = frozenset(map(type, items))
        known = self._lists.get(kinds)
        if known is None:
            states = sorted({_STATES[k] for k in kinds if k is not type(None)})
            known = self._lists[kinds] = "|".join(states) + "*" if states else ""
        return known

    def _layout(self, depth: int, node: dict) -> _Layout:
        child = self.levels[depth + 1].key if depth + 1 < len(self.levels) else None
        label = self.levels[depth].name
        made = _Layout([], [], [], -1, -1, [], {})
        low = [k.lower() for k in node]
        for at, (key, value) in enumerate(node.items()):
            name, kind = low[at], _KINDS[type(value)]
            if kind == _NULL or (name != key and name in node) or name in low[:at] and name != key:
                continue  # of keys that differ in letter case only, the lower-case one, else the first
            if name == child:
                made.child = at
            elif kind in (_LIST, _OBJECT):
                made.others.append((at, name, kind))
            else:
                made.scalars.append((at, kind == _TEXT))
                made.names.append(name)
                made.parts.append((name, _STATES[type(value)]))
                if name == label and kind == _TEXT:
                    made.name = at
        self._known += 1
        return made

    def _fields(self, layout: _Layout, values: list) -> str:
        """Takes down the fields of an object and returns its variant; an object within it gives fields with a dot."""
        self.field_keys += layout.names
        self.field_values += [values[at] if text else _written(values[at]) for at, text in layout.scalars]
        states: list = []
        if layout.child >= 0:
            held = values[layout.child]
            states.append(self._list_state(held if type(held) is list else [held]))
        for at, name, kind in layout.others:
            value = values[at]
            if kind == _LIST:
                state = self._list_state(value)
                states.append(state)
                if state:
                    self.field_keys.append(name)
                    self.field_values.append(_written(value))
            else:
                for inner, x in value.items():
                    if x is not None:
                        state = self._list_state(x) or "list" if type(x) is list else _STATES[type(x)]
                        inner = f"{name}.{inner.lower()}"
                        states.append((inner, state))
                        self.field_keys.append(inner)
                        self.field_values.append(_written(x))
        found = tuple(states)
        variant = layout.variants.get(found)
        if variant is None:
            variant = layout.variants[found] = self._variant(layout, states)
        return variant

    def _variant(self, layout: _Layout, states: list) -> str:
        self._known += 1
        parts = dict(layout.parts)
        parts.update(s for s in states if isinstance(s, tuple))
        plain = [s for s in states if isinstance(s, str)]
        named = ([self._child_key] if layout.child >= 0 else []) + [n for _, n, kind in layout.others if kind == _LIST]
        parts.update((k, s) for k, s in zip(named, plain) if s)
        return "{" + ", ".join(f"{k}: {s}" for k, s in sorted(parts.items())) + "}"

    def _node(self, level: Level, places: tuple[int, ...], name: str) -> None:
        self.types.append(level.type)
        self.places += places
        self.places += [-1] * (len(self.levels) - len(places))
        self.names.append(name.lower() if level.lower else name)

    def _items(self, value: object, depth: int, places: tuple[int, ...]) -> None:
        level = self.levels[depth]
        layouts = self._layouts
        for i, item in enumerate(value if type(value) is list else () if value is None else (value,)):
            if type(item) is dict:
                values = list(item.values())
                shape = (depth, tuple(item), tuple(map(type, values)))
                layout = layouts.get(shape)
                if layout is None:
                    layout = layouts[shape] = self._layout(depth, item)
                name = values[layout.name].strip() if layout.name >= 0 else ""
                if level.named and not name:
                    continue
                at = (*places, i)
                self._node(level, at, name)
                self._child_key = self.levels[depth + 1].key if depth + 1 < len(self.levels) else ""
                self.variants.append(self._fields(layout, values))
                self.field_ends.append(len(self.field_keys))
                if layout.child >= 0:
                    self._items(values[layout.child], depth + 1, at)
            elif level.texts and type(item) is str and (name := item.strip()):
                self._node(level, (*places, i), name)
                self.variants.append("text")
                self.field_ends.append(len(self.field_keys))

    def nodes(self, texts: list[str | None]) -> pa.ListArray:
        """The nodes of each text's record, parents before children; none where it holds no record."""
        self._start()
        ends = [0]
        for text in texts:
            if text and (found := find_record(text, self.levels[0].key)) is not None:
                self._items(found[0][found[1]], 0, ())
            ends.append(len(self.types))
        whole = lambda xs: pa.array(xs, pa.int32())
        size = len(self.levels)
        places = pa.ListArray.from_arrays(whole(range(0, len(self.places) + 1, size)), pa.array(self.places, pa.int64()))
        fields = pa.MapArray.from_arrays(whole(self.field_ends), pa.array(self.field_keys, pa.string()), pa.array(self.field_values, pa.string()))
        columns = [pa.array(self.types, pa.string()), places, pa.array(self.names, pa.string()), pa.array(self.variants, pa.string()), fields]
        rows = pa.StructArray.from_arrays(columns, ["node_type", "positions", "node_name", "variant", "fields"])
        return pa.ListArray.from_arrays(whole(ends), rows)


_shredders: dict[tuple[Level, ...], Shredder] = {}


def worker_shredder(levels: tuple[Level, ...]) -> Shredder:
    """This worker's shredder of such records; it outlives tasks."""
    if levels not in _shredders:
        _shredders.clear()
        _shredders[levels] = Shredder(levels)
    return _shredders[levels]


def position(level: Level) -> str:
    """The column that holds a node's place among its parent's nodes of a type."""
    return f"{level.type}_no"


def shred(df: DataFrame, text: str, keys: list[str], levels: tuple[Level, ...] = REPLY) -> DataFrame:
    """One row per node of the records in column ``text``: ``keys``, type, positions, name, variant and fields.

    Null and empty texts, prose, cut-off JSON and JSON with constants outside the standard hold no record. Rows are
    independent of each other: no shuffle. The nodes are a table, sorted by variant within each task, so that the table of
    one variant is read without the others. Empty tables give no rows, repeated rows their nodes repeatedly. A key named
    like a column of nodes gets an underscore after its name.
    """

    @F.arrow_udf(ArrayType(StructType.fromDDL(NODE)))
    def nodes(texts: pa.Array) -> pa.Array:
        return worker_shredder(levels).nodes(texts.to_pylist())

    exploded = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(nodes(F.col(text))).alias("__node"))
    taken = ["node_type", *map(position, levels), "node_name", "variant", "fields"]
    places = [F.col("__node.positions")[i].alias(position(x)) for i, x in enumerate(levels)]
    rows = exploded.select(
        *[F.col(f"`{k}`").alias(own_name(k, taken)) for k in keys], "__node.node_type", *places, "__node.node_name", "__node.variant", "__node.fields"
    )
    return materialize(rows.sortWithinPartitions("node_type", "variant"), "nodes")


def variants(nodes: DataFrame) -> DataFrame:
    """``node_type, variant, n``: the structural variants that were found; their number follows the shapes, not the rows."""
    return nodes.groupBy("node_type", "variant").agg(F.count(F.lit(1)).alias("n"))


def columns_of(variant: str) -> dict[str, str]:
    """Column -> Spark type of a variant's own fields; fields of mixed or nested states are JSON texts."""
    named = [x.rsplit(": ", 1) for x in variant[1:-1].split(", ")] if variant[:1] == "{" and len(variant) > 2 else []
    return {name: TYPES.get(state, "string") for name, state in named}


def typed_table(nodes: DataFrame, node_type: str, variant: str, levels: tuple[Level, ...] = REPLY) -> DataFrame:
    """The table of one variant: keys, positions, name and the variant's columns in their types (a dot becomes ``_``)."""
    common = [c for c in nodes.columns if c not in ("node_type", "variant", "fields")]
    children = {x.key for x in levels}
    rows = nodes.where((F.col("node_type") == node_type) & (F.col("variant") == variant))

    def typed(name: str, kind: str):
        raw = F.try_element_at("fields", F.lit(name))
        value = F.from_json(raw, kind) if kind.startswith("array") else raw.try_cast(kind)
        return value.alias(own_name(name.replace(".", "_"), common))

    return rows.select(*common, *[typed(n, k) for n, k in columns_of(variant).items() if n not in children])


def variant_tables(nodes: DataFrame, levels: tuple[Level, ...] = REPLY) -> dict[tuple[str, str], DataFrame]:
    """The typed table of every variant found, by type and variant."""
    found = sorted((r["node_type"], r["variant"]) for r in variants(nodes).collect())  # bounded by the shapes there are
    return {k: typed_table(nodes, *k, levels) for k in found}


def supertype(nodes: DataFrame) -> DataFrame:
    """What the tables of all variants have in common, of all of them: the union of their common columns, read at once."""
    return nodes.drop("variant", "fields")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return shred(current_rows(read_table(spark, folder, "metadata"), "image_id", "created_at", ["json"]), "json", ["image_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p5_found."""
    return supertype(_nodes(spark, folder))


def p5_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Query p5_variants: the structural variants of all nodes with their numbers."""
    return variants(_nodes(spark, folder))


def p5_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Query p5_subjects: subjects from the typed tables of all variants that have a number as count, with box where they have one."""
    tables = [t for (kind, variant), t in variant_tables(_nodes(spark, folder)).items() if kind == "subject" and columns_of(variant).get("count") == "double"]
    wanted = {"image_id": "bigint", "frame_no": "bigint", "subject_no": "bigint", "count": "double", "box_x1": "double", "box_y1": "double", "box_x2": "double", "box_y2": "double"}
    aligned = [t.select(*[(F.col(c) if c in t.columns else F.lit(None)).cast(k).alias(c) for c, k in wanted.items()]) for t in tables]
    if not aligned:
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in wanted.items()))
    rows = aligned[0]
    for more in aligned[1:]:
        rows = rows.unionByName(more)
    return rows
