"""Adjacency-table shredding of nested JSON records into related flat tables.

``shred`` turns every record into rows of one adjacency table: node, parent,
label, ordinal, kind and scalar, and of each node the entity it belongs to and
its field there. A list adds no node of its own: its elements hang under the
object that holds the list, labelled with the list's name and numbered by
their place, so that an object standing where a list belongs reads as a list
of one. ``pivoted`` brings object nodes together with their scalar children,
in one aggregation that is combined where the record was read, and turns the
children into columns; ``placed`` gives objects the place of their parents.
``entities`` and ``entity_table`` are these two with no columns and with those
of one list.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists of a record and lists inside their items.
TOP_LISTS = ("mentions", "matters", "relationships", "risks", "actions")
CHILD_LISTS = ("geographies", "attributes", "case_numbers", "legal_provisions")

ROOT = 0
_ADJACENCY = "node int, parent int, label string, ordinal bigint, kind string, scalar string, entity int, field string"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())


class _Number(str):
    """A JSON number kept in its own spelling."""

    __slots__ = ()


def parse_record(text: str | None, names: Sequence[str] = TOP_LISTS) -> dict | None:
    """The record object inside ``text``, or None where there is none to read.

    A record may be wrapped: written as a JSON string (any number of times),
    in a code fence, in a list, or under some other field of an outer object.
    """
    if text is None:
        return None
    try:
        value = _loads(text)
    except (ValueError, RecursionError):
        return None
    wanted = set(names)
    queue = [value]
    while queue:
        value = queue.pop(0)
        if isinstance(value, str) and not isinstance(value, _Number):
            if not any(n in value for n in wanted):
                continue
            try:
                queue.append(_loads(value))
            except (ValueError, RecursionError):
                continue
        elif isinstance(value, dict):
            if wanted & value.keys():
                return value
            queue.extend(value.values())
        elif isinstance(value, list):
            queue.extend(value)
    return None


def _loads(text: str) -> object:
    text = text.strip().lstrip("﻿")
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    return json.loads(text, parse_float=_Number, parse_int=_Number, strict=False)


def walk(record: dict, tops: Sequence[str] = TOP_LISTS, children: Sequence[str] = CHILD_LISTS) -> tuple[list, ...]:
    """The columns node, parent, label, ordinal, kind, scalar, entity, field of a record, the root first.

    Entities are the root, objects of a list of ``tops`` in it, and objects of
    a list of ``children`` in those; every other node belongs to the nearest
    entity above it, ``field`` being the labels from there, joined by dots.
    Iterative, so depth is bounded by the JSON reader only. Elements of a list
    inside a list keep the outer element's ordinal through an ``array`` node.
    """
    nodes, parents, labels, ordinals, kinds, scalars, owners, fields = out = tuple([v] for v in (ROOT, None, "", 0, "object", None, ROOT, ""))
    n = ROOT
    tops, children = frozenset(tops), frozenset(children)
    # (parent, label, ordinal, value, entity, its level, field of the parent)
    stack: list[tuple] = [(ROOT, k, -1, v, ROOT, 0, "") for k, v in reversed(record.items())]
    while stack:
        parent, label, ordinal, value, entity, level, above = stack.pop()
        kind = type(value)
        if kind is list and ordinal < 0:
            stack.extend((parent, label, i, v, entity, level, above) for i, v in reversed(list(enumerate(value))))
            continue
        n += 1
        scalar = None
        field = f"{above}.{label}" if above else label
        if kind is dict:
            name = "object"
            if not above and parent == entity and label in (tops if level == 0 else children if level == 1 else ()):
                entity, level, field = n, level + 1, ""
            stack.extend((n, k, -1, v, entity, level, field) for k, v in reversed(value.items()))
        elif kind is list:
            name = "array"
            stack.extend((n, label, i, v, entity, level, above) for i, v in reversed(list(enumerate(value))))
        elif kind is str:
            name, scalar = "string", value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")
        elif kind is _Number:
            name, scalar = "number", str(value)
        elif kind is bool:
            name, scalar = "boolean", "true" if value else "false"
        else:
            name, scalar = ("null", None) if value is None else ("number", str(value))
        nodes.append(n)
        parents.append(parent)
        labels.append(label)
        ordinals.append(ordinal if ordinal > 0 else 0)
        kinds.append(name)
        scalars.append(scalar)
        owners.append(entity)
        fields.append(field)
    return out


def shred(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str] = TOP_LISTS, children: Sequence[str] = CHILD_LISTS) -> DataFrame:
    """Adjacency table of the JSON in ``column``: ``keys`` plus node, parent, label, ordinal, kind, scalar, entity, field.

    Records are read one by one where they lie (no shuffle). ``keys`` must
    tell the records apart. A null, empty or unreadable record has no rows,
    nor has one without any of ``names`` at any level. Other columns are
    dropped, whatever they are called. Numbers keep their spelling.
    """
    source = df.select(*keys, column)
    key_fields = [source.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields) + ", " + _ADJACENCY

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            columns: list[list] = [[] for _ in _TYPES]
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                record = parse_record(text, names)
                if record is not None:
                    found = walk(record, names, children)
                    for own, new in zip(columns, found):
                        own += new
                    at += [i] * len(found[0])
                if len(at) >= 100_000:
                    yield _out(batch, keys, at, columns)
                    at, columns = [], [[] for _ in _TYPES]
            if at:
                yield _out(batch, keys, at, columns)

    return source.mapInArrow(run, schema)


def _out(batch: pa.RecordBatch, keys: Sequence[str], at: list[int], columns: list[list]) -> pa.RecordBatch:
    index = pa.array(at, pa.int32())
    arrays = [batch.column(i).take(index) for i in range(len(keys))] + [pa.array(c, t) for c, t in zip(columns, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, [*keys, *(f.split(" ")[0] for f in _ADJACENCY.split(", "))])


def pivoted(nodes: DataFrame, keys: Sequence[str], columns: Mapping[str, Column] | None = None) -> DataFrame:
    """``keys``, _entity, _parent, _label, _ordinal of every entity, and ``columns``: aggregates over its fields and scalars.

    An entity's own row and its scalar children have the same ``entity``, so
    joining them is one grouping, combined in the task that read the record
    before anything is shuffled. The root is no entity of a table.
    """
    own = (F.col("kind") == "object") & (F.col("node") == F.col("entity"))
    names = F.array(*[F.lit(n) for n in dict.fromkeys((*TOP_LISTS, *CHILD_LISTS))])
    # Numbers only, the label as its place among the names: such buffers are hashed, text would be sorted.
    place = {"_parent": F.col("parent"), "_ordinal": F.col("ordinal"), "_name": F.array_position(names, F.col("label"))}
    aggs = [F.max(F.when(own, c)).alias(n) for n, c in place.items()] + [c.alias(n) for n, c in (columns or {}).items()]
    grouped = nodes.where(F.col("entity") != ROOT).groupBy(*keys, F.col("entity").alias("_entity")).agg(*aggs)
    return grouped.withColumn("_label", F.element_at(names, F.col("_name").cast("int"))).drop("_name")


def placed(objects: DataFrame, keys: Sequence[str], rest: Sequence[str] = ()) -> DataFrame:
    """``keys``, path, item_pos, child_pos and ``rest`` of entities, each with the place of its parent.

    Items of a top list hang under the record, objects of an inner list under
    an item; ``path`` names the list or both lists joined by a dot, and
    ``child_pos`` is -1 for an item.
    """
    at_item = F.col("_parent") == ROOT
    # An item and its objects come from one record, which one task has held as text.
    family = Window.partitionBy(*keys, "_owner")
    found = objects.withColumn("_owner", F.when(at_item, F.col("_entity")).otherwise(F.col("_parent"))).withColumn("_item", F.max(F.when(at_item, F.struct("_label", "_ordinal"))).over(family))
    return found.select(
        *keys,
        F.when(at_item, F.col("_label")).otherwise(F.concat_ws(".", "_item._label", "_label")).alias("path"),
        F.col("_item._ordinal").alias("item_pos"),
        F.when(at_item, F.lit(-1)).otherwise(F.col("_ordinal")).cast("long").alias("child_pos"),
        *rest,
    )


def entities(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, path, item_pos, child_pos of every object of a list. Objects elsewhere are left out."""
    return placed(pivoted(nodes, keys), keys)


def _fields(fields: Sequence[str], lists: Sequence[str], embedded: Sequence[str]) -> dict[str, Column]:
    scalar = F.col("kind").isin("string", "number", "boolean")
    pick = lambda name: F.min_by("scalar", F.when(scalar & (F.col("field") == name), F.struct("ordinal", "node")))
    out = {f: pick(f) for f in fields}
    for f in lists:
        out[f] = F.transform(F.array_sort(F.collect_list(F.when(scalar & (F.col("field") == f), F.struct("ordinal", "node", "scalar")))), lambda x: x["scalar"])
    for e in embedded:
        value = pick(e)
        out[e.replace(".", "_")] = F.coalesce(value, pick(e.removesuffix(".quote"))) if e.endswith("evidence.quote") else value
    return out


def entity_table(nodes: DataFrame, keys: Sequence[str], path: str, fields: Sequence[str], lists: Sequence[str] = (), embedded: Sequence[str] = ()) -> DataFrame:
    """The flat table of one list: object nodes with their scalar children, pivoted.

    ``fields`` become text columns, ``lists`` arrays in list order, and each
    ``a.b`` or ``a.b.c`` in ``embedded`` a column ``a_b`` or ``a_b_c`` read
    from a single object inside the entity (a plain text in place of
    ``evidence`` counts as its quote). Rows keep ``keys`` and their and their
    parent's positions. Absent fields are null, absent lists empty; a field
    given twice takes its first value. Nothing is dropped but other fields.
    """
    columns = _fields(fields, lists, embedded)
    # Items of other lists are no parents or members of this one; of its parents only the place is needed.
    names = path.split(".")
    rows = pivoted(nodes, keys, columns).where(F.col("_label").isin(*names))
    return placed(rows, keys, list(columns)).where(F.col("path") == path).drop("path")
