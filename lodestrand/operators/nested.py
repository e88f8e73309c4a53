"""Nested JSON columns as flat tables with parent links (problem 7).

Every node of a record's JSON (object, array, value) gets an interval label: its number in pre-order and its number in
post-order of one depth-first traversal. A node encloses another if and only if its interval contains the other's, so
the tables of objects, arrays and values need no pointers: the parent of a node is found from the labels alone.

Text around JSON (a byte-order mark, a fenced block, prose) and JSON strings that hold JSON are unpacked first. JSON
that was cut off, and text without JSON, give no rows; null columns and empty texts neither. NaN and infinities are
values. Null elements of arrays keep their position. Of members named twice, the last counts.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "record_id long, column string, pre int, post int, level int, kind string, element boolean, path string, name string, value_type string, value string"
_PLACE = re.compile(r"\[\d+\]")
_DECODER = json.JSONDecoder()


def unpack(text: str | None):
    """The JSON container that ``text`` holds, or None; each layer of packing is shorter than the one around it."""
    while isinstance(text, str):
        s = text.lstrip("﻿ \t\r\n\xa0").rstrip()
        start = re.search(r"[{\[]", s)
        if not start:
            return None
        try:
            text = json.loads(s) if s[:1] in '{["' else _DECODER.raw_decode(s, start.start())[0]
        except (ValueError, RecursionError):
            if s[:1] == '"':
                return None
            try:
                text = _DECODER.raw_decode(s, start.start())[0]
            except (ValueError, RecursionError):
                return None
    return text if isinstance(text, (dict, list)) else None


def _scalar(v) -> tuple[str, str | None]:
    """(type, text) of a JSON value."""
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
    return kind, None if v is None else v if isinstance(v, str) else json.dumps(v)


KINDS = ("element", "object", "array", "value")


def label(root, column: str, wanted: frozenset = frozenset(KINDS)) -> list[tuple]:
    """(pre, post, level, kind, element, path, name, value type, value) of the nodes of the ``wanted`` kinds, in pre-order.

    ``level`` counts the enclosing objects that are elements of arrays; ``name`` is the last member on the path. All
    nodes are numbered, whichever are wanted. The traversal keeps a stack of its own, so nesting has no bound here.
    """
    out: list[tuple] = []
    show = "value" in wanted
    pre = post = 0
    stack: list[list] = []

    def enter(value, path: str, name: str, level: int, in_array: bool) -> None:
        nonlocal pre
        is_object = isinstance(value, dict)
        element = in_array and is_object
        at = None
        if ("element" in wanted if element else False) or ("object" if is_object else "array") in wanted:
            at = len(out)
            out.append((pre, 0, level, "object" if is_object else "array", element, path, name, None, None))
        stack.append([iter(value.items()) if is_object else enumerate(value), is_object, path, name, level + element, at])
        pre += 1

    if not isinstance(root, (dict, list)):
        return [(0, 0, 0, "value", False, column, column, *_scalar(root))] if show else []
    enter(root, column, column, 0, False)
    while stack:
        items, is_object, path, name, level, at = stack[-1]
        for k, v in items:
            if isinstance(v, str) and v[:1] in "{[" and isinstance(packed := unpack(v), (dict, list)):
                v = packed
            if isinstance(v, (dict, list)):
                enter(v, f"{path}.{k}" if is_object else f"{path}[{k}]", k if is_object else name, level, not is_object)
                break
            if show:
                out.append((pre, post, level, "value", False, f"{path}.{k}" if is_object else f"{path}[{k}]", k if is_object else name, *_scalar(v)))
            pre += 1
            post += 1
        else:
            if at is not None:
                out[at] = (out[at][0], post, *out[at][2:])
            post += 1
            stack.pop()
    return out


def nodes(records: DataFrame, id_column: str, columns: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The labelled nodes of the JSON ``columns`` of every record, one row per node of ``kinds`` (schema ``NODE_SCHEMA``)."""
    chosen = records.select(F.col(id_column).cast("long").alias("record_id"), *columns)
    wanted = frozenset(kinds)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for j, column in enumerate(columns, 1):
                for rid, text in zip(ids, batch.column(j).to_pylist()):
                    root = unpack(text)
                    if root is not None:
                        rows += [(rid, column, *node) for node in label(root, column, wanted)]
                    if len(rows) > 50_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return chosen.mapInArrow(run, NODE_SCHEMA)


_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
_NAMES = ["record_id", "column", "pre", "post", "level", "kind", "element", "path", "name", "value_type", "value"]


def _clean(x):
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) and not x.isascii() else x


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(map(_clean, x) if t == pa.string() else x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def linked(labelled: DataFrame, kind: str) -> DataFrame:
    """The nodes of a kind (``element``, ``array`` or ``value``) of ``labelled``, which holds them and all elements, with
    parent_path: the path of the nearest enclosing element object, or ''.

    The parent of a node of level n is the element object of level n - 1 whose interval contains the node's. In
    pre-order that is the last one of that level before the node, so one sorted pass per record and level finds it,
    without comparing nodes in pairs; the containment of the interval is checked on the labels. A node takes part as
    child at its own level and, if it is an element, as parent at the next: both come from one reading of it.
    """
    chosen = F.col("element") if kind == "element" else F.col("kind") == kind
    roles = F.filter(F.array(F.struct(F.col("level").alias("slot"), chosen.alias("child")), F.struct((F.col("level") + 1).alias("slot"), (~F.col("element")).alias("child"))), lambda r, i: F.when(i == 0, r["child"]).otherwise(F.col("element")))
    rows = labelled.withColumn("role", F.explode(roles))
    order = Window.partitionBy("record_id", "column", "role.slot").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.last(F.when(~F.col("role.child"), F.struct("post", "path")), ignorenulls=True).over(order)
    met = rows.withColumn("above", above).filter("role.child")
    parent = F.when((F.col("level") > 0) & (F.col("above.post") > F.col("post")), F.col("above.path")).otherwise("")
    return met.select(*labelled.columns, parent.alias("parent_path"))


def object_table(labelled: DataFrame) -> DataFrame:
    """One row per object that is an element of an array, with its type (path without positions) and parent."""
    return linked(labelled, "element").select("record_id", "column", "pre", "post", F.regexp_replace("path", r"\[\d+\]", "").alias("type"), "path", "parent_path")


def value_table(labelled: DataFrame) -> DataFrame:
    """One row per value, with its member's name, JSON type and the element object it belongs to."""
    return linked(labelled, "value").select("record_id", "column", "pre", "post", "path", "name", "value_type", "value", "parent_path")


def array_table(labelled: DataFrame) -> DataFrame:
    """One row per array, with the element object it belongs to."""
    return linked(labelled, "array").select("record_id", "column", "pre", "post", "path", "name", "parent_path")
