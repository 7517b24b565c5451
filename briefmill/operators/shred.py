"""Adjacency-table shredding of deeply nested records into related flat tables.

Every record becomes nodes (record, node, parent, path, label, positions, kind, scalar): one row for each object,
element and scalar that is not null. A node's name is its way from the root, so a parent is found without a counter
and the result is the same in every run. ``entities`` then joins the object nodes of one path with their scalar
children and pivots these into the columns of a flat table that leads back to its parent.

Defined cases: a null record, a null or empty array gives no nodes; a null element gives none but keeps its position; a
single value or object where an array is due (``arrays``) is an array of one; text that holds a JSON object, array or
null, or such text once more inside a JSON string, stands for what it holds; other text is a scalar; equal elements stay
apart by their position; a repeated key of one JSON object keeps its last value; records of any depth and length are
walked with a stack of their own and handed over in pieces, so a very long record does not fill memory with nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.runtime import spread

#: Nodes handed over at once.
PIECE = 20_000
OPENERS = ("{", "[", '"')


def decoded(value: Any) -> Any:
    """What a JSON value stands for: text that holds an object, an array, null or JSON text of these is replaced by it."""
    while isinstance(value, str):
        text = value.strip()
        if text == "null":
            return None
        if not text.startswith(OPENERS):
            return value
        try:
            inner = json.loads(text)
        except (ValueError, RecursionError):
            return value
        if isinstance(inner, str):
            end = decoded(inner)
            return value if isinstance(end, str) else end
        if inner is None or isinstance(inner, (dict, list)):
            return inner
        return value
    return value


def nodes_of(record: Any, arrays: frozenset[str]) -> Iterator[tuple]:
    """The nodes of one record: (node, parent, path, label, positions, kind, scalar)."""
    stack: list[tuple[str, str | None, str, str, tuple[int, ...], Any]] = []

    def children(node: str, path: str, positions: tuple[int, ...], value: dict) -> Iterable[tuple]:
        for label, child in value.items():
            child = decoded(child)
            if child is None:
                continue
            below = f"{path}.{label}" if path else label
            if label in arrays and not isinstance(child, list):
                child = [child]
            if isinstance(child, list):
                yield from elements(node, below, label, positions, child, f"{node}/{label}")
            else:
                yield f"{node}/{label}", node, below, label, positions, child

    def elements(parent: str, path: str, label: str, positions: tuple[int, ...], value: list, name: str) -> Iterable[tuple]:
        for i, child in enumerate(value):
            child = decoded(child)
            if child is not None:
                yield f"{name}[{i}]", parent, path, label, (*positions, i), child

    root = decoded(record)
    if not isinstance(root, dict):
        return
    yield "", None, "", "", (), "object", None
    stack.extend(reversed(list(children("", "", (), root))))
    while stack:
        node, parent, path, label, positions, value = stack.pop()
        if isinstance(value, dict):
            yield node, parent, path, label, positions, "object", None
            stack.extend(reversed(list(children(node, path, positions, value))))
        elif isinstance(value, list):
            yield node, parent, path, label, positions, "array", None
            stack.extend(reversed(list(elements(node, f"{path}[]", label, positions, value, node))))
        else:
            yield node, parent, path, label, positions, "scalar", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def shred(df: DataFrame, key: str, roots: list[str], arrays: Iterable[str]) -> DataFrame:
    """The node table of ``df``: (key, node, parent, path, label, positions, kind, scalar).

    key: column that names the record. roots: columns to shred. arrays: labels whose value is due to be an array. Other
    columns are not read, so their names cannot clash. Nothing is shuffled unless the scan has fewer splits than cores.
    """
    due = frozenset(arrays)
    kind = df.schema[key].dataType
    packed = spread(df.select(F.col(key).alias("__key"), F.to_json(F.struct(*[F.col(c) for c in roots]), {"ignoreNullFields": "false"}).alias("__record")))
    names = ["node", "parent", "path", "label", "positions", "kind", "scalar"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def piece(batch: pa.RecordBatch = batch, at: list[int] = at, rows: list[tuple] = rows) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                made = [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]]
                at.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(made, ["__key", *names])

            for i, record in enumerate(batch.column(1).to_pylist()):
                for row in nodes_of(record, due):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= PIECE:
                        yield piece()
            if rows:
                yield piece()

    out = packed.mapInArrow(walk, f"__key {kind.simpleString()}, node string, parent string, path string, label string, positions array<int>, kind string, scalar string")
    return out.withColumnRenamed("__key", key)


def entities(nodes: DataFrame, key: str, path: str, fields: list[str], positions: list[str]) -> DataFrame:
    """The flat table of one path: (key, node, parent, a column for each position, value, fields).

    Object nodes are joined with their scalar children, which are pivoted into ``fields``; ``value`` holds what an
    element that is no object is itself. A field that is absent is null. The join is on (key, node), which is unique,
    so a record with many rows spreads over all tasks.
    """
    own = nodes.filter((F.col("path") == path) & (F.size("positions") == len(positions)))
    own = own.select(key, "node", "parent", *[F.col("positions")[i].alias(p) for i, p in enumerate(positions)], F.col("scalar").alias("value"))
    if not fields:
        return own
    below = nodes.filter((F.col("kind") == "scalar") & F.col("path").isin([f"{path}.{f}" for f in fields]))
    wide = below.groupBy(key, F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == f, F.col("scalar"))).alias(f) for f in fields])
    return own.join(wide, [key, "node"], "left")


def position(nodes_positions: Column, i: int) -> Column:
    """Position ``i`` of a node, -1 where that level does not apply."""
    return F.coalesce(F.try_element_at(nodes_positions, F.lit(i + 1)), F.lit(-1))
