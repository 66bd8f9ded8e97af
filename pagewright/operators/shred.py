"""Deeply nested JSON records as flat related tables.

Columnar shredding: the values of a chunk of records are written as one column per path (keys, and `[]` for array
elements). Every entry of a column has a repetition level (at which array of the path it repeats, 0 for a new record) and a
definition level (how many steps of the path are present). A path that is missing below some ancestor still gets one entry
for that ancestor, so a column's levels alone tell each entry's record and its position in every array on the path. Tables are
rebuilt per repeated ancestor from these level sequences; parent links follow from the path, without a join.

Shapes may differ between records (an object here, an array or a text there): each path keeps its own column of kinds and
values, so nothing is lost and `assemble()` gives the records back.
"""

from __future__ import annotations

import enum
import json
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from pagewright.functions.jsontext import decode, kind

ITEM = None  #: the path step of an array's elements; keys are strings


class Shape(enum.Enum):
    """Stands in a column for a value that isn't a scalar (an enum, so that it keeps its identity in the workers)."""

    OBJECT = 1
    ARRAY = 2


OBJECT, ARRAY = Shape.OBJECT, Shape.ARRAY
#: Records shredded together: bounds a task's memory, whatever the size of its Arrow batches.
CHUNK = 512
NODES = "source_field string, record_id string, file_no int, node_path string, parent_path string"
VALUES = NODES + ", name string, type string, value string"


class Node:
    """A path of the chunk's union schema with its column."""

    __slots__ = ("path", "kids", "item", "is_object", "is_scalar", "rep", "dfn", "val", "below")

    def __init__(self, path: tuple):
        self.path, self.kids, self.item = path, {}, None
        self.is_object = self.is_scalar = False
        self.rep: list[int] = []
        self.dfn: list[int] = []
        self.val: list[Any] = []
        self.below: list[Node] = []  # columns at and beneath this path


def _schema(node: Node, value: Any) -> None:
    if isinstance(value, dict):
        node.is_object = True
        for k, v in value.items():
            kid = node.kids.get(k)
            if kid is None:
                kid = node.kids[k] = Node((*node.path, k))
            _schema(kid, v)
    elif isinstance(value, list):
        if node.item is None:
            node.item = Node((*node.path, ITEM))
        for v in value:
            _schema(node.item, v)
    else:
        node.is_scalar = True


def _close(node: Node, objects_only: bool) -> list[Node]:
    node.below = [x for kid in ([*node.kids.values(), node.item] if node.item else node.kids.values()) for x in _close(kid, objects_only)]
    if node.is_object or not objects_only:
        node.below = [node, *node.below]
    return node.below


def _missing(node: Node, r: int, d: int) -> None:
    for c in node.below:
        c.rep.append(r)
        c.dfn.append(d)
        c.val.append(None)


def _write(node: Node, value: Any, r: int, d: int, depth: int) -> None:
    own = node.below and node.below[0] is node
    if isinstance(value, dict):
        if own:
            node.rep.append(r)
            node.dfn.append(d)
            node.val.append(OBJECT)
        for k, kid in node.kids.items():
            if k in value:
                _write(kid, value[k], r, d + 1, depth)
            elif kid.below:
                _missing(kid, r, d)
        if node.item is not None:
            _missing(node.item, r, d)
        return
    if own:
        node.rep.append(r)
        node.dfn.append(d)
        node.val.append(ARRAY if isinstance(value, list) else value)
    if node.item is not None and node.item.below:
        if isinstance(value, list) and value:
            at = r
            for v in value:
                _write(node.item, v, at, d + 1, depth + 1)
                at = depth + 1
        else:
            _missing(node.item, r, d)
    for kid in node.kids.values():
        if kid.below:
            _missing(kid, r, d)


def shred(records: list, objects_only: bool = False) -> list[Node]:
    """The columns of a chunk of decoded records, the top level's first. With `objects_only`, only the columns of paths that
    hold an object somewhere (column pruning for tables that need no values)."""
    if sys.getrecursionlimit() < 100_000:
        sys.setrecursionlimit(100_000)
    top = Node(())
    for v in records:
        _schema(top, v)
    _close(top, objects_only)
    if not top.below or top.below[0] is not top:
        top.below = [top, *top.below]
    for v in records:
        _write(top, v, 0, 0, 0)
    return top.below


def places(column: Node) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From the level sequences of a column: for each present entry its index in the column, its record and its position in each array on the path."""
    rep = np.fromiter(column.rep, np.int32, len(column.rep))
    there = np.flatnonzero(np.fromiter(column.dfn, np.int32, len(rep)) == len(column.path))
    record = np.cumsum(rep == 0) - 1
    positions = []
    for k in range(1, sum(s is ITEM for s in column.path) + 1):
        count = np.cumsum(rep == k)
        start = np.maximum.accumulate(np.where(rep < k, count, 0))  # the count where the innermost array began
        positions.append((count - start)[there])
    return there, record[there], positions


def _paths(path: tuple, positions: list[np.ndarray], n: int) -> list[str]:
    if not positions:
        return ["/".join(path)] * n
    pattern = "/".join("%d" if s is ITEM else s.replace("%", "%%") for s in path)
    return [pattern % p for p in zip(*(p.tolist() for p in positions), strict=True)]


def _parent_steps(path: tuple) -> int:
    """Steps of the nearest enclosing object's path: up to the last key, which only an object can hold."""
    return max((i for i, s in enumerate(path) if s is not ITEM), default=0)


def nodes(columns: list[Node]) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
    """(record, node_path, parent_path) of every object below the top level, one repeated ancestor after the other."""
    for c in columns:
        if not c.path or not c.is_object:
            continue
        there, record, positions = places(c)
        if len(c.val) != len(there) or c.is_scalar or c.item is not None:
            keep = np.fromiter((c.val[i] is OBJECT for i in there), bool, len(there))
            there, record, positions = there[keep], record[keep], [p[keep] for p in positions]
        if len(there):
            up = _parent_steps(c.path)
            yield record, _paths(c.path, positions, len(there)), _paths(c.path[:up], positions[: sum(s is ITEM for s in c.path[:up])], len(there))


def assemble(columns: list[Node]) -> list[Any]:
    """The records again, from the columns of `shred(records)`."""
    built: dict[tuple, Any] = {}
    records: list[Any] = []
    for c in sorted(columns, key=lambda c: len(c.path)):
        there, record, positions = places(c)
        for n, i in enumerate(there):
            v = c.val[i]
            value = {} if v is OBJECT else [] if v is ARRAY else v
            at, up = [int(record[n])], iter(positions)
            for s in c.path:
                at.append(int(next(up)[n]) if s is ITEM else s)
            built[tuple(at)] = value
            if not c.path:
                records.append(value)
            else:
                holder = built[tuple(at[:-1])]
                if isinstance(holder, list):
                    holder.append(value)
                else:
                    holder[at[-1]] = value
    return records


def _decoded(batch: Any, field: str) -> tuple[list[int], list]:
    rows, values = [], []
    for i, text in enumerate(batch.column(field).to_pylist()):
        v = decode(text, unwrap=True)
        if isinstance(v, (dict, list)):
            rows.append(i)
            values.append(v)
    return rows, values


def flat_nodes(df: DataFrame, record_id: str, file_no: str | None, fields: dict[str, str]) -> DataFrame:
    """One row per JSON object below the top level: source_field, record_id, file_no (0 without a column), node_path, parent_path.

    `fields`: JSON column -> name as source_field. Null, empty, broken text and scalars have no rows; JSON text inside a JSON
    string is decoded. A null record_id stays null. Other columns of `df` aren't read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                ids = batch.column("record_id")
                numbers = batch.column("file_no")
                for column, name in fields.items():
                    rows, values = _decoded(batch, column)
                    if not rows:
                        continue
                    take, node_path, parent_path = [], [], []
                    index = np.array(rows)
                    for record, p, up in nodes(shred(values, objects_only=True)):
                        take.append(index[record])
                        node_path += p
                        parent_path += up
                    if node_path:
                        where = pa.array(np.concatenate(take))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(node_path)), ids.take(where), numbers.take(where), pa.array(node_path), pa.array(parent_path)],
                            names=["source_field", "record_id", "file_no", "node_path", "parent_path"],
                        )

    narrow = df.selectExpr(f"cast({record_id} as string) as record_id", f"cast({file_no or 0} as int) as file_no", *(f"`{c}`" for c in fields))
    return narrow.mapInArrow(run, NODES)


def flat_values(df: DataFrame, record_id: str, file_no: str | None, fields: dict[str, str]) -> DataFrame:
    """One row per scalar value at any depth, with the place of its own and of its parent object, its key (for array elements
    the array's key), its type and its value as text. Rules as in `flat_nodes`; a JSON null is a row of type `null`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                ids, numbers = batch.column("record_id").to_pylist(), batch.column("file_no").to_pylist()
                for column, name in fields.items():
                    rows, values = _decoded(batch, column)
                    out: list[tuple] = []
                    for c in shred(values):
                        if not c.path or not c.is_scalar:
                            continue
                        there, record, positions = places(c)
                        up = _parent_steps(c.path)
                        own = _paths(c.path, positions, len(there))
                        parents = _paths(c.path[:up], positions[: sum(s is ITEM for s in c.path[:up])], len(there))
                        key = next((s for s in reversed(c.path) if s is not ITEM), "")
                        for i, rec, p, q in zip(there, record, own, parents, strict=True):
                            v = c.val[i]
                            if v is not OBJECT and v is not ARRAY:
                                row = rows[rec]
                                out.append((name, ids[row], numbers[row], p, q, key, kind(v) or "null", None if v is None else v if isinstance(v, str) else json.dumps(v)))
                    if out:
                        text = pa.string()
                        kinds = [text, text, pa.int32(), text, text, text, text, text]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)],
                            names=["source_field", "record_id", "file_no", "node_path", "parent_path", "name", "type", "value"],
                        )

    narrow = df.selectExpr(f"cast({record_id} as string) as record_id", f"cast({file_no or 0} as int) as file_no", *(f"`{c}`" for c in fields))
    return narrow.mapInArrow(run, VALUES)
