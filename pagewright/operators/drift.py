"""Schemas that drift between the records of a stream: one union schema, and a list of every change.

A stream is the ordered sequence of JSON records of one installation, book or source file. Two results:

* `changes()`: what each record changed against the one before it (added, removed, renamed, retyped, version);
* `union_schema()` and `unify()`: the types of every field folded through a promotion lattice, and all records cast to them.

Order inside a stream is needed, yet a stream may hold a third of all rows. So a stream is cut into blocks of at most
`BLOCK` sequence numbers. Each block is summarised on its own (its last record, last known types, last version), the small
summaries of a stream are folded in order to give the state in which each block starts, and each block then lists its changes
from that state. Blocks are read as sorted streams, so no task holds more than one record and a state, and none has to take a
whole stream.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsontext import decode, kind, leaves

#: Sequence numbers in a block: about 4 MB of records of 1 KB.
BLOCK = 4096
CHANGES = "source_table string, stream_key string, seq int, change string, field string, new_field string"
#: A type that isn't known yet in a block, because all values since the block's start were null.
OPEN = "?"


def promote(*types: str | None) -> str:
    """The lattice of field types: null (none is known) lies under every type, equal types meet in themselves, others in text (JSON text for
    arrays and objects). The one rule for schemas, for tables and for what counts as a change of type."""
    known = {t for t in types if t not in (None, "null", OPEN)}
    return known.pop() if len(known) == 1 else "text" if known else "null"


def _text(value: Any) -> str | None:
    """A value written as text for the comparison of renamed fields; None if it never matches."""
    if value is None or value == "" or isinstance(value, (list, dict)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _fields(text: str | None) -> dict[str, list] | None:
    """path -> [type or None, value as text] of one record; None if the record is skipped."""
    value = decode(text)
    if not isinstance(value, dict):
        return None
    return {p: [kind(v), _text(v)] for p, v in leaves(value).items()}


def _step(state: dict[str, list] | None, fields: dict[str, list], default: str | None) -> tuple[list[tuple[str, str, str]], dict]:
    """Changes from `state` to a record and the new state. A field that is null keeps its last known type; `default` stands
    for the type of a null field if there is no record before."""
    if state is None:
        return [], {p: [t or default, v] for p, (t, v) in fields.items()}
    gone = [p for p in state if p not in fields]
    new = [p for p in fields if p not in state]
    out: list[tuple[str, str, str]] = []
    moved: dict[str, str] = {}
    if gone and new:
        was = Counter(state[p][1] for p in gone)
        now = Counter(fields[p][1] for p in new)
        for p in gone:
            v = state[p][1]
            if v is not None and was[v] == 1 and now[v] == 1:
                q = next(q for q in new if fields[q][1] == v)
                moved[q] = p
                out.append(("renamed", p, q))
                if fields[q][0] is not None and promote(state[p][0], fields[q][0]) != fields[q][0]:
                    out.append(("retyped", q, ""))
    left = set(moved.values())
    out += [("removed", p, "") for p in gone if p not in left]
    out += [("added", p, "") for p in new if p not in moved]
    after = {}
    for p, (t, v) in fields.items():
        before = state[p][0] if p in state else None
        if t is None:
            t = before
        elif before is not None and promote(before, t) != t:
            out.append(("retyped", p, ""))
        after[p] = [t, v]
    return out, after


def _streamed(batches: Iterator, names: list[str]) -> Iterator[tuple[bool, tuple]]:
    """(whether a new group of the first three columns begins, row) of sorted rows; a row equal to the one before in everything
    but its payload, which arrived twice, comes once."""
    last = None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            ident = row[:6]
            if ident != last:
                yield last is None or ident[:3] != last[:3], row
            last = ident


def _carry(before: dict | None, summary: dict) -> dict:
    """The state after a block, from the state before it and the block's summary."""
    if before is None:
        return summary
    state = summary["state"]
    if state is None:
        state = before["state"]
    elif before["state"] is not None:
        old = before["state"]
        state = {p: [old[p][0] if t == OPEN and p in old else t, v] for p, (t, v) in state.items()}
    return {"state": state, "version": summary["version"]}


def _batches(rows: Iterator[tuple], names: list[str], types: list) -> Iterator:
    import pyarrow as pa

    while chunk := list(itertools.islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*chunk, strict=True), types, strict=True)], names=names)


def changes(records: DataFrame, versioned: tuple[str, ...] = ("pages",), block: int = BLOCK) -> DataFrame:
    """Changes between the records of each stream.

    `records`: source_table, stream_key, seq, ident (tells apart rows of the same seq; equal rows count once), json, version.
    Rows without stream_key or seq belong to no stream and are left out. Null records and those that don't decode to an
    object are skipped; for tables in `versioned` a change of `version` (null is a value of its own) is listed for every row.
    An empty table gives no rows. Tasks read their rows in order, one after the other; they hold one record and its state.
    """
    keys = ["source_table", "stream_key", "block"]
    columns = [*keys, "start", "seq", "ident", "json", "version"]
    keyed = (
        records.where("stream_key is not null and seq is not null")
        .withColumn("block", F.floor(F.col("seq") / block))
        .select("source_table", "stream_key", "block", F.lit(1).alias("start"), "seq", F.coalesce("ident", F.lit("")).alias("ident"), "json", "version")
    )

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, "start", "seq", "ident")

    def summarise(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            key, state, version = None, None, None
            for new, (t, k, b, _, _, _, text, now) in _streamed(batches, columns):
                if new:
                    if key is not None:
                        yield (*key, json.dumps({"state": state, "version": version}))
                    key, state = (t, k, b), None
                version = now
                fields = _fields(text)
                if fields is not None:
                    state = _step(state, fields, OPEN)[1]
            if key is not None:
                yield (*key, json.dumps({"state": state, "version": version}))

        yield from _batches(rows(), [*keys, "state"], [pa.string(), pa.string(), pa.int64(), pa.string()])

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            last, carried = None, None
            for batch in batches:
                for t, k, b, state in zip(*(batch.column(n).to_pylist() for n in [*keys, "state"]), strict=True):
                    if (t, k) != last:
                        last, carried = (t, k), None
                    if carried is not None:
                        yield t, k, b, json.dumps(carried)
                    carried = _carry(carried, json.loads(state))

        yield from _batches(rows(), [*keys, "json"], [pa.string(), pa.string(), pa.int64(), pa.string()])

    def differences(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            first, state, version = True, None, None
            for new, (t, k, _, start, seq, _, text, now) in _streamed(batches, columns):
                if new:
                    first, state, version = True, None, None
                if start == 0:
                    carried = json.loads(text)
                    first, state, version = False, carried["state"], carried["version"]
                    continue
                if t in versioned:
                    if not first and now != version:
                        yield t, k, seq, "version", "layout_schema_version", ""
                    version = now
                first = False
                fields = _fields(text)
                if fields is not None:
                    found, state = _step(state, fields, None)
                    for c, f, n in found:
                        yield t, k, seq, c, f, n

        yield from _batches(rows(), ["source_table", "stream_key", "seq", "change", "field", "new_field"], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])

    kinds = "source_table string, stream_key string, block long, "
    summaries = ordered(keyed).mapInArrow(summarise, kinds + "state string")
    starts = summaries.repartition("source_table", "stream_key").sortWithinPartitions(*keys).mapInArrow(fold, kinds + "json string")
    starts = starts.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("seq"), F.lit("").alias("ident"), "json", F.lit(None).cast(keyed.schema["version"].dataType).alias("version"))
    return ordered(keyed.union(starts)).mapInArrow(differences, CHANGES)


def observed_types(records: DataFrame) -> DataFrame:
    """(source_table, field, type, n) counted in the tasks that read the records: schemas are read in parallel and only
    distinct (field, type) pairs are shuffled."""

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            seen: Counter = Counter()
            for table, text in zip(batch["source_table"], batch["json"], strict=True):
                for path, (t, _) in (_fields(text) or {}).items():
                    seen[table, path, t or "null"] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source_table", "field", "type", "n"])

    return (
        records.select("source_table", "json")
        .mapInPandas(read, "source_table string, field string, type string, n long")
        .groupBy("source_table", "field", "type")
        .agg(F.sum("n").alias("n"))
    )


def union_schema(records: DataFrame) -> DataFrame:
    """(source_table, field, types, promoted, records): the union schema of each kind of record, its types folded through the lattice.
    Only a row for each field reaches the fold."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.append_column("promoted", pa.array([promote(*t) for t in batch.column("seen").to_pylist()], pa.string()))

    found = observed_types(records).groupBy("source_table", "field").agg(F.sort_array(F.collect_set("type")).alias("seen"), F.sum("n").alias("records"))
    return found.mapInArrow(fold, "source_table string, field string, seen array<string>, records long, promoted string").select("source_table", "field", F.concat_ws(",", "seen").alias("types"), "promoted", "records")


def unify(records: DataFrame, keys: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    """All records of one kind as a table with one column per field of the union schema (`fields`: path, promoted type).

    Numbers become doubles, booleans booleans, everything else text (arrays and objects as JSON text). A field that a record
    lacks, and a null, give null. Records that don't decode to an object keep their row with null fields.
    """
    spark_type = {"number": "double", "boolean": "boolean"}
    names = [p for p, _ in fields]
    kinds = [t for _, t in fields]
    key_types = [records.schema[k] for k in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in key_types] + [f"`{p}` {spark_type.get(t, 'string')}" for p, t in fields])

    def cast(value: Any, to: str) -> Any:
        if value is None:
            return None
        if to in ("number", "boolean"):
            return float(value) if to == "number" else value
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for text in batch["json"]:
                value = decode(text)
                flat = leaves(value) if isinstance(value, dict) else {}
                rows.append([cast(flat.get(p), t) for p, t in zip(names, kinds, strict=True)])
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    return records.select(*keys, "json").mapInPandas(read, schema)
