r"""Scanners over TeX fragments: braces, environments and alignment marks, aware of comments and escapes. They need a stack, so they run in
Python, in Arrow batches; null gives null."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame

_TOKEN = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}|\\.|%[^\n]*\n?|[{}&]", re.S)


def tokens(text: str) -> Iterator[tuple[int, str, str]]:
    """(place, kind, name) of what counts: `{`, `}`, `&`, `begin` and `end` with the environment's name. Comments and escapes don't."""
    for m in _TOKEN.finditer(text):
        if m.group(1):
            yield m.start(), m.group(1), m.group(2)
        elif m.group() in "{}&":
            yield m.start(), m.group(), ""


def balanced(text: str) -> bool:
    """Whether braces close in order."""
    depth = 0
    for _, kind, _ in tokens(text):
        depth += {"{": 1, "}": -1}.get(kind, 0)
        if depth < 0:
            return False
    return depth == 0


def environments(text: str) -> bool:
    """Whether environments close in order, each by its own name."""
    open_: list[str] = []
    for _, kind, name in tokens(text):
        if kind == "begin":
            open_.append(name)
        elif kind == "end" and (not open_ or open_.pop() != name):
            return False
    return not open_


def marks(text: str) -> list[int]:
    """Places of the `&` outside all braces and environments."""
    braces = inside = 0
    out = []
    for place, kind, _ in tokens(text):
        braces += {"{": 1, "}": -1}.get(kind, 0)
        inside += {"begin": 1, "end": -1}.get(kind, 0)
        if kind == "&" and braces == inside == 0:
            out.append(place)
    return out


def first_mark(text: str) -> int | None:
    return next(iter(marks(text)), None)


def mark_count(text: str) -> int:
    return len(marks(text))


def before_mark(text: str) -> str:
    """What stands before the first mark; the whole text if there is none."""
    at = first_mark(text)
    return text if at is None else text[:at]


def after_mark(text: str) -> str | None:
    at = first_mark(text)
    return None if at is None else text[at + 1 :]


def scanned(df: DataFrame, ident: str, text: str, by: dict[str, Callable[[str], Any]], kind: str) -> DataFrame:
    """(ident, a column of `kind` for each scanner of `by`) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        to = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}[kind]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("ident"), *(pa.array([None if t is None else f(t) for t in texts], to) for f in by.values())], names=["ident", *by])

    made = df.selectExpr(f"`{ident}` as ident", f"`{text}` as text").mapInArrow(run, f"ident {df.schema[ident].dataType.simpleString()}, " + ", ".join(f"{n} {kind}" for n in by))
    return made.withColumnRenamed("ident", ident)
