"""Deeply nested JSON records to related flat tables.

Each record is parsed as a stream of tokens into triples: path, value and the ordinals of the array
elements on the way. Paths that share their repeated ancestor form one table; pivoting a group of triples
by (record, ordinals) gives its rows, and the ordinals of a row begin with those of its parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagestrata.runtime import one_delivery, ship, written

_SPACE = re.compile(r"[ \t\n\r]*")
_LITERAL = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
OBJECT, ARRAY = object(), object()
# Where a crawl result may stand inside its payload, and its repeated members.
WRAPPERS = (("result",), ("data", "crawl"))
ARRAYS = frozenset({"pages", "pages[].internal_links", "pages[].external_links", "pages[].images", "pages[].redirect_chain", "issues", "issues[].urls"})
TEXT_ELEMENTS = frozenset({"issues[].urls"})
TABLES = {
    "pages": ("pages[]", ["url", "status", "title", "depth"]),
    "internal_links": ("pages[].internal_links[]", ["url", "anchor", "nofollow"]),
    "images": ("pages[].images[]", ["src", "alt", "width", "height"]),
    "issues": ("issues[]", ["category", "check", "severity", "description"]),
    "issue_urls": ("issues[].urls[]", ["url", "detail"]),
}
KINDS = {"page": "pages[]", "internal_link": "pages[].internal_links[]", "image": "pages[].images[]", "issue": "issues[]", "issue_url": "issues[].urls[]"}


class Incomplete(ValueError):
    """The text is no complete JSON value."""


def scan(text: str) -> Iterator[tuple[tuple, object]]:
    """(steps, value) of every scalar and of every start of an object or array, as the text goes by; steps are member names and
    element numbers. The nesting is kept on a stack of its own, so its depth is not bound by the interpreter's."""
    at = _SPACE.match(text, 1 if text[:1] == "﻿" else 0).end()
    stack: list[tuple[str, object]] = []  # ("{", name) or ("[", number)
    expect_value = True
    size = len(text)
    while True:
        if expect_value:
            if at >= size:
                raise Incomplete
            char = text[at]
            steps = tuple(s for _, s in stack)
            if char == "{":
                yield steps, OBJECT
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == "}":
                    at += 1
                    expect_value = False
                    continue
                at = _key(text, at, stack)
                continue
            if char == "[":
                yield steps, ARRAY
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == "]":
                    at += 1
                    expect_value = False
                    continue
                stack.append(("[", 0))
                continue
            if char == '"':
                try:
                    value, at = scanstring(text, at + 1, True)
                except ValueError as error:
                    raise Incomplete from error
                yield steps, value
            else:
                found = _LITERAL.match(text, at)
                if not found:
                    raise Incomplete
                at = found.end()
                yield steps, None if found[0] == "null" else found[0]
            expect_value = False
        at = _SPACE.match(text, at).end()
        if not stack:
            if at != size:
                raise Incomplete
            return
        kind, step = stack[-1]
        char = text[at : at + 1]
        if char == ",":
            at = _SPACE.match(text, at + 1).end()
            if kind == "[":
                stack[-1] = ("[", step + 1)
            else:
                stack.pop()
                at = _key(text, at, stack)
            expect_value = True
        elif char == ("]" if kind == "[" else "}"):
            stack.pop()
            at += 1
        else:
            raise Incomplete


def _key(text: str, at: int, stack: list) -> int:
    if text[at : at + 1] != '"':
        raise Incomplete
    try:
        name, at = scanstring(text, at + 1, True)
    except ValueError as error:
        raise Incomplete from error
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise Incomplete
    stack.append(("{", name))
    return _SPACE.match(text, at + 1).end()


def _placed(steps: tuple, value: object, out: list, nested_issues: bool) -> None:
    """One scanned value under its canonical path: array paths always have an ordinal."""
    if value is ARRAY or not steps:
        return
    ordinals: list[int] = []
    k = 0
    path = ""
    while k < len(steps):
        step = steps[k]
        if isinstance(step, int):
            # An array where none is expected: its elements are kept apart all the same.
            path += "[]"
            ordinals.append(step)
            k += 1
            continue
        if path == "" and step == "issues" and nested_issues and k + 1 < len(steps) and steps[k + 1] == "issues":
            k += 1
        path = f"{path}.{step}" if path else step
        k += 1
        if path in ARRAYS and k < len(steps) and not isinstance(steps[k], int):
            path += "[]"
            ordinals.append(0)
    if path in ARRAYS:
        if value is OBJECT:
            if steps == ("issues",) and nested_issues:
                return
            path += "[]"
            ordinals.append(0)
        elif isinstance(value, str):
            inner = value.strip()
            if inner.startswith("["):
                try:
                    scanned = list(scan(inner))
                except Incomplete:
                    scanned = None
                if scanned is not None:
                    for more, v in scanned:
                        _placed(steps + more, v, out, nested_issues)
                    return
            if path not in TEXT_ELEMENTS or not inner:
                return
            path += "[]"
            ordinals.append(0)
        else:
            return
    if path.endswith("[]") and value is None:
        return
    out.append((path, ordinals, None if value is OBJECT else value))


def triples_of(payload: str | None) -> list[tuple[str, list[int], str | None]]:
    """Canonical triples of one payload; none where it is not complete JSON."""
    if not payload:
        return []
    try:
        scanned = list(scan(payload))
    except Incomplete:
        return []
    if scanned and scanned[0][1] not in (OBJECT, ARRAY):
        return []
    # An array around the record stands for its only element.
    if scanned and scanned[0][1] is ARRAY:
        if len(scanned) < 2 or scanned[1][1] is not OBJECT or any(s[:1] == (1,) for s, _ in scanned):
            return []
        scanned = [(s[1:], v) for s, v in scanned[1:]]
    for wrapper in WRAPPERS:
        n = len(wrapper)
        if any(s == wrapper and v is OBJECT for s, v in scanned):
            scanned = [(s[n:], v) for s, v in scanned if s[:n] == wrapper]
            break
    nested = any(s[:2] == ("issues", "issues") for s, _ in scanned)
    out: list[tuple[str, list[int], str | None]] = []
    for steps, value in scanned:
        _placed(steps, value, out, nested)
    return out


def triples(results: DataFrame, id_column: str = "result_id", payload_column: str = "payload") -> DataFrame:
    """(id, path, ordinals, value) of every record, each id once. Null ids are dropped; null, empty and cut-off
    payloads give nothing. Other columns are ignored."""
    schema = T._parse_datatype_string("id long, path string, ordinals array<int>, value string")
    arrow = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # One record at a time, so that a batch of large payloads is never held as triples at once.
                found = triples_of(payload)
                for start in range(0, len(found), 20_000):
                    part = found[start : start + 20_000]
                    columns = [[key] * len(part), [p for p, _, _ in part], [o for _, o, _ in part], [v for _, _, v in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ship(results.sparkSession)
    once = one_delivery(results, id_column, [payload_column]).select(F.col(id_column).alias("id"), F.col(payload_column).alias("payload"))
    return once.mapInArrow(over, schema)


def flat_table(found: DataFrame, ancestor: str, fields: list[str], id_column: str = "result_id") -> DataFrame:
    """Rows of one repeated ancestor: the id, parent_pos, child_pos and the fields as strings.

    parent_pos is the position of the element that holds the row (0 at the top), child_pos its own. Elements
    that are bare texts give their text as the first field. found is what triples() gave.
    """
    own = found.where((F.col("path") == ancestor) | F.col("path").isin([f"{ancestor}.{f}" for f in fields]))
    values = []
    for k, field in enumerate(fields):
        member = F.max(F.when(F.col("path") == f"{ancestor}.{field}", F.col("value")))
        values.append((F.coalesce(member, F.max(F.when(F.col("path") == ancestor, F.col("value")))) if k == 0 else member).alias(field))
    rows = own.groupBy("id", "ordinals").agg(F.count("*").alias("__triples"), *values)
    parent = F.when(F.size("ordinals") > 1, F.element_at("ordinals", -2)).otherwise(F.lit(0))
    return rows.select(F.col("id").alias(id_column), parent.alias("parent_pos"), F.element_at("ordinals", -1).alias("child_pos"), *fields)


def tables(results: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of crawl results, parsed once."""
    found = written(triples(results), "triples")
    return {name: flat_table(found, ancestor, fields) for name, (ancestor, fields) in TABLES.items()}


def child_records(results: DataFrame) -> DataFrame:
    """(result_id, kind, parent_pos, child_pos): one row for every row of the flat tables.

    The pivot groups triples by record, ancestor and ordinals at once; only keys are kept.
    """
    found = triples(results)
    kind = F.create_map(*[F.lit(x) for k, p in KINDS.items() for x in (p, k)])
    ancestor = F.regexp_extract("path", r"^(.*\[\])", 1)
    keyed = found.select("id", kind[ancestor].alias("kind"), "ordinals").where(F.col("kind").isNotNull())
    rows = keyed.groupBy("id", "kind", "ordinals").agg(F.count("*").alias("triples"))
    parent = F.when(F.size("ordinals") > 1, F.element_at("ordinals", -2)).otherwise(F.lit(0))
    return rows.select(F.col("id").alias("result_id"), "kind", parent.alias("parent_pos"), F.element_at("ordinals", -1).alias("child_pos"))
