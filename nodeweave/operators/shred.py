"""Nested records to related flat tables.

A record is parsed once into triples (path, ordinals, value): the path names the
fields on the way down with ``[]`` for each repeated step, the ordinals are the
positions taken at those steps. Triples with the same repeated ancestor and the
same ordinals make one row of that ancestor's table; the ordinals without the
last are the row's parent. All triples of a record come from one parse, so the
pivot happens where the record is and nothing but finished rows is shuffled.

``repeated`` names the paths that hold many members. At such a path a list is
taken as it is; an object whose keys are all numbers holds members at those
numbers; an object that is no such thing is one member at 0; text that is JSON
is parsed; other text is split at ``|``, ``;`` or ``,`` (only for paths in
``split_text``). A null member keeps its position and gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.session import spread

#: A child of a record: its level, its parent's position, its own, its key.
CHILD = "struct<level: string, parent_pos: int, child_pos: int, child_key: string>"

ROWS = T.StructType([
    T.StructField("record", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("ordinals", T.ArrayType(T.IntegerType())),
    T.StructField("cols", T.MapType(T.StringType(), T.StringType())),
])


def _scalar(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, separators=(",", ":"))


def parse_json(text: str | None) -> object:
    """The JSON value of a text, also within a code fence; None if it is none."""
    if text is None:
        return None
    s = text.strip()
    if s.startswith("```"):
        s = s.strip("`").strip()
        if s[:4].lower() == "json":
            s = s[4:]
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        return None


def fault_of(text: str | None) -> str:
    """Why a text gave no record."""
    if text is None or not text.strip():
        return "empty"
    try:
        json.loads(text)
    except RecursionError:
        return "nested too deeply"
    except ValueError:
        return "no complete JSON"
    return "no record in it"


def unwrap(value: object, marker: str, wrappers: tuple[str, ...]) -> dict | None:
    """The record within a value: an object with ``marker``, perhaps under one of the wrapper names, perhaps as text."""
    for _ in range(8):
        if isinstance(value, str):
            value = parse_json(value)
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, dict):
            if marker in value:
                return value
            inner = [value[w] for w in wrappers if w in value]
            if len(inner) != 1:
                return None
            value = inner[0]
        else:
            return None
    return None


def members(value: object, split_text: bool) -> list[tuple[int, object]]:
    """(position, member) at a repeated path, whatever shape it has."""
    if isinstance(value, str):
        s = value.strip()
        if s[:1] in ("[", "{"):
            parsed = parse_json(s)
            if isinstance(parsed, (list, dict)):
                return members(parsed, split_text)
        if not split_text or not s:
            return []
        mark = next((m for m in ("|", ";", ",") if m in s), None)
        return list(enumerate(x.strip() for x in s.split(mark))) if mark else [(0, s)]
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict):
        if value and all(k.isdigit() for k in value):
            return sorted((int(k), v) for k, v in value.items())
        return [(0, value)] if value else []
    return [] if value is None else [(0, value)]


def triples(record: dict, repeated: frozenset[str], split_text: frozenset[str], maps: frozenset[str], objects: frozenset[str]) -> Iterator[tuple[str, tuple[int, ...], str, object]]:
    """(ancestor, ordinals, field, value) of one record, depth first; ancestor is the nearest repeated path."""
    todo: list[tuple[str, str, tuple[int, ...], str, object]] = [("", "", (), "", record)]
    while todo:
        path, ancestor, at, field, value = todo.pop()
        if path in repeated:
            for i, m in members(value, path in split_text):
                if m is not None:
                    todo.append((path + "[]", path, (*at, i), "", m))
            continue
        if isinstance(value, str) and (path in objects or path in maps) and value.strip()[:1] == "{":
            value = parse_json(value)
        if path in maps:
            if isinstance(value, dict):
                for i, (k, v) in enumerate(value.items()):
                    yield path, (*at, i), "key", k
                    yield path, (*at, i), "value", v
            continue
        if isinstance(value, dict):
            for k, v in value.items():
                todo.append((f"{path}.{k}" if path else k, ancestor, at, f"{field}.{k}" if field else k, v))
        else:
            yield ancestor, at, field or "value", value


def _shredder(record_col: str, json_col: str, marker: str, wrappers: tuple[str, ...], repeated: frozenset, split_text: frozenset, maps: frozenset, objects: frozenset, tables: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for rid, text in zip(part.column(record_col).to_pylist(), part.column(json_col).to_pylist()):
                    value = parse_json(text)
                    record = unwrap(value, marker, wrappers) if marker else (value if isinstance(value, dict) else None)
                    rows: dict[tuple[str, tuple[int, ...]], dict[str, str | None]] = {}
                    if record is None:
                        rows["(unreadable)", ()] = {"body": text, "reason": fault_of(text)}
                    else:
                        for ancestor, at, field, v in triples(record, repeated, split_text, maps, objects):
                            rows.setdefault((ancestor, at), {})[field] = _scalar(v)
                    for (ancestor, at), cols in rows.items():
                        if tables is None or ancestor in tables:
                            out[0].append(rid)
                            out[1].append(ancestor)
                            out[2].append(at)
                            out[3].append(list(cols.items()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], kind)], ["record", "table", "ordinals", "cols"]
                )

    return run


def shred(df: DataFrame, record_col: str, json_col: str, repeated: list[str], split_text: list[str] = (), maps: list[str] = (), objects: list[str] = (), marker: str = "", wrappers: tuple[str, ...] = (), tables: list[str] | None = None) -> DataFrame:
    """(record, table, ordinals, cols): one row for each member of each repeated path of the JSON texts.

    ``table`` is the repeated path (the record itself is the table named by the
    empty string), ``ordinals`` the positions on the way to the row and ``cols`` its
    fields as text. ``maps`` are paths whose keys are data: a row (key, value) each.
    ``objects`` are paths whose object may be delivered as JSON text. A text that
    holds no record (null, empty, cut off, no object, without ``marker`` under any
    wrapper) gives one row of the table ``(unreadable)`` with its reason. ``tables`` keeps only
    those tables. Repeated records are not dropped here. Fields unknown to a
    caller stay in ``cols``.
    """
    picked = df.select(F.col(record_col).cast("string").alias("r"), F.col(json_col).alias("j"))
    return spread(picked).mapInArrow(
        _shredder("r", "j", marker, tuple(wrappers), frozenset(repeated), frozenset(split_text), frozenset(maps), frozenset(objects), None if tables is None else frozenset(tables)), ROWS
    )


def child(level: str, parent: Column, pos: Column, key: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), parent.cast("int").alias("parent_pos"), pos.cast("int").alias("child_pos"), key.alias("child_key"))


def members_of(level: str, items: Column, key: Callable[[Column], Column]) -> Column:
    """The children that a typed array holds, as an array; a null member keeps its position and gives none."""
    return F.transform(items, lambda x, i: F.when(x.isNotNull(), child(level, F.lit(-1), i, key(x))))


def inner_members_of(level: str, items: Column, inner: Callable[[Column], Column]) -> Column:
    """The children that a typed array of texts within each member of an array holds."""
    return F.flatten(F.transform(items, lambda x, i: F.coalesce(F.transform(inner(x), lambda y, j: F.when(y.isNotNull(), child(level, i, j, y))), F.array().cast(f"array<{CHILD}>"))))


def children_of(*parts: Column) -> Column:
    """All children of a record, without the gaps that null members leave."""
    none = F.array().cast(f"array<{CHILD}>")
    return F.array_compact(F.concat(*[F.coalesce(p, none) for p in parts]))


def flat_table(rows: DataFrame, name: str, fields: list[tuple[str, str]]) -> DataFrame:
    """The table of one repeated path: record, the parent's position (-1 at the record), its own, then its fields (name, type).

    The link to the parent is (record, parent_pos). Null fields stay null, so does a text that is no value of its type.
    """
    own = rows.filter(F.col("table") == name)
    size = F.size("ordinals")
    keys = [F.col("record"), F.when(size > 1, F.get("ordinals", size - 2)).otherwise(F.lit(-1)).alias("parent_pos"), F.when(size > 0, F.get("ordinals", size - 1)).otherwise(F.lit(-1)).alias("pos")]
    return own.select(*keys, *[F.col("cols")[f].try_cast(kind).alias(f.replace(".", "_")) for f, kind in fields])
