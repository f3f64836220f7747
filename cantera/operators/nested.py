"""Deeply nested records to related flat tables.

JSON text of any shape is parsed once to variants; level by level objects and arrays are
exploded into a row per object with the link to its record and to the enclosing object; the
merged schema is an aggregate of those rows, and each object path becomes a typed child
table.  Typed nested columns need no parsing: every array level is one posexplode.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Cut

KEYS = ("record_id", "parent_ord", "ord")
#: So many levels are exploded round by round; what lies deeper is walked text by text.
LEVELS = 24
OBJECTS = "record_id bigint, table_path string, parent_path string, obj_path string, ord int, fields map<string,string>"


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _parsed(text: str):
    """The value of a JSON text nested however deep; whole numbers keep their text.

    Raises ValueError where the text is no JSON.
    """
    top: list = []
    stack: list[tuple] = [(top, None)]  # open containers, each with the member name it waits to fill
    at, want = _SPACE.match(text).end(), "value"  # else "first" (value or end), "name", "names" (name or end), "next"
    while True:
        held, name = stack[-1]
        c = text[at : at + 1]
        if want == "next":
            if len(stack) == 1:
                if c:
                    raise ValueError("more after the value")
                return top[0]
            if c == ",":
                at, want = at + 1, "name" if isinstance(held, dict) else "value"
            elif c and c == ("}" if isinstance(held, dict) else "]"):
                stack.pop()
                at += 1
            else:
                raise ValueError("no comma")
        elif (want == "names" and c == "}") or (want == "first" and c == "]"):
            stack.pop()
            at, want = at + 1, "next"
        elif want in ("name", "names"):
            if c != '"':
                raise ValueError("no name")
            name, at = json.decoder.scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            stack[-1] = (held, name)
            at, want = at + 1, "value"
        else:
            want, opened = "next", None
            if c in ("{", "[") and c:
                value = opened = {} if c == "{" else []
                at, want = at + 1, "names" if c == "{" else "first"
            elif c == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
            elif found := _NUMBER.match(text, at):
                value, at = found.group(), found.end()
                value = value if value.lstrip("-").isdigit() else float(value)
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError("no value")
                value, at = _WORDS[word], at + len(word)
            if isinstance(held, dict):
                held[name] = value
            else:
                held.append(value)
            if opened is not None:
                stack.append((opened, None))
        at = _SPACE.match(text, at).end()


def _objects(text: str | None, shape: str = "", owner: str = "", path: str = "", at: int = 0) -> list[tuple]:
    """``(table_path, parent_path, obj_path, ord, fields)`` of every object below the record.

    The record itself comes first with path ''.  Null, blank and invalid payloads and
    payloads without an object or array give nothing.
    """
    if text is None or not text.strip():
        return []
    try:
        top = json.loads(text, parse_constant=_no_constant, parse_int=str)
    except RecursionError:
        try:
            top = _parsed(text)
        except ValueError:
            return []
    except ValueError:
        return []
    out: list[tuple] = []
    todo = [(top, shape, path, owner, at)]
    while todo:
        value, shape, path, owner, at = todo.pop()
        if isinstance(value, dict):
            flat: list[tuple[str, str | None]] = []
            out.append((shape, owner, path, at, flat))
            for name, x in value.items():
                if isinstance(x, (dict, list)):
                    todo.append((x, f"{shape}.{name}" if shape else name, f"{path}.{name}" if path else name, path, 0))
                elif x is None or isinstance(x, str):
                    flat.append((name, x))
                else:
                    flat.append((name, json.dumps(x)))
        elif isinstance(value, list):
            for i, x in enumerate(value):
                if isinstance(x, (dict, list)):
                    todo.append((x, f"{shape}[]", f"{path}.{i}" if path else str(i), owner, i))
    return out


def _walked(rest: DataFrame) -> DataFrame:
    """The objects of texts that the parser of the JVM leaves: nested beyond its limit or beyond
    ``LEVELS``, with a member named twice; what is no JSON gives nothing."""
    kind = pa.schema([("record_id", pa.int64()), ("table_path", pa.string()), ("parent_path", pa.string()), ("obj_path", pa.string()), ("ord", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, *given in zip(*(c.to_pylist() for c in batch.columns)) for x in _objects(*given)]
            columns = list(zip(*rows)) if rows else [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return rest.mapInArrow(walk, OBJECTS)


def _as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _members(value: Column) -> Column:
    """The scalar members of an object as text."""
    plain = F.filter(F.map_entries(_as_object(value)), lambda e: ~F.schema_of_variant(e["value"]).rlike("^(OBJECT|ARRAY)"))
    return F.map_from_entries(F.transform(plain, lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$", "string"))))


def json_objects(df: DataFrame, record_id: str, payload: str) -> DataFrame:
    """One row per JSON object in ``payload``: ``record_id, table_path, parent_path, obj_path,
    ord, fields`` (scalar members as text, null members kept).

    ``obj_path`` joins member names and zero-based positions by ``.`` and is, with the record,
    the key of the object; ``parent_path`` that of the enclosing one; ``ord`` is the position
    in the enclosing array; ``table_path`` is the path without positions
    (``decomposition[].decomposition[]``).  The record itself has path ''.  Null, blank and
    invalid payloads give no rows.

    Each round explodes one level of objects and arrays into a table of its own.
    """
    text = F.col(payload)
    # the parser ignores what follows a value, so a payload must be whole inside both brackets
    whole = F.when(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull(), F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant"))
    named = df.select(F.col(record_id).cast("bigint").alias("record_id"), text.alias("raw"), whole.alias("value"))
    top = Cut(named.select("record_id", F.when(F.col("value").isNull() & F.col("raw").rlike(r"[{\[]"), F.col("raw")).alias("raw"), "value")).rows
    none = F.lit("")
    keys = ["record_id", "table_path", "parent_path", "obj_path", "ord"]
    start = [none.alias("table_path"), none.alias("parent_path"), none.alias("obj_path"), F.lit(0).alias("ord")]
    found = [_walked(top.filter("raw is not null").select("record_id", "raw", *start))]
    level = top.filter("value is not null").select("record_id", *start, "value")
    for depth in range(LEVELS + 1):
        kept = level.withColumn("is_object", _as_object(F.col("value")).isNotNull()).filter(F.col("is_object") | _as_array(F.col("value")).isNotNull())
        done = Cut(kept, n=F.count(F.lit(1)))
        if not done.counts["n"]:
            break
        if depth == LEVELS:
            found.append(_walked(done.rows.select("record_id", F.to_json("value").alias("raw"), "table_path", "parent_path", "obj_path", "ord")))
            break
        found.append(done.rows.filter("is_object").select(*keys, _members(F.col("value")).alias("fields")))
        dot = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(c, F.lit(".")))
        inside = done.rows.filter("is_object").select("record_id", "table_path", "obj_path", F.explode(F.map_entries(_as_object(F.col("value")))).alias("e"))
        inside = inside.select("record_id", F.concat(dot("table_path"), "e.key").alias("table_path"), F.col("obj_path").alias("parent_path"), F.concat(dot("obj_path"), "e.key").alias("obj_path"), F.lit(0).alias("ord"), F.col("e.value").alias("value"))
        listed = done.rows.filter("not is_object").select("record_id", "table_path", "parent_path", "obj_path", F.posexplode(_as_array(F.col("value"))).alias("ord", "value"))
        listed = listed.select("record_id", F.concat("table_path", F.lit("[]")).alias("table_path"), "parent_path", F.concat(dot("obj_path"), "ord").alias("obj_path"), "ord", "value")
        level = inside.unionByName(listed)
    return reduce(DataFrame.unionByName, [f.toDF(*keys, "fields") for f in found])


def json_links(df: DataFrame, record_id: str, payload: str) -> DataFrame:
    """``record_id, parent_path, obj_path`` of every nested object, from the tables of the levels."""
    return json_objects(df, record_id, payload).filter("table_path <> ''").select("record_id", "parent_path", "obj_path")


def merged_schema(objects: DataFrame) -> DataFrame:
    """``table_path, field, kind, n, n_null``: the members seen at each path over all records.

    ``kind`` is the narrowest of boolean, bigint, double and string that holds every value
    (a decimal comma counts as a decimal point, so numbers sent as text become numbers).
    """
    each = objects.select("table_path", F.explode("fields").alias("field", "value"))
    point = F.regexp_replace("value", ",", ".")
    seen = each.groupBy("table_path", "field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.coalesce(F.bool_and(F.col("value").isin("true", "false")), F.lit(False)).alias("as_bool"),
        F.coalesce(F.bool_and(F.col("value").rlike(r"^-?\d{1,18}$")), F.lit(False)).alias("as_long"),
        F.coalesce(F.bool_and(point.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")), F.lit(False)).alias("as_double"),
    )
    kind = F.when(F.col("as_bool"), "boolean").when(F.col("as_long"), "bigint").when(F.col("as_double"), "double").otherwise("string")
    return seen.select("table_path", "field", kind.alias("kind"), "n", "n_null")


def child_table(objects: DataFrame, table_path: str, schema: list[tuple[str, str]]) -> DataFrame:
    """The typed flat table of one object path: ``record_id, parent_path, obj_path, ord`` and
    the members ``(field, kind)``; a member that clashes with a key column, or with another
    member but for case, gets ``_`` appended.
    """
    own = {"record_id", "parent_path", "obj_path", "ord"}
    typed = []
    for field, kind in schema:
        value = F.col("fields")[field]
        if kind in ("bigint", "double"):
            value = F.regexp_replace(value, ",", ".").try_cast(kind)
        elif kind == "boolean":
            value = value.try_cast("boolean")
        name = field
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        typed.append(value.alias(name))
    return objects.filter(F.col("table_path") == table_path).select("record_id", "parent_path", "obj_path", "ord", *typed)


def child_tables(objects: DataFrame) -> dict[str, DataFrame]:
    """The typed flat table of every object path, driven by the merged schema: all members at
    the path in order of their names; a path whose objects have no members has the keys only.

    Only the paths and the merged schema come to the driver.
    """
    fields = {r[0]: [] for r in objects.select("table_path").distinct().toLocalIterator()}
    for r in merged_schema(objects).orderBy("table_path", "field").toLocalIterator():
        fields[r["table_path"]].append((r["field"], r["kind"]))
    return {path: child_table(objects, path, schema) for path, schema in fields.items()}


def explode_nested(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every array-of-struct level of a typed table as a child table, keyed by its path.

    Each child row has ``record_id`` (the key of the record), ``parent_ord`` (the positions of
    the enclosing rows joined by ``.``), ``ord`` and the scalar members; struct members are
    flattened with ``_`` between the names, and a member that clashes with a key column gets
    ``_`` appended.
    """
    out: dict[str, DataFrame] = {}

    def scalars(schema: T.StructType, at: str, name: str = "") -> list:
        cols = []
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                cols += scalars(f.dataType, f"{at}`{f.name}`.", f"{name}{f.name}_")
            elif not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
                cols.append(F.col(f"{at}`{f.name}`").alias(f"{name}{f.name}" + "_" * (f"{name}{f.name}" in KEYS)))
        return cols

    def arrays(schema: T.StructType, at: str, name: str = "") -> list[tuple[str, str, T.StructType]]:
        found = []
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                found += arrays(f.dataType, f"{at}`{f.name}`.", f"{name}{f.name}.")
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                found.append((f"{at}`{f.name}`", f"{name}{f.name}", f.dataType.elementType))
        return found

    def descend(rows: DataFrame, schema: T.StructType, at: str, path: str) -> None:
        for column, name, element in arrays(schema, at):
            full = f"{path}.{name}" if path else name
            child = rows.select("record_id", F.concat_ws(".", F.when(F.col("parent_ord") != "", F.col("parent_ord")), F.col("ord").cast("string")).alias("parent_ord"), F.posexplode(column).alias("ord", "row"))
            child_rows = child.filter("row is not null")
            out[full] = child_rows.select("record_id", "parent_ord", "ord", *scalars(element, "row."))
            descend(child_rows, element, "row.", full)

    base = df.select(F.col(key).alias("record_id"), F.lit("").alias("parent_ord"), F.lit(None).cast("int").alias("ord"), F.struct(*df.columns).alias("row"))
    descend(base, df.schema, "row.", "")
    return out
