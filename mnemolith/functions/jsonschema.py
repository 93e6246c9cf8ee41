"""JSON Schema validation of JSON texts: a schema compiles to one column over VARIANT values.

Covers what record schemas use: type, const, enum, required, properties, additionalProperties, items,
contains, pattern, length, size and number bounds, allOf, anyOf, oneOf, not, if/then/else and local $ref.
`errors` is the same for a single value in Python. Only texts that VARIANT can't hold (no JSON, or with keys
that repeat) and schemas that refer to themselves are looked at there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
}


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def errors(value, schema, root: dict | None = None, path: str = "$") -> Iterator[str]:
    """`path: message` for every violation, in the order of the schema's checks."""
    root = schema if root is None else root
    if schema is True:
        return
    if schema is False:
        yield f"{path}: not allowed"
        return
    if "$ref" in schema:
        target = root
        for part in filter(None, schema["$ref"].lstrip("#").split("/")):
            target = target[part]
        yield from errors(value, target, root, path)
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            yield f"{path}: is not of type {' or '.join(kinds)}"
            return
    if "const" in schema and not _same(value, schema["const"]):
        yield f"{path}: is not {json.dumps(schema['const'])}"
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        yield f"{path}: is not one of {json.dumps(schema['enum'])}"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            yield f"{path}: has a wrong length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{path}: does not match {schema['pattern']}"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            yield f"{path}: is out of range"
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            yield f"{path}: has a wrong number of items"
        if "items" in schema:
            for i, item in enumerate(value):
                yield from errors(item, schema["items"], root, f"{path}[{i}]")
        if "contains" in schema and not any(valid(item, schema["contains"], root) for item in value):
            yield f"{path}: contains no required item"
    elif isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                yield f"{path}: {name} is missing"
        known = schema.get("properties", {})
        rest = schema.get("additionalProperties", True)
        for name, member in value.items():
            if name in known:
                yield from errors(member, known[name], root, f"{path}.{name}")
            elif rest is False:
                yield f"{path}: {name} is unknown"
            elif rest is not True:
                yield from errors(member, rest, root, f"{path}.{name}")
    for part in schema.get("allOf", ()):
        yield from errors(value, part, root, path)
    if "anyOf" in schema and not any(valid(value, s, root) for s in schema["anyOf"]):
        yield f"{path}: fits none of the alternatives"
    if "oneOf" in schema and sum(valid(value, s, root) for s in schema["oneOf"]) != 1:
        yield f"{path}: fits not exactly one of the alternatives"
    if "not" in schema and valid(value, schema["not"], root):
        yield f"{path}: fits what it must not"
    if "if" in schema:
        branch = schema.get("then" if valid(value, schema["if"], root) else "else", True)
        yield from errors(value, branch, root, path)


def valid(value, schema, root: dict | None = None) -> bool:
    return next(errors(value, schema, root), None) is None


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class _Recursive(Exception):
    """A schema that refers to itself has no column."""


_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


class _Compiler:
    """Columns of ARRAY<STRING>: the violations of a VARIANT column, in the order of the schema."""

    def __init__(self, root: dict) -> None:
        self.root = root
        self.none = F.array().cast("array<string>")

    def _message(self, path: Column, text: str | Column) -> Column:
        return F.concat(path, F.lit(": "), F.lit(text) if isinstance(text, str) else text)

    def _if(self, wrong: Column, path: Column, text: str | Column) -> Column:
        return F.when(wrong, F.array(self._message(path, text))).otherwise(self.none)

    def _is(self, name: str, value: Column, kind: Column) -> Column:
        number = kind.rlike(_NUMBER)
        whole = F.try_variant_get(value, "$", "double")
        return {
            "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": number,
            "integer": number & (kind.startswith("BIGINT") | F.coalesce(whole == F.rint(whole), F.lit(False))),
        }[name]

    def _equals(self, value: Column, kind: Column, wanted) -> Column:
        if isinstance(wanted, bool):
            return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "boolean") == wanted, F.lit(False))
        if isinstance(wanted, (int, float)):
            return kind.rlike(_NUMBER) & F.coalesce(F.try_variant_get(value, "$", "double") == float(wanted), F.lit(False))
        if isinstance(wanted, str):
            return (kind == "STRING") & F.coalesce(F.try_variant_get(value, "$", "string") == wanted, F.lit(False))
        if wanted is None:
            return kind == "VOID"
        return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))

    def errors(self, value: Column, schema, path: Column, refs: tuple[str, ...] = ()) -> Column:
        if schema is True:
            return self.none
        if schema is False:
            return F.array(self._message(path, "not allowed"))
        if "$ref" in schema:
            if schema["$ref"] in refs:
                raise _Recursive
            target = self.root
            for part in filter(None, schema["$ref"].lstrip("#").split("/")):
                target = target[part]
            return self.errors(value, target, path, (*refs, schema["$ref"]))
        scalar = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        kinds = schema.get("type", ())
        if not ({"properties", "required", "additionalProperties"} & schema.keys() or "object" in kinds):
            return let(scalar, lambda kind: self._checks(value, kind, None, schema, path, refs))
        # The schema of a whole object would be worked out for nothing: that it has members says enough.
        kind_of = lambda members: F.when(members.isNotNull(), "OBJECT").otherwise(scalar)
        return let(F.try_variant_get(value, "$", "map<string,variant>"), lambda members: let(kind_of(members), lambda kind: self._checks(value, kind, members, schema, path, refs)))

    def _checks(self, value: Column, kind: Column, members: Column | None, schema: dict, path: Column, refs: tuple[str, ...]) -> Column:
        valid = lambda part: F.size(self.errors(value, part, path, refs)) == 0
        found: list[Column] = []
        if "const" in schema:
            found.append(self._if(~self._equals(value, kind, schema["const"]), path, f"is not {json.dumps(schema['const'])}"))
        if "enum" in schema:
            known = F.lit(False)
            for wanted in schema["enum"]:
                known = known | self._equals(value, kind, wanted)
            found.append(self._if(~known, path, f"is not one of {json.dumps(schema['enum'])}"))
        found += self._text(value, kind, schema, path) + self._number(value, kind, schema, path) + self._list(value, kind, schema, path, refs) + self._object(kind, members, schema, path, refs)
        found += [self.errors(value, part, path, refs) for part in schema.get("allOf", ())]
        if "anyOf" in schema:
            fits = F.lit(False)
            for part in schema["anyOf"]:
                fits = fits | valid(part)
            found.append(self._if(~fits, path, "fits none of the alternatives"))
        if "oneOf" in schema:
            fitting = F.lit(0)
            for part in schema["oneOf"]:
                fitting = fitting + valid(part).cast("int")
            found.append(self._if(fitting != 1, path, "fits not exactly one of the alternatives"))
        if "not" in schema:
            found.append(self._if(valid(schema["not"]), path, "fits what it must not"))
        if "if" in schema:
            found.append(F.when(valid(schema["if"]), self.errors(value, schema.get("then", True), path, refs)).otherwise(self.errors(value, schema.get("else", True), path, refs)))
        out = F.concat(*found) if len(found) > 1 else found[0] if found else self.none
        kinds = schema.get("type")
        if kinds is None:
            return out
        kinds = [kinds] if isinstance(kinds, str) else kinds
        right = F.lit(False)
        for name in kinds:
            right = right | self._is(name, value, kind)
        return F.when(right, out).otherwise(F.array(self._message(path, f"is not of type {' or '.join(kinds)}")))

    def _text(self, value: Column, kind: Column, schema: dict, path: Column) -> list[Column]:
        text, mine, out = F.try_variant_get(value, "$", "string"), kind == "STRING", []
        if {"minLength", "maxLength"} & schema.keys():
            size = F.length(text)
            out.append(self._if(mine & ((size < schema.get("minLength", 0)) | (size > schema.get("maxLength", 1 << 31))), path, "has a wrong length"))
        if "pattern" in schema:
            out.append(self._if(mine & ~text.rlike(schema["pattern"]), path, f"does not match {schema['pattern']}"))
        return out

    def _number(self, value: Column, kind: Column, schema: dict, path: Column) -> list[Column]:
        if not {"minimum", "maximum"} & schema.keys():
            return []
        number, beyond = F.try_variant_get(value, "$", "double"), F.lit(False)
        if "minimum" in schema:
            beyond = beyond | (number < schema["minimum"])
        if "maximum" in schema:
            beyond = beyond | (number > schema["maximum"])
        return [self._if(kind.rlike(_NUMBER) & beyond, path, "is out of range")]

    def _list(self, value: Column, kind: Column, schema: dict, path: Column, refs: tuple[str, ...]) -> list[Column]:
        items, mine, out = F.try_variant_get(value, "$", "array<variant>"), kind.startswith("ARRAY"), []
        if {"minItems", "maxItems"} & schema.keys():
            size = F.size(items)
            out.append(self._if(mine & ((size < schema.get("minItems", 0)) | (size > schema.get("maxItems", 1 << 31))), path, "has a wrong number of items"))
        if "items" in schema and schema["items"] is not True:
            each = F.transform(items, lambda x, i: self.errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), refs))
            out.append(F.when(mine, F.flatten(each)).otherwise(self.none))
        if "contains" in schema:
            there = F.exists(items, lambda x: F.size(self.errors(x, schema["contains"], path, refs)) == 0)
            out.append(self._if(mine & ~F.coalesce(there, F.lit(False)), path, "contains no required item"))
        return out

    def _object(self, kind: Column, members: Column | None, schema: dict, path: Column, refs: tuple[str, ...]) -> list[Column]:
        known, rest, mine = schema.get("properties", {}), schema.get("additionalProperties", True), kind.startswith("OBJECT")
        if not known and rest is True and not schema.get("required"):
            return []
        return [F.when(mine, self._members(members, known, rest, schema.get("required", ()), path, refs)).otherwise(self.none)]

    def _then(self, schema, path: Column, refs: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda value: self.errors(value, schema, path, refs)

    def _members(self, members: Column, known: dict, rest, required: Sequence[str], path: Column, refs: tuple[str, ...]) -> Column:
        out = [self._if(~F.map_contains_key(members, name), path, f"{name} is missing") for name in required]
        for name, part in known.items():
            found = let(F.try_element_at(members, F.lit(name)), self._then(part, F.concat(path, F.lit(f".{name}")), refs))
            out.append(F.when(F.map_contains_key(members, name), found).otherwise(self.none))
        if rest is not True:
            more = F.array_except(F.map_keys(members), F.array(*map(F.lit, known)).cast("array<string>"))
            if rest is False:
                out.append(F.transform(more, lambda k: self._message(path, F.concat(k, F.lit(" is unknown")))))
            else:
                out.append(F.flatten(F.transform(more, lambda k: self.errors(F.try_element_at(members, k), rest, F.concat(path, F.lit("."), k), refs))))
        return F.concat(*out) if len(out) > 1 else out[0] if out else self.none


def schema_errors(text: Column, schema: dict) -> Column:
    """ARRAY<STRING> of violations of a JSON text, in the order of the schema; null and texts that are no JSON have one."""

    @arrow_udf("array<string>")
    def check(texts: pa.Array) -> pa.Array:
        out: list[list[str] | None] = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            try:
                value = json.loads(t)
            except ValueError:
                out.append(["$: is no JSON"])
                continue
            out.append(list(errors(value, schema)))
        return pa.array(out, pa.list_(pa.string()))

    nothing = F.array(F.lit("$: is no JSON"))
    try:
        compiler = _Compiler(schema)
        compiled = let(F.try_parse_json(text), lambda value: F.when(value.isNotNull(), compiler.errors(value, schema, F.lit("$"))))
    except _Recursive:
        return F.coalesce(check(text), nothing)
    # Texts that VARIANT holds don't leave the JVM: what the function gets for them is null.
    return F.coalesce(compiled, check(F.when(F.try_parse_json(text).isNull(), text)), nothing)
