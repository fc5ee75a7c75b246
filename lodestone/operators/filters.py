"""The document filter language compiled to columns, in its two dialects.

`cli` is the JSON filter, `viewer` the query language's; they differ on object
operands and unknown operators. Values are compared by strict type: a number never
equals a string, JSON null differs from a missing path, and $ne and $nin hold for
missing paths. Paths resolve in a VARIANT column, or in plain columns, where
comparisons reach the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..types import FilterError

class Field:
    """A resolved path: how to test its type and read it."""

    def exists(self) -> Column:
        raise NotImplementedError

    def equals(self, value: Any) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        """The number there, or null."""
        raise NotImplementedError

    def string(self) -> Column:
        raise NotImplementedError


class VariantField(Field):
    def __init__(self, value: Column):
        self.value = value
        self.kind = F.schema_of_variant(value)

    def exists(self) -> Column:
        return self.value.isNotNull()

    def number(self) -> Column:
        return F.when(self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.value, "$", "double"))

    def string(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.value, "$", "string"))

    def equals(self, value: Any) -> Column:
        if value is None:
            return F.coalesce(F.is_variant_null(self.value) & self.value.isNotNull(), F.lit(False))
        if isinstance(value, bool):
            return F.coalesce((self.kind == "BOOLEAN") & (F.try_variant_get(self.value, "$", "boolean") == value), F.lit(False))
        if isinstance(value, int | float):
            return F.coalesce(self.number() == float(value), F.lit(False))
        if isinstance(value, str):
            return F.coalesce(self.string() == value, F.lit(False))
        return F.lit(False)  # arrays and objects are equal only to themselves


class PlainField(Field):
    """A column of a scalar type; SQL NULL is a missing path. Tests are written so that they are never null and reach the scan."""

    def __init__(self, value: Column, kind: str):
        self.value, self.kind = value, kind

    def exists(self) -> Column:
        return self.value.isNotNull()

    def number(self) -> Column:
        return self.value if re.match("tinyint|smallint|int|bigint|float|double|decimal", self.kind) else F.lit(None).cast("double")

    def string(self) -> Column:
        return self.value if self.kind == "string" else F.lit(None).cast("string")

    def equals(self, value: Any) -> Column:
        same = {bool: self.kind == "boolean", str: self.kind == "string"}.get(type(value), isinstance(value, int | float) and bool(re.match("tinyint|smallint|int|bigint|float|double|decimal", self.kind)))
        return self.value.isNotNull() & (self.value == F.lit(value)) if same and value is not None else F.lit(False)


def variant_path(root: Column, path: str) -> Column:
    """A dotted path: keys, array positions, and the length of arrays; null where missing."""
    value = root
    for part in path.split("."):
        quoted = "$[" + json.dumps(part, ensure_ascii=False) + "]"
        found = F.try_variant_get(value, quoted, "variant")
        if part.isdigit():
            found = F.coalesce(found, F.try_variant_get(value, f"$[{int(part)}]", "variant"))
        elif part == "length":
            array = F.try_variant_get(value, "$", "array<variant>")
            found = F.coalesce(found, F.parse_json(F.when(F.schema_of_variant(value).startswith("ARRAY"), F.size(array).cast("string"))))
        value = found
    return value


def variant_resolver(context: str = "context", ident: Column | None = None, dialect: str = "cli") -> Callable[[str], Field]:
    """cli: paths are context paths, `context.` optional, id is never there. viewer: id, context or context.*."""

    def resolve(path: str) -> Field:
        root = F.col(context)
        if dialect == "cli":
            if path == "id":
                return VariantField(F.parse_json(F.lit(None).cast("string")))
            return VariantField(variant_path(root, path.removeprefix("context.")))
        if path == "id" and ident is not None:
            return PlainField(ident, "string")
        if path == "context":
            return VariantField(root)
        if path.startswith("context."):
            return VariantField(variant_path(root, path.removeprefix("context.")))
        return VariantField(F.parse_json(F.lit(None).cast("string")))

    return resolve


def column_resolver(schema, dialect: str = "cli") -> Callable[[str], Field]:
    """Paths are column names, with `context.` in front if wished."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}

    def resolve(path: str) -> Field:
        name = path.removeprefix("context.")
        return PlainField(F.col(f"`{name}`"), kinds[name]) if name in kinds else PlainField(F.lit(None).cast("string"), "string")

    return resolve


def pattern_error(pattern: str) -> str | None:
    """What java.util.regex, which will run the pattern, has against it; Python's view where no session is active."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?i)" + pattern) if spark else re.compile(pattern)
    except re.error as e:
        return str(e)
    except (IllegalArgumentException, Py4JJavaError) as e:
        return str(e).splitlines()[0]
    return None


def _operator(field: Field, op: str, operand: Any, dialect: str) -> Column:
    false, true = F.lit(False), F.lit(True)
    if op == "$eq":
        return field.equals(operand)
    if op == "$ne":
        return ~field.equals(operand)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if isinstance(operand, bool) or not isinstance(operand, int | float):
            return false
        n = field.number()
        holds = {"$gt": n > operand, "$gte": n >= operand, "$lt": n < operand, "$lte": n <= operand}[op]
        if isinstance(field, PlainField):
            # NaN is above all numbers to Spark, and unordered here
            return n.isNotNull() & holds & ~F.isnan(n) if field.kind in ("float", "double") and op in ("$gt", "$gte") else n.isNotNull() & holds
        return F.coalesce(holds, false)
    if op in ("$in", "$nin"):
        if not isinstance(operand, list):
            return false
        any_ = false
        for value in operand:
            any_ = any_ | field.equals(value)
        return any_ if op == "$in" else ~any_
    if op == "$regex":
        if not isinstance(operand, str):
            return false
        if (error := pattern_error(operand)) is not None:
            if dialect == "viewer":
                return false
            raise FilterError(f"bad pattern {operand!r}: {error}") from None
        return F.coalesce(field.string().rlike("(?i)" + operand), false)
    if op == "$exists":
        return field.exists() if operand else ~field.exists()
    if dialect == "viewer":
        raise FilterError(f"Unknown operator {op}")
    return true


def _condition(field: Field, condition: Any, dialect: str) -> Column:
    if isinstance(condition, list):
        return F.lit(False)
    if isinstance(condition, dict):
        if dialect == "viewer" and not any(k.startswith("$") for k in condition):
            return F.lit(False)
        out = F.lit(True)
        for op, operand in condition.items():
            out = out & _operator(field, op, operand, dialect)
        return out
    return field.equals(condition)


def compile_filter(spec: dict | str, resolve: Callable[[str], Field], dialect: str = "cli") -> Column:
    """A boolean column, never null."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise FilterError(f"filter is not JSON: {e}") from None
    if not isinstance(spec, dict):
        raise FilterError("filter must be an object")
    out = F.lit(True)
    for key, condition in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(condition, list):
                raise FilterError(f"{key} needs a list")
            parts = [compile_filter(x, resolve, dialect) for x in condition]
            both = F.lit(key == "$and")
            for p in parts:
                both = both & p if key == "$and" else both | p
            out = out & both
        else:
            out = out & _condition(resolve(key), condition, dialect)
    return out
