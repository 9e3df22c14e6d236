"""Arrays and documents: list-or-scalar fields, dotted paths, sweeping, reshaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as empty.
EMPTY_VALUES = (".", "-", "", "NA", "none", " ", "Not Available", "unknown")


def as_list(x: Column) -> Column:
    """Null is an empty list, a scalar a list of one."""
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def normalised(xs: Column, sort: bool = True) -> Column:
    """Without empty values and repeats, sorted."""
    kept = F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & ~x.cast("string").isin("", "0", "0.0", "false")))
    return F.array_sort(kept) if sort else kept


def scalar_or_list(xs: Column, sep: str = "|") -> Column:
    """A list of one as its element, a longer one in brackets."""
    return F.when(F.size(xs) == 1, F.get(xs, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(xs, sep), F.lit("]")))


def append_unseen(a: Column, b: Column) -> Column:
    """``a`` and then what of ``b`` is not in it, in order."""
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(a, x)))


def without_positions(xs: Column, positions: list[int]) -> Column:
    return F.filter(xs, lambda x, i: ~i.isin(*positions))


def items(xs: Column, *positions: int) -> Column:
    return F.array(*[F.get(xs, F.lit(i)) for i in positions])


def swept(x: Column, values=EMPTY_VALUES) -> Column:
    """Null for a value that counts as empty."""
    return F.when(~x.isin(*values), x)


def swept_list(xs: Column, values=EMPTY_VALUES) -> Column:
    kept = F.filter(xs, lambda x: x.isNotNull() & ~x.isin(*values))
    return F.when(F.size(kept) > 0, kept)


def list_length(xs: Column) -> Column:
    return F.coalesce(F.when(xs.isNotNull(), F.size(xs)), F.lit(0)).cast("bigint")


def _is_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType)


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType, bool]]:
    """(dotted path, type, whether a list lies on the way) of each leaf."""
    out = []
    for field in schema.fields:
        kind, many = field.dataType, False
        while _is_array(kind):
            kind, many = kind.elementType, True
        path = prefix + field.name
        if isinstance(kind, T.StructType):
            out += [(p, k, many or m) for p, k, m in leaves(kind, path + ".")]
        else:
            out.append((path, kind, many))
    return out


def values_at(schema: T.StructType, path: str, base: Column | None = None) -> Column:
    """All values at a dotted path, through lists, as one flat array."""
    head, _, rest = path.partition(".")
    field = schema[head]
    here = F.col(head) if base is None else base.getField(head)
    kind = field.dataType
    if _is_array(kind):
        element = kind.elementType
        if not rest:
            return F.coalesce(here, F.array().cast(kind))
        deeper = F.transform(here, lambda x: values_at(element, rest, x))
        return F.coalesce(F.flatten(deeper), F.array().cast(T.ArrayType(_leaf_type(element, rest))))
    if rest:
        return values_at(kind, rest, here)
    return F.when(here.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(here))


def _leaf_type(kind: T.DataType, path: str) -> T.DataType:
    for name in path.split("."):
        while _is_array(kind):
            kind = kind.elementType
        kind = kind[name].dataType
    while _is_array(kind):
        kind = kind.elementType
    return kind


def map_at(kind: T.DataType, value: Column, path: list[str], f: Callable[[Column], Column | None]) -> Column:
    """The value with ``f`` applied at a path, through lists; ``f`` returning None drops the field."""
    if _is_array(kind):
        return F.transform(value, lambda x: map_at(kind.elementType, x, path, f))
    if not path:
        return f(value)
    if not isinstance(kind, T.StructType):
        return value
    fields = []
    for field in kind.fields:
        inner = value.getField(field.name)
        if field.name == path[0]:
            if len(path) == 1 and f(inner) is None:
                continue
            inner = map_at(field.dataType, inner, path[1:], f) if len(path) > 1 else f(inner)
        fields.append(inner.alias(field.name))
    if path[0] not in kind.names and len(path) == 1 and (made := f(F.lit(None))) is not None:
        fields.append(made.alias(path[0]))
    return F.when(value.isNull(), F.lit(None)).otherwise(F.struct(*fields)) if fields else F.lit(None)


def on_document(schema: T.StructType, path: str, f: Callable[[Column], Column | None]) -> list[Column]:
    """The root columns, with ``f`` applied at a dotted path."""
    head, *rest = path.split(".")
    out = []
    for field in schema.fields:
        if field.name != head:
            out.append(F.col(field.name))
        elif rest:
            out.append(map_at(field.dataType, F.col(head), rest, f).alias(head))
        elif (made := f(F.col(head))) is not None:
            out.append(made.alias(head))
    if head not in schema.names and not rest and (made := f(F.lit(None))) is not None:
        out.append(made.alias(head))
    return out


def sorted_keys(kind: T.DataType, value: Column) -> Column:
    """The value with the keys of every level in order."""
    if _is_array(kind):
        return F.transform(value, lambda x: sorted_keys(kind.elementType, x))
    if isinstance(kind, T.StructType):
        return F.struct(*[sorted_keys(f.dataType, value.getField(f.name)).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    return value


def nested(pairs: dict[str, Column]) -> list[Column]:
    """Columns from dotted names: {'a.b': x} is a struct a with the field b."""
    tree: dict = {}
    for name, column in pairs.items():
        at, parts = tree, name.split(".")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
        at[parts[-1]] = column

    def build(x) -> Column:
        return F.struct(*[build(v).alias(k) for k, v in x.items()]) if isinstance(x, dict) else x

    return [build(v).alias(k) for k, v in tree.items()]


def renamed(kind: T.DataType, value: Column, f: Callable[[str], str]) -> Column:
    """The value with a function of the names of every level."""
    if _is_array(kind):
        return F.transform(value, lambda x: renamed(kind.elementType, x, f))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[renamed(x.dataType, value.getField(x.name), f).alias(f(x.name)) for x in kind.fields]))
    return value


def renamed_document(schema: T.StructType, f: Callable[[str], str]) -> list[Column]:
    return [renamed(x.dataType, F.col(x.name), f).alias(f(x.name)) for x in schema.fields]


def key_values(schema: T.StructType, include: list[str] | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """All (path, value as text) of a document, through lists; some paths, or all but some."""
    pair = lambda p: lambda v: F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"))
    paths = [p for p, _, _ in leaves(schema) if (include is None or p in include) and p not in exclude]
    return F.concat(*[F.transform(values_at(schema, p), pair(p)) for p in paths])


def last_element(schema: T.StructType, path: str) -> Column:
    """The objects that hold the last name of a path, through lists, as one list."""
    return values_at(schema, path.rpartition(".")[0])


def get(schema: T.StructType, path: str) -> Column:
    """The value at a dotted path without lists; an unknown name is an error at once."""
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise KeyError(path)
        kind = kind[name].dataType
    return F.col(path)


def _member(name: str) -> Callable[[Column], Column]:
    return lambda x: x.getField(name)


def lookup(schema: T.StructType, path: str) -> Column:
    """The value at a dotted path; null for unknown names, a list of the next name's values at a list, where it stops."""
    kind, column = schema, None
    for name in path.split("."):
        if _is_array(kind):
            inner = kind.elementType
            found = isinstance(inner, T.StructType) and name in inner.names
            return F.transform(column, _member(name)) if found else F.lit(None)
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None)
        column = F.col(name) if column is None else column.getField(name)
        kind = kind[name].dataType
    return column
