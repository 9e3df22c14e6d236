"""What a document store offers, on DataFrames: queries, pages, counts, and updates in place.

A query is a dictionary as document stores know it, {"field": value} or {"field": {"$op": value}},
all of whose parts have to hold; it becomes one predicate that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.arrays import as_list, values_at
from quillon.operators.load import duplicated_ids, remove_ids

#: Characters that an id may have to be indexed.
MAX_ID = 512


class StoreError(ValueError):
    """An update or a document that the store cannot take."""


_COMPARE = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v) | c.isNull(),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$regex": lambda c, v: c.rlike(v),
}


def _test(op: str, value) -> Callable[[Column], Column]:
    return lambda c: _COMPARE[op](c, value)


def _field(schema: T.StructType, path: str, test) -> Column:
    """A test of the values at a path: of a list, one that passes will do."""
    kind = schema
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return test(F.lit(None))
        kind = kind[name].dataType
    plain = "[" not in path and not isinstance(kind, T.ArrayType) and _is_plain(schema, path)
    return test(F.col(path)) if plain else F.exists(values_at(schema, path), test)


def _is_plain(schema: T.StructType, path: str) -> bool:
    kind = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType):
            return False
        kind = kind[name].dataType
    return True


def matches(schema: T.StructType, query: dict) -> Column:
    """The predicate of a query; an absent field is null. ``$and``, ``$or`` and ``$not`` nest queries."""
    parts = []
    for name, wanted in query.items():
        if name in ("$and", "$or"):
            inner = [matches(schema, q) for q in wanted]
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), inner))
        elif name == "$not":
            parts.append(~F.coalesce(matches(schema, wanted), F.lit(False)))
        elif isinstance(wanted, dict) and any(k.startswith("$") for k in wanted):
            for op, value in wanted.items():
                if op == "$not":
                    parts.append(~F.coalesce(matches(schema, {name: value}), F.lit(False)))
                elif op in _COMPARE:
                    parts.append(_field(schema, name, _test(op, value)))
                else:
                    raise StoreError(f"unknown operator {op}")
        else:
            parts.append(_field(schema, name, _test("$exists", False) if wanted is None else _test("$eq", wanted)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def find(docs: DataFrame, query: dict | None = None, fields: list[str] | None = None, sort: list[str] | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
    """Documents of a query; pages need an order, ``-field`` is descending."""
    out = docs.filter(matches(docs.schema, query)) if query else docs
    if sort:
        out = out.orderBy(*[F.col(s[1:]).desc() if s.startswith("-") else F.col(s).asc() for s in sort])
    if start:
        out = out.offset(start)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*fields) if fields else out


def find_with_total(docs: DataFrame, query: dict, sort: list[str], limit: int, start: int = 0) -> DataFrame:
    """A page, with the number of all matches as ``total``."""
    total = find(docs, query).agg(F.count("*")).scalar()
    return find(docs, query, sort=sort, start=start, limit=limit).withColumn("total", total)


def find_in_json(docs: DataFrame, document: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose JSON text has all the values, compared as text."""
    return docs.filter(reduce(lambda a, b: a & b, [F.get_json_object(document, f"$.{k}") == F.lit(str(v)) for k, v in wanted.items()]))


def find_one(docs: DataFrame, key_value, key: str = "_id") -> DataFrame:
    return docs.filter(F.col(key) == F.lit(key_value)).limit(1)


def exists(docs: DataFrame, key_value, key: str = "_id") -> DataFrame:
    """One row: whether the id is there."""
    return find_one(docs, key_value, key).agg((F.count("*") > 0).alias("exists"))


def count(docs: DataFrame, query: dict | None = None, name: str = "n") -> DataFrame:
    return find(docs, query).agg(F.count("*").alias(name))


def ids(docs: DataFrame, key: str = "_id") -> DataFrame:
    """The ids alone: a scan of one column."""
    return docs.select(F.col(key).alias("_id"))


def id_counts(docs: DataFrame, key: str = "_id") -> DataFrame:
    """One row: documents, and different ids."""
    return docs.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"))


def fetch(docs: DataFrame, wanted: list, limit: int = 1000, key: str = "_id") -> DataFrame:
    """The documents of a list of ids; more than ``limit`` of them are an error when rows are read."""
    found = docs.filter(F.col(key).isin(*wanted)).limit(limit + 1)
    n = found.agg(F.count("*")).scalar()
    too_many = F.raise_error(F.lit(f"more than {limit} documents match")).cast(dict(docs.dtypes)[key])
    return found.withColumn(key, F.when(n > limit, too_many).otherwise(F.col(key)))


def scroll(docs: DataFrame, query: dict, expected: int | None = None) -> DataFrame:
    """All documents of a query; ``expected`` is checked by ``checked_scroll``."""
    return find(docs, query)


def checked_scroll(docs: DataFrame, query: dict, consume) -> int:
    """Hands the matches to ``consume`` once; an error if fewer or more came out than match."""
    seen = Observation()
    consume(find(docs, query).observe(seen, F.count(F.lit(1)).alias("n")))
    expected = find(docs, query).count()
    if seen.get["n"] != expected:
        raise StoreError(f"{seen.get['n']} documents of {expected}")
    return expected


def delete_one(docs: DataFrame, key_value, key: str = "_id") -> DataFrame:
    return docs.filter(~F.col(key).eqNullSafe(F.lit(key_value)))


def without_id(docs: DataFrame, key: str = "_id") -> DataFrame:
    """One row: how many documents cannot be stored for want of an id."""
    return docs.filter(F.col(key).isNull()).agg(F.count("*").alias("n"))


def insert(docs: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """New documents added; one without an id, or whose id is taken, is an error when rows are read."""
    taken = new.join(docs.select(F.col(key).alias("_taken")), F.col(key) == F.col("_taken"), "left")
    fail = F.when(F.col(key).isNull(), F.raise_error(F.lit("a document has no id"))).when(F.col("_taken").isNotNull(), F.raise_error(F.concat(F.lit("the id is taken: "), F.col(key).cast("string"))))
    checked = taken.withColumn(key, F.coalesce(fail.cast(dict(new.dtypes)[key]), F.col(key))).drop("_taken")
    return docs.unionByName(checked, allowMissingColumns=True)


def write_many(docs: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """``insert`` of a batch that is also free of repeated ids."""
    repeated = duplicated_ids(new, key).select(F.col(key).alias("_twice"))
    met = new.join(repeated, F.col(key) == F.col("_twice"), "left")
    fail = F.when(F.col("_twice").isNotNull(), F.raise_error(F.concat(F.lit("the id comes twice: "), F.col(key).cast("string"))))
    return insert(docs, met.withColumn(key, F.coalesce(fail.cast(dict(new.dtypes)[key]), F.col(key))).drop("_twice"), key)


def update_many(docs: DataFrame, query: dict, values: dict, upsert: bool = False, key: str = "_id") -> DataFrame:
    """Root fields set in all matches; ``upsert`` adds a document of the query and the values where nothing matches."""
    hit = F.coalesce(matches(docs.schema, query), F.lit(False))
    kinds = dict(docs.dtypes)
    out = docs.select(*[F.when(hit, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in docs.columns])
    if not upsert:
        return out
    if any("." in k or k.startswith("$") or isinstance(v, dict) for k, v in query.items()):
        raise StoreError("a query that is to be stored has plain fields")
    made = {**query, **values}
    new = docs.sparkSession.range(1).select(*[F.lit(made.get(c)).cast(kinds[c]).alias(c) for c in docs.columns])
    return out.unionByName(new.join(docs.filter(hit).limit(1).select(F.lit(1).alias("_hit")), F.lit(True), "left_anti"))


def apply_operators(docs: DataFrame, update: dict[str, dict]) -> DataFrame:
    """``$set``, ``$unset``, ``$push``, ``$addToSet`` and ``$pull`` on every document; paths are root fields."""
    for op, changes in update.items():
        for field, value in changes.items():
            there = field in docs.columns
            if op == "$set":
                docs = docs.withColumn(field, value if isinstance(value, Column) else F.lit(value))
            elif op == "$unset":
                docs = docs.drop(field)
            elif op in ("$push", "$addToSet", "$pull"):
                old = F.coalesce(F.col(field), F.array().cast(docs.schema[field].dataType)) if there else F.array()
                item = F.lit(value)
                docs = docs.withColumn(field, {"$push": F.array_append(old, item), "$addToSet": F.array_union(old, F.array(item)), "$pull": F.array_remove(old, value)}[op])
            else:
                raise StoreError(f"unknown operator {op}")
    return docs


def index_batch(docs: DataFrame, key: str = "_id", max_id: int = MAX_ID) -> DataFrame:
    """Documents that can be indexed: ids of at most ``max_id`` characters. ``counted`` is the number of all."""
    return docs.withColumn("counted", docs.agg(F.count("*")).scalar()).filter(F.length(F.col(key)) <= max_id)


def resumed(target: DataFrame, source: DataFrame, key: str = "_id") -> DataFrame:
    """The target and the source's documents that it lacks."""
    return target.unionByName(remove_ids(source, target, key), allowMissingColumns=True)


def united_ids(*parts: DataFrame, key: str = "_id") -> DataFrame:
    """The different ids of all parts, as text, sorted."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(F.col(key).cast("string").alias("_id")) for p in parts]).distinct().sort("_id")


def sizes(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """One row: how many texts have fewer than ``limit`` bytes, and how many have more."""
    n = F.octet_length(text)
    return docs.agg(F.count_if(n < limit).alias("small"), F.count_if(n >= limit).alias("large"))


def paired(a: DataFrame, b: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """(key, a, b): a field of the documents that both collections have."""
    return a.select(key, F.col(field).alias("a")).join(b.select(key, F.col(field).alias("b")), key)


def listed_by(docs: DataFrame, key: str, group: str) -> DataFrame:
    """(group, list of keys, sorted)."""
    return docs.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias(key))


def listed_values(docs: DataFrame, field: str) -> Column:
    """A field's value as a list, whatever it is."""
    return as_list(F.col(field))
