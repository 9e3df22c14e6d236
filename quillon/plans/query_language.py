"""A small query language over documents, translated into Column predicates.

    query  := or        or := and (OR and)*      and := unary ((AND)? unary)*
    unary  := NOT unary | + unary | - unary | ( or ) | clause
    clause := _exists_:field | field:value | value
    value  := word | "phrase" | [a TO b] | {a TO b} | word with * or ?

Neighbours without an operator are joined by ``default`` (AND or OR). A field is compared by its
kind: text fields by their lower-case tokens, keywords by their lower-cased whole, numbers
after a lenient cast (what cannot be cast matches nothing), lists by any element.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.arrays import leaves, values_at
from quillon.functions.scalars import glob_to_regex

#: Limits of a request.
MAX_SIZE, MAX_FROM, MAX_SORT, MAX_FACETS, DEFAULT_SIZE, DEFAULT_FACET_SIZE = 1000, 10_000, 10, 1000, 10, 10
#: Terms of one multi-search.
MAX_TERMS = 1000
_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)(?=[\s()]|\Z)|(&&|\|\|)|([+\-!])(?=\S)|((?:[^\s():"\[{\\]|\\.)+:)?(?:"((?:[^"\\]|\\.)*)"|([\[{])\s*(\S+)\s+TO\s+([^\s\]}]+)\s*([\]}])|((?:[^\s()"\\]|\\.)+))|(\S))', re.S)


class QueryError(ValueError):
    """A query that cannot be read."""


@dataclass
class Fields:
    """What the planner knows of a collection: its schema, text fields, default fields."""

    schema: T.StructType
    text: frozenset[str] = frozenset()
    default: tuple[str, ...] = ("_id",)
    scopes: dict[str, str] = field(default_factory=dict)


def tokens(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _unescape(word: str) -> str:
    return re.sub(r"\\(.)", r"\1", word)


def _kind(fields: Fields, path: str) -> T.DataType | None:
    kind: T.DataType = fields.schema
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def _any(fields: Fields, path: str, test) -> Column:
    """Whether a value at the path passes; lists pass by any element."""
    kind: T.DataType = fields.schema
    through_list = False
    for name in path.split("."):
        through_list |= isinstance(kind, T.ArrayType)
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        kind = kind[name].dataType
    if through_list or isinstance(kind, T.ArrayType):
        return F.exists(values_at(fields.schema, path), lambda x: F.coalesce(test(x), F.lit(False)))
    return F.coalesce(test(F.col(path)), F.lit(False))


def exists(fields: Fields, path: str) -> Column:
    if _kind(fields, path) is None:
        return F.lit(False)
    return _any(fields, path, lambda x: x.isNotNull())


def _holds(word: str):
    return lambda x: F.array_contains(tokens(x), word)


def match(fields: Fields, path: str, value: str, phrase: bool = False) -> Column:
    """One value against one field."""
    kind = _kind(fields, path)
    if kind is None:
        return F.lit(False)
    if isinstance(kind, T.StringType):
        if path in fields.text:
            asked = re.findall(r"\w+", value.lower())
            if not asked:
                return F.lit(False)
            if phrase or len(asked) > 1 and phrase is not None:
                return _any(fields, path, lambda x: F.contains(F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" ")), F.lit(" " + " ".join(asked) + " ")))
            return _any(fields, path, lambda x: reduce(lambda a, b: a & b, [F.array_contains(tokens(x), w) for w in asked]))
        return _any(fields, path, lambda x: F.lower(x) == value.lower())
    return _any(fields, path, lambda x: x == F.lit(value).try_cast(kind))


def _wildcard(fields: Fields, path: str, value: str) -> Column:
    if value == "*":
        return exists(fields, path)
    if _kind(fields, path) is None:
        return F.lit(False)
    pattern = glob_to_regex(value.lower().replace("[", "\\["))
    if path in fields.text:
        return _any(fields, path, lambda x: F.exists(tokens(x), lambda t: t.rlike(pattern)))
    return _any(fields, path, lambda x: F.lower(x.cast("string")).rlike(pattern))


def _range(fields: Fields, path: str, low: str, high: str, closed: tuple[bool, bool]) -> Column:
    kind = _kind(fields, path)
    if kind is None:
        return F.lit(False)

    def test(x: Column) -> Column:
        out = x.isNotNull()
        if low != "*":
            bound = F.lit(low.strip('"')).try_cast(kind)
            out = out & ((x >= bound) if closed[0] else (x > bound))
        if high != "*":
            bound = F.lit(high.strip('"')).try_cast(kind)
            out = out & ((x <= bound) if closed[1] else (x < bound))
        return out

    return _any(fields, path, test)


def _lex(query: str) -> list[tuple]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None or m[13] is not None:
            raise QueryError(f"cannot read {query[at:]!r}")
        at = m.end()
        if m[1] or m[2]:
            out.append((m[1] or m[2],))
        elif m[3] or m[4]:
            out.append(({"&&": "AND", "||": "OR"}.get(m[4], m[3]),))
        elif m[5]:
            out.append(("NOT" if m[5] in "-!" else "MUST",))
        else:
            name = _unescape(m[6][:-1]) if m[6] else None
            if m[7] is not None:
                out.append(("phrase", name, _unescape(m[7])))
            elif m[8]:
                out.append(("range", name, m[9], m[10], (m[8] == "[", m[11] == "]")))
            else:
                word = m[12]
                if "/" == word[:1] == word[-1:] and len(word) > 1 or re.search(r"(?<!\\)~\d*$", word):
                    raise QueryError("regular expressions and fuzzy words are not supported")
                out.append(("word", name, word))
    return out


def parse(query: str, fields: Fields, default: str = "AND") -> Column:
    """The predicate of a query string."""
    found = _lex(query)
    at = 0

    def peek() -> str | None:
        return found[at][0] if at < len(found) else None

    def either() -> Column:
        nonlocal at
        out = both()
        while peek() == "OR":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        must, may = [], []
        joined = default == "AND"
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                at += 1
                if not must and not may or peek() in (None, ")", "OR", "AND"):
                    raise QueryError("AND without operands")
                joined = True
                if may and default == "OR":
                    must.append(may.pop())
            forced = peek() in ("MUST", "NOT")
            one = unary()
            (must if forced or joined or peek() == "AND" else may).append(one)
            joined = default == "AND"
        if not must and not may:
            raise QueryError("an operator without operands")
        if must:
            return reduce(lambda a, b: a & b, must)
        return reduce(lambda a, b: a | b, may)

    def unary() -> Column:
        nonlocal at
        if at >= len(found):
            raise QueryError("an operator without operands")
        kind, *rest = found[at]
        at += 1
        if kind == "NOT":
            return ~unary()
        if kind == "MUST":
            return unary()
        if kind == "(":
            out = either()
            if peek() != ")":
                raise QueryError("a parenthesis is not closed")
            at += 1
            return out
        if kind in ("AND", "OR", ")"):
            raise QueryError(f"{kind} without operands")
        name, paths = rest[0], [rest[0]] if rest[0] else list(fields.default)
        if name == "_exists_":
            return exists(fields, _unescape(rest[1]))
        if kind == "range":
            return reduce(lambda a, b: a | b, [_range(fields, p, rest[1], rest[2], rest[3]) for p in paths])
        if kind == "word" and name is None and rest[1] == "*":
            return F.lit(True)
        if kind == "word" and re.search(r"(?<!\\)[*?]", rest[1]):
            return reduce(lambda a, b: a | b, [_wildcard(fields, p, rest[1]) for p in paths])
        return reduce(lambda a, b: a | b, [match(fields, p, _unescape(rest[1]), kind == "phrase") for p in paths])

    if not found:
        return F.lit(False)
    out = either()
    if at < len(found):
        raise QueryError("a parenthesis too many")
    return out


def multi_match(q: str, scopes: list[str], fields: Fields) -> Column:
    """One term against several fields; all its words must be in one field."""
    def one(path: str) -> Column:
        if path in fields.text:
            asked = re.findall(r"\w+", q.lower())
            return reduce(lambda a, b: a & b, [_any(fields, path, _holds(w)) for w in asked]) if asked else F.lit(False)
        return match(fields, path, q)

    return reduce(lambda a, b: a | b, [one(p) for p in scopes])


def compound_match(qs: list[str], scopes: list[list[str]], fields: Fields) -> Column:
    """The i-th term in the i-th scopes, for all i."""
    if not qs or len(qs) != len(scopes):
        raise QueryError("as many terms as scopes are needed")
    return reduce(lambda a, b: a & b, [multi_match(q, s, fields) for q, s in zip(qs, scopes, strict=True)])


def string_query(q: str | None, fields: Fields, seed: int = 0) -> tuple[Column, list[Column]]:
    """Predicate and order of a request's ``q``."""
    if q == "":
        return F.lit(False), []
    if q is None or q == "__all__":
        return F.lit(True), []
    if q == "__any__":
        return F.lit(True), [F.rand(seed)]
    return parse(q, fields), []


@dataclass(frozen=True)
class Pattern:
    """Recognises terms: a regular expression with optional groups ``scope`` and ``term``."""

    regex: str
    scopes: tuple[str, ...] = ()


DEFAULT_PATTERN = Pattern(r"(?P<scope>\w+):(?P<term>[^:]+)")


def autoscope(q: str, patterns: list[Pattern], known: set[str], default: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
    """(term, fields) by the first pattern that fits the whole string and leads to known fields."""
    for p in [*patterns, DEFAULT_PATTERN]:
        if m := re.fullmatch(p.regex, q):
            groups = m.groupdict()
            scopes = p.scopes or ((groups["scope"],) if groups.get("scope") else ())
            if scopes and set(scopes) <= known:
                return groups.get("term") or q, scopes
    return q, default


def patterns_of(given, default: Pattern = DEFAULT_PATTERN) -> list[Pattern]:
    """(regex, field or fields) in their order; the default pattern comes last, wherever it was given."""
    out = []
    for regex, scopes in given or ():
        re.compile(regex)
        pattern = Pattern(regex, (scopes,) if isinstance(scopes, str) else tuple(scopes))
        if pattern != default:
            out.append(pattern)
    return [*out, default]


def named_query(templates: dict[str, str], name: str, values: dict[str, str], fields: Fields) -> Column:
    """A stored query with ``{{name}}`` places filled in; a value cannot add syntax of its own."""
    if name not in templates:
        raise QueryError(f"no query is named {name}")
    filled = re.sub(r"\{\{(\w+)\}\}", lambda m: re.sub(r"([^\w])", r"\\\1", values[m[1]]), templates[name])
    return parse(filled, fields)


@dataclass
class Planner:
    """How a single query becomes a predicate; both strategies and the choice of table can be replaced.

    With scopes a term is matched in them; else, if ``autoscope`` is set, patterns find term and
    scopes; else the query language reads it.
    """

    fields: Fields
    autoscope: bool = False
    patterns: list[Pattern] = field(default_factory=list)
    default_scopes: tuple[str, ...] = ("_id",)
    string_strategy: Callable[[str, Fields], Column] | None = None
    match_strategy: Callable[[str, list[str], Fields], Column] | None = None
    table_of: Callable[[str, str], str] | None = None

    def predicate(self, q: str, scopes: tuple[str, ...] = ()) -> Column:
        match = self.match_strategy or multi_match
        if not scopes and self.autoscope:
            known = {p for p, _, _ in leaves(self.fields.schema)}
            q, scopes = autoscope(q, self.patterns, known, self.default_scopes)
        if scopes:
            return match(q, list(scopes), self.fields)
        return (self.string_strategy or (lambda text, fields: string_query(text, fields)[0]))(q, self.fields)

    def table(self, name: str, q: str) -> str:
        """The table that a query goes to: the named one unless the hook says otherwise."""
        return self.table_of(name, q) if self.table_of else name


@dataclass
class Request:
    """Options of a search; limits are checked when it is made."""

    q: str | None = None
    scopes: tuple[str, ...] = ()
    filter: str | None = None
    post_filter: str | None = None
    source: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()
    from_: int = 0
    size: int = DEFAULT_SIZE
    facets: tuple[str, ...] = ()
    facet_size: int = DEFAULT_FACET_SIZE
    seed: int = 0

    def __post_init__(self):
        if not 0 <= self.size <= MAX_SIZE or not 0 <= self.from_ <= MAX_FROM or len(self.sort) > MAX_SORT or len(self.facets) > MAX_FACETS:
            raise QueryError("an option is out of its bounds")


def matched(docs: DataFrame, request: Request, fields: Fields, post: bool = True) -> tuple[DataFrame, list[Column]]:
    """Documents of a request, before paging, and the order that its ``q`` asks for."""
    if request.scopes:
        predicate, order = multi_match(request.q or "", list(request.scopes), fields), []
    else:
        predicate, order = string_query(request.q, fields, request.seed)
    out = docs.filter(predicate)
    if request.filter:
        out = out.filter(parse(request.filter, fields, "OR"))
    if post and request.post_filter:
        out = out.filter(parse(request.post_filter, fields, "OR"))
    return out, order


def ordered(sort: tuple[str, ...], key: str = "_id") -> list[Column]:
    """``-field`` is descending; missing values last; ties by id."""
    return [F.col(s[1:]).desc_nulls_last() if s.startswith("-") else F.col(s).asc_nulls_last() for s in sort] + [F.col(key).asc()]


def search(docs: DataFrame, request: Request, fields: Fields, key: str = "_id") -> DataFrame:
    """A page of hits."""
    out, order = matched(docs, request, fields)
    out = out.orderBy(*(order or ordered(request.sort, key))).offset(request.from_).limit(request.size)
    return source_filter(out, request.source) if request.source else out


def source_filter(docs: DataFrame, wanted: tuple[str, ...], key: str = "_id") -> DataFrame:
    """Fields to include, and after ``-`` to exclude; ``*`` stands for any name, ``all`` for all."""
    include = [re.compile(glob_to_regex(w).replace("(?s:", "(?:")) for w in wanted if not w.startswith("-") and w != "all"]
    exclude = [re.compile(glob_to_regex(w[1:]).replace("(?s:", "(?:")) for w in wanted if w.startswith("-")]

    def keep(path: str) -> bool:
        ups = [path.rsplit(".", i)[0] for i in range(path.count(".") + 1)]
        fits = lambda ps: any(p.match(u) for p in ps for u in ups)
        return (not include or "all" in wanted or fits(include)) and not fits(exclude)

    def build(kind: T.DataType, value: Column, path: str) -> Column | None:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if not any(keep(f"{path}.{n}") for n in kind.elementType.names):
                return None
            return F.transform(value, lambda x: build(kind.elementType, x, path))
        if isinstance(kind, T.StructType):
            parts = [(f.name, build(f.dataType, value.getField(f.name), f"{path}.{f.name}")) for f in kind.fields]
            parts = [c.alias(n) for n, c in parts if c is not None]
            return F.when(value.isNotNull(), F.struct(*parts)) if parts else None
        return value if keep(path) else None

    cols = []
    for f in docs.schema.fields:
        made = F.col(f.name) if f.name == key else build(f.dataType, F.col(f.name), f.name)
        if made is not None:
            cols.append(made.alias(f.name))
    return docs.select(*cols)


def page_after(docs: DataFrame, cursor: str | int | None, size: int, key: str = "_id") -> DataFrame:
    """The next page of a scroll: ids after the cursor."""
    out = docs if cursor is None else docs.filter(F.col(key) > F.lit(cursor))
    return out.orderBy(key).limit(size)


def multi_search(docs: DataFrame, queries: list[str], scopes: list[str], fields: Fields, size: int = DEFAULT_SIZE, key: str = "_id") -> DataFrame:
    """(query, _id, found) for many terms in one plan: a scan of the documents serves all.

    Terms without a hit have one row that says so. Scopes are keyword or number fields.
    """
    if len(queries) > MAX_TERMS:
        raise QueryError(f"at most {MAX_TERMS} terms")
    asked = docs.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries)], "n int, query string")
    flat = [F.transform(values_at(fields.schema, p), lambda x: F.lower(x.cast("string"))) for p in scopes]
    wanted = F.array(*[F.lit(q) for q in sorted({q.lower() for q in queries})]).cast("array<string>")
    held = docs.select(F.col(key).cast("string").alias("_id"), F.array_intersect(F.concat(*flat), wanted).alias("terms")).filter(F.size("terms") > 0)
    terms = held.select("_id", F.explode("terms").alias("term"))
    hits = terms.join(F.broadcast(asked), F.col("term") == F.lower("query")).select("n", "_id").distinct()  # MAX_TERMS rows
    from pyspark.sql import Window

    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy("_id"))).filter(F.col("rank") <= size)
    return asked.join(hits, "n", "left").select("query", "_id", F.col("_id").isNotNull().alias("found"))


def bm25(docs: DataFrame, text: str, query: str, key: str = "_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(_id, score) of the documents that hold a word of the query, by the published formula."""
    words = sorted(set(re.findall(r"\w+", query.lower())))
    own = docs.select(F.col(key).alias("_id"), tokens(F.col(text)).alias("t"))
    counted = own.select("_id", F.size("t").alias("len"), *[(F.size("t") - F.size(F.array_remove("t", w))).alias(f"f{i}") for i, w in enumerate(words)])
    aggs = [F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))]]
    joined = counted.withColumn("s", counted.agg(F.struct(*aggs)).scalar()).select("*", "s.*")
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        f = F.col(f"f{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return joined.select("_id", score.alias("score")).filter("score > 0")
