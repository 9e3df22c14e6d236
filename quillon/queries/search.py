"""The query language, filters and result shaping over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import scalars as S
from quillon.operators import catalogue, collections, facets
from quillon.plans import query_language as Q
from quillon.plans import shaping
from quillon.queries.scalar import _ITEMS, orders_as_documents
from quillon.registry import Tables, big, query


def _orders(spark, d):
    docs = Tables(spark, d).orders.withColumnRenamed("o_orderkey", "_id")
    return docs, Q.Fields(docs.schema, default=("o_orderstatus", "o_orderpriority"))


def _parts(spark, d):
    docs = Tables(spark, d).part.withColumnRenamed("p_partkey", "_id")
    return docs, Q.Fields(docs.schema, text=frozenset({"p_name", "p_type"}), default=("p_name", "p_type", "p_brand"))


def _ids(df):
    return df.select("_id")


@query("q_match_all", "SELECT (SELECT count(*) FROM orders) AS all_docs, CAST(0 AS BIGINT) AS none_docs")
def q_match_all(spark, d):
    docs, fields = _orders(spark, d)
    every, nothing = Q.string_query("__all__", fields)[0], Q.string_query("", fields)[0]
    return docs.agg(F.count_if(every).alias("all_docs"), F.count_if(nothing).alias("none_docs"))


@query("q_query_string", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice BETWEEN 1000 AND 200000) AND NOT o_orderpriority = '1-URGENT'")
def q_query_string(spark, d):
    docs, fields = _orders(spark, d)
    return _ids(docs.filter(Q.parse("o_orderstatus:F AND o_totalprice:[1000 TO 200000] -o_orderpriority:1\\-URGENT", fields)))


@query("q_multi_match", r"SELECT p_partkey AS _id FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '\w+'), 'small') OR list_contains(regexp_extract_all(lower(p_type), '\w+'), 'small') OR lower(p_brand) = 'small'")
def q_multi_match(spark, d):
    docs, fields = _parts(spark, d)
    return _ids(docs.filter(Q.multi_match("SMALL", ["p_name", "p_type", "p_brand"], fields)))


@query("q_compound_match", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'O' AND (o_orderpriority = '5-LOW' OR o_orderstatus = '5-LOW')")
def q_compound_match(spark, d):
    docs, fields = _orders(spark, d)
    return _ids(docs.filter(Q.compound_match(["o", "5-low"], [["o_orderstatus"], ["o_orderpriority", "o_orderstatus"]], fields)))


@query("q_user_filter", "SELECT o_orderkey AS _id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_user_filter(spark, d):
    docs, fields = _orders(spark, d)
    named = {"urgent": "o_orderpriority:1\\-URGENT OR o_orderpriority:2\\-HIGH"}
    return _ids(docs.filter(Q.parse(named["urgent"], fields, "OR")))


@query("q_mongo", "SELECT c_custkey AS _id, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'BUILDING'")
def q_mongo(spark, d):
    docs = Tables(spark, d).customer
    return docs.filter(shaping.any_equal("BUILDING", ["c_mktsegment", "c_name"])).select(F.col("c_custkey").alias("_id"), "c_name")


@query("q_sql", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 50 OFFSET 10")
def q_sql(spark, d):
    docs = Tables(spark, d).customer.filter(shaping.any_equal("MACHINERY", ["c_mktsegment"]))
    return docs.orderBy("c_custkey").offset(10).limit(50).select("c_custkey", "c_name")


@query("q_build", "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_build(spark, d):
    docs, fields = _orders(spark, d)
    return Q.search(docs, Q.Request(q="o_orderstatus:P", sort=("-o_totalprice",), size=20), fields).select("_id", "o_totalprice")


_TERMS = ["genes:1017", "o_orderstatus:F", "5-LOW", "x:y:z"]
_PATTERNS = [(r"(?P<term>\d-\w+)", "o_orderpriority")]


@query("q_autoscope", "SELECT * FROM (VALUES ('genes:1017', 'genes:1017', '_id'), ('o_orderstatus:F', 'F', 'o_orderstatus'), ('5-LOW', '5-LOW', 'o_orderpriority'), ('x:y:z', 'x:y:z', '_id')) v(q, term, scopes)")
def q_autoscope(spark, d):
    known = {"o_orderstatus", "o_orderpriority"}
    rows = [(t, *(lambda r: (r[0], ",".join(r[1])))(Q.autoscope(t, Q.patterns_of(_PATTERNS), known, ("_id",)))) for t in _TERMS]
    return spark.createDataFrame(rows, "q string, term string, scopes string")


@query("q_autoscope_patterns", r"SELECT * FROM (VALUES (0, '(?P<term>\d-\w+)', 'o_orderpriority'), (1, '[a-z]+', 'a,b'), (2, '(?P<scope>\w+):(?P<term>[^:]+)', '')) v(n, regex, scopes)")
def q_autoscope_patterns(spark, d):
    given = [(Q.DEFAULT_PATTERN.regex, ()), *_PATTERNS, ("[a-z]+", ["a", "b"])]
    return spark.createDataFrame([(i, p.regex, ",".join(p.scopes)) for i, p in enumerate(Q.patterns_of(given))], "n int, regex string, scopes string")


@query("q_dispatch", "SELECT 'scopes' AS way, o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'pattern', o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'string', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def q_dispatch(spark, d):
    docs, fields = _orders(spark, d)
    plain, auto = Q.Planner(fields), Q.Planner(fields, autoscope=True, patterns=Q.patterns_of(_PATTERNS))
    ways = {"scopes": plain.predicate("P", ("o_orderstatus",)), "pattern": auto.predicate("5-LOW"), "string": plain.predicate("o_orderstatus:F AND o_totalprice:{300000 TO *]")}
    return reduce(lambda a, b: a.unionByName(b), [docs.filter(p).select(F.lit(w).alias("way"), "_id") for w, p in ways.items()])


@query("u_string_hook", "SELECT o_orderkey AS _id FROM orders WHERE o_orderpriority LIKE '%HIGH'")
def u_string_hook(spark, d):
    docs, fields = _orders(spark, d)
    planner = Q.Planner(fields, string_strategy=lambda q, f: F.col("o_orderpriority").endswith(q.upper()))
    return _ids(docs.filter(planner.predicate("high")))


@query("u_match_hook", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = 'P'")
def u_match_hook(spark, d):
    docs, fields = _orders(spark, d)
    planner = Q.Planner(fields, match_strategy=lambda q, scopes, f: shaping.any_equal(q, scopes))
    return _ids(docs.filter(planner.predicate("P", ("o_orderstatus", "o_orderpriority"))))


@query("u_adjust_index", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u_adjust_index(spark, d):
    t = Tables(spark, d)
    planner = Q.Planner(Q.Fields(t.nation.schema), table_of=lambda name, q: "region" if q.startswith("r:") else name)
    first = lambda name: getattr(t, name).select(F.col(getattr(t, name).columns[1]).alias("name"))
    return first(planner.table("nation", "x")).unionByName(first(planner.table("nation", "r:x")))


for _name in ("g_facade_es", "g_es_exec_sync"):
    query(_name, "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 15")(
        lambda spark, d: Q.search(_orders(spark, d)[0], Q.Request(q="o_orderstatus:O", sort=("o_totalprice",), size=15), _orders(spark, d)[1]).select("_id", "o_totalprice")
    )


@query("q_user_template", r"SELECT p_partkey AS _id FROM part WHERE regexp_matches(lower(p_name), '\bsma') OR regexp_matches(lower(p_type), '\bsma')")
def q_user_template(spark, d):
    docs, fields = _parts(spark, d)
    return _ids(docs.filter(Q.named_query({"prefix": "p_name:{{q}}* OR p_type:{{q}}*"}, "prefix", {"q": "sma"}, fields)))


@query("f_wildcard_value", "SELECT p_partkey AS _id FROM part WHERE p_brand LIKE 'Brand#_3' OR p_type LIKE '%COPPER'")
def f_wildcard_value(spark, d):
    docs, _ = _parts(spark, d)
    return _ids(docs.filter(S.matches_glob(F.col("p_brand"), "Brand#?3") | S.matches_glob(F.col("p_type"), "*COPPER")))


@query("f_local_q", "SELECT event_id AS _id FROM events WHERE event_type = 'click' AND user_id = 7")
def f_local_q(spark, d):
    docs = Tables(spark, d).events.withColumnRenamed("event_id", "_id")
    return _ids(docs.filter(Q.parse("event_type:click AND user_id:7", Q.Fields(docs.schema))))


@query("f_hubdb_find", f"SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS _id {_ITEMS} WHERE o_orderpriority = '2-HIGH' AND l_returnflag = 'R'")
def f_hubdb_find(spark, d):
    docs = orders_as_documents(spark, d)
    return _ids(docs.filter((F.col("customer.priority.level") == "2-HIGH") & F.array_contains(A.values_at(docs.schema, "items.flag"), "R")))


@query("f_exists_field", "SELECT 'c_acctbal' AS field, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS n FROM customer UNION ALL SELECT 'c_mktsegment', count(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 END) FROM customer")
def f_exists_field(spark, d):
    docs = Tables(spark, d).customer.withColumns({"c_acctbal": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))})
    return facets.field_counts(docs, ["c_acctbal", "c_mktsegment"])


@query("f_biggest_doc", """WITH x AS (SELECT CASE WHEN p_size > 10 THEN 'a' END AS a, CASE WHEN p_size % 2 = 0 THEN 'b' END AS b, CASE WHEN p_retailprice > 1000 THEN 'c' END AS c FROM part)
SELECT concat_ws(',', a, b, c) AS fields, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS BIGINT) AS n_fields, count(*) AS n_docs FROM x GROUP BY ALL HAVING n_fields >= 2""")
def f_biggest_doc(spark, d):
    docs = Tables(spark, d).part.select(F.when(F.col("p_size") > 10, 1).alias("a"), F.when(F.col("p_size") % 2 == 0, 1).alias("b"), F.when(F.col("p_retailprice") > 1000, 1).alias("c"))
    return facets.common_fields(docs, ["a", "b", "c"], 2)


@query("f_archived_status", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus IN ('P', 'O'))")
def f_archived_status(spark, d):
    t = Tables(spark, d)
    jobs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("jobs"))
    return collections.find(t.customer.join(jobs, "c_custkey", "left"), {"jobs": {"$not": {"$in": ["P", "O"]}}}).select("c_custkey")


@query("f_source_regex", "SELECT n_name FROM nation WHERE regexp_full_match(n_name, 'NATION_1.*|NATION_2')")
def f_source_regex(spark, d):
    return catalogue.matching_sources(Tables(spark, d).nation, "n_name", ["NATION_1.*", "NATION_2"]).select("n_name")


@query("f_root_sources", "SELECT n_name FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_2')")
def f_root_sources(spark, d):
    t = Tables(spark, d).nation
    return shaping.root_sources(t.select("n_name"), "n_name", ["!NATION_1", "!NATION_2"])


@query("f_id_regex_skip", "SELECT CASE WHEN regexp_matches(c_name, '^Customer#0*[0-4]') THEN c_name ELSE CAST(n_regionkey AS VARCHAR) END AS _id, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f_id_regex_skip(spark, d):
    from quillon.plans.keygraph import convert
    from quillon.queries.building import _edges

    docs = Tables(spark, d).customer.select(F.col("c_name").alias("_id"), "c_custkey", "c_nationkey")
    return convert(docs, _edges(spark, d)[2:3], [("nation", "c_nationkey")], ["region"], skip_regex="^Customer#0*[0-4]").select("_id", "c_custkey")


# shaping


@query("p_source_filter", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey AS key, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS parts {_ITEMS} GROUP BY o_orderkey, o_custkey")
def p_source_filter(spark, d):
    docs = Q.source_filter(orders_as_documents(spark, d), ("customer", "items.*", "-customer.priority", "-items.flag", "-items.qty"))
    return docs.select("_id", "customer.*", F.array_join("items.part", ",").alias("parts"))


@query("p_exclude_fields_by_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND count(l_orderkey) > 3 THEN CAST(NULL AS VARCHAR) ELSE array_to_string(list_sort(list(l_partkey)), ',') END AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def p_exclude_fields_by_id(spark, d):
    t = Tables(spark, d)
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_partkey")).alias("parts")).join(t.orders.select("o_orderkey"), "o_orderkey")
    listed = t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey")
    out = shaping.exclude_fields(docs, listed, ["parts"], "o_orderkey", 3)
    return out.select("o_orderkey", F.array_join("parts", ",").alias("parts"))


@query("p_flatten", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'customer.priority.level' AS path, o_orderpriority AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'items.flag', array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), '|') {_ITEMS} GROUP BY o_orderkey")
def p_flatten(spark, d):
    return shaping.flattened(orders_as_documents(spark, d)).filter(F.col("path").isin("customer.priority.level", "items.flag"))


_WITH_ITEMS = "FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"
_FLAT = " UNION ALL ".join(
    [f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, '{p}' AS path, CAST({x} AS VARCHAR) AS value {_WITH_ITEMS}" for p, x in (("status", "o_orderstatus"), ("price", "o_totalprice"), ("customer.key", "o_custkey"), ("customer.priority.level", "o_orderpriority"))]
    + [f"SELECT CAST(o_orderkey AS VARCHAR), 'items.{p}', array_to_string(list({x} ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), '|') {_ITEMS} GROUP BY o_orderkey" for p, x in (("line", "l_linenumber"), ("part", "l_partkey"), ("qty", "l_quantity"), ("flag", "l_returnflag"))]
)


@query("p_traverse", _FLAT)
def p_traverse(spark, d):
    return shaping.flattened(orders_as_documents(spark, d))


@query("p_flatten_iter", _FLAT)
def p_flatten_iter(spark, d):
    return shaping.flattened(orders_as_documents(spark, d)).orderBy("_id", F.desc("path"))


@query("p_dotfield_hit", "SELECT l_orderkey, coalesce(array_to_string(list_sort(list(CAST(l_discount * 100 AS BIGINT)) FILTER (l_discount > 0)), ','), '') AS discounts FROM lineitem GROUP BY l_orderkey")
def p_dotfield_hit(spark, d):
    xs = F.collect_list(F.round(F.col("l_discount") * 100).cast("bigint"))
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(shaping.truthy_items(xs)), ",").alias("discounts"))


@query("p_always_list", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS joined, CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS BIGINT) AS n FROM orders")
def p_always_list(spark, d):
    xs = A.as_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return Tables(spark, d).orders.select("o_orderkey", F.array_join(xs, ",").alias("joined"), big(F.size(xs)).alias("n"))


@query("p_allow_null", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS missing, o_orderstatus AS status FROM orders")
def p_allow_null(spark, d):
    docs = Tables(spark, d).orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status")).alias("x"))
    docs = shaping.ensure_field(docs, "x.missing", F.lit(None).cast("string"))
    return docs.select("o_orderkey", "x.missing", "x.status")


@query("p_exists_or_null", "SELECT o_orderkey, CAST(7 AS BIGINT) AS made, o_totalprice AS price FROM orders")
def p_exists_or_null(spark, d):
    docs = Tables(spark, d).orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    docs = shaping.ensure_field(shaping.ensure_field(docs, "a.b.made", F.lit(7).cast("bigint")), "price", F.lit(None).cast("double"))
    return docs.select("o_orderkey", "a.b.made", "price")


@query("p_sorted_keys", """SELECT n_nationkey, concat('{"a":', CAST(n_regionkey AS VARCHAR), ',"b":"', n_name, '"}') AS json FROM nation""")
def p_sorted_keys(spark, d):
    docs = Tables(spark, d).nation.select("n_nationkey", F.struct(F.col("n_name").alias("b"), F.col("n_regionkey").alias("a")).alias("x"))
    return docs.select("n_nationkey", F.to_json(A.sorted_keys(docs.schema["x"].dataType, F.col("x"))).alias("json"))


@query("p_license", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'http://license' AS license, count(*) AS n {_ITEMS} GROUP BY o_orderkey")
def p_license(spark, d):
    docs = shaping.with_license(orders_as_documents(spark, d), {"customer": "http://license", "items": "http://items"})
    return docs.select("_id", F.col("customer._license").alias("license"), F.size(F.filter("items", lambda x: x._license == "http://items")).cast("bigint").alias("n"))


@query("p_jmespath", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS parts {_ITEMS} WHERE l_returnflag = 'R' GROUP BY o_orderkey")
def p_jmespath(spark, d):
    docs = orders_as_documents(spark, d)
    found = shaping.jmespath(docs, "items[?flag=='R'].part")
    return docs.select("_id", found.alias("xs")).filter(F.size("xs") > 0).select("_id", F.array_join("xs", ",").alias("parts"))


@query("p_jmespath_obj", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderpriority AS level, count(*) AS n {_ITEMS} GROUP BY o_orderkey, o_orderpriority")
def p_jmespath_obj(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", shaping.jmespath(docs, "customer.priority.level").alias("level"), shaping.jmespath(docs, "length(items)").alias("n"))


@query("p_result", "SELECT q.query, CAST(c.c_custkey AS VARCHAR) AS _id, c.c_custkey IS NOT NULL AS found FROM (VALUES ('customer#000000001'), ('Customer#000000007'), ('nobody')) q(query) LEFT JOIN customer c ON lower(c.c_name) = lower(q.query)")
def p_result(spark, d):
    docs = Tables(spark, d).customer
    return Q.multi_search(docs, ["customer#000000001", "Customer#000000007", "nobody"], ["c_name"], Q.Fields(docs.schema), key="c_custkey")


@query("p_mapping", "SELECT * FROM (VALUES ('_id', 'string', false), ('status', 'string', false), ('price', 'double', false), ('customer.key', 'bigint', false), ('customer.priority.level', 'string', false), ('items.line', 'int', true), ('items.part', 'bigint', true), ('items.qty', 'double', true), ('items.flag', 'string', true)) v(path, type, is_list)")
def p_mapping(spark, d):
    return shaping.field_metadata(spark, orders_as_documents(spark, d).schema, prefix="")


@query("p_filter_dict", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey AS key FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def p_filter_dict(spark, d):
    docs = orders_as_documents(spark, d)
    for path in ("customer.priority", "items", "absent"):
        docs = docs.select(*A.on_document(docs.schema, path, lambda x: None)) if path.split(".")[0] in docs.columns else docs
    return docs.select("_id", "customer.*")


@query("p_remove_key", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, sum(l_partkey)::BIGINT AS parts {_ITEMS} GROUP BY o_orderkey")
def p_remove_key(spark, d):
    docs = orders_as_documents(spark, d)
    docs = docs.select(*A.on_document(docs.schema, "items.flag", lambda x: None))
    return docs.select("_id", F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x.part).alias("parts"))


@query("p_parse_dots", "SELECT n_nationkey, concat('{\"name\":\"', n_name, '\",\"region\":{\"key\":', CAST(n_regionkey AS VARCHAR), '}}') AS json FROM nation")
def p_parse_dots(spark, d):
    docs = Tables(spark, d).nation.select("n_nationkey", *A.nested({"n.name": F.col("n_name"), "n.region.key": F.col("n_regionkey")}))
    return docs.select("n_nationkey", F.to_json("n").alias("json"))


@query("p_make_object", "SELECT n_nationkey, concat('{\"b\":{\"c\":\"', n_name, '\"}}') AS json FROM nation")
def p_make_object(spark, d):
    return Tables(spark, d).nation.select("n_nationkey", *A.nested({"a.b.c": F.col("n_name")})).select("n_nationkey", F.to_json("a").alias("json"))


@query("p_compose_dots", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey AS \"customer.key\", o_orderpriority AS \"customer.priority.level\" FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def p_compose_dots(spark, d):
    return shaping.dotted(orders_as_documents(spark, d), ["customer.key", "customer.priority.level"])


@query("p_hit", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'http://x' AS \"customer._license\", CAST(o_custkey AS VARCHAR) AS \"customer.key\", o_orderpriority AS \"customer.priority.level\", o_orderstatus AS status, '' AS missing, CAST(count(*) AS VARCHAR) AS n {_ITEMS} GROUP BY o_orderkey, o_custkey, o_orderpriority, o_orderstatus")
def p_hit(spark, d):
    docs = orders_as_documents(spark, d).withColumns({"_version": F.lit(3), "_score": F.lit(1.5)})
    options = shaping.HitOptions(score=False, licences=(("customer", "http://x"),), allow_null=("missing",), always_list=("status",), jmespath=(("n", "length(items)"),), dotfield=True)
    return shaping.format_hits(docs, options).drop("items.line", "items.part", "items.qty", "items.flag", "price")


@query("u_hit_hook", "SELECT r_regionkey AS _id, lower(r_name) AS name, r_name AS r_name FROM region")
def u_hit_hook(spark, d):
    docs = Tables(spark, d).region.withColumnRenamed("r_regionkey", "_id")
    return shaping.format_hits(docs, shaping.HitOptions(hook=lambda x: x.withColumn("name", F.lower("r_name")))).select("_id", "name", "r_name")


@query("p_mongo_fmt", "SELECT count(*) OVER () AS total, 'gte' AS relation, n_name AS name FROM nation")
def p_mongo_fmt(spark, d):
    return shaping.envelope(Tables(spark, d).nation).select(F.col("total.value").alias("total"), "total.relation", F.col("hit.n_name").alias("name"))


@query("p_sql_fmt", "SELECT count(*) OVER () AS total, r_regionkey AS key, r_name AS name FROM region")
def p_sql_fmt(spark, d):
    hits = shaping.rows_as_documents(["key", "name"], Tables(spark, d).region)
    return shaping.envelope(hits).select(F.col("total.value").alias("total"), "hit.*")


@query("c_format_include", "SELECT n_nationkey, n_name FROM nation")
def c_format_include(spark, d):
    return shaping.without(Tables(spark, d).nation, ["n_regionkey"])


@query("p_listitems", "SELECT c_custkey, array_to_string([string_split(c_name, '#')[2], string_split(c_name, '#')[1]], ',') AS picked FROM customer")
def p_listitems(spark, d):
    return Tables(spark, d).customer.select("c_custkey", F.array_join(A.items(F.split("c_name", "#"), 1, 0), ",").alias("picked"))


@query("p_find_doc", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS parts {_ITEMS} GROUP BY o_orderkey")
def p_find_doc(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", F.array_join(A.values_at(docs.schema, "items.part"), ",").alias("parts"))


# order and pages


@query("s_sort", "SELECT o_orderkey AS _id, CAST(row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice, o_orderkey) AS BIGINT) AS rank FROM orders ORDER BY rank LIMIT 100")
def s_sort(spark, d):
    from pyspark.sql import Window

    docs, _ = _orders(spark, d)
    order = Q.ordered(("-o_orderpriority", "o_totalprice"))
    top = docs.orderBy(*order).limit(100)
    return top.select("_id", big(F.row_number().over(Window.orderBy(*order))).alias("rank"))


@query("s_from_size", "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def s_from_size(spark, d):
    docs, fields = _orders(spark, d)
    return Q.search(docs, Q.Request(q="o_orderstatus:F", sort=("-o_totalprice",), from_=50, size=25), fields).select("_id", "o_totalprice")


@query("s_scroll", "SELECT o_orderkey AS _id FROM orders WHERE o_orderkey > 6000 ORDER BY o_orderkey LIMIT 60")
def s_scroll(spark, d):
    docs, _ = _orders(spark, d)
    return Q.page_after(docs, 6000, 60).select("_id")


@query("s_fetch_limit", "SELECT c_custkey FROM customer WHERE c_custkey IN (1, 5, 9, 99999999)")
def s_fetch_limit(spark, d):
    return collections.fetch(Tables(spark, d).customer, [1, 5, 9, 99999999], key="c_custkey").select("c_custkey")


@query("s_search", r"SELECT p_partkey AS _id, p_size FROM part WHERE regexp_matches(lower(p_name), '(^|\W)small ring(\W|$)') AND p_size >= 10 ORDER BY p_size, p_partkey LIMIT 30")
def s_search(spark, d):
    docs, fields = _parts(spark, d)
    return Q.search(docs, Q.Request(q='p_name:"small ring"', filter="p_size:[10 TO *]", sort=("p_size",), size=30), fields).select("_id", "p_size")


@query("s_random", "SELECT least(count(*), 10) AS n, true AS known, true AS again FROM orders")
def s_random(spark, d):
    docs, fields = _orders(spark, d)
    page = lambda seed: Q.search(docs, Q.Request(q="__any__", size=10, seed=seed), fields).select("_id")
    met = page(3).withColumn("a", F.lit(True)).join(page(3).withColumn("b", F.lit(True)), "_id", "full_outer").join(docs.select("_id", F.lit(True).alias("there")), "_id", "left")
    whole = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(False)))
    return met.agg(F.count("*").alias("n"), whole("there").alias("known"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("again"))


@query("s_score", r"""WITH t AS (SELECT doc_id AS _id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents), w AS (SELECT unnest(['the', 'tion', 'worthless']) AS w),
c AS (SELECT _id, len(ws) AS len, w, len(list_filter(ws, lambda x: x = w)) AS f FROM t, w), g AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t),
df AS (SELECT w, count(*) FILTER (f > 0) AS df FROM c GROUP BY w)
SELECT _id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM c JOIN df USING (w), g GROUP BY _id HAVING sum(f) > 0""")
def s_score(spark, d):
    return Q.bm25(Tables(spark, d).documents, "text", "the worthless tion", key="doc_id").select("_id", F.round("score", 6).alias("score"))


@query("s_listsort", "SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS BIGINT) AS rank FROM nation")
def s_listsort(spark, d):
    return catalogue.places(Tables(spark, d).nation, F.desc("n_name"), "rank").select("n_nationkey", "n_name", "rank")
