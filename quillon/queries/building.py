"""Merging, converting, profiling, comparing and releasing collections."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import scalars as S
from quillon.functions import values as V
from quillon.operators import catalogue, collections, diff, facets, load, merge, parallel, profile
from quillon.plans import keygraph as G
from quillon.plans import release, shaping
from quillon.plans.shaping import united
from quillon.queries.loading import _BOTH, _CUST, _SET, _customers, _events, _folder, _json_list, _newer
from quillon.queries.scalar import _ITEMS, orders_as_documents
from quillon.registry import Tables, big, query
from quillon.sources import files
from quillon.sources.catalog import Collection

# joins across collections

for _name, _how in (("j_merge_source", "LEFT"), ("j_index_coldhot", "FULL")):
    query(_name, _SET.format(_how))((lambda root: lambda spark, d: merge.merge_source(_customers(spark, d), _newer(spark, d), root=root))(_how == "FULL"))


def _three(spark, d):
    t = Tables(spark, d)
    return {
        "c_orders": t.orders.groupBy(F.col("o_custkey").alias("_id")).agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n")),
        "a_customers": t.customer.select(F.col("c_custkey").alias("_id"), F.col("c_acctbal").alias("best"), F.col("c_mktsegment").alias("seg")),
        "b_events": t.events.groupBy(F.col("user_id").alias("_id")).agg(F.max("value").alias("best"), F.min("event_type").alias("kind")),
    }


_THREE = """WITH o AS (SELECT o_custkey AS _id, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS _id, c_acctbal AS best, c_mktsegment AS seg FROM customer), e AS (SELECT user_id AS _id, max(value) AS best, min(event_type) AS kind FROM events GROUP BY 1) """


@query("j_merge_sources", _THREE + "SELECT c._id, coalesce(o.best, e.best, c.best) AS best, o.n, c.seg, e.kind FROM c LEFT JOIN o ON c._id = o._id LEFT JOIN e ON c._id = e._id")
def j_merge_sources(spark, d):
    return merge.merge_sources(_three(spark, d), roots=["a_customers"]).select("_id", "best", "n", "seg", "kind")


@query("j_merge_order", _THREE + "SELECT i._id, coalesce(e.best, c.best, o.best) AS best FROM (SELECT _id FROM o UNION SELECT _id FROM c UNION SELECT _id FROM e) i LEFT JOIN o ON i._id = o._id LEFT JOIN c ON i._id = c._id LEFT JOIN e ON i._id = e._id")
def j_merge_order(spark, d):
    return merge.merge_sources(_three(spark, d), order=["c_orders", "a_customers", "b_events"]).select("_id", "best")


@query("j_batch_dups", "SELECT _id, arg_max(kind, pos) AS kind, arg_max(v, pos) FILTER (v IS NOT NULL) AS v FROM (SELECT user_id AS _id, event_id AS pos, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN value END AS v FROM events) GROUP BY _id")
def j_batch_dups(spark, d):
    docs = _events(spark, d).select("_id", "pos", "kind", F.when(F.col("pos") % 2 == 0, F.col("value")).alias("v"))
    return merge.batch_duplicates(docs, "_id", "pos")


@query("j_link_build", "SELECT c_custkey AS _id, c_name AS name FROM customer")
def j_link_build(spark, d):
    return Collection.linked(spark, "linked_build", _customers(spark, d).select("_id", "name"))


@query("j_id_mapper", "SELECT coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS _id, c_name AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def j_id_mapper(spark, d):
    t = Tables(spark, d)
    docs = t.customer.select(F.col("c_nationkey").alias("_id"), F.col("c_name").alias("name"))
    return merge.map_ids(docs, t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("dst")))


@query("j_id_translate", "SELECT n_name AS _id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def j_id_translate(spark, d):
    t = Tables(spark, d)
    docs = t.customer.select(F.col("c_nationkey").alias("_id"), F.col("c_name").alias("name"))
    return merge.map_ids(docs, t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("dst")), transparent=False)


def _edges(spark, d):
    t = Tables(spark, d)
    return [
        G.Edge("order", "customer", t.orders, "o_orderkey", "o_custkey"),
        G.Edge("customer", "nation", t.customer, "c_custkey", "c_nationkey"),
        G.Edge("nation", "region", t.nation, "n_nationkey", "n_regionkey"),
        G.Edge("customer", "segment", t.customer, "c_custkey", "c_mktsegment"),
        G.Edge("segment", "region", t.region, "r_name", "r_regionkey", weight=0.5),
    ]


@query("j_edge_lookup", "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS orig, CAST(o_custkey AS VARCHAR) AS cur FROM orders")
def j_edge_lookup(spark, d):
    ids = Tables(spark, d).orders.select(F.col("o_orderkey").cast("string").alias("orig"))
    return _edges(spark, d)[0].follow(ids.withColumn("cur", F.col("orig")))


@query("j_edge_ci", "SELECT lower(n_name) AS orig, CAST(n_regionkey AS VARCHAR) AS cur FROM nation")
def j_edge_ci(spark, d):
    t = Tables(spark, d).nation
    edge = G.Edge("name", "region", t, "n_name", "n_regionkey", ignore_case=True)
    return edge.follow(t.select(F.lower("n_name").alias("orig"), F.lower("n_name").alias("cur")))


@query("j_edge_regex", "SELECT c_name AS orig, 'id:' || regexp_extract(c_name, '([1-9][0-9]*)$', 1) AS cur FROM customer WHERE regexp_matches(c_name, '^Customer#0*[1-9][0-9]*$')")
def j_edge_regex(spark, d):
    edge = G.Edge("name", "number", pattern=r"^Customer#0*([1-9][0-9]*)$", replacement="id:$1")
    c = Tables(spark, d).customer
    return edge.follow(c.select(F.col("c_name").alias("orig"), F.col("c_name").alias("cur")))


@query("j_edge_api", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS orig, CAST(c_nationkey AS VARCHAR) AS cur FROM customer")
def j_edge_api(spark, d):
    ids = Tables(spark, d).customer.select(F.col("c_custkey").cast("string").alias("orig"))
    return _edges(spark, d)[1].follow(ids.withColumn("cur", F.col("orig")))


@query("j_keylookup", "SELECT CAST(o_orderkey AS VARCHAR) AS orig, CAST(n_regionkey AS VARCHAR) AS cur FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j_keylookup(spark, d):
    return G.travel(Tables(spark, d).orders.select(F.col("o_orderkey").alias("orig")), _edges(spark, d), "order", "region")


@query("j_keylookup_batch", "SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS _id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j_keylookup_batch(spark, d):
    c = Tables(spark, d).customer
    docs = c.select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"))
    return G.convert(docs, _edges(spark, d)[2:3], [("nation", "nation")], ["region"], skip_failures=True).select("_id", "name")


@query("j_paths", "SELECT * FROM (VALUES (0, 'order->customer->segment->region'), (1, 'order->customer->nation->region')) v(n, path)")
def j_paths(spark, d):
    rows = [(i, "->".join([p[0].source, *(e.target for e in p)])) for i, p in enumerate(G.simple_paths(_edges(spark, d), "order", "region"))]
    return spark.createDataFrame(rows, "n int, path string")


@query("j_copy", "SELECT CAST(c_nationkey AS VARCHAR) AS _id, c_name AS name FROM customer")
def j_copy(spark, d):
    docs = Tables(spark, d).customer.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), "c_nationkey")
    return G.copy_id(docs, "c_nationkey").select("_id", "name")


def _pairs(spark, d):
    return Tables(spark, d).orders.select(F.col("o_custkey").alias("orig"), F.col("o_orderstatus").alias("cur"))


@query("j_idstruct", "SELECT DISTINCT o_custkey AS orig, o_orderstatus AS cur FROM orders")
def j_idstruct(spark, d):
    return G.IdPairs(_pairs(spark, d)).pairs


@query("g_idstruct_add", "SELECT DISTINCT o_custkey AS orig, o_orderstatus AS cur FROM orders UNION SELECT c_custkey, 'new' FROM customer")
def g_idstruct_add(spark, d):
    more = Tables(spark, d).customer.select(F.col("c_custkey").alias("orig"), F.lit("new").alias("cur"))
    return G.IdPairs(_pairs(spark, d)).add(more).add(more.withColumn("cur", F.lit(""))).pairs


@query("j_ci_idstruct", "SELECT DISTINCT lower(c_mktsegment) AS k, c_nationkey AS cur FROM customer")
def j_ci_idstruct(spark, d):
    pairs = Tables(spark, d).customer.select(F.col("c_mktsegment").alias("orig"), F.col("c_nationkey").alias("cur"))
    return G.IdPairs(pairs, ignore_case=True).pairs.select(F.col("orig").alias("k"), "cur")


@query("g_idstruct_left", "SELECT DISTINCT o_orderstatus AS cur FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8)")
def g_idstruct_left(spark, d):
    return G.IdPairs(_pairs(spark, d)).left(spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8)], "orig bigint"))


@query("g_idstruct_right", "SELECT DISTINCT o_custkey AS orig FROM orders WHERE o_orderstatus = 'P'")
def g_idstruct_right(spark, d):
    return G.IdPairs(_pairs(spark, d)).right(spark.createDataFrame([("P",)], "cur string"))


@query("j_api_batch", "SELECT CAST(n_regionkey AS VARCHAR) AS _id, c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j_api_batch(spark, d):
    c = Tables(spark, d).customer
    docs = c.select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey", "c_mktsegment")
    return G.convert(docs, _edges(spark, d), [("segment", "c_mktsegment"), ("customer", "c_custkey")], ["region"])


@query("j_api_replace", "SELECT c_custkey, input FROM (SELECT c_custkey, input, row_number() OVER (PARTITION BY c_custkey ORDER BY pr) AS rn FROM (SELECT c_custkey, 'name' AS input, 1 AS pr FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'segment', 2 FROM customer)) WHERE rn = 1")
def j_api_replace(spark, d):
    c = Tables(spark, d).customer.select("c_custkey")
    rows = c.filter("c_custkey % 2 = 0").withColumn("input", F.lit("name")).unionByName(c.withColumn("input", F.lit("segment")))
    return load.keep_one(rows, ["c_custkey"], [G.by_priority(F.col("input"), ["name", "segment"])])


for _name in ("j_two_docs", "g_two_docs_mem"):
    query(_name, _BOTH + "SELECT o._id, o.name AS a, n.name AS b FROM o JOIN n ON o._id = n._id")(lambda spark, d: collections.paired(_customers(spark, d), _newer(spark, d), "name"))


@query("j_merge_dict", "SELECT coalesce(c_nationkey, s_nationkey) AS k, coalesce(c, -1) AS customers, coalesce(s, -1) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey > 3 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey < 20 GROUP BY 1) ON c_nationkey = s_nationkey")
def j_merge_dict(spark, d):
    t = Tables(spark, d)
    parts = {"customers": t.customer.filter("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("value")), "suppliers": t.supplier.filter("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("value"))}
    return merge.outer_merge(parts, "k", -1)


@query("j_prebuilt_mongo", "SELECT CAST(k AS VARCHAR) AS _id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT c_custkey AS k, 'customer' AS s FROM customer UNION ALL SELECT o_custkey, 'orders' FROM orders UNION ALL SELECT user_id, 'events' FROM events) GROUP BY k")
def j_prebuilt_mongo(spark, d):
    t = Tables(spark, d)
    out = merge.registry({"customer": t.customer.select(F.col("c_custkey").alias("_id")), "orders": t.orders.select(F.col("o_custkey").alias("_id")), "events": t.events.select(F.col("user_id").alias("_id"))})
    return out.select("_id", F.array_join("sources", ",").alias("sources"))


_VERSIONS = "WITH b AS (SELECT n_name AS source, CAST(n_nationkey AS VARCHAR) AS version FROM nation WHERE n_nationkey < 20), c AS (SELECT n_name AS source, CAST(n_nationkey + n_nationkey % 3 AS VARCHAR) AS version FROM nation) "


@query("j_whatsnew", _VERSIONS + "SELECT c.source, b.version AS old, c.version AS new FROM c LEFT JOIN b ON b.source = c.source WHERE b.version IS DISTINCT FROM c.version")
def j_whatsnew(spark, d):
    n = Tables(spark, d).nation
    v = lambda e: F.expr(e).cast("string").alias("version")
    return merge.whats_new(n.filter("n_nationkey < 20").select(F.col("n_name").alias("source"), v("n_nationkey")), n.select(F.col("n_name").alias("source"), v("n_nationkey + n_nationkey % 3")))


@query("j_merge_worker", _json_list('{"kind":', '}'))
def j_merge_worker(spark, d):
    docs = _events(spark, d).select("_id", "pos", F.to_json(F.struct("kind")).alias("doc"))
    return merge.fold_documents(docs, "_id", "pos")


# structural merges


def _flag_lists(spark, d):
    line = Tables(spark, d).lineitem
    own = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == f, F.col("l_returnflag"))))
    return line.groupBy("l_orderkey").agg(own("O").alias("a"), own("F").alias("b"))


_FLAGS = "SELECT l_orderkey, coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'O')), []) AS a, coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F')), []) AS b FROM lineitem GROUP BY l_orderkey"


@query("m_merge_struct", f"SELECT l_orderkey, array_to_string(a || list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS merged FROM ({_FLAGS})")
def m_merge_struct(spark, d):
    return _flag_lists(spark, d).select("l_orderkey", F.array_join(merge.merge_lists(F.col("a"), F.col("b")), ",").alias("merged"))


@query("m_merge_root_keys", f"SELECT l_orderkey, array_to_string(a || b, ',') AS merged FROM ({_FLAGS})")
def m_merge_root_keys(spark, d):
    return _flag_lists(spark, d).select("l_orderkey", F.array_join(merge.merge_root_lists(F.col("a"), F.col("b")), ",").alias("merged"))


@query("m_dict_attrmerge", f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(a || b)), ',') AS merged FROM ({_FLAGS})")
def m_dict_attrmerge(spark, d):
    return _flag_lists(spark, d).select("l_orderkey", F.array_join(A.normalised(F.concat("a", "b")), ",").alias("merged"))


@query("m_dict_apply", f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(a || ['Z'])), ',') AS merged FROM ({_FLAGS})")
def m_dict_apply(spark, d):
    return _flag_lists(spark, d).select("l_orderkey", F.array_join(A.normalised(F.array_append("a", F.lit("Z"))), ",").alias("merged"))


for _name in ("m_update_recur", "m_merge_object"):
    query(_name, _BOTH + "SELECT o._id, coalesce(n.name, o.name) AS name, coalesce(n.seg, o.seg) AS seg FROM o JOIN n ON o._id = n._id")(
        lambda spark, d: merge.update_nested(_customers(spark, d).select("_id", F.struct("name", "seg").alias("x")), _newer(spark, d).select("_id", F.struct("name", "seg").alias("x"))).select("_id", "x.name", "x.seg")
    )


@query("m_updated_dict", "SELECT n_nationkey, 'z' AS name, n_regionkey || '' AS region FROM nation")
def m_updated_dict(spark, d):
    m = V.updated(F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")), {"name": F.lit("z")})
    return Tables(spark, d).nation.select("n_nationkey", m["name"].alias("name"), m["region"].alias("region"))


@query("m_dict_to_list", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name FROM nation ORDER BY n_nationkey")
def m_dict_to_list(spark, d):
    by_region = Tables(spark, d).nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return merge.documents_of(by_region, "m", "name")


@query("m_src_meta", "SELECT c_mktsegment AS source, CASE WHEN count(DISTINCT c_nationkey) = 1 THEN min(c_nationkey) END AS version, count(*) AS n FROM customer GROUP BY 1")
def m_src_meta(spark, d):
    return catalogue.source_versions(Tables(spark, d).customer, "c_mktsegment", "c_nationkey")


@query("m_hubmeta_add", "SELECT n_regionkey, CASE WHEN count(DISTINCT CASE WHEN n_regionkey = 1 THEN 'gene' ELSE n_name END) = 1 THEN 'gene' ELSE '__multiple__' END AS type, CAST('v1' AS VARCHAR) AS version, max('2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0')) AS build_date, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS sources, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def m_hubmeta_add(spark, d):
    rows = Tables(spark, d).nation.select("n_regionkey", F.when(F.col("n_regionkey") == 1, "gene").otherwise(F.col("n_name")).alias("type"), F.lit("v1").alias("version"), F.concat(F.lit("2024-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("build_date"), F.array("n_name").alias("sources"), big("n_nationkey").alias("total"))
    return merge.combine_metadata(rows, ["n_regionkey"])


@query("m_merge_dups", """WITH e AS (SELECT user_id AS _id, event_id AS pos, event_type AS kind, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events),
s AS (SELECT *, coalesce(max(CASE WHEN kind <> f THEN 1 ELSE 0 END) OVER (PARTITION BY _id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS other, row_number() OVER (PARTITION BY _id ORDER BY pos) AS rn FROM e)
SELECT _id, array_to_string(list(kind ORDER BY pos) FILTER (rn = 1 OR kind <> f OR other = 1), ',') AS kinds FROM s GROUP BY _id""")
def m_merge_dups(spark, d):
    out = merge.first_different(_events(spark, d).select("_id", "pos", "kind"), "_id", "pos", ["kind"])
    return out.select("_id", F.array_join("kind", ",").alias("kinds"))


@query("m_merge_delta", """SELECT user_id AS _id, CASE WHEN min(event_id) % 7 = 0 AND count(*) FILTER (event_id % 7 = 0) = 1 THEN '{"__REPLACE__":true,"kind":"' ELSE '{"kind":"' END || arg_max(event_type, event_id) || '"}' AS doc FROM events GROUP BY user_id""")
def m_merge_delta(spark, d):
    docs = _events(spark, d).select("_id", "pos", F.to_json(F.struct(F.when(F.col("pos") % 7 == 0, True).alias("__REPLACE__"), "kind")).alias("doc"))
    return merge.fold_documents(docs, "_id", "pos", f=merge.apply_delta)


@query("m_merge_mapping", "SELECT column_name AS field, CASE data_type WHEN 'INTEGER' THEN 'integer' WHEN 'VARCHAR' THEN 'keyword' END AS type FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
def m_merge_mapping(spark, d):
    t = Tables(spark, d)
    return spark.createDataFrame(profile.schema_rows(profile.mapping(merge.merged_schema([t.nation, t.region]))), "field string, type string")


@query("m_merge_meta", "SELECT n_regionkey, 'x' AS type, 'v' AS version, max(n_name) AS build_date, string_agg(n_name, ',' ORDER BY n_name) AS sources, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1")
def m_merge_meta(spark, d):
    rows = Tables(spark, d).nation.select("n_regionkey", F.lit("x").alias("type"), F.lit("v").alias("version"), F.col("n_name").alias("build_date"), F.array("n_name").alias("sources"), big("n_nationkey").alias("total"))
    return merge.combine_metadata(rows, ["n_regionkey"])


@query("m_mappings_add", "SELECT * FROM (VALUES ('n_name', 'text'), ('n_nationkey', 'integer'), ('r_name', 'keyword')) v(field, type)")
def m_mappings_add(spark, d):
    t = Tables(spark, d)
    nation, region = profile.mapping(t.nation.select("n_nationkey", "n_name").schema), profile.mapping(t.region.select("r_name").schema)
    both = united(nation["properties"], region["properties"], {"n_name": {"type": "text"}})
    return spark.createDataFrame(profile.schema_rows({"properties": both}), "field string, type string")


@query("m_license_add", "SELECT * FROM (VALUES ('exac', 'http://b'), ('snpeff', 'http://a'), ('wellderly', 'http://c')) v(source, url)")
def m_license_add(spark, d):
    both = united({"exac": "http://a", "snpeff": "http://a"}, {"exac": "http://b", "wellderly": "http://c"})
    return spark.createDataFrame(sorted(both.items()), "source string, url string")


# aggregations


@query("a_facet_terms", "WITH c AS (SELECT o_orderpriority AS term, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT * FROM c ORDER BY n DESC, term LIMIT 3) SELECT term, n AS count, CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s) AS BIGINT) AS other FROM s")
def a_facet_terms(spark, d):
    return facets.terms_facet(Tables(spark, d).orders, "o_orderpriority", 3).select("term", "count", "other")


@query("a_facet_format", "WITH x AS (SELECT DISTINCT l_orderkey, l_returnflag AS term FROM lineitem), c AS (SELECT term, count(*) AS n FROM x GROUP BY 1), s AS (SELECT * FROM c ORDER BY n DESC, term LIMIT 2) SELECT term, n AS count, CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s) AS BIGINT) AS other, CAST((SELECT sum(n) FROM s) AS BIGINT) AS total, CAST(0 AS BIGINT) AS missing FROM s")
def a_facet_format(spark, d):
    docs = Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return facets.terms_facet(docs, "flags", 2, is_array=True)


@query("a_facet_nested", """WITH p AS (SELECT o_orderstatus, o_orderpriority, count(*) AS inner_count FROM orders GROUP BY 1, 2), t AS (SELECT o_orderstatus, sum(inner_count)::BIGINT AS outer_count FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)
SELECT o_orderstatus, outer_count, o_orderpriority, inner_count, rank FROM (SELECT p.*, t.outer_count, row_number() OVER (PARTITION BY p.o_orderstatus ORDER BY inner_count DESC, o_orderpriority) AS rank FROM p JOIN t ON p.o_orderstatus = t.o_orderstatus) WHERE rank <= 2""")
def a_facet_nested(spark, d):
    return facets.nested_facet(Tables(spark, d).orders, "o_orderstatus", "o_orderpriority", 2)


@query("a_count_root_keys", "SELECT 'c_name' AS field, count(c_name) AS n FROM customer UNION ALL SELECT 'c_acctbal', count(nullif(c_mktsegment, 'BUILDING')) FROM customer")
def a_count_root_keys(spark, d):
    docs = Tables(spark, d).customer.withColumn("c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return facets.field_counts(docs, ["c_name", "c_acctbal"])


for _name, _keys in (("a_src_stats", ("c_mktsegment", "c_nationkey")), ("a_item_count", ("c_mktsegment",)), ("a_field_tracking", ("c_nationkey",))):
    query(_name, f"SELECT {', '.join(_keys)}, count(*) AS n FROM customer GROUP BY ALL")((lambda keys: lambda spark, d: facets.group_count(Tables(spark, d).customer, *keys))(_keys))


@query("a_hist_edge", "SELECT 'order-->customer' AS edge, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def a_hist_edge(spark, d):
    e = _edges(spark, d)[0]
    ids = Tables(spark, d).orders.select(F.col("o_orderkey").cast("string").alias("orig")).withColumn("cur", F.col("orig"))
    return facets.group_count(e.follow(ids).withColumn("edge", F.lit(f"{e.source}-->{e.target}")), "edge")


@query("a_hist_io", "SELECT 'order' AS input, 'region' AS output, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def a_hist_io(spark, d):
    out = G.travel(Tables(spark, d).orders.select(F.col("o_orderkey").alias("orig")), _edges(spark, d), "order", "region")
    return facets.group_count(out.withColumns({"input": F.lit("order"), "output": F.lit("region")}), "input", "output")


@query("a_list2dict", "SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY o_orderkey), ',') AS statuses FROM orders GROUP BY o_custkey")
def a_list2dict(spark, d):
    from quillon.operators import tables

    return tables.group_values(Tables(spark, d).orders, ["o_custkey"], F.col("o_orderstatus"), F.col("o_orderkey")).select("o_custkey", F.array_join("values", ",").alias("statuses"))


@query("a_list_merge_by_conf", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS builds FROM nation GROUP BY 1")
def a_list_merge_by_conf(spark, d):
    return collections.listed_by(Tables(spark, d).nation, "n_name", "n_regionkey").select("n_regionkey", F.array_join("n_name", ",").alias("builds"))


for _name, _keep in (("a_keep_n_snapshots", 3), ("a_keep_n_indices", 2), ("g_keep_archive", 1), ("g_keep_archive_src", 5)):
    query(_name, f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= {_keep} AS kept FROM orders")((lambda keep: lambda spark, d: facets.newest(Tables(spark, d).orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], keep).select("o_orderkey", "kept"))(_keep))


@query("a_archive_old", "SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 1000")
def a_archive_old(spark, d):
    return catalogue.by_age(Tables(spark, d).orders, "o_orderdate", 1000, F.lit("1998-01-01").cast("date")).select("o_orderkey")


@query("a_build_info", "SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS jobs FROM events GROUP BY user_id")
def a_build_info(spark, d):
    return catalogue.last_status(Tables(spark, d).events, "user_id", "event_id", "event_type")


@query("a_source_sum", "SELECT n_regionkey, CAST(sum(c) AS BIGINT) AS n FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1")
def a_source_sum(spark, d):
    t = Tables(spark, d)
    subs = facets.group_count(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", name="c")
    return catalogue.source_totals(subs, t.nation, "n_nationkey", "n_regionkey", "c")


@query("a_id_sets", "SELECT DISTINCT user_id AS _id FROM events")
def a_id_sets(spark, d):
    return collections.ids(Tables(spark, d).events, "user_id").distinct()


@query("a_agg_sum", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem")
def a_agg_sum(spark, d):
    return parallel.fold_sum(Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("total")), lambda batch: batch.sum().to_frame().T, "total")


@query("a_agg_append", "SELECT n_nationkey * 10 AS id FROM nation")
def a_agg_append(spark, d):
    return parallel.fold_append(Tables(spark, d).nation.select(F.col("n_nationkey").alias("id")), lambda batch: batch * 10, "id int")


@query("a_index_listing", "SELECT n_name, c AS n FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey ORDER BY n_nationkey DESC LIMIT 10")
def a_index_listing(spark, d):
    t = Tables(spark, d)
    counts = facets.group_count(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey")
    return catalogue.newest_first(t.nation.join(counts, "n_nationkey"), F.desc("n_nationkey"), 10).select("n_name", "n")


# profiles


def _profiled(spark, d):
    docs = Tables(spark, d).part.select(F.col("p_partkey").alias("_id"), "p_name", "p_size", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"))
    return profile.leaf_rows(docs)


_PROFILED = "(SELECT 'p_name' AS path, 'str' AS type, CAST(length(p_name) AS DOUBLE) AS number, p_name AS text FROM part UNION ALL SELECT 'p_size', 'int', CAST(p_size AS DOUBLE), CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'price', 'float', CASE WHEN p_size > 25 THEN p_retailprice END, CASE WHEN p_size > 25 THEN CAST(p_retailprice AS VARCHAR) END FROM part)"
_STATS = f"SELECT path, type, false AS in_list, count(text) AS count, count(*) FILTER (text IS NULL) AS none, min(number) AS min, max(number) AS max FROM {_PROFILED} GROUP BY 1, 2"


@query("i_inspect_docs", f"SELECT path, type, count(*) AS n FROM {_PROFILED} GROUP BY 1, 2")
def i_inspect_docs(spark, d):
    return facets.group_count(_profiled(spark, d), "path", "type")


for _name in ("i_stats", "i_flatten_inspect"):
    query(_name, _STATS)(lambda spark, d: profile.statistics(_profiled(spark, d)))


@query("i_stats_merge", _STATS)
def i_stats_merge(spark, d):
    rows = _profiled(spark, d)
    return profile.merged_statistics(profile.statistics(rows.filter("_id % 2 = 0")).unionByName(profile.statistics(rows.filter("_id % 2 = 1"))))


for _name in ("i_deepstats", "g_deep_report"):
    query(_name, f"SELECT path, type, round(avg(number), 4) AS mean, median(number) AS median, round(CASE WHEN count(number) > 1 THEN stddev_samp(number) END, 4) AS stdev FROM {_PROFILED} GROUP BY 1, 2")(lambda spark, d: profile.statistics(_profiled(spark, d), deep=True, exact_median=True).select("path", "type", F.round("mean", 4).alias("mean"), "median", F.round("stdev", 4).alias("stdev")))


@query("i_regex_ident", "SELECT 'p_name' AS path, 'red' AS info, count(*) AS n FROM part WHERE p_name LIKE 'red%' UNION ALL SELECT 'p_name', 'word', count(*) FROM part WHERE regexp_matches(p_name, '^[a-z]+ ')")
def i_regex_ident(spark, d):
    return profile.identifiers(_profiled(spark, d).filter("path = 'p_name'"), {"red": "red", "word": "[a-z]+ "})


# names of every kind: p_size is a number in one source and a text in the other, and a list in the third
_FIELDS = "(SELECT * FROM (VALUES ('Part Name', 'str'), ('brand-name', 'str'), ('p_size', 'int'), ('p_size', 'str'), ('ok', 'int'), ('ok', 'float'), ('tags', 'list of str'), ('tags', 'str')) v(path, type) WHERE EXISTS (SELECT 1 FROM part))"
_RULES = {
    "W001": "contains(path, ' ')",
    "W002": "path <> lower(path)",
    "W003": "regexp_matches(path, '[^a-zA-Z0-9_.]')",
    "W004": "path IN (SELECT path FROM f GROUP BY path HAVING count(DISTINCT CASE WHEN type IN ('int', 'float') THEN 'number' ELSE regexp_replace(type, '^list of ', '') END) > 1)",
}


def _observed(spark, d):
    """Leaves of three sources over the parts, whose fields differ in name and type."""
    p = Tables(spark, d).part.withColumnRenamed("p_partkey", "_id")
    one = p.select("_id", F.col("p_name").alias("Part Name"), "p_size", F.col("p_size").alias("ok"))
    two = p.select("_id", F.col("p_brand").alias("brand-name"), F.col("p_size").cast("string").alias("p_size"), F.col("p_retailprice").alias("ok"), F.col("p_type").alias("tags"))
    three = p.select("_id", F.split("p_type", " ").alias("tags"))
    return reduce(lambda a, b: a.unionByName(b), [profile.leaf_rows(x) for x in (one, two, three)])


_WARN = f"WITH f AS (SELECT * FROM {_FIELDS}) " + " UNION ALL ".join(f"SELECT DISTINCT path, '{c}' AS code FROM f WHERE {r}" for c, r in _RULES.items())


@query("i_validate_names", _WARN)
def i_validate_names(spark, d):
    return profile.name_warnings(profile.observed_fields(_observed(spark, d)))


@query("i_flatten_validate", f"WITH f AS (SELECT * FROM {_FIELDS}), w AS ({_WARN}) SELECT f.path, string_agg(DISTINCT type, ',' ORDER BY type) AS types, (SELECT string_agg(code, ',' ORDER BY code) FROM w WHERE w.path = f.path) AS codes FROM f GROUP BY f.path")
def i_flatten_validate(spark, d):
    return profile.flat_validated(_observed(spark, d))


for _code, _rule in _RULES.items():
    query(f"g_{_code.lower()}", f"WITH f AS (SELECT * FROM {_FIELDS}) SELECT DISTINCT path, '{_code}' AS code FROM f WHERE {_rule}")((lambda code: lambda spark, d: i_validate_names(spark, d).filter(F.col("code") == code))(_code))


@query("i_clean_big", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey END AS value FROM orders")
def i_clean_big(spark, d):
    huge = F.lit("30000000000000000000").cast("decimal(38,0)")
    n = F.when(F.col("o_orderkey") % 3 == 0, huge).otherwise(F.col("o_orderkey").cast("decimal(38,0)"))
    return Tables(spark, d).orders.select("o_orderkey", profile.within_64_bits(n).alias("value"))


@query("i_validate_docs", "SELECT c_custkey, 'number' AS field FROM customer WHERE c_custkey % 4 = 1")
def i_validate_docs(spark, d):
    docs = Tables(spark, d).customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 1, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("number"))
    return profile.invalid_values(docs, {"number": "bigint"}, "c_custkey")


@query("g_regex_merge", "SELECT n_regionkey, string_agg(DISTINCT left(n_name, 7), ',' ORDER BY left(n_name, 7)) AS infos FROM nation GROUP BY 1")
def g_regex_merge(spark, d):
    return merge.united_values(Tables(spark, d).nation.withColumn("info", F.left("n_name", F.lit(7))), "n_regionkey", "info").select("n_regionkey", F.array_join("info", ",").alias("infos"))


_DOC_TYPES = "('status', 'str'), ('price', 'float'), ('customer.key', 'int'), ('customer.priority.level', 'splitstr'), ('items.line', 'int'), ('items.part', 'int'), ('items.qty', 'float'), ('items.flag', 'str')"
_DOC_STATS = "SELECT path, type, in_list, count(number) AS count, count(*) FILTER (number IS NULL) AS none, min(number) AS min, max(number) AS max FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS path, '{t}' AS type, {m} AS in_list, CAST({x} AS DOUBLE) AS number FROM {src}"
    for p, t, m, x, src in (
        ("status", "str", "false", "length(o_orderstatus)", "orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
        ("price", "float", "false", "o_totalprice", "orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
        ("customer.key", "int", "false", "o_custkey", "orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
        ("customer.priority.level", "str", "false", "length(o_orderpriority)", "orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
        ("items.line", "int", "true", "l_linenumber", _ITEMS.removeprefix("FROM ")),
        ("items.part", "int", "true", "l_partkey", _ITEMS.removeprefix("FROM ")),
        ("items.qty", "float", "true", "l_quantity", _ITEMS.removeprefix("FROM ")),
        ("items.flag", "str", "true", "length(l_returnflag)", _ITEMS.removeprefix("FROM ")),
    )
) + ") GROUP BY path, type, in_list"
_BFS = ("status", "price", "customer", "items", "customer.key", "customer.priority", "customer.priority.level")
_DFS = ("status", "price", "customer", "customer.key", "customer.priority", "customer.priority.level", "items")


def _steps(names):
    values = ", ".join(f"('{p}', CAST({i} AS BIGINT))" for i, p in enumerate(names))
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, path, step FROM orders, (VALUES {values}) v(path, step) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"


def _step_values(names):
    return f"""SELECT _id, path, step, CASE path WHEN 'status' THEN '{{"v":"' || o_orderstatus || '"}}' ELSE '{{"v":' || o_custkey || '}}' END AS value FROM ({_steps(names)}) JOIN orders ON _id = CAST(o_orderkey AS VARCHAR) WHERE path IN ('status', 'customer.key')"""


def _walked(spark, d, depth_first):
    return profile.traversal(orders_as_documents(spark, d), depth_first)


_SCHEMA_ROWS = "SELECT * FROM (VALUES ('_id', 'string'), ('status', 'string'), ('price', 'number'), ('customer.key', 'integer'), ('customer.priority.level', 'string'), ('items.line', 'integer'), ('items.part', 'integer'), ('items.qty', 'number'), ('items.flag', 'string')) v(path, type)"
_MAPPING_ROWS = "SELECT * FROM (VALUES ('_id', 'keyword'), ('status', 'text'), ('price', 'float'), ('customer.key', 'integer'), ('customer.priority.level', 'keyword'), ('items.line', 'integer'), ('items.part', 'integer'), ('items.qty', 'float'), ('items.flag', 'keyword')) v(path, type)"

for _name, (_sql, _run) in {
    "i_inspect": (f"SELECT path, types FROM (VALUES {_DOC_TYPES}) v(path, types) WHERE EXISTS (SELECT 1 {_ITEMS})", lambda spark, d: profile.observed_types(profile.leaf_rows(orders_as_documents(spark, d)))),
    "i_merge_record": ("SELECT * FROM (VALUES ('p_name', 'splitstr'), ('p_size', 'int'), ('price', 'float')) v(path, types)", lambda spark, d: profile.observed_types(_profiled(spark, d))),
    "i_merge_scalar_list": ("SELECT * FROM (VALUES ('n', 'list of float'), ('tags', 'list of str')) v(path, type) WHERE EXISTS (SELECT 1 FROM part)", lambda spark, d: _scalars_and_lists(spark, d)),
    "i_jsonschema": (_SCHEMA_ROWS, lambda spark, d: spark.createDataFrame(profile.schema_rows(profile.json_schema(orders_as_documents(spark, d).schema)), "path string, type string")),
    "i_es_mapping": (_MAPPING_ROWS, lambda spark, d: spark.createDataFrame(profile.schema_rows(profile.mapping(orders_as_documents(spark, d).schema, frozenset({"status"}))), "path string, type string")),
    "i_total_fields": ("SELECT CAST(9 AS INTEGER) AS n", lambda spark, d: spark.createDataFrame([(profile.total_fields(profile.mapping(orders_as_documents(spark, d).schema)),)], "n int")),
    "i_inspector": (_DOC_STATS, lambda spark, d: profile.statistics(profile.leaf_rows(orders_as_documents(spark, d)))),
    "i_model_gen": ("SELECT * FROM (VALUES ('r_regionkey', 'Optional[Union[int, list[int]]]'), ('r_name', 'Optional[Union[str, list[str]]]')) v(field, annotation)", lambda spark, d: spark.createDataFrame(profile.model(Tables(spark, d).region.schema), "field string, annotation string")),
    "i_traverse_bfs": (_steps(_BFS), lambda spark, d: _walked(spark, d, False).select("_id", "path", "step")),
    "i_traverse_bfs_rec": (_step_values(_BFS), lambda spark, d: _walked(spark, d, False).filter(F.col("path").isin("status", "customer.key"))),
    "i_traverse_dfs": (_steps(_DFS), lambda spark, d: _walked(spark, d, True).select("_id", "path", "step")),
    "i_traverse_dfs_rec": (_step_values(_DFS), lambda spark, d: _walked(spark, d, True).filter(F.col("path").isin("status", "customer.key"))),
    "g_inspect_batch": (_STATS, lambda spark, d: profile.statistics(_profiled(spark, d))),
    "g_inspect_flat_api": (_DOC_STATS, lambda spark, d: profile.statistics(profile.leaf_rows(orders_as_documents(spark, d)))),
    "g_src_validate": ("SELECT 'c_name' AS field, count(*) AS n FROM customer WHERE try_cast(c_name AS BIGINT) IS NULL", lambda spark, d: facets.group_count(profile.invalid_values(Tables(spark, d).customer.select("c_custkey", "c_name"), {"c_name": "bigint"}, "c_custkey"), "field")),
    "i_typify": ("SELECT * FROM (VALUES ('a', 'bigint'), ('b.c', 'string'), ('b.d', 'double'), ('e', 'plain')) v(path, type)", lambda spark, d: _typed_rows(spark)),
    "g_deep_merge": ("SELECT path, count(number) AS count, round(avg(number), 6) AS mean, round(stddev_samp(number), 6) AS stdev FROM " + _PROFILED + " GROUP BY path", lambda spark, d: _merged_deep(spark, d)),
    "g_stats_flatten": (_STATS, lambda spark, d: profile.merged_statistics(profile.statistics(_profiled(spark, d).filter("number > 20 OR number IS NULL")).unionByName(profile.statistics(_profiled(spark, d).filter("number <= 20"))))),
}.items():
    query(_name, _sql)(_run)


def _scalars_and_lists(spark, d):
    p = Tables(spark, d).part.withColumnRenamed("p_partkey", "_id")
    one = p.select("_id", F.col("p_size").alias("n"), F.array("p_brand", "p_type").alias("tags"))
    two = p.select("_id", F.array("p_retailprice").alias("n"), F.col("p_brand").alias("tags"))
    return profile.merged_observations(profile.leaf_rows(one), profile.leaf_rows(two))


def _typed_rows(spark):
    stored = {"a": V.MARK + "int", "b": {"c": V.MARK + "str", "d": V.MARK + "float"}, "e": "plain"}

    def rows(value, path=""):
        if isinstance(value, dict):
            return [r for k, v in value.items() for r in rows(v, f"{path}.{k}" if path else k)]
        return [(path, value if isinstance(value, str) else value.simpleString())]

    return spark.createDataFrame(rows(V.typed(stored)), "path string, type string")


def _merged_deep(spark, d):
    rows = _profiled(spark, d)
    parts = profile.value_sums(rows.filter("_id % 2 = 0")).unionByName(profile.value_sums(rows.filter("_id % 2 = 1")))
    return profile.merged_values(parts).select("path", "count", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


# differences and releases

_CMP = _BOTH + ", x AS (SELECT coalesce(o._id, n._id) AS _id, CASE WHEN o._id IS NULL THEN 'add' WHEN n._id IS NULL THEN 'delete' WHEN o.name IS DISTINCT FROM n.name OR o.bal IS DISTINCT FROM n.bal OR o.seg IS DISTINCT FROM n.seg THEN 'update' ELSE 'same' END AS op FROM o FULL JOIN n ON o._id = n._id) "


def _ops(spark, d):
    return diff.compared(_customers(spark, d), _newer(spark, d)).select("_id", "op")


for _name, _keep in (("d_diff_new_old", ("add", "update")), ("d_diff_old_new", ("delete",)), ("d_diff_cols", ("add", "delete", "update", "same")), ("d_collections_mem", ("add", "delete", "update")), ("d_diff_docs", ("update",)), ("g_diff_backends", ("add", "delete", "update"))):
    query(_name, _CMP + f"SELECT _id, op FROM x WHERE op IN ({', '.join(repr(k) for k in _keep)})")((lambda keep: lambda spark, d: _ops(spark, d).filter(F.col("op").isin(*keep)))(_keep))


@query("d_json_files", _CMP + "SELECT op, count(*) AS n FROM x GROUP BY op")
def d_json_files(spark, d):
    return facets.group_count(_ops(spark, d), "op")


@query("d_diff_doc", _BOTH + """SELECT o._id, 'seg' AS attribute, CASE WHEN n.seg IS NULL THEN 'delete' ELSE 'update' END AS change FROM o JOIN n ON o._id = n._id WHERE n.seg IS DISTINCT FROM o.seg UNION ALL SELECT o._id, 'name', 'update' FROM o JOIN n ON o._id = n._id WHERE o.name <> n.name UNION ALL SELECT o._id, 'bal', 'update' FROM o JOIN n ON o._id = n._id WHERE o.bal <> n.bal""")
def d_diff_doc(spark, d):
    return diff.attribute_changes(_customers(spark, d), _newer(spark, d))


@query("d_full_diff_doc", "WITH x AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT CASE WHEN l_orderkey % 5 = 0 AND l_returnflag = 'R' THEN 'Q' ELSE l_returnflag END)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, a = b AS same FROM x")
def d_full_diff_doc(spark, d):
    line = Tables(spark, d).lineitem
    changed = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_returnflag") == "R"), "Q").otherwise(F.col("l_returnflag"))
    x = line.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(changed).alias("b"))
    return x.select("l_orderkey", diff.same_members(F.col("a"), F.col("b")).alias("same"))


@query("d_normalize", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name FROM nation")
def d_normalize(spark, d):
    return diff.unwrapped(Tables(spark, d).nation.select(F.col("n_nationkey").cast("string").alias("_id"), F.struct(F.col("n_name").alias("name")).alias("_source")))


@query("d_coldhot_fix", "SELECT c_custkey AS _id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'update' WHEN c_custkey % 2 = 0 THEN 'delete' ELSE 'update' END AS op, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a,b' END AS removed FROM customer")
def d_coldhot_fix(spark, d):
    c = Tables(spark, d).customer.select(F.col("c_custkey").alias("_id"))
    changes = c.select("_id", F.when(F.col("_id") % 2 == 0, "delete").otherwise("update").alias("op"), F.array(F.lit("a"), F.lit("b")).alias("removed"))
    cold = c.filter("_id % 3 = 0").select("_id", F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))
    return release.keep_cold(changes, cold).select("_id", "op", F.array_join("removed", ",").alias("removed"))


@query("d_report", _CMP + ", y AS (SELECT _id, op, row_number() OVER (PARTITION BY op ORDER BY _id) AS rn FROM x) SELECT op, 'root' AS path, count(*) AS n, array_to_string(list(_id ORDER BY _id) FILTER (rn <= 10), ',') AS ids FROM y GROUP BY op")
def d_report(spark, d):
    out = diff.report(_ops(spark, d).withColumn("path", F.lit("root")))
    return out.select("op", "path", "n", F.array_join("ids", ",").alias("ids"))


@query("d_sync_coldhot", _BOTH + "SELECT o._id, coalesce(n.name, o.name) AS name, n._id IS NULL OR (n.name IS NOT DISTINCT FROM o.name) AS skipped FROM o LEFT JOIN n ON o._id = n._id")
def d_sync_coldhot(spark, d):
    old, new = _customers(spark, d).select("_id", "name"), _newer(spark, d).select("_id", "name")
    out = load.update_roots(old, new, insert=False)
    return out.alias("u").join(old.alias("o"), "_id").select("_id", "u.name", F.col("u.name").eqNullSafe(F.col("o.name")).alias("skipped"))


_STAT = "WITH a AS (SELECT c_mktsegment AS name, count(*) AS c FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1), b AS (SELECT c_mktsegment AS name, count(*) AS c FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1) "


@query("d_relnote_stats", _STAT + "SELECT coalesce(a.name, b.name) AS name, a.c AS old, b.c AS new, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'deleted' WHEN a.c <> b.c THEN 'updated' ELSE 'same' END AS change FROM a FULL JOIN b ON a.name = b.name")
def d_relnote_stats(spark, d):
    c = Tables(spark, d).customer
    stats = lambda df: df.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("count"))
    return diff.stats_changes(stats(c.filter("c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING'")), stats(c.filter("c_mktsegment <> 'MACHINERY'")))


@query("d_relnote_mapping", "SELECT * FROM (VALUES ('customer.priority.level', 'delete'), ('customer.level', 'add')) v(path, change)")
def d_relnote_mapping(spark, d):
    old = orders_as_documents(spark, d)
    new = old.withColumn("customer", F.struct("customer.key", F.col("customer.priority.level").alias("level")))
    paths = lambda df: spark.createDataFrame([(p,) for p, _, _ in A.leaves(df.schema)], "path string")
    a, b = paths(old), paths(new)
    return a.join(b, "path", "left_anti").withColumn("change", F.lit("delete")).unionByName(b.join(a, "path", "left_anti").withColumn("change", F.lit("add")))


@query("d_relnote_counts", "SELECT split_part(n_name, '_', 1) AS main, split_part(n_name, '_', 2) AS sub, count(*) AS n FROM nation GROUP BY 1, 2")
def d_relnote_counts(spark, d):
    parts = F.split("n_name", "_")
    return facets.group_count(Tables(spark, d).nation.select(parts[0].alias("main"), parts[1].alias("sub")), "main", "sub")


@query("d_relnote_num", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'N.A' ELSE (CASE WHEN c_custkey % 2 = 1 THEN '-' ELSE '+' END) || format('{:,}', c_custkey * 1000) END AS text FROM customer")
def d_relnote_num(spark, d):
    n = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") * 1000 * F.when(F.col("c_custkey") % 2 == 1, -1).otherwise(1))
    return Tables(spark, d).customer.select("c_custkey", S.number_text(n, sign=True).alias("text"))


@query("d_update_path", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS VARCHAR) AS required, CAST(n_nationkey + n_regionkey + 1 AS VARCHAR) AS target FROM nation), r AS (SELECT '0' AS version, CAST(0 AS BIGINT) AS hops UNION SELECT target, hops + 1 FROM r JOIN e ON version = required WHERE hops < 8) SELECT version, min(hops) AS hops FROM r GROUP BY version")
def d_update_path(spark, d):
    inc = Tables(spark, d).nation.select(F.col("n_nationkey").cast("string").alias("required"), (F.col("n_nationkey") + F.col("n_regionkey") + 1).cast("string").alias("target"))
    return release.reachable(inc, "0", 8)


@query("d_best_version", "SELECT n_regionkey, max(v) AS version FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN '1.' ELSE '9' END || CAST(n_nationkey AS VARCHAR) AS v FROM nation) x WHERE contains(v, '.') OR NOT EXISTS (SELECT 1 FROM nation y WHERE y.n_regionkey = x.n_regionkey AND y.n_nationkey % 2 = 0) GROUP BY 1")
def d_best_version(spark, d):
    v = Tables(spark, d).nation.select("n_regionkey", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "1.").otherwise("9"), F.col("n_nationkey").cast("string")).alias("version"))
    return release.best_version(v, ["n_regionkey"])


def _json_docs(df):
    return df.select("_id", F.to_json(F.struct("name", "seg"), {"ignoreNullFields": "false"}).alias("doc"))


def _list_docs(df):
    return df.select("_id", F.to_json(F.struct(F.array("seg", "name").alias("xs"))).alias("doc"))


def _patches(spark, d):
    return diff.json_patches(_json_docs(_customers(spark, d)), _json_docs(_newer(spark, d)))


def _quoted(x: str) -> str:
    return f"coalesce('\"' || {x} || '\"', 'null')"


_DOC = f"""'{{"name":' || {_quoted('name')} || ',"seg":' || {_quoted('seg')} || '}}'"""
_J = _BOTH + f", a AS (SELECT _id, name, seg, {_DOC} AS doc FROM o), b AS (SELECT _id, name, seg, {_DOC} AS doc FROM n) "
_PATCH = _J + f"""SELECT a._id, '[' || concat_ws(',', '{{"op":"replace","path":"/name","value":' || {_quoted('b.name')} || '}}', CASE WHEN a.seg IS DISTINCT FROM b.seg THEN '{{"op":"replace","path":"/seg","value":' || {_quoted('b.seg')} || '}}' END) || ']' AS patch FROM a JOIN b ON a._id = b._id"""
_PATCHED = _J + "SELECT a._id, coalesce(b.doc, a.doc) AS doc, CASE WHEN b.doc IS NULL THEN 'unchanged' ELSE 'patched' END AS status FROM a LEFT JOIN b ON a._id = b._id"
# lists [seg, name]: an item that changes is one replacement, in place
_LIST_PATCH = _J + f"""SELECT a._id, '[{{"op":"replace","path":"/xs","value":[' || {_quoted('b.seg')} || ',' || {_quoted('b.name')} || ']}}]' AS patch FROM a JOIN b ON a._id = b._id"""


def _patched(spark, d):
    return diff.patched(_json_docs(_customers(spark, d)), _patches(spark, d))


for _name, (_sql, _run) in {
    "d_jsonpatch_docs": (_PATCH, lambda spark, d: diff.root_patches(_customers(spark, d).select("_id", "name", "seg"), _newer(spark, d).select("_id", "name", "seg"))),
    "d_jsondiff": (_LIST_PATCH, lambda spark, d: diff.json_patches(_list_docs(_customers(spark, d)), _list_docs(_newer(spark, d)))),
    "d_patch_make": (_PATCH, lambda spark, d: diff.json_patches(_json_docs(_customers(spark, d)), _json_docs(_newer(spark, d)), whole_lists=False)),
    "d_patch_apply": (_PATCHED, _patched),
    "g_jsonpatch_apply_obj": (f"SELECT * FROM ({_PATCHED}) WHERE status = 'patched'", lambda spark, d: _patched(spark, d).filter("status = 'patched'")),
    "d_sync_mongo": (f"SELECT status, count(*) AS n FROM ({_PATCHED}) GROUP BY status", lambda spark, d: facets.group_count(_patched(spark, d), "status")),
    "d_sync_es": (f"SELECT status, count(*) AS n FROM ({_PATCHED}) GROUP BY status", lambda spark, d: facets.group_count(diff.patched(_json_docs(_customers(spark, d)), diff.root_patches(_customers(spark, d).select("_id", "name", "seg"), _newer(spark, d).select("_id", "name", "seg"))), "status")),
    "d_sync_update": (f"SELECT * FROM ({_PATCHED}) WHERE status <> 'unchanged'", lambda spark, d: _patched(spark, d).filter("status <> 'unchanged'")),
    "g_sync_cols": (_CMP + "SELECT op, count(*) AS n FROM x GROUP BY op", lambda spark, d: facets.group_count(_ops(spark, d), "op")),
    "g_diff_batches": (_CMP + "SELECT _id, op FROM x WHERE op <> 'same'", lambda spark, d: _ops(spark, d).filter("op <> 'same'")),
    "g_diff_txt": (_CMP + ", y AS (SELECT _id, op, row_number() OVER (PARTITION BY op ORDER BY _id) AS rn FROM x) SELECT op, 'root' AS path, count(*) AS n, array_to_string(list(_id ORDER BY _id) FILTER (rn <= 3), ',') AS ids FROM y GROUP BY op", lambda spark, d: diff.report(_ops(spark, d).withColumn("path", F.lit("root")), examples=3).withColumn("ids", F.array_join("ids", ","))),
    "g_coldhot_diff": (_BOTH + "SELECT coalesce(o._id, n._id) AS _id, CASE WHEN n._id IS NULL THEN 'delete' WHEN n.seg IS NULL AND o.seg IS NOT NULL THEN 'update' ELSE 'same' END AS op FROM o FULL JOIN n ON o._id = n._id", lambda spark, d: diff.compared(load.hot_over_cold(_customers(spark, d), _newer(spark, d)), _newer(spark, d)).select("_id", "op")),
    "d_reduce": (_CMP + "SELECT _id, op FROM x", lambda spark, d: _reduced(spark, d)),
}.items():
    query(_name, _sql)(_run)


def _reduced(spark, d):
    path = _folder(spark)
    _ops(spark, d).repartition(16, "_id").write.parquet(path + "/small")
    return files.compacted(spark, path + "/small", path + "/large", 64 << 20)


_OPS = {
    "remove": ([{"op": "remove", "path": "/name"}], """'{"seg":"' || seg || '"}'"""),
    "add": ([{"op": "add", "path": "/extra", "value": [1, 2]}], """'{"name":"' || name || '","seg":"' || seg || '","extra":[1,2]}'"""),
    "replace": ([{"op": "replace", "path": "/name", "value": "x"}], """'{"name":"x","seg":"' || seg || '"}'"""),
    "move": ([{"op": "move", "from": "/name", "path": "/title"}], """'{"seg":"' || seg || '","title":"' || name || '"}'"""),
    "test": ([{"op": "test", "path": "/seg", "value": "BUILDING"}, {"op": "remove", "path": "/name"}], """CASE WHEN seg = 'BUILDING' THEN '{"seg":"' || seg || '"}' ELSE doc END"""),
    "copy": ([{"op": "copy", "from": "/name", "path": "/copy"}], """'{"name":"' || name || '","seg":"' || seg || '","copy":"' || name || '"}'"""),
}
for _kind, (_op, _after) in _OPS.items():
    _status = "CASE WHEN seg = 'BUILDING' THEN 'patched' ELSE 'skipped' END" if _kind == "test" else "'patched'"
    query(f"d_op_{_kind}", _J + f"SELECT _id, {_after} AS doc, {_status} AS status FROM a")(
        (lambda op: lambda spark, d: diff.patched(_json_docs(_customers(spark, d)), _customers(spark, d).select("_id", F.lit(json.dumps(op)).alias("patch"))))(_op)
    )


@query("g_reapply", _CUST.replace("c_name AS name, c_acctbal AS bal, c_mktsegment AS seg", "'unchanged' AS status"))
def g_reapply(spark, d):
    patches = _patches(spark, d)
    return diff.patched(_patched(spark, d).select("_id", "doc"), patches).select("_id", "status")


@query("g_diff_filelist", "SELECT count(*) FILTER (op <> 'same') > 0 AS some, true AS named, true AS hashed FROM (" + _CMP + "SELECT * FROM x)")
def g_diff_filelist(spark, d):
    path = _folder(spark)
    _ops(spark, d).filter("op <> 'same'").coalesce(2).write.json(path)
    listed = files.fingerprints(spark, path + "/*.json")
    return listed.agg((F.count("*") > 0).alias("some"), F.bool_and(F.col("file").endswith(".json")).alias("named"), F.bool_and(F.length("md5") == 32).alias("hashed"))


# ranks, catalog and housekeeping


@query("s_latest_prev", "SELECT n_name, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS previous FROM nation")
def s_latest_prev(spark, d):
    return catalogue.previous(Tables(spark, d).nation, "n_regionkey", "n_name").select("n_name", "previous")


for _name in ("s_priority_sort", "g_priority_in"):
    query(_name, "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS BIGINT) AS place FROM customer")(lambda spark, d: Tables(spark, d).customer.select("c_custkey", big(G.by_priority(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"])).alias("place")))


_TOTALS = "SELECT 'customer' AS name, count(*) AS total FROM customer UNION ALL SELECT 'orders', count(*) FROM orders"


@query("k_es_meta", _TOTALS)
def k_es_meta(spark, d):
    t = Tables(spark, d)
    return catalogue.totals({"customer": t.customer, "orders": t.orders})


@query("k_meta_get", "SELECT 'stats.customer' AS name, count(*) || '' AS value FROM customer UNION ALL SELECT 'build_version', '20240101'")
def k_meta_get(spark, d):
    meta = catalogue.totals({"stats.customer": Tables(spark, d).customer}).select("name", F.col("total").cast("string").alias("value"))
    return catalogue.public_metadata(meta.unionByName(spark.createDataFrame([("build_version", "20240101"), ("_private", "x")], "name string, value string")))


@query("k_mongo_meta", "SELECT count(*) AS total FROM customer")
def k_mongo_meta(spark, d):
    return collections.count(_customers(spark, d), name="total")


@query("k_sources", "SELECT coalesce(a.k, b.k, c.k) AS source, a.k IS NOT NULL AS customers, b.k IS NOT NULL AS suppliers, c.k IS NOT NULL AS nations FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 5) b ON a.k = b.k FULL JOIN (SELECT n_nationkey AS k FROM nation) c ON coalesce(a.k, b.k) = c.k")
def k_sources(spark, d):
    t = Tables(spark, d)
    named = lambda df, c: df.select(F.col(c).alias("source"))
    return catalogue.source_registry({"customers": named(t.customer.filter("c_nationkey < 15"), "c_nationkey"), "suppliers": named(t.supplier.filter("s_nationkey > 5"), "s_nationkey"), "nations": named(t.nation, "n_nationkey")})


@query("k_meta_fields", "SELECT * FROM (VALUES ('customer.key', 'bigint', false), ('customer.priority.level', 'string', false)) v(path, type, is_list)")
def k_meta_fields(spark, d):
    return shaping.field_metadata(spark, orders_as_documents(spark, d).schema, prefix="customer")


@query("g_fieldnotes", "SELECT * FROM (VALUES ('customer.key', 'bigint', false, 'who ordered'), ('customer.priority.level', 'string', false, NULL)) v(path, type, is_list, note)")
def g_fieldnotes(spark, d):
    return shaping.with_notes(k_meta_fields(spark, d), {"customer.key": "who ordered"})


@query("k_sql_meta", "SELECT column_name AS path, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type, false AS is_list FROM information_schema.columns WHERE table_name = 'customer'")
def k_sql_meta(spark, d):
    return shaping.field_metadata(spark, Tables(spark, d).customer.schema)


@query("g_drop_temp", "SELECT n_name FROM nation WHERE NOT (regexp_matches(n_name, '^NATION_1') AND NOT contains(n_name, '15'))")
def g_drop_temp(spark, d):
    return catalogue.without_temporary(Tables(spark, d).nation, "n_name", "NATION_1", "15").select("n_name")


@query("g_list_sources", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS source FROM part")
def g_list_sources(spark, d):
    return catalogue.exploded_sources(Tables(spark, d).part, F.split("p_name", " ")).select("p_partkey", "source")


@query("g_check_ready", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def g_check_ready(spark, d):
    t = Tables(spark, d)
    return catalogue.not_ready(t.nation, t.supplier.filter("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey")


@query("g_source_info", "SELECT n_nationkey, n_name, max(s_suppkey) AS last_upload FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def g_source_info(spark, d):
    t = Tables(spark, d)
    return catalogue.with_last(t.nation, t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), ["n_nationkey", "n_name"], "s_suppkey", "last_upload")


@query("g_dump_list", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01'")
def g_dump_list(spark, d):
    return catalogue.to_fetch(Tables(spark, d).orders, "o_orderdate", F.lit("1998-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("g_release_versions", "SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS version FROM orders ORDER BY 1")
def g_release_versions(spark, d):
    return catalogue.versions(Tables(spark, d).orders, F.date_format("o_orderdate", "yyyyMM"))


@query("g_remote_better", _VERSIONS + "SELECT c.source, b.version IS NULL OR c.version > b.version AS better FROM c LEFT JOIN b ON b.source = c.source")
def g_remote_better(spark, d):
    n = Tables(spark, d).nation.withColumnRenamed("n_name", "source")
    local = n.filter("n_nationkey < 20").select("source", F.col("n_nationkey").cast("string").alias("version"))
    return catalogue.remote_is_better(n.select("source", F.expr("n_nationkey + n_nationkey % 3").cast("string").alias("version")), local)


@query("g_local_home", "SELECT 'c_mktsegment' AS path, min(c_mktsegment) AS example FROM customer UNION ALL SELECT 'c_name', min(c_name) FROM customer UNION ALL SELECT 'c_nationkey', min(CAST(c_nationkey AS VARCHAR)) FROM customer")
def g_local_home(spark, d):
    docs = Tables(spark, d).customer.select(F.col("c_custkey").alias("_id"), "c_mktsegment", "c_name", "c_nationkey")
    return profile.examples(profile.leaf_rows(docs))


@query("g_store_meta", """SELECT count(*) AS total, '{"properties": {"r_regionkey": {"type": "integer"}, "r_name": {"type": "keyword", "normalizer": "keyword_lowercase_normalizer"}}}' AS mapping FROM region""")
def g_store_meta(spark, d):
    t = Tables(spark, d).region
    return collections.count(t, name="total").withColumn("mapping", F.lit(json.dumps(profile.mapping(t.schema))))


@query("g_autobuild_poll", _VERSIONS + "SELECT count(*) > 0 AS build FROM c LEFT JOIN b ON b.source = c.source WHERE b.version IS DISTINCT FROM c.version")
def g_autobuild_poll(spark, d):
    return j_whatsnew(spark, d).agg((F.count("*") > 0).alias("build"))


@query("g_facade_search", "SELECT c_custkey AS _id, * EXCLUDE (c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5")
def g_facade_search(spark, d):
    from quillon.plans import query_language as Q

    docs = Tables(spark, d).customer.withColumnRenamed("c_custkey", "_id")
    return Q.search(docs, Q.Request(q="c_mktsegment:building", size=5), Q.Fields(docs.schema))
