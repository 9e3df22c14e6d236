"""Scalar, array and document functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import scalars as S
from quillon.functions import values as V
from quillon.registry import Tables, big, query

#: Strings of many kinds, from the customers: numbers, words, padded and signed ones.
RAW = """CASE CAST(c_custkey % 12 AS INT) WHEN 0 THEN CAST(c_custkey AS VARCHAR(20)) WHEN 1 THEN concat(' -', CAST(c_custkey AS VARCHAR(20)), ' ') WHEN 2 THEN concat(CAST(c_custkey AS VARCHAR(20)), '.25') WHEN 3 THEN 'yes' WHEN 4 THEN 'No' WHEN 5 THEN c_mktsegment WHEN 6 THEN 'NO' WHEN 7 THEN '1' WHEN 8 THEN '0' WHEN 9 THEN '1e3' WHEN 10 THEN 't' ELSE 'x1' END"""
_RAW_CTE = f"WITH r AS (SELECT c_custkey, {RAW} AS s FROM customer) "
_IS_INT = r"regexp_full_match(s, '\s*[+-]?\d+\s*')"
_IS_FLOAT = r"regexp_full_match(s, '\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)\s*')"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).customer.select("c_custkey", F.expr(RAW).alias("s"))


@query("x_split_ids", r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(concat(p_name, ',"', p_type, '"|', p_brand), '"[^"]*"|[^\s|,+"]+'), lambda x: trim(replace(x, '"', ''))), ';') AS ids FROM part""")
def x_split_ids(spark, d):
    q = F.concat("p_name", F.lit(',"'), "p_type", F.lit('"|'), "p_brand")
    return Tables(spark, d).part.select("p_partkey", F.array_join(S.split_ids(q), ";").alias("ids"))


@query("x_str_list", r"""SELECT s_suppkey, len(regexp_extract_all(replace(s_name, '#', '+'), '[^\s|,+"]+')) AS n FROM supplier""")
def x_str_list(spark, d):
    return Tables(spark, d).supplier.select("s_suppkey", big(F.size(S.split_ids(F.regexp_replace("s_name", "#", "+")))).alias("n"))


@query("x_substr", """SELECT o_orderkey, regexp_extract(o_orderpriority, '-(.*)$', 1) AS tail, CASE WHEN strpos(o_orderpriority, 'E') > 0 THEN substr(o_orderpriority, 1, strpos(o_orderpriority, 'E') - 1) ELSE '' END AS head,
 CASE WHEN regexp_matches(o_orderpriority, '-[^I]*I') THEN regexp_extract(o_orderpriority, '-[^I]*I') ELSE '' END AS marked FROM orders""")
def x_substr(spark, d):
    c = F.col("o_orderpriority")
    return Tables(spark, d).orders.select("o_orderkey", S.substring_between(c, "-").alias("tail"), S.substring_between(c, "", "E").alias("head"), S.substring_between(c, "-", "I", include=True).alias("marked"))


@query("x_to_int", _RAW_CTE + f"SELECT c_custkey, CASE WHEN {_IS_INT} THEN CAST(trim(s) AS BIGINT) END AS value, CASE WHEN NOT {_IS_INT} THEN s END AS kept FROM r")
def x_to_int(spark, d):
    s = F.col("s")
    return _raw(spark, d).select("c_custkey", S.to_int(s).alias("value"), S.unconverted(s, S.to_int(s)).alias("kept"))


@query("x_to_float", _RAW_CTE + f"SELECT c_custkey, CASE WHEN {_IS_FLOAT} THEN CAST(trim(s) AS DOUBLE) END AS value, CASE WHEN NOT {_IS_FLOAT} THEN s END AS kept FROM r")
def x_to_float(spark, d):
    s = F.col("s")
    return _raw(spark, d).select("c_custkey", S.to_float(s).alias("value"), S.unconverted(s, S.to_float(s)).alias("kept"))


@query("x_to_number", _RAW_CTE + f"SELECT c_custkey, CASE WHEN {_IS_FLOAT} THEN CAST(trim(s) AS DOUBLE) END AS value, {_IS_INT} AS is_int FROM r")
def x_to_number(spark, d):
    s = F.col("s")
    return _raw(spark, d).select("c_custkey", S.to_number(s).alias("value"), S.is_int(s).alias("is_int"))


@query("x_is_int", _RAW_CTE + f"SELECT count(*) FILTER ({_IS_INT}) AS ints, count(*) FILTER (NOT {_IS_INT}) AS others FROM r")
def x_is_int(spark, d):
    s = F.col("s")
    return _raw(spark, d).agg(F.count_if(S.is_int(s)).alias("ints"), F.count_if(~S.is_int(s)).alias("others"))


@query("x_to_boolean", _RAW_CTE + "SELECT c_custkey, CASE WHEN s IN ('true','1','t','y','yes','Y','Yes','YES') THEN true WHEN s IN ('false','0','f','n','N','No','no','NO') THEN false END AS value FROM r")
def x_to_boolean(spark, d):
    return _raw(spark, d).select("c_custkey", S.to_boolean(F.col("s")).alias("value"))


@query("x_str_bool", _RAW_CTE + f"SELECT c_custkey, CASE WHEN {_IS_FLOAT} THEN CAST(trim(s) AS DOUBLE) > 0 ELSE lower(s) IN ('1','true','yes','y','t') END AS value FROM r")
def x_str_bool(spark, d):
    return _raw(spark, d).select("c_custkey", S.option_to_bool(F.col("s")).alias("value"))


@query("x_str_int", _RAW_CTE + f"SELECT c_custkey, CASE WHEN {_IS_INT} THEN CAST(trim(s) AS BIGINT) END AS strict_value, CASE WHEN {_IS_FLOAT} THEN CAST(trunc(CAST(trim(s) AS DOUBLE)) AS BIGINT) END AS lax_value FROM r")
def x_str_int(spark, d):
    s = F.col("s")
    return _raw(spark, d).select("c_custkey", S.option_to_int(s, True).alias("strict_value"), S.option_to_int(s).alias("lax_value"))


@query("x_id_strip", "SELECT n_nationkey, array_to_string(list_transform(string_split(concat(' ', n_name, ' | ', CAST(n_regionkey AS VARCHAR), '|x '), '|'), lambda x: trim(x)), ';') AS ids FROM nation")
def x_id_strip(spark, d):
    s = F.concat(F.lit(" "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit("|x "))
    return Tables(spark, d).nation.select("n_nationkey", F.array_join(S.id_strip(s), ";").alias("ids"))


@query("x_list_split", "SELECT p_partkey, array_to_string(string_split(rtrim(p_type), ' '), ';') AS parts, CAST(len(string_split(rtrim(p_type), ' ')) AS BIGINT) AS n FROM part")
def x_list_split(spark, d):
    xs = S.list_split(F.col("p_type"), " ")
    return Tables(spark, d).part.select("p_partkey", F.array_join(xs, ";").alias("parts"), big(F.size(xs)).alias("n"))


@query("x_normalized", """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS flags, CAST(len(list_distinct(list(l_returnflag || l_linestatus))) = 1 AS BOOLEAN) AS single FROM lineitem GROUP BY l_orderkey""")
def x_normalized(spark, d):
    xs = A.normalised(F.collect_list(F.concat("l_returnflag", "l_linestatus")))
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(xs.alias("xs")).select("l_orderkey", F.array_join("xs", ",").alias("flags"), (F.size("xs") == 1).alias("single"))


@query("x_nodup", """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, coalesce(array_to_string(list_sort(list_distinct(list(l_suppkey) FILTER (l_suppkey <> 0))), ','), '') AS suppliers FROM lineitem GROUP BY l_orderkey""")
def x_nodup(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.array_join(A.normalised(F.collect_list("l_returnflag")), ",").alias("flags"), F.array_join(A.normalised(F.collect_list("l_suppkey")).cast("array<string>"), ",").alias("suppliers"))


@query("x_alwayslist", _RAW_CTE + "SELECT c_custkey, CAST(CASE WHEN nullif(s, '0') IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n, coalesce(nullif(s, '0'), '') AS joined FROM r")
def x_alwayslist(spark, d):
    xs = A.as_list(F.when(F.col("s") != "0", F.col("s")))
    return _raw(spark, d).select("c_custkey", big(F.size(xs)).alias("n"), F.array_join(xs, ",").alias("joined"))


@query("x_value_convert", "SELECT l_orderkey, array_to_string(list_sort(list(l_partkey * 2 + 1)), ',') AS doubled FROM lineitem GROUP BY l_orderkey")
def x_value_convert(spark, d):
    xs = V.mapped(F.collect_list("l_partkey"), lambda x: x * 2 + 1)
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(xs), ",").alias("doubled"))


@query("x_dict_convert", "SELECT n_regionkey, array_to_string(list_sort(list(lower(n_name) || '=' || CAST(n_nationkey * 10 AS VARCHAR))), ',') AS pairs FROM nation GROUP BY n_regionkey")
def x_dict_convert(spark, d):
    m = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    m = V.mapped_entries(m, F.lower, lambda v: v * 10)
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return Tables(spark, d).nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(pairs), ",").alias("pairs"))


@query("x_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def x_md5(spark, d):
    return Tables(spark, d).documents.select("doc_id", S.digest(F.col("text")).alias("md5"))


@query("x_newer", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') < strptime('19950101', '%Y%m%d') AS older FROM orders")
def x_newer(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", S.newer(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("19950101")).alias("older"))


@query("x_sizeof_fmt", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1fB', CAST(n_chars AS DOUBLE)) ELSE printf('%.1fKiB', round(CAST(n_chars / 1024.0 AS DECIMAL(18, 10)), 1)) END AS size FROM documents")
def x_sizeof_fmt(spark, d):
    return Tables(spark, d).documents.select("doc_id", S.size_text(F.col("n_chars")).alias("size"))


@query("x_json_serial", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def x_json_serial(spark, d):
    return Tables(spark, d).events.select("event_id", S.iso_utc(F.col("ts")).alias("iso"))


@query("x_translate", "SELECT c_custkey, regexp_replace(regexp_replace(c_name, '^Customer', 'cust'), '#0*', ':') AS translated FROM customer")
def x_translate(spark, d):
    return Tables(spark, d).customer.select("c_custkey", V.translated(F.col("c_name"), [("^Customer", "cust"), ("#0*", ":")]).alias("translated"))


@query("x_jmes_unique", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM lineitem GROUP BY l_orderkey")
def x_jmes_unique(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.array_join(V.distinct(F.collect_list("l_suppkey")), ",").alias("suppliers"))


@query("x_jmes_unique_count", "SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_orderkey")
def x_jmes_unique_count(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(V.distinct_count(F.collect_list("l_suppkey")).alias("suppliers"))


@query("x_timestamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders")
def x_timestamp(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", V.day_stamp(F.col("o_orderdate")).alias("stamp"))


@query("x_timesofar", "WITH s AS (SELECT event_id, CAST(trunc(value * 100) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh:%dm:%ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm:%ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM s")
def x_timesofar(spark, d):
    return Tables(spark, d).events.select("event_id", S.duration_text(F.col("value") * 100).alias("duration"))


@query("x_safe_unicode", "SELECT doc_id, sha256(replace(text, chr(65533), '#')) AS hash FROM documents")
def x_safe_unicode(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.sha2(V.masked(F.col("text")), 256).alias("hash"))


@query("x_file_newer", "SELECT 'region.parquet' AS file, true AS older FROM region LIMIT 1")
def x_file_newer(spark, d):
    from quillon.sources import files

    return files.older_than(Tables(spark, d).region, F.current_timestamp())


@query("x_uid", "WITH h AS (SELECT event_id, sha256(user_id || '|' || event_type) AS h FROM events) SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uid FROM h")
def x_uid(spark, d):
    return Tables(spark, d).events.select("event_id", V.pseudonym(F.col("user_id"), F.col("event_type")).alias("uid"))


# JSON values of all kinds, by part
_JSON = "CASE p_partkey % 7 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN '\"text\"' WHEN 3 THEN '[1, 2]' WHEN 4 THEN 'true' WHEN 5 THEN '{\"a\": 1}' ELSE 'null' END"
for _name, _test, _true in (("x_is_str", V.is_text, "2"), ("x_is_float", V.is_float, "1"), ("x_is_seq", V.is_sequence, "3"), ("x_is_scalar", V.is_scalar, "0, 1, 2, 4, 6")):
    query(_name, f"SELECT p_partkey, p_partkey % 7 IN ({_true}) AS value FROM part")((lambda test: lambda spark, d: Tables(spark, d).part.select("p_partkey", test(F.expr(_JSON)).alias("value")))(_test))


@query("x_safe_type", _RAW_CTE + f"SELECT c_custkey, CASE WHEN {_IS_FLOAT} THEN CAST(trim(s) AS DOUBLE) END AS value, CASE WHEN NOT {_IS_FLOAT} THEN s END AS kept FROM r")
def x_safe_type(spark, d):
    value, kept = V.converted(F.col("s"), "double")
    return _raw(spark, d).select("c_custkey", value.alias("value"), kept.alias("kept"))


# documents and arrays


def orders_as_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents: an order with its customer and the list of its items."""
    t = Tables(spark, d)
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("items"))
    head = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return head.select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderpriority").alias("level")).alias("priority")).alias("customer"), "items")


_ITEMS = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query("c_sweep", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brands FROM part")
def c_sweep(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, F.lit("NA")).otherwise(F.col("p_name"))
    brands = F.array(F.lit("-"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("none")), F.lit(""))
    return Tables(spark, d).part.select("p_partkey", A.swept(name).alias("name"), F.array_join(A.swept_list(brands), ",").alias("brands"))


@query("c_boolean_convert", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus = 'F' AS status, array_to_string(list(CAST(l_returnflag = 'N' AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS flags {_ITEMS} GROUP BY o_orderkey, o_orderstatus")
def c_boolean_convert(spark, d):
    docs = orders_as_documents(spark, d)
    f = lambda x: S.to_boolean(x, ("F", "N"), ("O", "P", "R", "A"))
    docs = docs.select(*A.on_document(docs.schema, "status", f))
    docs = docs.select(*A.on_document(docs.schema, "items.flag", f))
    return docs.select("_id", "status", F.array_join(F.transform("items", lambda x: x.flag.cast("string")), ",").alias("flags"))


@query("c_float_convert", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, CAST(o_custkey AS DOUBLE) AS key, sum(CAST(l_partkey AS DOUBLE)) AS parts {_ITEMS} GROUP BY o_orderkey, o_custkey")
def c_float_convert(spark, d):
    docs = orders_as_documents(spark, d)
    for path in ("customer.key", "items.part"):
        docs = docs.select(*A.on_document(docs.schema, path, lambda x: x.cast("double")))
    return docs.select("_id", "customer.key", F.aggregate("items", F.lit(0.0), lambda a, x: a + x.part).alias("parts"))


@query("c_int_convert", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty {_ITEMS} GROUP BY o_orderkey")
def c_int_convert(spark, d):
    docs = orders_as_documents(spark, d)
    docs = docs.select(*A.on_document(docs.schema, "items.qty", lambda x: x.cast("bigint")))
    return docs.select("_id", F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x.qty).alias("qty"))


@query("c_value_convert_num", "SELECT c_custkey, CAST(regexp_replace(c_name, '^Customer#', '') AS DOUBLE) AS number, c_mktsegment AS segment FROM customer")
def c_value_convert_num(spark, d):
    own = Tables(spark, d).customer.select("c_custkey", F.regexp_replace("c_name", "^Customer#", "").alias("number"), F.col("c_mktsegment").alias("segment"))
    return own.select("c_custkey", S.to_number(F.col("number")).alias("number"), S.unconverted(F.col("segment"), S.to_number(F.col("segment"))).alias("segment"))


@query("c_unlist", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN count(*) = 1 THEN min(CAST(l_partkey AS VARCHAR)) ELSE '[' || array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), '|') || ']' END AS part {_ITEMS} GROUP BY o_orderkey")
def c_unlist(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", A.scalar_or_list(F.transform("items", lambda x: x.part.cast("string"))).alias("part"))


@query("c_unlist_ie", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN count(*) = 1 THEN min(l_returnflag) ELSE '[' || array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), '|') || ']' END AS flag, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), '|') AS part {_ITEMS} GROUP BY o_orderkey")
def c_unlist_ie(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", A.scalar_or_list(F.transform("items", lambda x: x.flag)).alias("flag"), F.array_join(F.transform("items", lambda x: x.part), "|").alias("part"))


@query("c_key_value", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS parts, o_orderpriority AS level {_ITEMS} GROUP BY o_orderkey, o_orderpriority")
def c_key_value(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", F.array_join(A.values_at(docs.schema, "items.part"), ",").alias("parts"), F.array_join(A.values_at(docs.schema, "customer.priority.level"), ",").alias("level"))


@query("c_set_key", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, array_to_string(list('seen' ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS flags {_ITEMS} GROUP BY o_orderkey")
def c_set_key(spark, d):
    docs = orders_as_documents(spark, d)
    docs = docs.select(*A.on_document(docs.schema, "items.flag", lambda x: F.lit("seen")))
    return docs.select("_id", F.array_join(F.transform("items", lambda x: x.flag), ",").alias("flags"))


@query("c_list_length", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def c_list_length(spark, d):
    t = Tables(spark, d)
    docs = t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return docs.select("o_orderkey", A.list_length(F.col("parts")).alias("n"))


@query("c_get_dotfield", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderpriority AS level FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def c_get_dotfield(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", A.get(docs.schema, "customer.priority.level").alias("level"))


@query("c_nested_lookup", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS flags, CAST(NULL AS VARCHAR) AS none {_ITEMS} GROUP BY o_orderkey")
def c_nested_lookup(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", F.array_join(A.lookup(docs.schema, "items.flag.deeper"), ",").alias("flags"), A.lookup(docs.schema, "customer.absent").cast("string").alias("none"))


@query("c_last_element", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, count(*) AS n, array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS flags {_ITEMS} GROUP BY o_orderkey")
def c_last_element(spark, d):
    docs = orders_as_documents(spark, d)
    found = A.last_element(docs.schema, "items.flag")
    return docs.select("_id", big(F.size(found)).alias("n"), F.array_join(F.transform(found, lambda x: x.flag), ",").alias("flags"))


@query("c_list_trim", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, coalesce(array_to_string(list(l_partkey ORDER BY rn) FILTER (rn NOT IN (1, 3)), ','), '') AS parts FROM (SELECT o_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS rn {_ITEMS}) GROUP BY o_orderkey")
def c_list_trim(spark, d):
    docs = orders_as_documents(spark, d)
    return docs.select("_id", F.array_join(A.without_positions(F.transform("items", lambda x: x.part), [0, 2]), ",").alias("parts"))


_KEYS = " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, '{p}' AS path, CAST({x} AS VARCHAR) AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)" for p, x in (("status", "o_orderstatus"), ("price", "o_totalprice"), ("customer.key", "o_custkey"), ("customer.priority.level", "o_orderpriority"))) + "".join(f" UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'items.{p}', CAST({x} AS VARCHAR) {_ITEMS}" for p, x in (("line", "l_linenumber"), ("part", "l_partkey"), ("flag", "l_returnflag")))


@query("c_traverse_keys", _KEYS)
def c_traverse_keys(spark, d):
    docs = orders_as_documents(spark, d)
    pairs = A.key_values(docs.schema, exclude=("_id", "items.qty"))
    return docs.select("_id", F.explode(pairs).alias("x")).select("_id", "x.path", "x.value")


@query("c_value_convert_ie", f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, array_to_string(list(l_quantity * 2 ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag), ',') AS qty {_ITEMS} GROUP BY o_orderkey")
def c_value_convert_ie(spark, d):
    docs = orders_as_documents(spark, d)
    docs = docs.select(*A.on_document(docs.schema, "items.qty", lambda x: x * 2))
    return docs.select("_id", F.array_join(F.transform("items", lambda x: x.qty), ",").alias("qty"))


@query("c_dict_walk", f'SELECT CAST(o_orderkey AS VARCHAR) AS "_ID", o_custkey AS "KEY", o_orderpriority AS "LEVEL", CAST(sum(l_partkey) AS BIGINT) AS "PARTS" {_ITEMS} GROUP BY o_orderkey, o_custkey, o_orderpriority')
def c_dict_walk(spark, d):
    docs = orders_as_documents(spark, d)
    walked = docs.select(*A.renamed_document(docs.schema, str.upper))
    return walked.select("_ID", "CUSTOMER.KEY", "CUSTOMER.PRIORITY.LEVEL", F.aggregate("ITEMS", F.lit(0).cast("bigint"), lambda a, x: a + x.PART).alias("PARTS"))


@query("c_dict_traverse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k FROM events")
def c_dict_traverse(spark, d):
    return Tables(spark, d).events.select("event_id", V.mapped_entries(F.from_json("props", "map<string,bigint>"), value=lambda v: v + 1)["k"].alias("k"))
