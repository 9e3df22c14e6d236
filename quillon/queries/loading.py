"""Reading, storing and updating collections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.cluster import shared_folder
from quillon.operators import catalogue, collections, facets, load, tables
from quillon.plans import shaping
from quillon.registry import Tables, big, query
from quillon.sources import files, stores
from quillon.sources.catalog import Collection, full_names

_CUST = "SELECT c_custkey AS _id, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer"


def _customers(spark, d):
    return Tables(spark, d).customer.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))


def _newer(spark, d):
    """A second version: some customers change, some are new."""
    c = _customers(spark, d).filter("_id % 3 = 0")
    return c.select((F.col("_id") + F.when(F.col("_id") % 2 == 0, 0).otherwise(1_000_000)).alias("_id"), F.upper("name").alias("name"), (F.col("bal") * 2).alias("bal"), F.when(F.col("_id") % 4 != 0, F.col("seg")).alias("seg"))


_NEWER = "SELECT _id + CASE WHEN _id % 2 = 0 THEN 0 ELSE 1000000 END AS _id, upper(name) AS name, bal * 2 AS bal, CASE WHEN _id % 4 <> 0 THEN seg END AS seg FROM o WHERE _id % 3 = 0"
_BOTH = f"WITH o AS ({_CUST}), n AS ({_NEWER}) "


def _folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:8]}"


# readers


@query("scan_delimited", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def scan_delimited(spark, d):
    path = _folder(spark)
    Tables(spark, d).nation.write.option("sep", "\t").option("header", True).csv(path)
    return files.scan_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int", keep=F.col("n_regionkey") != 2)


@query("scan_delimited_check", "SELECT n_name || ',x,y,z' AS _bad FROM nation WHERE n_nationkey % 5 = 0")
def scan_delimited_check(spark, d):
    path = _folder(spark)
    t = Tables(spark, d).nation
    t.select(F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit(",x,y,z"))).otherwise(F.concat_ws(",", "n_name", "n_nationkey")).alias("value")).write.text(path)
    return files.bad_lines(spark, path, "name string, n int", sep=",", header=False)


@query("tab_project_list", "SELECT s_name, s_nationkey FROM supplier")
def tab_project_list(spark, d):
    return tables.project(Tables(spark, d).supplier, "s_name", "s_nationkey")


@query("tab_to_dict", "SELECT n_regionkey AS key, array_to_string(list(n_name ORDER BY n_nationkey), '|') AS value, count(*) > 1 AS many FROM nation GROUP BY n_regionkey")
def tab_to_dict(spark, d):
    out = tables.group_values(Tables(spark, d).nation, ["n_regionkey"], F.col("n_name"), F.col("n_nationkey"))
    return out.select(F.col("n_regionkey").alias("key"), F.array_join("values", "|").alias("value"), (F.size("values") > 1).alias("many"))


@query("tab_to_dict_adjacent", """WITH c AS (SELECT *, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM c)
SELECT o_custkey, o_orderstatus, CAST(island AS BIGINT) AS island, count(*) AS n, min(o_orderkey) AS first_order FROM i GROUP BY o_custkey, o_orderstatus, island""")
def tab_to_dict_adjacent(spark, d):
    out = tables.group_adjacent(Tables(spark, d).orders, "o_orderstatus", "o_orderkey", ["o_custkey"])
    return out.groupBy("o_custkey", "o_orderstatus", "island").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("file_merge", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def file_merge(spark, d):
    t = Tables(spark, d)
    return tables.concatenated([t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")), t.supplier.select(F.col("s_name").alias("name"))])


@query("rec_blocks", "SELECT 'id ' || n_nationkey || chr(10) || 'name ' || n_name AS block FROM nation")
def rec_blocks(spark, d):
    path = _folder(spark)
    Tables(spark, d).nation.select(F.concat(F.lit("id "), "n_nationkey", F.lit("\nname "), "n_name", F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    return files.scan_blocks(spark, path)


@query("dup_line_expand", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_brand FROM part")
def dup_line_expand(spark, d):
    return tables.expand_lines(Tables(spark, d).part.select("p_partkey", F.col("p_name").alias("word"), "p_brand"), ["word"], " ", strip=True)


@query("scan_ndjson", "SELECT n_name, n_nationkey FROM nation")
def scan_ndjson(spark, d):
    path = _folder(spark)
    Tables(spark, d).nation.write.json(path)
    return files.scan_ndjson(spark, path, "n_name string, n_nationkey int")


@query("scan_json_array", "SELECT r_regionkey, r_name FROM region")
def scan_json_array(spark, d):
    path = _folder(spark)
    Tables(spark, d).region.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    return files.scan_json_array(spark, path, "r_regionkey int, r_name string")


@query("open_any", "SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region")
def open_any(spark, d):
    path = _folder(spark)
    Tables(spark, d).region.orderBy("r_regionkey").coalesce(1).select("r_name").write.option("compression", "gzip").text(path)
    return files.open_files(spark, path + "/*.gz").select(F.decode("content", "utf-8").alias("text"))


@query("open_by_magic", "SELECT CAST(sum(strlen(n_name) + 1) AS INTEGER) AS bytes FROM nation")
def open_by_magic(spark, d):
    path = _folder(spark)
    Tables(spark, d).nation.select("n_name").coalesce(1).write.option("compression", "bzip2").text(path)
    return files.open_files(spark, path + "/*.bz2").select(F.length("content").alias("bytes"))


@query("load_obj", "SELECT n_nationkey, n_name FROM nation")
def load_obj(spark, d):
    path = _folder(spark)
    Tables(spark, d).nation.select("n_nationkey", "n_name").write.option("compression", "gzip").json(path)
    return files.load_objects(spark, path + "/*.gz", "n_nationkey int, n_name string")


@query("uncompress_all", "SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(s_name) + 1) AS BIGINT) AS bytes FROM supplier")
def uncompress_all(spark, d):
    path = _folder(spark)
    Tables(spark, d).supplier.select("s_name").repartition(3).write.option("compression", "gzip").text(path)
    plain = files.open_files(spark, path + "/*.gz").select(F.decode("content", "utf-8").alias("text"))
    return plain.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))


def _database(spark, kind="sqlite"):
    """The path of a new SQLite file or Derby database in the shared folder."""
    folder = shared_folder(spark)
    if not folder.startswith(("file:", "/")):
        raise ValueError("SQLite files and Derby databases need a shared folder that is mounted")
    return f"{folder.removeprefix('file:').replace('///', '/').replace('//', '/')}/{uuid.uuid4().hex[:8]}.{kind}"


def _in_sqlite(spark, df, key="_id"):
    """The path of an SQLite file whose table ``docs`` has the rows."""
    path = _database(spark)
    stores.write_sqlite(df, path, "docs", key=key)
    return path


_DERBY = {"driver": stores.DERBY}


def _in_derby(spark, df, *changes):
    """The URL of a Derby database whose table ``docs`` had the rows before the statements."""
    url = stores.create_derby(df, _database(spark, "derby"), "docs")
    for sql in changes:
        stores.run_jdbc(spark, url, sql)
    return stores.publish_derby(spark, url)


def _from_jdbc(spark, url, wanted=None, table="docs"):
    return stores.scan_jdbc(spark, url, table, wanted, **_DERBY)


@query("scan_sqlite", "SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE '%7' AND s_nationkey > 3 ORDER BY s_suppkey LIMIT 20 OFFSET 1")
def scan_sqlite(spark, d):
    from quillon.functions.scalars import matches_glob

    path = _database(spark)
    stores.write_sqlite(Tables(spark, d).supplier, path, "supplier", key="s_suppkey")
    docs = stores.scan_sqlite(spark, path, "supplier").filter(matches_glob(F.col("s_name"), "*7") & (F.col("s_nationkey") > 3))
    return collections.find(docs, sort=["s_suppkey"], start=1, limit=20, fields=["s_suppkey", "s_name"])


@query("scan_sqlite_v2", "SELECT n_name, total FROM (SELECT n_name, count(*) OVER () AS total FROM nation WHERE n_regionkey = 3 AND n_nationkey > 2) ORDER BY n_name LIMIT 3")
def scan_sqlite_v2(spark, d):
    path = _database(spark)
    documents = Tables(spark, d).nation.select(F.col("n_nationkey").cast("string").alias("_id"), F.to_json(F.struct("*")).alias("document"))
    stores.write_sqlite(documents, path, "nation", key="_id")
    kind = "struct<n_nationkey:bigint,n_name:string,n_regionkey:bigint>"
    docs = stores.scan_sqlite(spark, path, "nation").select(F.from_json("document", kind).alias("d")).select("d.*")
    return collections.find_with_total(docs, {"n_regionkey": 3, "n_nationkey": {"$gt": 2}}, ["n_name"], 3).select("n_name", "total")


@query("scan_pg", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def scan_pg(spark, d):
    url = _in_derby(spark, Tables(spark, d).supplier.select("s_suppkey", "s_name", F.to_json(F.struct("s_nationkey")).alias("document")))
    return collections.find_in_json(_from_jdbc(spark, url), "document", {"s_nationkey": 3}).select("s_suppkey", "s_name")


@query("scan_mongo", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500 OFFSET 100")
def scan_mongo(spark, d):
    return collections.find(Tables(spark, d).orders, {"o_orderstatus": "O"}, ["o_orderkey", "o_totalprice"], ["o_orderkey"], 100, 500)


@query("scan_ids", "SELECT o_orderkey AS _id FROM orders")
def scan_ids(spark, d):
    return collections.ids(Tables(spark, d).orders, "o_orderkey")


@query("scan_es", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def scan_es(spark, d):
    path = _folder(spark)
    collections.checked_scroll(Tables(spark, d).customer, {"c_mktsegment": "MACHINERY"}, lambda hits: hits.write.parquet(path))
    return spark.read.parquet(path).select("c_custkey", "c_name")


@query("g_es_helper_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000")
def g_es_helper_scan(spark, d):
    return collections.scroll(Tables(spark, d).customer, {"c_acctbal": {"$gte": 5000}}).select("c_custkey", "c_name")


_LISTED = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000"


def _listed(spark, d):
    return Tables(spark, d).orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("_id"))


for _name in ("mget_ids", "verify_overlap", "mget_mongo", "g_es_backend_mget", "g_idx_mget"):
    query(_name, f"SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_custkey IN ({_LISTED})")(lambda spark, d: load.only_ids(_customers(spark, d), _listed(spark, d)).select("_id", "name"))

@query("g_sqlite_idsearch", f"SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_custkey IN ({_LISTED})")
def g_sqlite_idsearch(spark, d):
    path = _in_sqlite(spark, _customers(spark, d).select("_id", "name"))
    return load.only_ids(stores.scan_sqlite(spark, path, "docs"), _listed(spark, d))


for _name in ("mexists_ids", "g_idx_mexists"):
    query(_name, f'SELECT k AS _id, EXISTS (SELECT 1 FROM customer WHERE c_custkey = k AND c_custkey % 2 = 0) AS "exists" FROM ({_LISTED})')(lambda spark, d: load.exists_flags(_listed(spark, d).distinct(), _customers(spark, d).filter("_id % 2 = 0")))


@query("count_from_ids", f"SELECT count(*) AS n FROM customer WHERE c_custkey IN ({_LISTED})")
def count_from_ids(spark, d):
    return load.only_ids(_customers(spark, d), _listed(spark, d)).agg(F.count("*").alias("n"))


@query("backend_resolve", "SELECT * FROM nation")
def backend_resolve(spark, d):
    c = Collection(spark, "resolved_nations")
    c.write(Tables(spark, d).nation)
    return spark.table("resolved_nations")


# stores


@query("store_basic", "SELECT c_custkey AS _id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 1000")
def store_basic(spark, d):
    return load.store_basic(_customers(spark, d).select("_id", "name"), batch_size=500, max_batches=2)


@query("store_check_size", "SELECT doc_id FROM documents WHERE strlen(CAST(to_json({'doc_id': doc_id, 'text': text}) AS VARCHAR)) < 16777216")
def store_check_size(spark, d):
    return load.small_enough(Tables(spark, d).documents.select("doc_id", "text")).select("doc_id")


@query("store_none", "SELECT count(*) - count(*) AS stored FROM customer")
def store_none(spark, d):
    return spark.range(1).select(F.lit(load.store_none(_customers(spark, d))).cast("bigint").alias("stored"))


@query("store_dispatch", "SELECT 'error' AS strategy, count(*) AS n FROM customer UNION ALL SELECT 'ignore', count(DISTINCT user_id) FROM events UNION ALL SELECT 'merge', count(DISTINCT user_id) FROM events")
def store_dispatch(spark, d):
    parts = [("error", load.store(_customers(spark, d), "error")), ("ignore", load.store(_events(spark, d), "ignore", position="pos")), ("merge", load.store(_events(spark, d), "merge", position="pos"))]
    return tables.concatenated([df.agg(F.count("*").alias("n")).select(F.lit(n).alias("strategy"), "n") for n, df in parts])


_EV = "SELECT user_id AS _id, event_id AS pos, event_type AS kind, value FROM events"


def _events(spark, d):
    return Tables(spark, d).events.select(F.col("user_id").alias("_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), "value")


@query("store_merge_root", f"SELECT _id, array_to_string(list(kind ORDER BY pos), ',') AS kinds, count(*) AS n FROM ({_EV}) GROUP BY _id")
def store_merge_root(spark, d):
    out = load.merge_root_lists(_events(spark, d), "_id", "pos", ["kind", "value"])
    return out.select("_id", F.array_join("kind", ",").alias("kinds"), big(F.size("value")).alias("n"))


@query("store_ignore_dups", f"SELECT _id, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY pos // 100, pos DESC) AS rn FROM ({_EV})) WHERE rn = 1")
def store_ignore_dups(spark, d):
    return load.keep_last_of_first_batch(_events(spark, d), "_id", "pos", 100).select("_id", "kind", "pos")


for _name, _dir in (("store_ignore_nobatch", "first"), ("g_unique_docs", "last")):
    query(_name, f"SELECT _id, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY pos {'DESC' if _dir == 'last' else 'ASC'}) AS rn FROM ({_EV})) WHERE rn = 1")((lambda keep: lambda spark, d: keep(_events(spark, d), "_id", "pos").select("_id", "kind", "pos"))(load.keep_last if _dir == "last" else load.keep_first))

_REPLACED = _BOTH + "SELECT coalesce(n._id, o._id) AS _id, CASE WHEN n._id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n._id IS NOT NULL THEN n.bal ELSE o.bal END AS bal, CASE WHEN n._id IS NOT NULL THEN n.seg ELSE o.seg END AS seg FROM o FULL JOIN n ON o._id = n._id"
def _replaced_in_sqlite(spark, d):
    path = _in_sqlite(spark, _customers(spark, d))
    stores.write_sqlite(_newer(spark, d), path, "docs", key="_id", replace=True)
    return stores.scan_sqlite(spark, path, "docs")


def _replaced_in_jdbc(spark, d):
    old = _from_jdbc(spark, _in_derby(spark, _customers(spark, d).drop("seg")))
    return _from_jdbc(spark, _in_derby(spark, load.upsert(old, _newer(spark, d).drop("seg"))))


for _name in ("g_sqlite_save", "g_sqlite_replace"):
    query(_name, _REPLACED)(_replaced_in_sqlite)
query("sink_pg_replace", f"SELECT _id, name, bal FROM ({_REPLACED})")(_replaced_in_jdbc)
for _name in ("store_upsert", "sink_index_bulk", "g_es_hub_replace"):
    query(_name, _REPLACED)(lambda spark, d: load.upsert(_customers(spark, d), _newer(spark, d)))

_SET = _BOTH + "SELECT coalesce(o._id, n._id) AS _id, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal, coalesce(n.seg, o.seg) AS seg FROM o {} JOIN n ON o._id = n._id"
for _name, _how in (("sink_update", "LEFT"), ("sink_update_docs", "FULL"), ("sink_merge_task", "FULL"), ("g_mem_update", "LEFT"), ("g_es_update", "FULL")):
    query(_name, _SET.format(_how))((lambda insert: lambda spark, d: load.update_roots(_customers(spark, d), _newer(spark, d), insert=insert))(_how == "FULL"))


@query("sink_sqlite_update", _SET.format("FULL"))
def sink_sqlite_update(spark, d):
    path = _in_sqlite(spark, _customers(spark, d))
    stores.write_sqlite(load.update_roots(stores.scan_sqlite(spark, path, "docs"), _newer(spark, d)), path, "updated", key="_id")
    return stores.scan_sqlite(spark, path, "updated")


@query("sink_pg_update", _SET.format("LEFT"))
def sink_pg_update(spark, d):
    old = _from_jdbc(spark, _in_derby(spark, _customers(spark, d)))
    return _from_jdbc(spark, _in_derby(spark, load.update_roots(old, _newer(spark, d), insert=False)))


@query("sink_update_diff", _BOTH + "SELECT o._id, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal, coalesce(n.seg, o.seg) AS seg FROM o LEFT JOIN n ON o._id = n._id WHERE o._id % 5 <> 0 UNION ALL SELECT * FROM n WHERE _id NOT IN (SELECT _id FROM o)")
def sink_update_diff(spark, d):
    old, new = _customers(spark, d), _newer(spark, d)
    return load.apply_diff(old, new, new, old.filter("_id % 5 = 0"))


@query("g_sqlite_remove", f"SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_custkey NOT IN ({_LISTED})")
def g_sqlite_remove(spark, d):
    path = _in_sqlite(spark, _customers(spark, d).select("_id", "name"))
    stores.delete_rows(path, "docs", "_id", _listed(spark, d).distinct())
    return stores.scan_sqlite(spark, path, "docs")


@query("g_pg_remove", "SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def g_pg_remove(spark, d):
    url = _in_derby(spark, _customers(spark, d), """DELETE FROM docs WHERE "seg" IS NULL OR "seg" = 'BUILDING' AND LENGTH("seg") = 8""")  # Derby's = ignores blanks at the end
    return _from_jdbc(spark, url).select("_id", "name")


for _name in ("sink_remove_ids", "g_es_hub_remove", "g_id_cache"):
    query(_name, f"SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_custkey NOT IN ({_LISTED})")(lambda spark, d: load.remove_ids(_customers(spark, d), _listed(spark, d)).select("_id", "name"))


@query("sink_delete_docs", f"SELECT count(*) FILTER (c_custkey IS NOT NULL AND c_custkey % 2 = 0) AS deleted, count(*) FILTER (NOT coalesce(c_custkey % 2 = 0, false)) AS failed FROM ({_LISTED}) LEFT JOIN customer ON k = c_custkey")
def sink_delete_docs(spark, d):
    asked = load.exists_flags(_listed(spark, d).distinct(), _customers(spark, d).filter("_id % 2 = 0"))
    return asked.agg(F.count_if(F.col("exists")).alias("deleted"), F.count_if(~F.col("exists")).alias("failed"))


@query("sink_resume_task", _BOTH + "SELECT _id, name FROM o UNION ALL SELECT _id, name FROM n WHERE _id NOT IN (SELECT _id FROM o)")
def sink_resume_task(spark, d):
    return collections.resumed(_customers(spark, d), _newer(spark, d)).select("_id", "name")


@query("g_es_delete", "SELECT c_custkey AS _id FROM customer WHERE c_custkey <> 7")
def g_es_delete(spark, d):
    return collections.delete_one(_customers(spark, d), 7).select("_id")


@query("sink_build_index", _CUST)
def sink_build_index(spark, d):
    source, target = Collection(spark, "source_customers"), Collection(spark, "index_customers")
    source.write(_customers(spark, d))
    return target.checked_copy(source)


@query("sink_clean_field", "SELECT c_custkey AS _id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS bal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def sink_clean_field(spark, d):
    docs = _customers(spark, d).withColumns({"name": F.when(F.col("_id") % 2 == 0, F.col("name")), "bal": F.when(F.col("_id") % 3 == 0, F.col("bal"))})
    return load.clean_field(docs, "seg")


@query("sink_index_task", "SELECT text AS _id, counted FROM (SELECT text, count(*) OVER () AS counted FROM documents) WHERE length(text) <= 512")
def sink_index_task(spark, d):
    return collections.index_batch(Tables(spark, d).documents.select(F.col("text").alias("_id")))


@query("sink_switch", "SELECT * FROM nation")
def sink_switch(spark, d):
    c = Collection(spark, "switched_nations")
    c.write(Tables(spark, d).nation.limit(0))
    c.write(Tables(spark, d).nation)
    return spark.table("switched_nations")


@query("sink_hub_update_ops", "SELECT user_id AS _id, 'seen' AS state, array_to_string(list_sort(list_distinct(list(event_type) || ['added'])), ',') AS added, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: x <> 'view')), ',') AS pulled FROM events GROUP BY user_id")
def sink_hub_update_ops(spark, d):
    kinds = F.array_sort(F.collect_set("event_type"))
    docs = Tables(spark, d).events.groupBy(F.col("user_id").alias("_id")).agg(kinds.alias("added"), kinds.alias("pulled"), F.max("value").alias("value"))
    docs = collections.apply_operators(docs, {"$set": {"state": "seen"}, "$unset": {"value": 1}, "$addToSet": {"added": "added"}, "$pull": {"pulled": "view"}})
    return docs.select("_id", "state", F.array_join(F.array_sort("added"), ",").alias("added"), F.array_join("pulled", ",").alias("pulled"))


@query("export_ids", "SELECT DISTINCT CAST(k AS VARCHAR) AS _id FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def export_ids(spark, d):
    t = Tables(spark, d)
    return collections.united_ids(t.orders.select(F.col("o_custkey").alias("_id")), t.customer.select(F.col("c_custkey").alias("_id")))


@query("serialize_json", """SELECT concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","none":null}') AS json FROM nation""")
def serialize_json(spark, d):
    return files.to_json_lines(Tables(spark, d).nation.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@query("serialize_yaml", "SELECT string_agg('- r_regionkey: ' || r_regionkey || chr(10) || '  r_name: ' || r_name || chr(10), '' ORDER BY r_regionkey) AS yaml FROM region")
def serialize_yaml(spark, d):
    rows = [r.asDict() for r in Tables(spark, d).region.orderBy("r_regionkey").collect()]  # five rows
    return spark.createDataFrame([(files.to_yaml(rows),)], "yaml string")


@query("serialize_msgpack", "SELECT '82AB' || hex('r_regionkey') || printf('%02X', r_regionkey) || 'A6' || hex('r_name') || printf('%02X', 160 + strlen(r_name)) || hex(r_name) AS packed FROM region")
def serialize_msgpack(spark, d):
    return files.to_msgpack_rows(Tables(spark, d).region).select(F.hex("packed").alias("packed"))


@query("reindex", "SELECT * FROM nation")
def reindex(spark, d):
    old, new = Collection(spark, "old_nations"), Collection(spark, "new_nations")
    old.write(Tables(spark, d).nation)
    return new.checked_copy(old)


_KINDS = "SELECT _id, list(kind ORDER BY first_pos) AS kinds, count(*) AS n FROM (SELECT user_id AS _id, event_type AS kind, min(event_id) AS first_pos FROM events GROUP BY ALL) GROUP BY _id"


def _json_list(before: str, after: str) -> str:
    return f"""SELECT _id, '{before}' || CASE WHEN n = 1 THEN '"' || kinds[1] || '"' ELSE '["' || array_to_string(kinds, '","') || '"]' END || '{after}' AS doc FROM ({_KINDS})"""


@query("store_merge", _json_list('{"x":{"kind":', '}}'))
def store_merge(spark, d):
    from quillon.operators.merge import fold_documents

    docs = _events(spark, d).select("_id", "pos", F.to_json(F.struct(F.struct("kind").alias("x"))).alias("doc"))
    return fold_documents(docs, "_id", "pos")


# helpers of stores


@query("g_sqlite_insert", "SELECT user_id AS _id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def g_sqlite_insert(spark, d):
    return load.duplicated_ids(_events(spark, d))


@query("g_pg_insert", "SELECT count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS lost FROM customer")
def g_pg_insert(spark, d):
    docs = _customers(spark, d)
    stored = collections.insert(docs.limit(0), docs)
    return stored.agg(F.count("*").alias("n")).join(collections.without_id(docs).withColumnRenamed("n", "lost"))


@query("g_sqlite_bulk", _BOTH + "SELECT _id, name FROM o UNION ALL SELECT _id, name FROM n WHERE _id > 1000000")
def g_sqlite_bulk(spark, d):
    return collections.write_many(_customers(spark, d), _newer(spark, d).filter("_id > 1000000")).select("_id", "name")


@query("g_sqlite_count", "SELECT count(*) AS n FROM customer")
def g_sqlite_count(spark, d):
    return collections.count(stores.scan_sqlite(spark, _in_sqlite(spark, _customers(spark, d).select("_id", "name")), "docs"))


@query("g_pg_count", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0")
def g_pg_count(spark, d):
    return collections.count(_from_jdbc(spark, _in_derby(spark, _customers(spark, d).select("_id", "bal"))), {"bal": {"$gt": 0}})


@query("a_count", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def a_count(spark, d):
    return collections.count(_customers(spark, d), {"seg": {"$in": ["BUILDING", "MACHINERY"]}})


@query("a_build_stats", "SELECT count(*) AS total FROM customer")
def a_build_stats(spark, d):
    return collections.count(_customers(spark, d), name="total")


_SEVENTH = "SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_custkey = 7"


@query("g_sqlite_findone", _SEVENTH)
def g_sqlite_findone(spark, d):
    return stores.scan_sqlite(spark, _in_sqlite(spark, _customers(spark, d).select("_id", "name")), "docs", {"_id": 7}).limit(1)


@query("g_pg_findone", _SEVENTH)
def g_pg_findone(spark, d):
    return _from_jdbc(spark, _in_derby(spark, _customers(spark, d).select("_id", "name")), {"_id": 7}).limit(1)


@query("g_es_get", _SEVENTH)
def g_es_get(spark, d):
    return collections.find_one(_customers(spark, d), 7).select("_id", "name")


@query("g_es_exists", 'SELECT count(*) > 0 AS "exists" FROM customer WHERE c_custkey = 7')
def g_es_exists(spark, d):
    return collections.exists(_customers(spark, d), 7)


@query("g_es_ids", "SELECT c_custkey AS _id FROM customer")
def g_es_ids(spark, d):
    return collections.ids(_customers(spark, d))


@query("g_es_backend_query", "SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def g_es_backend_query(spark, d):
    return collections.scroll(_customers(spark, d), {"seg": "BUILDING"}).select("_id", "name")


@query("g_es_hub_update_many", "SELECT c_custkey AS _id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE c_name END AS name FROM customer")
def g_es_hub_update_many(spark, d):
    return collections.update_many(_customers(spark, d), {"seg": "BUILDING"}, {"name": "x"}).select("_id", "name")


@query("g_shelve_update", "SELECT c_custkey AS _id, c_name AS name, CASE WHEN c_custkey = 7 THEN 'moved' ELSE c_mktsegment END AS seg FROM customer UNION ALL SELECT NULL, 'nobody', 'made'")
def g_shelve_update(spark, d):
    once = collections.update_many(_customers(spark, d).select("_id", "name", "seg"), {"_id": 7}, {"seg": "moved"}, upsert=True)
    return collections.update_many(once, {"name": "nobody"}, {"seg": "made"}, upsert=True)


@query("g_doc_size", "SELECT count(*) FILTER (strlen(text) < 2000) AS small, count(*) FILTER (strlen(text) >= 2000) AS large FROM documents")
def g_doc_size(spark, d):
    return collections.sizes(Tables(spark, d).documents, "text", 2000)


@query("g_unique_ids", "SELECT count(*) AS n, count(DISTINCT user_id) AS ids FROM events")
def g_unique_ids(spark, d):
    return collections.id_counts(_events(spark, d))


@query("g_sqlite_rename", "SELECT r_regionkey, r_name FROM region")
def g_sqlite_rename(spark, d):
    path = _in_sqlite(spark, Tables(spark, d).region.select(big("r_regionkey").alias("r_regionkey"), "r_name"), "r_regionkey")
    stores.rename_table(path, "docs", "regions")
    return stores.scan_sqlite(spark, path, "regions").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("g_pg_rename", "SELECT * FROM region")
def g_pg_rename(spark, d):
    url = _in_derby(spark, Tables(spark, d).region, "RENAME TABLE docs TO regions")
    return _from_jdbc(spark, url, table="regions")


@query("g_es_alias", "SELECT * FROM region")
def g_es_alias(spark, d):
    c = Collection(spark, "alias_before")
    c.write(Tables(spark, d).region)
    c.rename("alias_after")
    return spark.table("alias_after")


@query("g_shelve_find", "SELECT c_custkey AS _id, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
def g_shelve_find(spark, d):
    return collections.find(_customers(spark, d), {"seg": "BUILDING", "bal": {"$gt": 9000}})


@query("g_hub_backup", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def g_hub_backup(spark, d):
    path = _folder(spark)
    files.to_json_lines(Tables(spark, d).region).write.text(path)
    return spark.read.text(path)


@query("g_hub_restore", "SELECT * FROM region")
def g_hub_restore(spark, d):
    c = Collection(spark, "restored_region")
    c.write(Tables(spark, d).region)
    c.write(Tables(spark, d).region.limit(1))
    return c.read(0)


@query("g_es_index_names", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS BIGINT) AS place FROM nation")
def g_es_index_names(spark, d):
    return catalogue.places(Tables(spark, d).nation, F.desc("n_nationkey")).select("n_name", "place")


@query("g_es_update_mapping", "SELECT r_regionkey, CAST(NULL AS VARCHAR) AS added FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def g_es_update_mapping(spark, d):
    t = Tables(spark, d)
    return tables.concatenated([t.region, t.region.withColumn("added", F.col("r_name"))]).select("r_regionkey", "added")


@query("g_mapping_es_index", _BOTH + "SELECT _id, name FROM n WHERE _id NOT IN (SELECT _id FROM o)")
def g_mapping_es_index(spark, d):
    return load.create_only(_customers(spark, d), _newer(spark, d)).select("_id", "name")


_CHUNKS = "SELECT c_custkey AS _id, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS chunk FROM customer"


@query("g_doc_iterator", _CHUNKS)
def g_doc_iterator(spark, d):
    return tables.chunked(_customers(spark, d), ["_id"], 100).select("_id", "chunk")


@query("s_iter_n", "SELECT c_custkey AS _id, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS chunk FROM customer")
def s_iter_n(spark, d):
    return tables.chunked(_customers(spark, d).select("_id"), ["_id"], 100).select("_id", "chunk")


@query("s_partition", "SELECT chunk, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 250 AS chunk FROM customer) GROUP BY chunk")
def s_partition(spark, d):
    return facets.group_count(tables.chunked(_customers(spark, d).select("_id"), ["_id"], 250), "chunk")


@query("s_schedule", "SELECT chunk AS batch, least((chunk + 1) * 400, total) AS done, round(least((chunk + 1) * 400, total) * 100.0 / total, 4)::DOUBLE AS percent FROM (SELECT DISTINCT (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS chunk, count(*) OVER () AS total FROM customer)")
def s_schedule(spark, d):
    batches = facets.group_count(tables.chunked(_customers(spark, d).select("_id"), ["_id"], 400), "chunk")
    out = batches.withColumn("total", batches.agg(F.sum("n")).scalar())
    done = F.least((F.col("chunk") + 1) * 400, F.col("total"))
    return out.select(F.col("chunk").alias("batch"), done.alias("done"), F.round(done * 100.0 / F.col("total"), 4).cast("double").alias("percent"))


@query("k_fullname", "SELECT CASE WHEN r_name = n_name THEN r_name ELSE concat_ws('.', r_name, n_name) END AS fullname FROM nation JOIN region ON n_regionkey = r_regionkey")
def k_fullname(spark, d):
    t = Tables(spark, d)
    subs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("main"), F.col("n_name").alias("sub"))
    return full_names(subs).select("fullname")


@query("k_mongo_exec", "SELECT c_custkey AS _id FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY c_custkey LIMIT 10 OFFSET 5")
def k_mongo_exec(spark, d):
    return _customers(spark, d).filter(shaping.any_equal("FURNITURE", ["seg"])).orderBy("_id").offset(5).limit(10).select("_id")


@query("k_sql_exec", "SELECT n_name FROM nation WHERE n_regionkey = 3")
def k_sql_exec(spark, d):
    return shaping.execute(spark, "SELECT n_name FROM {t} WHERE n_regionkey = :r", {"r": 3}, t=Tables(spark, d).nation)
