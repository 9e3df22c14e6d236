"""Stores, document collections, fetching, MessagePack and request options."""

from __future__ import annotations

import datetime as dt
import sqlite3

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions import msgpack, values
from quillon.operators import catalogue, collections, diff, load, parallel, profile
from quillon.plans import build, options, shaping
from quillon.plans import query_language as Q
from quillon.sources import acquire, files, stores


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "ann", ["x", "y"], {"n": 5}), (2, "bob", [], {"n": 7}), (3, None, ["y"], {"n": None})]
    return spark.createDataFrame(rows, "_id bigint, name string, tags array<string>, deep struct<n: int>")


def _ids(df):
    return sorted(r["_id"] for r in df.select("_id").collect())


@pytest.mark.parametrize(
    ("query", "wanted"),
    [
        ({}, [1, 2, 3]),
        ({"name": "ann"}, [1]),
        ({"name": None}, [3]),
        ({"tags": "y"}, [1, 3]),
        ({"deep.n": {"$gte": 5, "$lt": 7}}, [1]),
        ({"absent": {"$exists": False}}, [1, 2, 3]),
        ({"name": {"$in": ["ann", "bob"]}, "tags": "x"}, [1]),
        ({"name": {"$nin": ["ann"]}}, [2, 3]),
        ({"$or": [{"name": "bob"}, {"tags": "x"}]}, [1, 2]),
        ({"$not": {"tags": "y"}}, [2]),
        ({"name": {"$not": {"$regex": "^a"}}}, [2, 3]),
        ({"name": {"$ne": "ann"}}, [2, 3]),
    ],
)
def test_queries_of_documents(docs, query, wanted):
    assert _ids(collections.find(docs, query)) == wanted


def test_pages_and_updates_of_documents(docs):
    assert [(r["_id"], r["total"]) for r in collections.find_with_total(docs, {"tags": "y"}, ["-_id"], 1).collect()] == [(3, 2)]
    with pytest.raises(collections.StoreError):
        collections.matches(docs.schema, {"name": {"$near": 1}})
    with pytest.raises(PySparkException, match="more than 1"):
        collections.fetch(docs, [1, 2], limit=1).collect()
    with pytest.raises(PySparkException, match="taken"):
        collections.insert(docs, docs.filter("_id = 1")).collect()
    with pytest.raises(PySparkException, match="no id"):
        collections.insert(docs, docs.filter("_id = 1").withColumn("_id", F.lit(None).cast("bigint"))).collect()
    with pytest.raises(PySparkException, match="twice"):
        collections.write_many(docs.limit(0), docs.unionByName(docs)).collect()
    plain = docs.select("_id", "name")
    once = collections.update_many(plain, {"name": "zoe"}, {"_id": 9}, upsert=True)
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, "ann"), (2, "bob"), (3, None), (9, "zoe")], key=str)
    assert collections.update_many(once, {"name": "zoe"}, {"_id": 8}, upsert=True).count() == 4
    changed = collections.apply_operators(docs, {"$set": {"name": "n"}, "$push": {"tags": "y"}, "$unset": {"deep": 1}})
    assert changed.columns == ["_id", "name", "tags"] and [r["tags"] for r in changed.orderBy("_id").collect()] == [["x", "y", "y"], ["y"], ["y", "y"]]
    assert _ids(collections.resumed(plain.filter("_id < 3"), plain)) == [1, 2, 3]
    seen = []
    assert collections.checked_scroll(docs, {"tags": "y"}, lambda df: seen.append(df.count())) == 2 and seen == [2]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    df = spark.createDataFrame([(i, f"n{i % 7}", i / 2, None if i % 5 else b"b") for i in range(2500)], "id bigint, name string, x double, data binary")
    assert stores.write_sqlite(df, path, "t", key="id") == 2500
    back = stores.scan_sqlite(spark, path, "t", partitions=3)
    assert back.dtypes == df.dtypes and back.rdd.getNumPartitions() == 3
    assert sorted(back.collect()) == sorted(df.collect())
    assert stores.scan_sqlite(spark, path, "t", {"name": "n3"}).filter("x > 1000").count() == df.filter("name = 'n3' AND x > 1000").count()
    with pytest.raises(sqlite3.IntegrityError):
        stores.write_sqlite(df.limit(1), path, "t", key="id")
    assert stores.write_sqlite(df.filter("id = 7").withColumn("name", F.lit("new")), path, "t", key="id", replace=True) == 1
    assert stores.scan_sqlite(spark, path, "t", {"id": 7}).first()["name"] == "new"
    sqlite3.connect(path).execute("CREATE TABLE bare (a TEXT)")
    assert stores.scan_sqlite(spark, path, "bare").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert stores.scan_sqlite(spark, path, "t").filter("id >= 2490 AND name IN ('n1', 'n2') AND length(name) = 2").count() == sum(i % 7 in (1, 2) for i in range(2490, 2500))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_jdbc(spark):
    url = "jdbc:derby:memory:written;create=true"
    df = spark.createDataFrame([(i, f"n{i % 7}") for i in range(2500)], "id bigint, name string")
    stores.write_jdbc(df, url, "t", "name VARCHAR(60)", driver=stores.DERBY)
    stores.write_jdbc(df.filter("id < 3"), url, "t", "", driver=stores.DERBY)
    assert stores.scan_jdbc(spark, url, "t", driver=stores.DERBY).count() == 2503
    assert stores.run_jdbc(spark, url, "DELETE FROM t WHERE \"id\" >= 10") == 2490
    assert [r["id"] for r in stores.scan_jdbc(spark, url, "t", {"name": "n3"}, driver=stores.DERBY).collect()] == [3]


def test_derby(spark, tmp_path):
    texts = [None, "", " ", " a ", 'a"b', '"', "a,b", "x\ny", "x\r\ny\r", "\n", "\\n", "'", "NULL", "\t", "x\x00y", "ü€😀", "y" * 32672]
    df = spark.createDataFrame([(i, t, None if i % 3 else i / 7, None if i % 4 else i) for i, t in enumerate(texts)] + [(-(2**63), "low", 1e300, -(2**31)), (None, None, None, None)], "_id bigint, name string, x double, n int")
    url = stores.create_derby(df, str(tmp_path / "a.derby"), "docs")
    assert stores.run_jdbc(spark, url, """DELETE FROM docs WHERE "name" = 'low'""") == 1
    url = stores.publish_derby(spark, url)
    assert [x.name for x in tmp_path.iterdir()] == ["a.derby.jar"]
    back = stores.scan_jdbc(spark, url, "docs", driver=stores.DERBY)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.filter("name IS NULL OR name <> 'low'").collect()), key=str)
    assert stores.scan_jdbc(spark, url, "docs", {"_id": 7}, driver=stores.DERBY).first()["name"] == texts[7]
    with pytest.raises(Py4JJavaError, match="read-only"):
        stores.run_jdbc(spark, url, "DELETE FROM docs")
    with pytest.raises(Py4JJavaError, match="outside the range"):
        stores.create_derby(df.select(F.lit(float("nan")).alias("x")), str(tmp_path / "b.derby"), "docs")


def test_sql_of_json_documents():
    assert stores.json_query("t", {"name": "o'hara", "n": 3}) == """SELECT * FROM "t" WHERE "document" ->> 'name' = 'o''hara' AND "document" ->> 'n' = '3'"""


def test_messages_come_back():
    value = {"a": [None, True, False, 0, -1, -33, 127, 128, 70000, -70000, 2**40, -(2**40), 1.5], "t": "x" * 40, "b": b"\x00\x01", "long": list(range(20)), "when": dt.datetime(2024, 1, 2, 3, 4), "d": {str(i): i for i in range(17)}, "u": "ü" * 70000}
    assert msgpack.unpack(msgpack.pack(value)) == value
    # examples of the published format
    assert msgpack.pack({"compact": True, "schema": 0}) == b"\x82\xa7compact\xc3\xa6schema\x00"
    assert msgpack.pack(255) == b"\xcc\xff" and msgpack.pack(-128) == b"\xd0\x80" and msgpack.pack(65536) == b"\xce\x00\x01\x00\x00"
    for bad in (b"\xc1", b"\x92\x01", msgpack.pack(1) + b"\x00"):
        with pytest.raises(ValueError, match="mark|ends|goes on"):
            msgpack.unpack(bad)
    with pytest.raises(TypeError):
        msgpack.pack(object())


def test_fetching_again_takes_what_is_newer(tmp_path):
    source = tmp_path / "there"
    source.mkdir()
    (source / "a.txt").write_text("1")
    told = []
    fetch = acquire.FolderAcquirer(source, tmp_path / "here", version="v", post=told.append)
    assert fetch.run().fetched == ["a.txt"] and fetch.run().skipped == ["a.txt"] and len(told) == 1
    (source / "b.txt").write_text("2")
    assert fetch.run().fetched == ["b.txt"] and fetch.run(force=True).fetched == ["a.txt", "b.txt"]
    linked = acquire.FolderAcquirer(source, tmp_path / "links", how="link", version="v").run()
    assert (tmp_path / "links" / "v" / "a.txt").is_symlink() and linked.fetched == ["a.txt", "b.txt"]
    moved = acquire.FolderAcquirer(source, tmp_path / "moved", how="move", pattern="a*", version="v").run()
    assert moved.fetched == ["a.txt"] and not (source / "a.txt").exists()
    with pytest.raises(FileNotFoundError):
        acquire.ManualAcquirer(tmp_path / "nowhere")
    with pytest.raises(RuntimeError):
        acquire.GitAcquirer(str(tmp_path / "no-repository"), tmp_path / "clone").run()


def test_a_file_that_fails_half_way_does_not_appear(tmp_path):
    class Broken(acquire.Acquirer):
        def listing(self):
            yield acquire.Remote("x", "x.txt")

        def fetch(self, remote, target):
            target.write_text("half")
            raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        Broken(tmp_path, "v").run()
    assert not (tmp_path / "v" / "x.txt").exists()


def test_documents_of_an_api_come_in_files(tmp_path):
    status = acquire.ApiAcquirer(lambda: iter({"n": i} for i in range(25)), tmp_path, per_file=10, version="v").run()
    assert status.fetched == [f"documents-{i}.ndjson" for i in range(3)]
    assert sum(len((tmp_path / "v" / n).read_text().splitlines()) for n in status.fetched) == 25


def test_put_object(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    acquire.put_object(spark, str(tmp_path / "a"), f"file://{tmp_path}/b")
    assert (tmp_path / "b").read_text() == "1"
    with pytest.raises(FileExistsError):
        acquire.put_object(spark, str(tmp_path / "a"), f"file://{tmp_path}/b")


def test_options_of_all_kinds():
    O = options.Option  # noqa: E741, N806
    assert options.split_list('a,"b c"|d+e  \'f,g\'') == ["a", "b c", "d", "e", "f,g"]
    with pytest.raises(options.OptionError):
        options.split_list('a "b')
    read = lambda option, value: options.converted(option, value)
    assert [read(O("bool"), x) for x in ("2", "0", "-1", "yes", "no", True)] == [True, False, False, True, False, True]
    assert read(O("int", strict=False), "2.7") == 2 and read(O("float"), "1e3") == 1000.0 and read(O("list"), ("a",)) == ["a"]
    assert read(O(translations=(("^a", "b"), ("b", "c"))), "ab") == "cc"
    for option, value in ((O("int"), "2.7"), (O("float"), "x"), (O("int"), None)):
        with pytest.raises(options.OptionError):
            read(option, value)


def test_planner_hooks_and_named_queries(spark):
    df = spark.createDataFrame([(1, "red"), (2, "blue")], "_id bigint, colour string")
    fields = Q.Fields(df.schema, default=("colour",))
    assert _ids(df.filter(Q.Planner(fields).predicate("red"))) == [1]
    assert _ids(df.filter(Q.named_query({"c": "colour:{{q}}"}, "c", {"q": "blue"}, fields))) == [2]
    assert _ids(df.filter(Q.named_query({"c": "colour:{{q}}"}, "c", {"q": "red OR blue"}, fields))) == []  # one word, no syntax
    with pytest.raises(Q.QueryError):
        Q.named_query({}, "c", {}, fields)
    with pytest.raises(Q.QueryError):
        Q.multi_search(df, [str(i) for i in range(1001)], ["colour"], fields)


def test_hits_in_their_final_shape(spark):
    df = spark.createDataFrame([(1, 2.0, {"b": "y", "a": "x"}, "z")], "_id bigint, _score double, src struct<b: string, a: string>, one string")
    out = shaping.format_hits(df, shaping.HitOptions(licences=(("src", "http://l"),), allow_null=("none",), always_list=("one",), jmespath=(("n", "length(one)"),)))
    assert out.columns == ["_id", "_score", "none", "one", "src", "n"] and out.schema["src"].dataType.names == ["_license", "a", "b"]
    assert tuple(out.select("none", "one", "n").first()) == (None, ["z"], 1)
    assert shaping.format_hits(df, shaping.HitOptions(score=False, dotfield=True)).columns == ["_id", "one", "src.a", "src.b"]


def test_builds_with_hooks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "_id bigint, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "_id bigint, v string")
    made = build.Build(roots=["a"], predicates={"b": "v <> 'w'"}, mappers={"b": lambda df: df.withColumn("v", F.upper("v"))}, post_merge=lambda df, names: df.withColumn("from", F.lit("+".join(names))))
    assert sorted(map(tuple, made.run({"a": a, "b": b}).select("_id", "v", "from").collect())) == [(1, "x", "a+b"), (2, "Z", "a+b")]
    assert build.Build().metadata(a, ["a"]) == {"stats": {"total": 2}, "sources": ["a"]}


def test_strategies_of_stores(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 2, "c")], "_id bigint, pos bigint, v string")
    assert load.store_none(df) == 0
    with pytest.raises(PySparkException, match="duplicated id 1"):
        load.store(df, None).collect()
    assert sorted(r["v"] for r in load.store(df, "ignore", position="pos").collect()) == ["a", "c"]
    assert sorted(map(str, (r["v"] for r in load.store(df, "merge", position="pos").collect()))) == ["['a', 'b']", "['c']"]
    for bad in ("replace", "ignore"):
        with pytest.raises(ValueError, match="strategy|order"):
            load.store(df, bad)


def test_stored_types_are_looked_up():
    from pyspark.sql import types as T

    assert values.typed({"a": ["__type__:int", "x"]}) == {"a": [T.LongType(), "x"]}
    with pytest.raises(KeyError):
        values.typed("__type__:__import__('os')")


def test_automatic_steps():
    assert catalogue.automatic_steps({"autobuild": True, "autopublish": {"type": ["full"]}, "autorelease": {"schedule": "x"}}) == [("autobuild", "full"), ("autobuild", "incremental"), ("autopublish", "full"), ("autorelease", "full"), ("autorelease", "incremental")]
    assert catalogue.automatic_steps({}) == []


def test_jobs_run_side_by_side(spark):
    out = parallel.run_jobs(spark, {n: (lambda n=n: spark.range(n).count()) for n in (3, 5)}, at_once=2)
    assert sorted(map(tuple, out.collect())) == [("3", 3), ("5", 5)] or sorted(r["n"] for r in out.collect()) == [3, 5]


def test_root_patches_agree_with_those_of_json(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "_id bigint, n string, s string")
    new = spark.createDataFrame([(1, "a", "q"), (2, "z", None), (3, "c", "y")], "_id bigint, n string, s string")
    as_json = lambda df: df.select("_id", F.to_json(F.struct("n", "s"), {"ignoreNullFields": "false"}).alias("doc"))
    assert sorted(map(tuple, diff.root_patches(old, new).collect())) == sorted(map(tuple, diff.json_patches(as_json(old), as_json(new)).collect()))


def test_report_shows_the_first_ids(spark):
    df = spark.range(500).select(F.col("id").alias("_id"), F.when(F.col("id") % 2 == 0, "add").otherwise("update").alias("op"), F.lit("p").alias("path"))
    got = {r["op"]: (r["n"], r["ids"]) for r in diff.report(df, examples=3).collect()}
    assert got == {"add": (250, [0, 2, 4]), "update": (250, [1, 3, 5])}


def test_deep_statistics_of_batches(spark):
    rows = profile.leaf_rows(spark.range(100).select(F.col("id").alias("_id"), (F.col("id") * 1.5).alias("x")))
    parts = profile.value_sums(rows.filter("_id < 30")).unionByName(profile.value_sums(rows.filter("_id >= 30")))
    got, want = profile.merged_values(parts).first(), profile.statistics(rows, deep=True).first()
    assert abs(got["mean"] - want["mean"]) < 1e-9 and abs(got["stdev"] - want["stdev"]) < 1e-9 and got["count"] == 100


def test_small_files_become_few(spark, tmp_path):
    spark.range(100).repartition(12).write.parquet(f"{tmp_path}/small")
    out = files.compacted(spark, f"{tmp_path}/small", f"{tmp_path}/large", 1 << 20)
    assert out.count() == 100 and len(out.inputFiles()) == 1


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path):
    from quillon.streaming.ingest import Upserter

    keeper = Upserter(spark, "k", "at", str(tmp_path), buckets=8)
    first = spark.createDataFrame([(i, 0, f"a{i}") for i in range(200)], "k bigint, at bigint, v string")
    second = spark.createDataFrame([(3, 1, "b"), (3, 2, "c"), (500, 1, "new")], "k bigint, at bigint, v string")
    keeper(first, 0)
    kept = dict(keeper.paths)
    for _ in range(2):  # the second time as after a failure
        keeper(second, 1)
        rows = {r["k"]: r["v"] for r in keeper.read().collect()}
        assert len(rows) == 201 and rows[3] == "c" and rows[500] == "new" and rows[4] == "a4"
    assert sum(keeper.paths[b] != kept[b] for b in kept) <= 2
