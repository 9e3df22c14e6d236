from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import diff, facets, load, tables
from quillon.plans import keygraph as G
from quillon.plans import query_language as Q
from quillon.plans import release, shaping
from quillon.sources import files
from quillon.sources.catalog import Collection
from quillon.streaming import ingest


@pytest.fixture(scope="module")
def genes(spark):
    rows = [("1", "CDK2", 9606, "cyclin dependent kinase 2", ["p33", "CDKN2"]), ("2", "cdk3", 9606, "cyclin dependent kinase 3", None), ("3", "TP53", 10090, None, ["p53"]), ("4", None, None, "other thing", [])]
    return spark.createDataFrame(rows, "_id string, symbol string, taxid int, name string, alias array<string>")


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("symbol:cdk2", "1"),
        ("cdk2", "1"),
        ("p53", "3"),
        ("name:kinase", "12"),
        ("name:kinase AND taxid:9606 AND NOT symbol:CDK3", "1"),
        ("name:kinase -symbol:cdk3", "1"),
        ("symbol:cdk2 OR symbol:tp53", "13"),
        ("(symbol:cdk2 OR symbol:tp53) AND taxid:[10000 TO *]", "3"),
        ('name:"dependent kinase"', "12"),
        ('name:"kinase dependent"', ""),
        ("_exists_:alias", "13"),
        ("NOT _exists_:symbol", "4"),
        ("symbol:cdk*", "12"),
        ("symbol:?p53", "3"),
        ("taxid:abc", ""),
        ("taxid:{9606 TO 20000]", "3"),
        ("absent:1", ""),
        ("*", "1234"),
        ("alias:cdkn2", "1"),
    ],
)
def test_queries(genes, query, ids):
    fields = Q.Fields(genes.schema, text=frozenset({"name"}), default=("_id", "symbol", "alias", "name"))
    assert "".join(sorted(r["_id"] for r in genes.filter(Q.parse(query, fields)).collect())) == ids


@pytest.mark.parametrize("query", ['"open', "(a", "a)", "AND a", "a OR", "/a.b/", "a~1", "NOT"])
def test_queries_that_cannot_be_read(genes, query):
    with pytest.raises(Q.QueryError):
        Q.parse(query, Q.Fields(genes.schema))


def test_default_operator_of_filters_is_or(genes):
    fields = Q.Fields(genes.schema)
    assert genes.filter(Q.parse("symbol:cdk2 symbol:tp53", fields, "OR")).count() == 2
    assert genes.filter(Q.parse("symbol:cdk2 symbol:tp53", fields)).count() == 0


def test_string_queries(genes):
    fields = Q.Fields(genes.schema)
    assert genes.filter(Q.string_query("", fields)[0]).count() == 0
    assert genes.filter(Q.string_query("__all__", fields)[0]).count() == 4
    assert Q.search(genes, Q.Request(q="__any__", size=2, seed=1), fields).count() == 2
    with pytest.raises(Q.QueryError):
        Q.Request(size=5000)
    with pytest.raises(Q.QueryError):
        Q.compound_match(["a"], [], fields)


def test_autoscope():
    patterns = [Q.Pattern(r"(?i)db(?P<term>\d+)", ("drugbank",)), Q.Pattern(r"cid:(?P<term>\d+)", ("pubchem.cid",))]
    known = {"drugbank", "pubchem.cid", "gene"}
    assert Q.autoscope("DB12", patterns, known, ("_id",)) == ("12", ("drugbank",))
    assert Q.autoscope("cid:118415428", patterns, known, ("_id",)) == ("118415428", ("pubchem.cid",))
    assert Q.autoscope("gene:1017", patterns, known, ("_id",)) == ("1017", ("gene",))
    assert Q.autoscope("x:1", patterns, known, ("_id",)) == ("x:1", ("_id",))


def test_search_pages_and_sources(genes):
    fields = Q.Fields(genes.schema)
    page = Q.search(genes, Q.Request(sort=("-taxid",), from_=1, size=2, source=("symbol",)), fields)
    assert page.columns == ["_id", "symbol"] and [r["_id"] for r in page.collect()] == ["1", "2"]
    assert [r["_id"] for r in Q.page_after(genes, "2", 10).collect()] == ["3", "4"]
    found = {(r["query"], r["_id"]): r["found"] for r in Q.multi_search(genes, ["CDK2", "p53", "zz"], ["symbol", "alias"], fields).collect()}
    assert found == {("CDK2", "1"): True, ("p53", "3"): True, ("zz", None): False}


def test_filter_narrows_facets_and_post_filter_does_not(genes):
    fields = Q.Fields(genes.schema)
    both, _ = Q.matched(genes, Q.Request(filter="taxid:9606", post_filter="symbol:cdk2"), fields, post=False)
    assert both.count() == 2
    hits, _ = Q.matched(genes, Q.Request(filter="taxid:9606", post_filter="symbol:cdk2"), fields)
    assert hits.count() == 1


def test_scores(genes):
    got = Q.bm25(genes, "name", "kinase 2").orderBy(F.desc("score")).collect()
    assert [r["_id"] for r in got] == ["1", "2"]


def test_jmespath(spark):
    df = spark.createDataFrame([([{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "a", "v": 1}],)], "xs array<struct<k:string,v:int>>")
    assert df.select(shaping.jmespath(df, "xs[?k=='a'].v")).first()[0] == [1, 1]
    assert df.select(shaping.jmespath(df, "unique(xs[].v)")).first()[0] == [1, 2]
    assert df.select(shaping.jmespath(df, "unique_count(xs[*].k)")).first()[0] == 2
    assert df.select(shaping.jmespath(df, "xs[-1].k")).first()[0] == "a"
    assert df.select(shaping.jmespath(df, "length(xs[?v>=`2`])")).first()[0] == 1


def test_facets(genes):
    got = facets.terms_facet(genes.withColumn("alias", F.array_append(F.coalesce("alias", F.array()), F.lit("x"))), "alias", 1, is_array=True).first()
    assert (got["term"], got["count"], got["other"], got["total"]) == ("x", 4, 3, 4)


@pytest.fixture(scope="module")
def graph(spark):
    table = lambda rows, cols: spark.createDataFrame(rows, cols)
    b = table([("b:1234", "a:1234"), ("b:f1", "a:f1")], "b_id string, a_id string")
    c = table([("c:1234", "b:1234", "e:1234"), ("c:f1", "b:f1", None)], "c_id string, b_id string, e_id string")
    d = table([("d:1234", "c:1234"), ("d:fail1", "c:f1")], "d_id string, c_id string")
    e = table([("e:1234", "d:1234"), ("e:f1", "d:f1")], "e_id string, d_id string")
    return [G.Edge("a", "b", b, "a_id", "b_id"), G.Edge("b", "a", b, "b_id", "a_id"), G.Edge("b", "c", c, "b_id", "c_id"), G.Edge("c", "d", d, "c_id", "d_id"), G.Edge("d", "e", e, "d_id", "e_id"), G.Edge("c", "e", c, "c_id", "e_id", weight=2.5)]


def test_key_graph(spark, graph):
    docs = spark.createDataFrame([("a:1234",), ("a:none",)], "_id string")
    assert [r[0] for r in G.convert(docs, graph, [("a", "_id")], ["d", "e"]).collect()] == ["d:1234"]
    assert sorted(r[0] for r in G.convert(docs, graph, [("a", "_id")], ["d"], skip_failures=True).collect()) == ["a:none", "d:1234"]
    assert sorted(r[0] for r in G.convert(docs, graph, [("a", "_id")], ["d"], skip_regex="^a:no").collect()) == ["a:none", "d:1234"]
    weights = [sum(e.weight for e in p) for p in G.simple_paths(graph, "a", "e")]
    assert weights == [4.0, 4.5]
    assert G.travel(docs.withColumnRenamed("_id", "orig"), graph, "a", "e").first()["cur"] == "e:1234"


def test_key_graph_goes_one_to_many_and_ignores_case(spark):
    t = spark.createDataFrame([("A:1", "b1"), ("a:1", "b2")], "a string, b string")
    edge = G.Edge("a", "b", t, "a", "b", ignore_case=True)
    got = G.convert(spark.createDataFrame([("a:1", 5)], "_id string, x int"), [edge], [("a", "_id")], ["b"])
    assert sorted((r["_id"], r["x"]) for r in got.collect()) == [("b1", 5), ("b2", 5)]


def test_update_path(spark):
    releases = [("1", None), ("2", "1"), ("3", "2"), ("3", None), ("4", "3")]
    assert release.update_path(spark, releases, "2", "4") == ["2.3", "3.4"]
    assert release.update_path(spark, releases, None, "2") == ["1", "1.2"]
    assert release.update_path(spark, releases, "4", "4") == []
    with pytest.raises(LookupError):
        release.update_path(spark, releases, None, "9")


def test_stores(spark):
    docs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 3, "w")], "_id string, pos int, v string")
    one = lambda df: sorted((r["_id"], r["v"]) for r in df.collect())
    assert one(load.keep_last_of_first_batch(docs, "_id", "pos", 2)) == [("a", "y"), ("b", "z")]
    assert one(load.keep_first(docs, "_id", "pos")) == [("a", "x"), ("b", "z")]
    assert one(load.keep_last(docs, "_id", "pos")) == [("a", "w"), ("b", "z")]
    with pytest.raises(Exception, match="duplicated id a"):
        load.store_basic(docs).collect()


def test_diff_applied_is_the_new_version(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "_id int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "_id int, v string")
    ops = {r["_id"]: r["op"] for r in diff.compared(old, new).collect()}
    assert ops == {1: "delete", 2: "same", 3: "update", 4: "add"}
    got = load.apply_diff(old, new, new, old.join(new, "_id", "left_anti"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in new.collect())


def test_adjacent_groups_and_chunks(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("aabba")], "i int, k string")
    assert [r["island"] for r in tables.group_adjacent(df, "k", "i").orderBy("i").collect()] == [1, 1, 2, 2, 3]
    assert [r["chunk"] for r in tables.chunked(df.repartition(3), ["i"], 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_files(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "a.tsv").write_text("n\tv\n1\tx\n2\ty\n")
    assert files.scan_delimited(spark, str(tmp_path / "a.tsv"), "n int, v string").count() == 2
    (tmp_path / "b.csv").write_text("n,v\n1,x\nzz,y\n")
    assert [r[0] for r in files.bad_lines(spark, str(tmp_path / "b.csv"), "n int, v string", sep=",").collect()] == ["zz,y"]
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"hello"))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("m", "zipped")
    got = {r["path"][-3:]: bytes(r["content"]) for r in files.open_files(spark, [str(tmp_path / "c.txt.gz"), str(tmp_path / "d.zip")]).collect()}
    assert got == {".gz": b"hello", "zip": b"zipped"}
    assert files.to_yaml({"a": [1, {"b": "x: y"}], "c": None}) == "a:\n  - 1\n  - b: 'x: y'\nc: null\n"


def test_collections_and_streams(spark, tmp_path):
    c = Collection(spark, "test_collection", f"file://{tmp_path}/c")
    c.write(spark.range(3).toDF("_id"))
    c.write(spark.range(5).toDF("_id"))
    assert spark.table("test_collection").count() == 5 and c.read(0).count() == 3
    for i in range(3):
        spark.createDataFrame([(k, i, f"v{i}") for k in range(i + 1)], "_id int, pos int, v string").write.mode("append").parquet(f"{tmp_path}/in")
    keeper = ingest.Upserter(spark, "_id", "pos", f"file://{tmp_path}/out")
    ingest.ingest(spark, f"{tmp_path}/in", "_id int, pos int, v string", keeper)
    assert sorted((r["_id"], r["v"]) for r in keeper.read().collect()) == [(0, "v2"), (1, "v2"), (2, "v2")]
