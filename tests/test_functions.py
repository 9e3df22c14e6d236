from __future__ import annotations

import copy

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import jsonpatch
from quillon.functions import scalars as S
from quillon.operators import merge, profile
from quillon.plans import options

scalars = st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab/~", max_size=3)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab/~", max_size=2), x, max_size=3), max_leaves=8)
objects = st.dictionaries(st.text("abc/~", max_size=2), values, max_size=4)


@given(objects, objects)
def test_patches_turn_one_into_the_other(a, b):
    for make in (jsonpatch.make, jsonpatch.make_with_lists):
        before = copy.deepcopy(a)
        assert jsonpatch.apply(a, make(a, b)) == b
        assert a == before


@given(objects, objects)
def test_a_patch_applied_again_with_conflicts_ignored_changes_nothing_that_it_set(a, b):
    done = jsonpatch.apply(a, jsonpatch.make(a, b))
    again = jsonpatch.apply(done, jsonpatch.make(a, b), ignore_conflicts=True)
    assert {k: again[k] for k in b if k not in a and k in again} == {k: b[k] for k in b if k not in a and k in again}


@pytest.mark.parametrize("patch", [[{"op": "remove", "path": "/x"}], [{"op": "replace", "path": "/x", "value": 1}], [{"op": "add", "path": "/l/9", "value": 1}], [{"op": "test", "path": "/a", "value": 2}], [{"op": "move", "from": "/l", "path": "/l/0"}]])
def test_conflicts(patch):
    with pytest.raises(jsonpatch.Conflict):
        jsonpatch.apply({"a": 1, "l": [1]}, patch)
    assert jsonpatch.apply({"a": 1, "l": [1]}, patch, ignore_conflicts=True) == {"a": 1, "l": [1]}


def test_verify_finds_what_did_not_take_effect():
    with pytest.raises(jsonpatch.Conflict):
        jsonpatch.apply({}, [{"op": "replace", "path": "/x", "value": 1}], ignore_conflicts=True, verify=True)


def test_structures_merge():
    assert merge.merge_structures({"_id": 1, "u": {"n": "A"}}, {"_id": 1, "u": {"n": "B"}}) == {"_id": 1, "u": {"n": ["A", "B"]}}
    assert merge.merge_structures([1, 2], [2, 3]) == [1, 2, 3]
    assert merge.merge_structures([1], 1) == [1]
    assert merge.merge_structures({"a": 1}, [{"a": 2}]) == [{"a": 2}, {"a": 1}]
    with pytest.raises(ValueError):
        merge.merge_structures({"a": 1}, 2)


@given(values)
def test_a_structure_merged_with_itself_is_itself(x):
    assert merge.merge_structures(copy.deepcopy(x), copy.deepcopy(x)) == x


def test_deltas():
    got = merge.apply_delta({"a": {"b": "c"}}, {"a": {"__REPLACE__": True, "B": {"__REPLACE__": False, "c": "d"}}})
    assert got == {"a": {"B": {"c": "d"}}}
    assert merge.apply_delta({"a": 1, "b": 2}, {"b": {"__REMOVE__": True}}) == {"a": 1}


def test_split_ids(spark):
    df = spark.createDataFrame([('CDK2 CDK3',), ('"CDK2 CDK3"\n CDk4',), ("a|b,c+d\t'e f'",), ("",)], "q string")
    assert [r[0] for r in df.select(S.split_ids(F.col("q"))).collect()] == [["CDK2", "CDK3"], ["CDK2 CDK3", "CDk4"], ["a", "b", "c", "d", "e f"], []]
    with pytest.raises(Exception, match="closing quotation"):
        spark.createDataFrame([('"a b',)], "q string").select(S.split_ids(F.col("q"))).collect()


def test_conversions(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("x",), ("1_000",), (None,)], "s string")
    got = df.select(S.to_int(F.col("s")), S.to_number(F.col("s")), S.option_to_bool(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, True), (None, 2.5, True), (None, None, False), (1000, 1000.0, False), (None, None, None)]


def test_globs(spark):
    df = spark.createDataFrame([("34567",), ("a.b",), (None,)], "s string")
    assert [r[0] for r in df.select(S.matches_glob(F.col("s"), "3*7")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(S.matches_glob(F.col("s"), "a.[!c]")).collect()] == [False, True, False]


def test_documents(spark):
    df = spark.createDataFrame([("1", {"k": 1}, [{"x": 1, "y": "a"}, {"x": 2, "y": None}])], "_id string, m struct<k:int>, l array<struct<x:int,y:string>>")
    assert df.select(A.values_at(df.schema, "l.x")).first()[0] == [1, 2]
    assert [p for p, _, _ in A.leaves(df.schema)] == ["_id", "m.k", "l.x", "l.y"]
    out = df.select(*A.on_document(df.schema, "l.y", lambda x: None))
    assert out.schema["l"].dataType.elementType.names == ["x"]
    assert df.select(*A.nested({"a.b": F.lit(1), "a.c": F.lit(2)})).first()["a"].asDict() == {"b": 1, "c": 2}


def test_profiles(spark):
    docs = spark.createDataFrame([(1, "124", 34.3), (2, "5", None), (3, "124", 50.2)], "_id int, id string, val double")
    got = {r["path"]: r for r in profile.statistics(profile.leaf_rows(docs), deep=True).collect()}
    assert (got["id"]["count"], got["id"]["min"], got["id"]["max"]) == (3, 1, 3)
    assert (got["val"]["count"], got["val"]["none"], got["val"]["mean"]) == (2, 1, 42.25)


def test_mapping_and_schema(spark):
    kind = spark.createDataFrame([], "a int, b array<struct<c:string,d:double>>").schema
    m = profile.mapping(kind, frozenset({"b.c"}))
    assert m["properties"]["a"] == {"type": "integer"} and m["properties"]["b"]["properties"]["c"] == {"type": "text"}
    assert profile.total_fields(m) == 3
    assert profile.json_schema(kind)["properties"]["b"]["type"] == "array"


def test_options():
    known = {"size": options.Option("int", default=10, maximum=1000, alias=("limit",)), "fields": options.Option("list"), "raw": options.Option("bool"), "q": options.Option(required=True)}
    assert options.parse(known, {"q": "x", "limit": "7", "fields": 'a,"b c"', "raw": "0"}) == {"q": "x", "size": 7, "fields": ["a", "b c"], "raw": False}
    for bad in ({}, {"q": "x", "size": "5000"}, {"q": "x", "size": "many"}, {"q": "x", "fields": '"a'}):
        with pytest.raises(options.OptionError):
            options.parse(known, bad)
