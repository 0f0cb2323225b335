"""Cases that went wrong once, each with the smallest tables that show it."""

import pytest

from ontoloom.functions import casts
from ontoloom.functions import names as N
from ontoloom.operators import documents as D
from ontoloom.operators import graph
from ontoloom.sources.store import Blocked, Store
from pyspark.sql import functions as F


def ids(df):
    return sorted(r["_id"] for r in df.collect())


def test_filters_of_arrays_and_nulls(spark):
    df = spark.createDataFrame([(1, 3, ["a", "b"]), (2, None, ["b"]), (3, 9, None)], "_id int, n int, tags array<string>")
    find = lambda q: ids(D.find(df, q))
    assert find({"tags": "b"}) == [1, 2] and find({"tags": {"$in": ["a", None]}}) == [1, 3] and find({"tags": {"$all": ["a", "b"]}}) == [1]
    assert find({"n": {"$not": {"$gt": 5}}}) == [1, 2] and find({"$nor": [{"n": {"$gt": 5}}]}) == [1, 2]
    assert find({"n": {"$in": [3, None]}}) == [1, 2] and find({"n": {"$nin": [3]}}) == [2, 3] and find({"n": {"$ne": 3}}) == [2, 3]
    assert find({"tags": {"$size": 2}}) == [1] and find({"tags": {"$elemMatch": {"$regex": "^a"}}}) == [1] and find({"n": {"$type": "int"}}) == [1, 3]
    assert ids(D.find(df, limit=0)) == [1, 2, 3] and ids(D.find(df, limit=-2)) == [1, 2]


def test_closure_of_cycles_and_long_chains(spark):
    loop = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "A")], "child string, parent string")
    assert sorted(map(tuple, graph.closure(loop).collect())) == [("A", "A", 2), ("A", "B", 1), ("B", "A", 1), ("B", "B", 2), ("C", "A", 1), ("C", "B", 2)]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)], "child string, parent string")
    assert graph.closure(chain).count() == 45
    pairs = spark.createDataFrame([("A", "A"), ("C", "C"), ("C", "B"), ("B", "C")], "child string, parent string")
    assert {tuple(r) for r in graph.is_subclass(pairs, loop).collect()} == {("A", "A", True), ("C", "C", True), ("C", "B", True), ("B", "C", False)}


def test_deletes_fold_all_fields_of_a_collection(spark, tmp_path):
    s, df = Store(spark, f"file://{tmp_path}/db"), spark.createDataFrame
    s.insert("people", df([("a",), ("b",)], "_id string"))
    s.insert("pets", df([("p", "a", "a", ["a", "b", "b"])], "_id string, owner_id string, vet_id string, friend_ids array<string>"))
    refs = [("pets", "owner_id", "unset"), ("pets", "vet_id", "restrict"), ("pets", "friend_ids", "pull")]
    gone = df([("a",)], "_id string")
    with pytest.raises(Blocked, match="restricts"):
        s.delete("people", gone, refs, "detach_if_valid")
    with pytest.raises(Blocked, match="cascade"):
        s.delete("people", gone, [("pets", "owner_id", "cascade")], "force_detach")
    assert s.suggest_mode("people", gone, refs) == "force_detach"
    commits = s._commits()
    made = s.delete("people", gone, refs, " Force_Detach")
    assert set(made) == {"people", "pets"} and s._commits() == [*commits, commits[-1] + 1]
    assert [tuple(r) for r in s.read("pets").collect()] == [("p", None, None, ["b", "b"])] and ids(s.read("people")) == ["b"]
    with pytest.raises(Blocked, match="violate"):
        s.delete("people", df([("b",)], "_id string"), [("pets", "friend_ids", "pull")], "detach_if_valid", check=lambda _, docs: docs.where("size(friend_ids) = 0"))


def test_referrers_count_once(spark):
    df = spark.createDataFrame
    t, docs = df([(1,)], "_id int"), df([("x", [1, 1]), ("y", [1])], "_id string, r array<int>")
    assert [tuple(r) for r in D.incoming(t, "_id", [("docs", docs, "r")]).collect()] == [(1, "docs", 2)]
    assert [tuple(r) for r in D.delete_plan(t, "_id", [("docs", docs, "r", "restrict")], "force_detach").collect()] == [(1, "docs", 2, "pull")]
    assert [r["examples"] for r in D.incoming_examples(t, "_id", [("docs", docs, "r", "_id")], 1).collect()] == [["x"]]


def test_upsert_of_partial_documents(spark):
    df = spark.createDataFrame
    got = D.upsert(df([(1, "a", 1), (2, "b", 2)], "_id int, a string, b int"), df([(2, None), (3, "c")], "_id int, a string"), "_id")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    old = df([(1, ("x", "y"))], "_id int, metadata struct<createdAt:string,notes:string>")
    assert [tuple(r["metadata"]) for r in D.patch(old, df([(1, ("n",))], "_id int, metadata struct<notes:string>"), "_id").collect()] == [("x", "n")]


def test_scalars_and_names(spark):
    t = spark.createDataFrame([("2020-13-45xyz",), ("nan",), ("True",), ("12",), ("1.",), ("2020/02/03",), ("2020-02-03T04:05:06Z",)], "t string")
    assert [r[0] for r in t.select(casts.xsd_type(F.col("t"))).collect()] == ["string", "double", "boolean", "integer", "double", "string", "string"]
    assert [r[0] for r in t.select(casts.xsd_type(F.col("t"), F.lit("http://www.w3.org/2001/XMLSchema#date"))).collect()] == ["date"] * 7
    dates = [r[0] for r in t.select(casts.parse_scalar(F.col("t"), F.lit("date"))).collect()]
    assert dates[0] == "2020-13-45xyz" and dates[5] == "2020-02-03T00:00:00Z" and dates[6] == "2020-02-03T04:05:06Z"
    c = spark.createDataFrame([("Sex",), ("Box",), ("TimeSeries",), ("Apperance",)], "c string")
    assert [r[0] for r in c.select(N.collection_name(F.col("c"))).collect()] == ["sexes", "boxs", "time_serieses", "appearances"]
    assert [r[0] for r in c.select(N.match_collection(F.col("c"), F.array(F.lit("boxes"), F.lit("time_series")))).collect()] == [None, "boxes", "time_series", None]
    assert [r[0] for r in spark.createDataFrame([("has_x_ids",), ("has_x_id",), ("x",)], "f string").select(N.unresolved_field(F.col("f"))).collect()] == ["has_x_unresolved", "has_x_unresolved", "x_unresolved"]


def test_paths_and_nested_merges(spark):
    df = spark.createDataFrame([(1, ("a", ("b",)))], "_id int, m struct<x:string,y:struct<z:string>>")
    assert D.flatten_paths(df).columns == ["_id", "m.x", "m.y.z"] and [tuple(r) for r in D.flatten_paths(df).collect()] == [(1, "a", "b")]
    assert D.has_path(df.schema, "m.y.z") and not D.has_path(df.schema, "m.q")
    assert [r[0] for r in D.set_path(df, "m.y.z", F.lit("c")).select("m.y.z").collect()] == ["c"] and [r[0] for r in D.set_path(df, "n.o", F.lit(1)).select("n.o").collect()] == [1]
    two = spark.createDataFrame([((1, None), (None, 2))], "low struct<a:int,b:int>, high struct<a:int,b:int>")
    assert [tuple(r[0]) for r in two.select(D.merge_nested(F.col("low"), F.col("high"), two.schema["low"].dataType)).collect()] == [(1, 2)]
