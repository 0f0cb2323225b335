import pytest

from ontoloom.sources.store import Store


def test_changes_are_versions(spark, tmp_path):
    s, df = Store(spark, f"file://{tmp_path}/db"), spark.createDataFrame
    s.insert("people", df([("a", "x"), ("b", "y")], "_id string, name string"))
    s.insert("pets", df([("p", "a", ["a", "b"])], "_id string, owner_id string, friend_ids array<string>"))
    with pytest.raises(ValueError):
        s.insert("people", df([("a", "z")], "_id string, name string"))
    s.upsert("people", df([("b", "yy"), ("c", "z")], "_id string, name string"))
    s.update("people", df([("c", None)], "_id string, name string"))
    got = lambda n, v=None: sorted(map(tuple, s.read(n, v).collect()), key=repr)
    assert got("people") == [("a", "x"), ("b", "yy"), ("c", None)] and got("people", 1) == [("a", "x"), ("b", "y")]
    gone = df([("a",)], "_id string")
    with pytest.raises(ValueError):
        s.delete("people", gone, [("pets", "owner_id", "restrict")])
    s.delete("people", gone, [("pets", "owner_id", "restrict")], "force_detach")
    s.delete("people", df([("b",)], "_id string"), [("pets", "friend_ids", "pull")], "detach_if_valid")
    assert got("pets") == [("p", None, ["a"])] and got("people") == [("c", None)]
    assert s.collections() == ["people", "pets"]
