from ontoloom.operators import validation as V

CONSTRAINTS = [("P", "age", "scalar", "int", True, False, None, None), ("P", "tags", "scalar", "string", False, True, 1, 2), ("P", "friend_ids", "reference", "array", False, True, None, None), ("P", "home_id", "reference", "objectId", False, False, None, None)]
ID = "a" * 24


def test_issues(spark):
    payloads = [
        (1, "P", f'{{"age": 3, "tags": ["x"], "friend_ids": ["{ID}"], "home_id": "{ID}", "_id": "q"}}'),
        (2, "P", '{"age": "3", "what": 1}'), (3, "Q", "{}"), (4, "A", "{}"), (5, "P", "[1]"),
        (6, "P", '{"age": null, "tags": ["a", "b", "c"], "friend_ids": "x", "home_id": ["y"]}'), (7, "P", '{"age": 1, "tags": "a"}'), (8, "P", None),
    ]
    df = spark.createDataFrame
    got = V.validate(df(payloads, "doc_id int, class string, payload string"), df([("P", False), ("A", True)], "name string, is_abstract boolean"), df(CONSTRAINTS, "class string, field string, kind string, bson_type string, required boolean, is_array boolean, min_items int, max_items int"))
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], set()).add((r["code"], r["field"]))
    assert 1 not in found
    assert found[2] == {("scalar_type_mismatch", "age"), ("unknown_field", "what")}
    assert found[3] == {("unknown_class", None)} and found[4] == {("abstract_class", None)}
    assert ("invalid_payload", None) in found[5] and ("invalid_payload", None) in found[8]
    assert {("missing_required_field", "age"), ("cardinality_too_large", "tags"), ("reference_array_expected", "friend_ids"), ("single_reference_expected", "home_id")} <= found[6]
    assert found[7] == {("scalar_array_expected", "tags")}


def test_targets_and_disjointness(spark):
    df = spark.createDataFrame
    ids = df([(1, "P", "r", "a"), (1, "P", "r", "b"), (2, "P", "r", "c")], "doc_id int, class string, field string, target string")
    targets = df([("P", "r", "x"), ("P", "r", "y")], "class string, field string, collection string")
    docs = df([("x", "a"), ("y", "a"), ("x", "b")], "collection string, _id string")
    assert sorted(map(tuple, V.missing_targets(ids, targets, docs).collect())) == [(1, "ambiguous_reference_target", "r"), (2, "missing_reference_target", "r")]
    types = df([("i", "A"), ("i", "B"), ("j", "A")], "name string, type string")
    assert [tuple(r) for r in V.disjoint_overlap(types, df([(["A", "B"],)], "class_names array<string>")).collect()] == [("i", ["A", "B"])]
