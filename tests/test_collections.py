import json

from ontoloom.plans import collections as C


def test_schema(spark):
    df = spark.createDataFrame
    classes = df([("Thing", True), ("Person", False), ("Sex", False)], "name string, is_abstract boolean")
    edges = df([("Person", "Thing")], "child string, parent string")
    found = C.collections(classes, df([("male", "Sex")], "name string, type string"))
    assert sorted(map(tuple, found.collect())) == [("Person", "persons", "collection"), ("Sex", "sexes", "vocabulary_collection")]
    rest = df([("Thing", "DataSomeValuesFrom", "age", False, None, None), ("Person", "ObjectMaxCardinality", "hasSex", False, "Sex", 1), ("Thing", "ObjectMinCardinality", "knows", False, "Person", 2)], "subject_class string, restriction_type string, property_name string, inverse boolean, filler string, cardinality int")
    dom = lambda *x: df(list(x), "property string, value string")
    scalar = C.fields(found, edges, dom(("age", "Thing")), dom(("age", "integer")), rest)
    assert list(map(tuple, scalar.collect())) == [("Person", "age", "age", "int", True)]
    refs = C.references(found, edges, dom(("hasSex", "Person"), ("knows", "Thing")), dom(("hasSex", "Sex"), ("knows", "Person")), rest, df([], "property string"))
    got = sorted((r["field"], r["is_array"], r["min_items"], r["on_delete"]) for r in refs.collect())
    assert got == [("has_sex_id", False, None, "unset"), ("knows_ids", True, 2, "restrict")]
    v = {r["collection"]: json.loads(r["validator"])["$jsonSchema"] for r in C.validators(found, scalar, refs).collect()}
    assert v["persons"]["required"] == ["age", "knows_ids"] and v["persons"]["properties"]["knows_ids"] == {"bsonType": "array", "minItems": 2}
