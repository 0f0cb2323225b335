"""Creation requests that may name a union or an abstract class and choose a subtype, and their layered checks.

requests: doc_id, class, subtype (null: none chosen), payload. classes: name, is_abstract. unions: class_name, operands.
found: class, collection, kind. Every check is a join or an expression over all requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.casts import OBJECT_ID
from ontoloom.operators.graph import closure
from ontoloom.operators.validation import items_of, kind_of, members, parsed, text_of, type_matches

LAYERS = ("class", "data", "object")
#: What the layers call the same findings.
CODES = {
    "class": {"abstract": "abstract_class", "no_collection": "class_not_materialized", "not_below": "subtype_not_descendant", "chosen": "subtype_selected"},
    "data": {"abstract": "abstract_class", "no_collection": "class_not_materialized", "not_below": "subtype_not_descendant", "chosen": "subtype_selected"},
    "object": {"abstract": "abstract_class_not_instantiable", "no_collection": "no_collection_for_class", "not_below": "invalid_subtype", "chosen": "requested_subtype_selected"},
}


def route(requests: DataFrame, classes: DataFrame, edges: DataFrame, unions: DataFrame, found: DataFrame, layer: str = "class", allow_vocabulary: bool = False, above: DataFrame | None = None) -> DataFrame:
    """requests with final_class, collection, level and code: the class that a request comes down to, or why it doesn't.

    A union needs a subtype among its members, any other class one below it; abstract classes and such without a collection
    can't be created, and the class layer refuses vocabularies.
    """
    names = CODES[layer]
    one = lambda c, prefix: classes.select(F.col("name").alias(c), F.col("is_abstract").alias(f"_{prefix}abstract")).distinct()
    members_of = unions.groupBy("class_name").agg(F.max_by("operands", F.size("operands")).alias("_members")).withColumnRenamed("class_name", "class")
    below = (closure(edges) if above is None else above).select(F.col("parent").alias("class"), F.col("child").alias("subtype")).distinct().withColumn("_below", F.lit(True))
    met = requests.join(one("class", "c"), "class", "left").join(members_of, "class", "left").join(one("subtype", "s"), "subtype", "left").join(below, ["class", "subtype"], "left")
    union, asked = F.size(F.coalesce("_members", F.array().cast("array<string>"))) > 0, F.col("subtype").isNotNull() & (F.col("subtype") != F.col("class"))
    error = (
        F.when(F.col("_cabstract").isNull(), "unknown_class").when(union & ~asked, "concrete_subtype_required")
        .when(asked & F.col("_sabstract").isNull(), "unknown_subtype").when(union & asked & ~F.array_contains("_members", F.col("subtype")), "invalid_union_subtype")
        .when(asked & ~union & F.col("_below").isNull(), names["not_below"]).when(asked & F.col("_sabstract"), "abstract_subtype" if layer != "object" else names["abstract"])
        .when(~asked & F.col("_cabstract"), names["abstract"])
    )
    final = F.when(error.isNull(), F.when(asked, F.col("subtype")).otherwise(F.col("class")))
    out = met.withColumns({"_error": error, "final_class": final}).join(found.select(F.col("class").alias("final_class"), "collection", "kind"), "final_class", "left")
    late = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("collection").isNull(), names["no_collection"])
    if layer == "class" and not allow_vocabulary:
        late = late.when(F.col("kind") == "vocabulary_collection", "vocabulary_create_blocked")
    info = F.when(asked & union, "parent_routed_to_subtype").when(asked, names["chosen"])
    return out.withColumn("_late", late).select(*requests.columns, "final_class", "collection", F.when(F.col("_late").isNotNull(), "error").when(info.isNotNull(), "info").alias("level"), F.coalesce("_late", info).alias("code"))


def _rows(df: DataFrame, level: str, code: str, field: str | None = "field") -> DataFrame:
    return df.select("doc_id", F.lit(level).alias("level"), F.lit(code).alias("code"), (F.col(field) if field else F.lit(None).cast("string")).alias("field"))


def data_issues(routed: DataFrame, constraints: DataFrame, strict: bool = True, with_metadata: bool = True) -> DataFrame:
    """(doc_id, level, code, field) of scalar fields. A required field that is there counts as given, even as null. constraints: as for validation."""
    rows = routed.where("coalesce(level, '') != 'error'").select("doc_id", F.col("final_class").alias("class"), "payload")
    skip = ["_id", "_ontology_type"] + ([] if with_metadata else ["metadata"])
    own = members(rows).where(~F.col("field").isin([*skip, "metadata"]))
    ruled = own.join(constraints, ["class", "field"], "left")
    level = "error" if strict else "warning"
    out = [_rows(ruled.where("kind is null"), level, "unknown_scalar_fields")]
    scalar = ruled.where("kind = 'scalar'").withColumn("_a", F.col("type").startswith("ARRAY"))
    items = F.exists(F.coalesce(items_of(F.col("value")), F.array().cast("array<variant>")), lambda x: ~type_matches(kind_of(x), F.col("bson_type"), text_of(x)))
    out.append(_rows(scalar.where("is_array and not _a"), "error", "data_array_expected"))
    out.append(_rows(scalar.where(F.col("is_array") & F.col("_a") & items), "error", "invalid_data_item_type"))
    out.append(_rows(scalar.where("not is_array and _a"), "error", "data_scalar_expected"))
    out.append(_rows(scalar.where(~F.col("is_array") & ~F.col("_a") & ((F.col("type") == "VOID") | ~type_matches(F.col("type"), F.col("bson_type"), text_of(F.col("value"))))), "error", "invalid_data_type"))
    need = rows.select("doc_id", "class").join(constraints.where("required and kind = 'scalar'").select("class", "field"), "class")
    out.append(_rows(need.join(own.select("doc_id", "field"), ["doc_id", "field"], "left_anti"), "error", "required_data_field_missing"))
    return reduce(DataFrame.unionByName, out)


def object_issues(routed: DataFrame, constraints: DataFrame, targets: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, level, code, field) of reference fields. targets: class, field, collection; documents: collection, _id; without documents, existence isn't asked and db_not_bound warns."""
    rows = routed.where("coalesce(level, '') != 'error'").select("doc_id", F.col("final_class").alias("class"), "payload")
    own = members(rows).where(~F.col("field").isin("_id", "_ontology_type", "metadata"))
    ruled = own.join(constraints, ["class", "field"], "left").withColumn("_a", F.col("type").startswith("ARRAY")).withColumn("_n", F.size(items_of(F.col("value"))))
    like = F.col("field").rlike("(_id|_ids)$|^has_")
    ref = ruled.where("kind = 'reference'")
    bad = lambda x: ~F.coalesce(text_of(x).rlike(OBJECT_ID), F.lit(False))
    out = [
        _rows(ruled.where("kind = 'scalar'"), "info", "scalar_field_ignored_by_object_validator"), _rows(ruled.where(F.col("kind").isNull() & like), "error", "unknown_reference_field"),
        _rows(ref.where("is_array and not _a"), "error", "reference_array_expected"), _rows(ref.where("not is_array and _a"), "error", "single_reference_received_array"),
        _rows(ref.where(F.col("is_array") & F.col("_a") & F.exists(F.coalesce(items_of(F.col("value")), F.array().cast("array<variant>")), bad)), "error", "invalid_reference_array"),
        _rows(ref.where(~F.col("is_array") & ~F.col("_a") & bad(F.col("value"))), "error", "invalid_reference_id"),
        _rows(ref.where("_a and _n < min_items"), "error", "reference_min_items_violation"), _rows(ref.where("_a and _n > max_items"), "error", "reference_max_items_violation"),
    ]
    need = rows.select("doc_id", "class").join(constraints.where("required and kind = 'reference'").select("class", "field"), "class")
    out.append(_rows(need.join(own.select("doc_id", "field"), ["doc_id", "field"], "left_anti"), "error", "missing_required_reference"))
    if documents is None:
        out.append(_rows(rows, "warning", "db_not_bound", None))
    else:
        ids = ref.select("doc_id", "class", "field", F.explode(F.when(F.col("_a"), F.transform(items_of(F.col("value")), text_of)).otherwise(F.array(text_of(F.col("value"))))).alias("target"))
        ids = ids.withColumn("target", F.lower("target")).where("target is not null")
        hits = ids.join(targets, ["class", "field"]).join(documents.select("collection", F.col("_id").alias("target"), F.lit(1).alias("_hit")), ["collection", "target"], "left").groupBy("doc_id", "field", "target").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("n"))
        out += [_rows(hits.where("n = 0").select("doc_id", "field").distinct(), "error", "missing_reference_targets"), _rows(hits.where("n > 1").select("doc_id", "field").distinct(), "warning", "ambiguous_reference_target")]
        out.append(_rows(ids.select("doc_id", "class", "field").distinct().join(targets.select("class", "field").distinct(), ["class", "field"], "left_anti"), "warning", "target_collection_unresolved"))
        there = documents.select("collection").distinct()
        out.append(_rows(ids.select("doc_id", "class", "field").distinct().join(targets, ["class", "field"]).join(there, "collection", "left_anti").select("doc_id", "field").distinct(), "warning", "target_collection_missing"))
    return reduce(DataFrame.unionByName, out)


def overlap_warnings(routed: DataFrame, edges: DataFrame, groups: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Warnings where a final class and its ancestors hold two classes of a disjoint group."""
    own = routed.where("final_class is not null").select("doc_id", F.col("final_class").alias("type"))
    up = own.unionByName(own.join((closure(edges) if above is None else above).select(F.col("child").alias("type"), "parent"), "type").select("doc_id", F.col("parent").alias("type"))).distinct()
    hits = up.join(groups.select(F.xxhash64("class_names").alias("_g"), F.explode("class_names").alias("type")), "type").groupBy("doc_id", "_g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(hits.select("doc_id").distinct(), "warning", "possible_disjoint_type_overlap", None)


def deployment_issues(routed: DataFrame, deployed: DataFrame) -> DataFrame:
    """Errors where a final class's collection isn't there. deployed: collection."""
    return _rows(routed.where("collection is not null").join(deployed.select("collection").distinct(), "collection", "left_anti"), "error", "collection_not_deployed", None)


def identity_warnings(routed: DataFrame, documents: DataFrame) -> DataFrame:
    """Warnings where a payload's _id already stands in another collection. documents: collection, _id."""
    own = routed.select("doc_id", "collection", F.lower(text_of(F.element_at(parsed(F.col("payload")), "_id"))).alias("_id")).where("_id is not null")
    other = documents.select(F.col("collection").alias("_c"), "_id")
    return _rows(own.join(other, "_id").where("_c != collection").select("doc_id").distinct().withColumn("field", F.lit("_id")), "warning", "individual_id_seen_in_other_collection")


def check_creation(requests, classes, edges, unions, found, constraints, groups, targets=None, documents=None, strict: bool = True, above: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(routed, issues): all layers over all requests. issues: source, doc_id, level, code, field; a layer that ends in another class or collection than the class layer is an error of its own."""
    above = closure(edges) if above is None else above
    routed = {layer: route(requests, classes, edges, unions, found, layer, above=above) for layer in LAYERS}
    parts = [("class", routed["class"].where("code is not null").select("doc_id", "level", "code", F.lit(None).cast("string").alias("field"))), ("class", overlap_warnings(routed["class"], edges, groups, above))]
    parts += [("data", data_issues(routed["data"], constraints, strict)), ("object", object_issues(routed["object"], constraints, targets, documents))]
    if documents is not None:
        parts += [("instance", deployment_issues(routed["class"], documents.select("collection"))), ("instance", identity_warnings(routed["class"], documents))]
    both = routed["class"].where("level is null or level != 'error'").select("doc_id", "final_class", "collection")
    for layer in ("data", "object"):
        other = routed[layer].select("doc_id", F.col("final_class").alias("_f"), F.col("collection").alias("_c"))
        met = both.join(other, "doc_id")
        parts += [("instance", _rows(met.where(~F.col("final_class").eqNullSafe(F.col("_f"))), "error", "final_class_mismatch", None)), ("instance", _rows(met.where(~F.col("collection").eqNullSafe(F.col("_c"))), "error", "collection_name_mismatch", None))]
    issues = reduce(DataFrame.unionByName, [df.select(F.lit(source).alias("source"), "doc_id", "level", "code", "field") for source, df in parts])
    return routed["class"], issues
