"""Checks of document payloads against constraint tables: one row for each issue.

payloads: doc_id, class, payload (a JSON object). classes: name, is_abstract. constraints: class, field, kind (scalar or
reference), bson_type, required, is_array, min_items, max_items. A payload is parsed once, its members meet the rules of
its class in one pass that makes an array of issues, and the issues are exploded. Checks against stored documents are joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.casts import OBJECT_ID, parse_date
from ontoloom.operators.graph import closure

#: Members that every payload may have.
SYSTEM = ["_id", "_ontology_type", "metadata", "_import_diagnostics"]
#: Members that loaded documents have whatever their class; they are checked where the class has rules for them.
IDENTITY = ["name", "iri", "label"]
NO_ISSUES = "array<struct<code:string,field:string,detail:string>>"


def parsed(payload: Column) -> Column:
    """The members of a JSON object; null for anything else."""
    return F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def is_empty(v: Column) -> Column:
    """Null, a blank string, or a list or object of nothing."""
    kind = kind_of(v)
    return v.isNull() | (kind == "VOID") | ((kind == "STRING") & (F.trim(text_of(v)) == "")) | F.coalesce(F.size(items_of(v)) == 0, F.lit(False)) | F.coalesce((F.size(F.try_variant_get(v, "$", "map<string,variant>")) == 0) & kind.startswith("OBJECT"), F.lit(False))


def members(payloads: DataFrame) -> DataFrame:
    """(doc_id, class, field, value, type) of each member of each payload."""
    found = payloads.select("doc_id", "class", F.explode(parsed(F.col("payload"))).alias("field", "value"))
    return found.withColumn("type", kind_of(F.col("value")))


def type_matches(kind, bson, text=None):
    """Whether a JSON value's type fits: whole numbers for int and long, any for double; a date is a string that reads as one, if the text is given."""
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    date = F.lit(False) if text is None else (kind == "STRING") & parse_date(text).isNotNull()
    return (
        F.when(bson.isin("int", "long"), kind == "BIGINT").when(bson.isin("double", "decimal"), number).when(bson == "bool", kind == "BOOLEAN")
        .when(bson.isin("string", "objectId"), kind == "STRING").when(bson == "date", date).when(bson == "object", kind.startswith("OBJECT")).otherwise(F.lit(True))
    )


def issue(code, field=None, detail=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (null if field is None else field).alias("field"), (null if detail is None else detail).alias("detail"))


def _listed(*pairs) -> Column:
    """An array of the issues whose conditions hold; conditions may be null."""
    return F.filter(F.array(*[F.when(c, i) for c, i in pairs]), lambda x: x.isNotNull())


def _bounds(n, rule, field) -> list:
    return [(n < rule["min_items"], issue("cardinality_too_small", field)), (n > rule["max_items"], issue("cardinality_too_large", field))]


def _scalar(e, rule) -> Column:
    v, f = e["value"], e["key"]
    kind = kind_of(v)
    array = kind.startswith("ARRAY")
    item_bad = F.exists(F.coalesce(items_of(v), F.array().cast("array<variant>")), lambda x: ~type_matches(kind_of(x), rule["bson_type"], text_of(x)))
    return _listed(
        (rule["is_array"] & ~array, issue("scalar_array_expected", f)),
        (rule["is_array"] & array & (rule["bson_type"] != "array") & item_bad, issue("scalar_type_mismatch", f)),
        (~rule["is_array"] & ~type_matches(kind, rule["bson_type"], text_of(v)), issue("scalar_type_mismatch", f)),
        *_bounds(F.when(array, F.size(items_of(v))), rule, f),
    )


def _reference(e, rule) -> Column:
    v, f = e["value"], e["key"]
    array = kind_of(v).startswith("ARRAY")
    ids = F.when(array, F.transform(items_of(v), lambda x: F.coalesce(text_of(x).rlike(OBJECT_ID), F.lit(False)))).otherwise(F.array(F.coalesce(text_of(v).rlike(OBJECT_ID), F.lit(False))))
    return _listed(
        (rule["is_array"] & ~array, issue("reference_array_expected", f)),
        (~rule["is_array"] & array, issue("single_reference_expected", f)),
        (F.exists(ids, lambda ok: ~ok), issue("invalid_object_id", f)),
        *_bounds(F.when(array, F.size(items_of(v))), rule, f),
    )


def issue_arrays(payloads: DataFrame, classes: DataFrame, constraints: DataFrame, unions: DataFrame | None = None) -> DataFrame:
    """payloads with members (a map) and issues (an array). unions: class_name of classes that stand for a union."""
    cols = ["field", "kind", "bson_type", "required", "is_array", "min_items", "max_items"]
    rules = constraints.groupBy("class").agg(F.collect_list(F.struct(*cols)).alias("_rules"))
    named = classes.select(F.col("name").alias("class"), "is_abstract").distinct()
    met = payloads.join(named, "class", "left").join(rules, "class", "left")
    union = F.lit(False)
    if unions is not None:
        met = met.join(unions.select(F.col("class_name").alias("class"), F.lit(True).alias("_union")).distinct(), "class", "left")
        union = F.coalesce("_union", F.lit(False))
    met = met.withColumn("members", parsed(F.col("payload"))).withColumn("_rules", F.coalesce("_rules", F.array().cast(met.schema["_rules"].dataType)))
    rule_of = F.map_from_entries(F.transform("_rules", lambda r: F.struct(r["field"], r)))
    plain = F.filter(F.map_entries("members"), lambda e: ~e["key"].isin(SYSTEM) & ~F.endswith(e["key"], F.lit("_unresolved")))

    def of(e):
        rule = F.element_at(F.col("_by"), e["key"])
        checked = F.when(rule["kind"] == "reference", _reference(e, rule)).otherwise(_scalar(e, rule))
        return F.when(rule.isNull() & ~e["key"].isin(IDENTITY), F.array(issue("unknown_field", e["key"]))).when(rule.isNull(), F.array().cast(NO_ISSUES)).when(is_empty(e["value"]), F.array().cast(NO_ISSUES)).otherwise(checked)

    lost = F.transform(F.filter("_rules", lambda r: r["required"] & is_empty(F.element_at(F.col("members"), r["field"]))), lambda r: issue("missing_required_field", r["field"]))
    met = met.withColumn("_by", rule_of)
    found = (
        F.when(F.col("is_abstract").isNull(), F.array(issue("unknown_class")))
        .when(union, F.array(issue("concrete_subtype_required")))
        .when(F.col("is_abstract"), F.array(issue("abstract_class")))
        .when(F.col("members").isNull(), F.array(issue("invalid_payload")))
        .otherwise(F.concat(F.flatten(F.transform(plain, of)), lost))
    )
    return met.select(*payloads.columns, "members", found.alias("issues"))


def validate(payloads: DataFrame, classes: DataFrame, constraints: DataFrame, unions: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, field): all issues of all documents, but those that need stored documents."""
    found = issue_arrays(payloads, classes, constraints, unions)
    return found.select("doc_id", F.explode(F.array_distinct("issues")).alias("i")).select("doc_id", "i.code", "i.field")


def system_issues(payloads: DataFrame) -> DataFrame:
    """(doc_id, code, field): an _id that is none, an _ontology_type other than the class, metadata that is no object."""
    m = payloads.withColumn("_m", parsed(F.col("payload")))
    own, kind, meta = (F.element_at(F.col("_m"), k) for k in ("_id", "_ontology_type", "metadata"))
    bad = _listed(
        (own.isNotNull() & (kind_of(own) != "VOID") & ~F.coalesce(text_of(own).rlike(OBJECT_ID), F.lit(False)), issue("invalid_object_id", F.lit("_id"))),
        (kind.isNotNull() & ~text_of(kind).eqNullSafe(F.col("class")), issue("invalid_ontology_type", F.lit("_ontology_type"))),
        (meta.isNotNull() & ~kind_of(meta).startswith("OBJECT"), issue("invalid_metadata", F.lit("metadata"))),
    )
    return m.select("doc_id", F.explode(bad).alias("i")).select("doc_id", "i.code", "i.field")


def references(found: DataFrame, constraints: DataFrame) -> DataFrame:
    """(doc_id, class, field, target): a row for each reference in the members of payloads. found: of members()."""
    ref = found.join(constraints.where("kind = 'reference'").select("class", "field"), ["class", "field"])
    items = F.when(F.col("type").startswith("ARRAY"), F.transform(items_of(F.col("value")), text_of)).otherwise(F.array(text_of(F.col("value"))))
    return ref.select("doc_id", "class", "field", F.explode(items).alias("target")).where("target is not null").withColumn("target", F.when(F.col("target").rlike(OBJECT_ID), F.lower("target")).otherwise(F.col("target")))


def _issue(df: DataFrame, code: str) -> DataFrame:
    return df.select("doc_id", F.lit(code).alias("code"), F.col("field"))


def missing_targets(ids: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Issues of references found in no or in several target collections. targets: class, field, collection; documents: collection, _id."""
    found = ids.join(targets, ["class", "field"]).join(documents.select("collection", F.col("_id").alias("target"), F.lit(1).alias("_hit")), ["collection", "target"], "left")
    hits = found.groupBy("doc_id", "field", "target").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("n"))
    return _issue(hits.where("n = 0"), "missing_reference_target").unionByName(_issue(hits.where("n > 1"), "ambiguous_reference_target"))


def unresolved_targets(ids: DataFrame, targets: DataFrame) -> DataFrame:
    """Issues of reference fields for which no target collection is known."""
    return _issue(ids.select("doc_id", "class", "field").distinct().join(targets.select("class", "field").distinct(), ["class", "field"], "left_anti"), "unresolved_target_collection")


def incompatible_targets(ids: DataFrame, allowed: DataFrame, documents: DataFrame, edges: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Issues of references to documents whose type is no allowed class nor below one. allowed: class, field, type; documents: _id, _ontology_type; above: the closure of edges, if it is at hand."""
    below = (closure(edges) if above is None else above).select(F.col("child").alias("_actual"), F.col("parent").alias("type"))
    fine = allowed.select("class", "field", F.col("type").alias("_actual")).unionByName(allowed.join(below, "type").select("class", "field", "_actual")).distinct()
    met = ids.join(allowed.select("class", "field").distinct(), ["class", "field"], "left_semi").join(documents.select(F.col("_id").alias("target"), F.col("_ontology_type").alias("_actual")), "target")
    return _issue(met.join(fine, ["class", "field", "_actual"], "left_anti"), "reference_target_type_mismatch").distinct()


def validate_create(payloads, classes, constraints, targets=None, allowed=None, documents=None, edges=None, unions=None, above=None) -> DataFrame:
    """(doc_id, code, field): everything that speaks against creating the documents. targets: class, field, collection; allowed: class, field, type; documents: collection, _id, _ontology_type. Without documents, no check of stored ones."""
    out = [validate(payloads, classes, constraints, unions), system_issues(payloads)]
    if documents is not None:
        ids = references(members(payloads), constraints)
        missing = missing_targets(ids, targets, documents)
        out += [missing.where("code != 'missing_reference_target'"), missing.where("code = 'missing_reference_target'").withColumn("code", F.lit("reference_target_missing")), unresolved_targets(ids, targets)]
        if allowed is not None:
            out.append(incompatible_targets(ids, allowed, documents, edges, above))
        own = payloads.select("doc_id", F.lower(text_of(F.element_at(parsed(F.col("payload")), "_id"))).alias("_id")).where("_id is not null")
        out.append(own.join(documents.select("_id").distinct(), "_id", "left_semi").select("doc_id", F.lit("duplicate_object_id").alias("code"), F.lit("_id").alias("field")))
    return reduce(DataFrame.unionByName, out)


class Invalid(ValueError):
    """Issues that stand against a change; the first ones are in the message."""


def require_valid(issues: DataFrame, limit: int = 20) -> None:
    """Raises Invalid if there is an issue (warnings don't count)."""
    found = issues.where(~F.col("code").isin("ambiguous_reference_target")).limit(limit).collect()
    if found:
        raise Invalid("; ".join(f"{r['doc_id']}: {r['code']}" + (f" ({r['field']})" if r["field"] else "") for r in found))


def as_json(issues: DataFrame) -> DataFrame:
    """(doc_id, issues): each document's issues as one JSON array, by code and field."""
    rest = [c for c in issues.columns if c != "doc_id"]
    return issues.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("issues"))


def disjoint_overlap(types: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, overlap): individuals asserted in two or more classes of a disjoint group. types: name, type; groups: class_names."""
    per = types.groupBy("name").agg(F.collect_set("type").alias("types"))
    pairs = types.join(groups.select("class_names", F.explode("class_names").alias("type")), "type").select("name", "class_names").distinct()
    return pairs.join(per, "name").select("name", F.array_sort(F.array_intersect("types", "class_names")).alias("overlap")).where(F.size("overlap") > 1).distinct()
