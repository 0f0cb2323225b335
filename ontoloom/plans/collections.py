"""Ontology catalogue to collection schemas: names, fields, references, requirements, validators.

Catalogue tables are as ontoloom.sources.owl gives them. Everything is joined set-wise over all classes at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.names import collection_name, snake_case
from ontoloom.operators.graph import closure, resolve_targets

#: Fields that every collection has, and those that vocabularies have beside them: name, type, required.
METADATA = [("metadata.createdAt", "date", False), ("metadata.createdBy", "string", False), ("metadata.updatedAt", "date", False), ("metadata.notes", "string", False)]
VOCABULARY = [("name", "string", True), ("iri", "string", False), ("label", "string", False)]
THING = ["Thing", "owl:Thing"]


def bson_type(iri):
    """By the first of objectid, int, float/double/decimal, bool, date/time that the range's IRI holds; else string."""
    low = F.lower(iri)
    return F.when(low.contains("objectid"), "objectId").when(low.contains("int"), "int").when(low.rlike("float|double|decimal"), "double").when(low.contains("bool"), "bool").when(low.rlike("date|time"), "date").otherwise("string")


def is_abstract(annotations: DataFrame) -> DataFrame:
    """(name) of classes that an annotation conceptType calls abstract, in any case."""
    return annotations.where((F.col("property") == "conceptType") & (F.lower(F.trim("value")) == "abstract")).select(F.col("subject").alias("name")).distinct()


def collections(classes: DataFrame, individuals: DataFrame) -> DataFrame:
    """(class, collection, kind): abstract classes have none; classes with individuals are vocabularies. classes: name, is_abstract."""
    used = individuals.select(F.col("type").alias("name")).distinct().withColumn("_used", F.lit(True))
    kind = F.when(F.col("_used"), "vocabulary_collection").otherwise("collection")
    return classes.where("not is_abstract").join(used, "name", "left").select(F.col("name").alias("class"), collection_name(F.col("name")).alias("collection"), kind.alias("kind"))


def _inherited(concrete: DataFrame, edges: DataFrame, facts: DataFrame, on: str, above: DataFrame) -> DataFrame:
    """facts about classes, copied to each concrete class below; depth is 0 for the class itself. What is said of owl:Thing holds for all. above: the closure of edges."""
    up = concrete.select("class", F.col("class").alias("_c"), F.lit(0).alias("depth"))
    up = up.unionByName(above.where("child != parent").select(F.col("child").alias("class"), F.col("parent").alias("_c"), "depth").join(concrete.select("class"), "class", "left_semi"))
    # A class of one's own may be called Thing too; then it has children. Facts about owl:Thing times classes: both are short catalogue tables.
    every = facts.where(F.col(on).isin(THING)).join(edges.select(F.col("parent").alias(on)), on, "left_anti").crossJoin(concrete.select("class")).withColumn("depth", F.lit(1 << 20))
    return up.join(facts, F.col("_c") == F.col(on)).drop("_c").unionByName(every.select("class", "depth", *facts.columns))


def fields(found: DataFrame, edges: DataFrame, domains: DataFrame, ranges: DataFrame, restrictions: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(class, property, field, bson_type, required): data properties of a class and its ancestors; the first by property and domain wins. above: the closure of edges, if it is at hand (in all functions here)."""
    above = closure(edges) if above is None else above
    first_range = ranges.groupBy("property").agg(F.min("value").alias("range"))
    own = _inherited(found, edges, domains.select("property", F.col("value").alias("domain")), "domain", above).join(first_range, "property", "left")
    need = _inherited(found, edges, restrictions.where("restriction_type = 'DataSomeValuesFrom' and not inverse").select(F.col("subject_class"), F.col("property_name").alias("property")), "subject_class", above).select("class", "property", F.lit(True).alias("_need")).distinct()
    one = own.withColumn("field", snake_case(F.col("property"))).withColumn("_n", F.row_number().over(Window.partitionBy("class", "field").orderBy("property", "domain"))).where("_n = 1")
    return one.join(need, ["class", "property"], "left").select("class", "property", "field", bson_type(F.coalesce("range", F.lit(""))).alias("bson_type"), F.coalesce("_need", F.lit(False)).alias("required"))


def standard_fields(found: DataFrame) -> DataFrame:
    """(class, property, field, bson_type, required): metadata of all collections; name, IRI and label of vocabularies."""
    spark = found.sparkSession
    rows = spark.createDataFrame([(None, *x) for x in METADATA] + [("vocabulary_collection", *x) for x in VOCABULARY], "_kind string, field string, bson_type string, required boolean")
    return found.join(F.broadcast(rows), F.col("_kind").isNull() | (F.col("_kind") == F.col("kind"))).select("class", F.lit(None).cast("string").alias("property"), "field", "bson_type", "required")


def all_fields(found: DataFrame, scalar: DataFrame) -> DataFrame:
    """Data properties with the standard fields; where both have a field, the data property comes last and wins."""
    return scalar.unionByName(standard_fields(found).join(scalar.select("class", "field"), ["class", "field"], "left_anti"))


def bound_rules(restrictions: DataFrame) -> DataFrame:
    """(subject_class, property, inverse, lo, hi, filler): what each restriction says of a property's number of values."""
    t, n = F.col("restriction_type"), F.col("cardinality")
    low = F.when(t.rlike("Min|Exact"), n).when(t.contains("Some"), 1)
    return restrictions.select("subject_class", F.col("property_name").alias("property"), "inverse", low.alias("lo"), F.when(t.rlike("Max|Exact"), n).alias("hi"), "filler")


def merge_bounds(rules: DataFrame) -> DataFrame:
    """(class, property, min_items, max_items, required, fillers): the largest minimum and the least maximum; required where a minimum is 1 or more. rules: class, property, lo, hi, filler."""
    return rules.groupBy("class", "property").agg(F.max("lo").alias("min_items"), F.min("hi").alias("max_items"), F.max(F.coalesce(F.col("lo") >= 1, F.lit(False))).alias("required"), F.array_sort(F.collect_set("filler")).alias("fillers"))


def conflicts(bounds: DataFrame) -> DataFrame:
    """Bounds that no number of values meets."""
    return bounds.where("min_items > max_items")


def later_cardinalities(axioms: DataFrame) -> DataFrame:
    """(domain, property, inverse, min_items, max_items): of several axioms, a later one overwrites its side; exact sets both. axioms: domain, property, kind, n, inverse, ordinal."""
    low, high = F.when(F.col("kind").isin("min", "exact"), F.col("n")), F.when(F.col("kind").isin("max", "exact"), F.col("n"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("ordinal")))
    return axioms.groupBy("domain", "property", "inverse").agg(last(low).alias("min_items"), last(high).alias("max_items"))


def references(found: DataFrame, edges: DataFrame, domains: DataFrame, ranges: DataFrame, restrictions: DataFrame, functional: DataFrame, policies: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """(class, property, field, is_array, min_items, max_items, targets, on_delete).

    Bounds are merged over the class and its ancestors; a reference is single when its maximum is 1 or the property
    functional. Targets are the fillers of the restrictions, else the ranges. Policy: the one that policies (property,
    policy) state, else restrict where required, pull for arrays and unset for the rest.
    """
    above = closure(edges) if above is None else above
    own = _inherited(found, edges, domains.select("property", F.col("value").alias("domain")), "domain", above).select("class", "property").distinct()
    bounds = merge_bounds(_inherited(found, edges, bound_rules(restrictions).where("not inverse"), "subject_class", above).select("class", "property", "lo", "hi", "filler"))
    said = ranges.groupBy("property").agg(F.array_sort(F.collect_set("value")).alias("_ranges"))
    joined = own.join(bounds, ["class", "property"], "left").join(said, "property", "left").join(functional.select("property", F.lit(True).alias("_f")).distinct(), "property", "left")
    if policies is None:
        joined = joined.withColumn("policy", F.lit(None).cast("string"))
    else:
        joined = joined.join(policies.select("property", "policy"), "property", "left")
    array = ~(F.coalesce(F.col("max_items") == 1, F.lit(False)) | F.coalesce("_f", F.lit(False)))
    snake = snake_case(F.col("property"))
    targets = F.when(F.size(F.coalesce("fillers", F.array().cast("array<string>"))) > 0, F.col("fillers")).otherwise(F.col("_ranges"))
    return joined.select(
        "class", "property", F.concat(snake, F.when(array, "_ids").otherwise("_id")).alias("field"), array.alias("is_array"), "min_items", "max_items", targets.alias("targets"),
        F.coalesce("policy", F.when(F.col("min_items") > 0, "restrict").when(array, "pull").otherwise("unset")).alias("on_delete"),
    )


def explicit_policies(annotations: DataFrame) -> DataFrame:
    """(property, policy) that annotations onDelete, deletePolicy or delete_policy state."""
    names = ["onDelete", "deletePolicy", "delete_policy"]
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("property"))
    return annotations.where(F.col("property").isin(names)).groupBy(F.col("subject").alias("property")).agg(F.min_by(F.lower(F.trim("value")), rank).alias("policy"))


def reverse_references(found: DataFrame, edges: DataFrame, domains: DataFrame, restrictions: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Like references(): what restrictions over the inverse of a property add to a class and its concrete descendants. They point to the property's domains."""
    bounds = merge_bounds(_inherited(found, edges, bound_rules(restrictions).where("inverse"), "subject_class", closure(edges) if above is None else above).select("class", "property", "lo", "hi", "filler"))
    said = domains.groupBy("property").agg(F.array_sort(F.collect_set("value")).alias("targets"))
    array = ~F.coalesce(F.col("max_items") == 1, F.lit(False))
    return bounds.join(said, "property").select(
        "class", "property", F.concat(snake_case(F.col("property")), F.when(array, "_ids").otherwise("_id")).alias("field"), array.alias("is_array"), "min_items", "max_items", "targets",
        F.when(F.col("min_items") > 0, "restrict").when(array, "pull").otherwise("unset").alias("on_delete"),
    )


def all_references(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Both kinds; a reverse one takes the place of a forward one of its name."""
    return forward.join(reverse.select("class", "field"), ["class", "field"], "left_anti").select(forward.columns).unionByName(reverse)


def target_collections(refs: DataFrame, found: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, field, position, target, collection): the concrete classes that each reference may point to and their collections, in order; the first is the primary one."""
    known = resolve_targets(refs.select("class", "field", F.col("targets").alias("ranges"), F.array().cast("array<string>").alias("fillers")), classes, edges)
    items = known.select("class", "field", F.posexplode("targets").alias("position", "target"))
    return items.join(found.select(F.col("class").alias("target"), "collection"), "target").select("class", "field", "position", "target", "collection")


def constraints(scalar: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows for ontoloom.operators.validation. Dotted metadata fields are nested, so the payload's own checks see to them."""
    null = F.lit(None).cast("int")
    plain = scalar.where("not contains(field, '.')").select("class", "field", F.lit("scalar").alias("kind"), "bson_type", "required", F.lit(False).alias("is_array"), null.alias("min_items"), null.alias("max_items"))
    linked = refs.select("class", "field", F.lit("reference").alias("kind"), F.when(F.col("is_array"), "array").otherwise("objectId").alias("bson_type"), (F.coalesce("min_items", F.lit(0)) > 0).alias("required"), "is_array", F.when(F.col("is_array"), F.col("min_items")).cast("int").alias("min_items"), F.when(F.col("is_array"), F.col("max_items")).cast("int").alias("max_items"))
    return plain.unionByName(linked)


def seeds(found: DataFrame, individuals: DataFrame, annotations: DataFrame) -> DataFrame:
    """(collection, name, iri, label) of a vocabulary's individuals; the label is the first comment, else the name. individuals: name, type."""
    said = annotations.where("property in ('comment', 'rdfs:comment')").groupBy(F.col("subject").alias("name")).agg(F.min("value").alias("_comment"))
    met = individuals.join(found.where("kind = 'vocabulary_collection'").select(F.col("class").alias("type"), "collection"), "type").join(said, "name", "left")
    return met.select("collection", "name", F.concat(F.lit("#"), "name").alias("iri"), F.coalesce("_comment", "name").alias("label"))


def disjoint_constraints(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(class, collection, class_names): the disjoint groups that a collection's class belongs to."""
    return found.join(groups.select("class_names", F.explode("class_names").alias("class")), "class").select("class", "collection", "class_names").distinct()


def service_rules(found: DataFrame, edges: DataFrame, classes: DataFrame, refs: DataFrame, restrictions: DataFrame) -> DataFrame:
    """(class, rule): what schemas can't state. Only-restrictions, forward or inverse; bounds over inverses; references whose target is abstract."""
    near = _inherited(found, edges, restrictions.select("subject_class", F.col("property_name").alias("property"), "restriction_type", "inverse", "filler", "cardinality"), "subject_class", closure(edges))
    side = F.when(F.col("inverse"), F.concat(F.lit("inverse of "), "property")).otherwise(F.col("property"))
    only = near.where("restriction_type like '%AllValuesFrom'").select("class", F.format_string("%s only %s", side, "filler").alias("rule"))
    count = near.where("inverse and cardinality is not null").select("class", F.format_string("%s %s %d", side, F.lower(F.regexp_extract("restriction_type", "(Min|Max|Exact)", 1)), "cardinality").alias("rule"))
    abstract = refs.select("class", "field", F.explode("targets").alias("name")).join(classes.where("is_abstract").select("name"), "name").select("class", F.format_string("%s: choose a concrete class of %s", "field", "name").alias("rule"))
    return only.unionByName(count).unionByName(abstract).distinct()


def validators(found: DataFrame, scalar: DataFrame, refs: DataFrame, additional: bool = True) -> DataFrame:
    """(collection, validator): one JSON schema for each collection. Fields with a dot are nested in objects, which are required where one of theirs is."""
    plain = scalar.select("class", "field", F.struct(F.col("bson_type").alias("bsonType"), F.lit(None).cast("int").alias("minItems"), F.lit(None).cast("int").alias("maxItems")).alias("s"), "required")
    linked = refs.select("class", "field", F.struct(F.when(F.col("is_array"), "array").otherwise("objectId").alias("bsonType"), F.when(F.col("is_array"), F.col("min_items")).cast("int").alias("minItems"), F.when(F.col("is_array"), F.col("max_items")).cast("int").alias("maxItems")).alias("s"), (F.coalesce("min_items", F.lit(0)) > 0).alias("required"))
    every = plain.unionByName(linked)
    names = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("required"), c))))
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "s"))))
    inner = every.where("contains(field, '.')").select("class", F.substring_index("field", ".", 1).alias("head"), F.substring_index("field", ".", -1).alias("field"), "s", "required")
    nested = inner.groupBy("class", "head").agg(entry.alias("properties"), names(F.col("field")).alias("inner_required"), F.max("required").alias("required"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))  # noqa: E731  an empty list is left out
    nested = nested.select("class", F.col("head").alias("field"), F.to_json(F.struct(F.lit("object").alias("bsonType"), "properties", some("inner_required").alias("required"))).alias("s"), "required")
    flat = every.where("not contains(field, '.')").select("class", "field", F.to_json("s").alias("s"), "required").unionByName(nested)
    per = flat.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("field", F.concat(F.lit('"'), "field", F.lit('":'), "s").alias("j")))).alias("_p"), names(F.col("field")).alias("_r"))
    body = F.array_join(F.transform(F.coalesce("_p", F.array().cast("array<struct<field:string,j:string>>")), lambda x: x["j"]), ",")
    need = F.when(F.size("_r") > 0, F.concat(F.lit(',"required":'), F.to_json("_r"))).otherwise(F.lit(""))
    schema = F.concat(F.lit('{"$jsonSchema":{"bsonType":"object","properties":{'), body, F.lit("}"), F.coalesce(need, F.lit("")), F.lit(f',"additionalProperties":{str(additional).lower()}}}}}'))
    return found.join(per, "class", "left").select("collection", schema.alias("validator"))


def field_specs(schemas: DataFrame) -> DataFrame:
    """(collection, field, bson_type, item_type, is_array, is_reference, required, min_items, max_items) of JSON schemas. schemas: collection, validator. Members of metadata come as metadata.<name>."""
    shape = "struct<`$jsonSchema`: struct<required: array<string>, properties: map<string, struct<bsonType: string, minItems: int, maxItems: int, required: array<string>, items: struct<bsonType: string>, properties: map<string, struct<bsonType: string>>>>>>"
    top = schemas.select("collection", F.from_json("validator", shape)["$jsonSchema"].alias("s"))
    rows = top.select("collection", F.col("s.required").alias("need"), F.explode("s.properties").alias("field", "p"))
    inner = rows.where("p.bsonType = 'object'").select("collection", F.col("field").alias("head"), F.col("p.required").alias("need"), F.explode("p.properties").alias("name", "q"))
    null = F.lit(None).cast("int")
    flat = rows.where("p.bsonType != 'object'").select("collection", "field", F.col("p.bsonType").alias("bson_type"), F.col("p.items.bsonType").alias("item_type"), F.coalesce(F.array_contains("need", F.col("field")), F.lit(False)).alias("required"), F.col("p.minItems").alias("min_items"), F.col("p.maxItems").alias("max_items"))
    deep = inner.select("collection", F.concat_ws(".", "head", "name").alias("field"), F.col("q.bsonType").alias("bson_type"), F.lit(None).cast("string").alias("item_type"), F.coalesce(F.array_contains("need", F.col("name")), F.lit(False)).alias("required"), null.alias("min_items"), null.alias("max_items"))
    array = F.col("bson_type") == "array"
    ref = (F.col("bson_type") == "objectId") | (array & (F.coalesce("item_type", F.lit("objectId")) == "objectId") & F.endswith("field", F.lit("_ids")))
    return flat.unionByName(deep).select("collection", "field", "bson_type", "item_type", array.alias("is_array"), ref.alias("is_reference"), "required", "min_items", "max_items")
