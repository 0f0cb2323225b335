"""Creation and update of JSON documents: defaults, merges and the checks of a patch, all set-wise.

requests: doc_id, class, payload; or for updates: request (any id), collection, class (null: none given), _id, patch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.casts import OBJECT_ID
from ontoloom.operators.graph import closure
from ontoloom.operators.validation import kind_of, parsed, text_of, validate

IMMUTABLE = ["_id", "_ontology_type"]


def to_payload(members: Column) -> Column:
    return F.to_json(F.to_variant_object(members))


def overlay(low: Column, high: Column) -> Column:
    """Two maps as one; what high holds wins, nulls too."""
    low, high = (F.coalesce(m, F.create_map().cast("map<string,variant>")) for m in (low, high))
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def _string(text: Column) -> Column:
    """A string as a variant."""
    return F.variant_get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant")


def object_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _inner(members: Column, key: str) -> Column:
    return F.element_at(members, key)


def _with(members: Column, **texts: Column) -> Column:
    return overlay(members, F.create_map(*[x for k, t in texts.items() for x in (F.lit(k), _string(t))]))


def normalise_create(requests: DataFrame, now: str) -> DataFrame:
    """requests with the payload to store: the type is the class, and metadata has createdAt and updatedAt, the given ones or now."""
    m = parsed(F.col("payload"))
    meta = object_of(_inner(m, "metadata"))
    stamped = overlay(_with(F.create_map().cast("map<string,variant>"), createdAt=F.lit(now), updatedAt=F.lit(now)), meta)
    whole = overlay(_with(m, _ontology_type=F.col("class")), F.create_map(F.lit("metadata"), F.to_variant_object(stamped)))
    return requests.withColumn("payload", F.when(m.isNotNull(), to_payload(whole)))


def merge_update(old: Column, patch: Column) -> Column:
    """The patch's members over the old ones; of metadata, those of one level below."""
    o, p = parsed(old), parsed(patch)
    mo, mp = object_of(_inner(o, "metadata")), object_of(_inner(p, "metadata"))
    both = overlay(o, p)
    return to_payload(F.when(mo.isNotNull() & mp.isNotNull(), overlay(both, F.create_map(F.lit("metadata"), F.to_variant_object(overlay(mo, mp))))).otherwise(both))


def normalise_update(old: Column, merged: Column, now: str) -> Column:
    """merged with the old _id, type and createdAt, and updatedAt as now."""
    o, m = parsed(old), parsed(merged)
    kept = F.map_filter(o, lambda k, _: k.isin(IMMUTABLE))
    mo = F.coalesce(object_of(_inner(o, "metadata")), F.create_map().cast("map<string,variant>"))
    meta = overlay(object_of(_inner(m, "metadata")), F.map_filter(mo, lambda k, _: k == "createdAt"))
    return to_payload(overlay(overlay(m, kept), F.create_map(F.lit("metadata"), F.to_variant_object(_with(meta, updatedAt=F.lit(now))))))


def effective_class(given: Column, stored: Column, first: Column) -> Column:
    """The class asked for, else that of the document, else the first class of the collection."""
    return F.coalesce(given, stored, first)


def update_issues(requests: DataFrame, stored: DataFrame, collections: DataFrame, edges: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(request, code, field): what speaks against the updates before documents are merged. stored: collection, _id, payload; collections: collection, class; above: the closure of edges, if it is at hand."""
    first = collections.groupBy("collection").agg(F.min("class").alias("_first"))
    up = (closure(edges) if above is None else above).select("child", "parent").distinct()
    rows = requests.join(first, "collection", "left")
    rows = rows.join(stored.select(F.col("collection").alias("_sc"), F.col("_id").alias("_sid"), F.col("payload").alias("_old")), (F.col("collection") == F.col("_sc")) & (F.lower("_id") == F.col("_sid")), "left")
    old, new = parsed(F.col("_old")), parsed(F.col("patch"))
    rows = rows.withColumns({"_o": old, "_p": new}).withColumn("_type", text_of(F.element_at("_o", "_ontology_type"))).withColumn("_class", effective_class(F.col("class"), F.col("_type"), F.col("_first")))
    rows = rows.join(up.select(F.col("child").alias("_c1"), F.col("parent").alias("_p1"), F.lit(True).alias("_below")), (F.col("_class") == F.col("_c1")) & (F.col("_type") == F.col("_p1")), "left")
    rows = rows.join(up.select(F.col("child").alias("_c2"), F.col("parent").alias("_p2"), F.lit(True).alias("_above")), (F.col("_type") == F.col("_c2")) & (F.col("_class") == F.col("_p2")), "left")
    related = (F.col("_class") == F.col("_type")) | F.col("_below").isNotNull() | F.col("_above").isNotNull()
    same = lambda k: F.lower(text_of(F.element_at("_p", k))).eqNullSafe(F.lower(text_of(F.element_at("_o", k)))) if k == "_id" else text_of(F.element_at("_p", k)).eqNullSafe(text_of(F.element_at("_o", k)))
    created = text_of(F.element_at(object_of(F.element_at("_p", "metadata")), "createdAt"))
    valid = F.coalesce(F.col("_id").rlike(OBJECT_ID), F.lit(False))
    found, asked = F.col("_old").isNotNull(), F.col("_p").isNotNull()
    tests = [
        (F.col("_first").isNull(), "unknown_class_or_collection", None), (~valid, "invalid_object_id", "_id"), (F.col("_first").isNotNull() & valid & ~found, "document_not_found", "_id"),
        (~asked, "invalid_patch", None), (found & F.col("_o").isNull(), "invalid_old_document", None), (found & F.col("_class").isNull(), "cannot_resolve_effective_class", None),
        (found & asked & F.map_contains_key("_p", F.lit("_id")) & ~same("_id"), "immutable_field", "_id"),
        (found & asked & F.map_contains_key("_p", F.lit("_ontology_type")) & ~same("_ontology_type"), "immutable_field", "_ontology_type"),
        (found & asked & created.isNotNull() & ~created.eqNullSafe(text_of(F.element_at(object_of(F.element_at("_o", "metadata")), "createdAt"))), "immutable_field", "metadata.createdAt"),
        (found & asked & F.map_contains_key("_p", F.lit("_ontology_type")) & (kind_of(F.element_at("_p", "_ontology_type")) != "STRING"), "invalid_ontology_type", "_ontology_type"),
        (found & F.col("_type").isNotNull() & ~related, "class_document_type_mismatch", "_ontology_type"),
    ]
    text = lambda x: F.lit(x).cast("string")
    listed = F.filter(F.array(*[F.when(c, F.struct(text(code).alias("code"), text(field).alias("field"))) for c, code, field in tests]), lambda x: x.isNotNull())
    return rows.select("request", F.explode(listed).alias("i")).select("request", "i.code", "i.field").distinct()


def plan_updates(requests: DataFrame, stored: DataFrame, collections: DataFrame, edges: DataFrame, classes: DataFrame, constraints: DataFrame, now: str, above: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, issues): (request, collection, _id, payload) of updates that nothing speaks against, merged and stamped, and (request, code, field) of the others."""
    early = update_issues(requests, stored, collections, edges, above)
    sound = requests.join(early.select("request").distinct(), "request", "left_anti")
    first = collections.groupBy("collection").agg(F.min("class").alias("_first"))
    met = sound.join(stored.select(F.col("collection").alias("_sc"), F.col("_id").alias("_sid"), F.col("payload").alias("_old")), (F.col("collection") == F.col("_sc")) & (F.lower("_id") == F.col("_sid"))).join(first, "collection")
    merged = met.withColumn("_new", merge_update(F.col("_old"), F.col("patch"))).withColumn("class", effective_class(F.col("class"), text_of(F.element_at(parsed(F.col("_old")), "_ontology_type")), F.col("_first")))
    late = validate(merged.select(F.col("request").alias("doc_id"), "class", F.col("_new").alias("payload")), classes, constraints).withColumnRenamed("doc_id", "request")
    done = merged.join(late.select("request").distinct(), "request", "left_anti").select("request", "collection", "_id", normalise_update(F.col("_old"), F.col("_new"), now).alias("payload"))
    return done, reduce(DataFrame.unionByName, [early, late])
