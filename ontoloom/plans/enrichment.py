"""Enrichment of a blueprint with instances: what they use and the schema doesn't declare is promoted into it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.casts import xsd_type
from ontoloom.functions.names import local_name
from ontoloom.plans.blueprint import Blueprint

#: Classes of what two properties without a declared range point to outside the ontology.
RANGE_OVERRIDES = {"hasMoustacheValue": "ImportedAppearanceValue", "hasBeardValue": "ImportedAppearanceValue"}
DROPPED_TYPES = ["NamedIndividual"]


def asserted(instances: Blueprint) -> DataFrame:
    """(name, type, position) without the types that say nothing."""
    return instances.individuals.where(~F.col("type").isin(DROPPED_TYPES) & F.col("type").isNotNull())


def first_types(types: DataFrame) -> DataFrame:
    return types.groupBy("name").agg(F.min_by("type", F.struct("position", "type")).alias("type"))


def new_literals(bp: Blueprint, instances: Blueprint) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(properties, domains, ranges) that literals of instances add: the domain is the first type of the subject, the range is read off the first value."""
    known = bp.properties.select(F.col("name").alias("property"))
    met = instances.data_assertions.join(known, "property", "left_anti").join(first_types(asserted(instances)), "name")
    kinds = met.groupBy("property").agg(xsd_type(F.min_by("value", F.struct("position", "value"))).alias("kind"))
    return met.select(F.col("property").alias("name"), F.lit("DataProperty").alias("kind")).distinct(), met.select("property", F.col("type").alias("value")).distinct(), kinds.select("property", F.concat(F.lit("xsd:"), "kind").alias("value"))


def target_types(bp: Blueprint, instances: Blueprint, overrides: dict[str, str] = RANGE_OVERRIDES) -> DataFrame:
    """(name, type): the types that a resource target may have: those it asserts itself, else the property's ranges, else the override; an abstract range stands for a class Imported<Range> below it."""
    targets = instances.object_assertions.select(F.col("target").alias("name"), "property").distinct()
    own = asserted(instances).select("name", "type")
    spark = bp.classes.sparkSession
    fixed = spark.createDataFrame(list(overrides.items()) or [("", "")], "property string, _fixed string")
    lost = targets.join(own.select("name"), "name", "left_anti").join(bp.ranges.select("property", F.col("value").alias("_range")), "property", "left").join(F.broadcast(fixed), "property", "left")
    said = lost.select("name", F.coalesce("_range", "_fixed").alias("type")).where("type is not null").join(bp.classes.select(F.col("name").alias("type"), "is_abstract"), "type", "left")
    return targets.select("name").join(own, "name").unionByName(said.select("name", F.when(F.col("is_abstract"), F.concat(F.lit("Imported"), "type")).otherwise(F.col("type")).alias("type"))).distinct()


def mirrored(annotations: DataFrame) -> DataFrame:
    """annotations, with each subject's labels as its comments where it has none."""
    comments, labels = (annotations.where(F.col("property").isin(p, f"rdfs:{p}")) for p in ("comment", "label"))
    return annotations.unionByName(labels.join(comments.select("subject").distinct(), "subject", "left_anti").withColumn("property", F.lit("comment")).select(annotations.columns))


def unresolved(instances: Blueprint) -> DataFrame:
    """(iri) of every absolute address that a resource target was written as."""
    return instances.object_assertions.where(F.col("iri").rlike("^https?://")).select("iri").distinct()


def enrich(bp: Blueprint, instances: Blueprint, overrides: dict[str, str] = RANGE_OVERRIDES) -> Blueprint:
    """bp with the instances' individuals and assertions, placeholders for targets that nothing describes, and the classes, subclass axioms and properties that these use.

    extra holds unresolved (iri), ordinary and imported (names of individuals with and without a type).
    """
    types = asserted(instances)
    targets = target_types(bp, instances, overrides)
    known = types.select("name").distinct()
    placeholders = targets.join(known, "name", "left_anti").withColumn("position", F.lit(0))
    nameless = instances.object_assertions.select(F.col("target").alias("name")).distinct().join(known, "name", "left_anti").join(targets.select("name"), "name", "left_anti")
    every = types.unionByName(placeholders)
    classes = bp.classes.unionByName(every.select(F.col("type").alias("name")).distinct().join(bp.classes.select("name"), "name", "left_anti").withColumn("is_abstract", F.lit(False)))
    below = every.where("startswith(type, 'Imported')").select(F.col("type").alias("child"), F.substring("type", 9, 1 << 20).alias("parent")).distinct().join(bp.classes.select(F.col("name").alias("parent")), "parent", "left_semi").select("child", "parent")
    props, domains, ranges = new_literals(bp, instances)
    objects = instances.object_assertions.join(bp.properties.select(F.col("name").alias("property")), "property", "left_anti")
    object_domains = objects.join(first_types(types), "name").select("property", F.col("type").alias("value")).distinct()
    object_ranges = objects.select("property", F.col("target").alias("name")).distinct().join(every.select("name", "type"), "name").select("property", F.col("type").alias("value")).distinct()
    union = lambda *dfs: reduce(DataFrame.unionByName, dfs).distinct()
    return bp.with_tables(
        classes=classes,
        edges=union(bp.edges, instances.edges, below),
        properties=union(bp.properties, props, objects.select(F.col("property").alias("name"), F.lit("ObjectProperty").alias("kind"))),
        domains=union(bp.domains, domains, object_domains),
        ranges=union(bp.ranges, ranges, object_ranges),
        annotations=mirrored(union(bp.annotations, instances.annotations)),
        individuals=union(bp.individuals, every.select(bp.individuals.columns)),
        data_assertions=union(bp.data_assertions, instances.data_assertions),
        object_assertions=union(bp.object_assertions, instances.object_assertions),
        extra={"unresolved": unresolved(instances), "ordinary": every.select("name").distinct(), "imported": nameless},
    )


def base_documents(bp: Blueprint, found: DataFrame, scalar: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, class, collection, name, iri, label, field, text, bson_type): the cast-to-be scalars of each routed individual, one row each (one with null field for individuals without any). routes: name, type."""
    routed = routes.join(found.select(F.col("class").alias("type"), "collection"), "type")
    said = bp.annotations.where("property in ('comment', 'rdfs:comment')").groupBy(F.col("subject").alias("name")).agg(F.min("value").alias("_c"))
    base = routed.join(said, "name", "left").select("name", F.col("type").alias("class"), "collection", F.concat(F.lit("#"), "name").alias("iri"), F.coalesce("_c", "name").alias("label"))
    facts = bp.data_assertions.join(scalar.select("class", "property", "field", "bson_type").withColumnRenamed("class", "_cl"), "property").groupBy("name", "_cl", "field", "bson_type").agg(F.min_by("value", "position").alias("text"))
    return base.join(facts.withColumnRenamed("name", "_n"), (F.col("name") == F.col("_n")) & (F.col("class") == F.col("_cl")), "left").select(F.concat_ws("/", "collection", "name").alias("id"), "class", "collection", "name", "iri", "label", "field", "text", "bson_type")


def reference_rows(bp: Blueprint, refs: DataFrame, routes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, field, position, target, required): the references of routed individuals by the ids of base_documents(); targets are met by local name."""
    ids = routes.join(found.select(F.col("class").alias("type"), "collection"), "type").select("name", "type", F.concat_ws("/", "collection", "name").alias("id"))
    links = bp.object_assertions.join(ids, "name").join(refs.select(F.col("class").alias("type"), "property", "field", (F.coalesce("min_items", F.lit(0)) > 0).alias("required")), ["type", "property"])
    goal = ids.select(F.col("name").alias("_t"), F.col("id").alias("_tid"))
    return links.join(goal, local_name(F.col("target")) == F.col("_t"), "left").select("id", "field", "position", F.coalesce("_tid", F.concat(F.lit("?/"), "target")).alias("target"), "required")
