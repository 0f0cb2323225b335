"""Lookups over a blueprint and its collections. Tables are small catalogue tables, each made once and kept in the shared
folder; every lookup is a filter or join on them.

Methods that name one thing return Python values; those whose name ends in _rows return DataFrames for many at once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.names import snake_case
from ontoloom.operators.graph import closure, concrete_descendants, settled
from ontoloom.plans import blueprint as B
from ontoloom.plans import collections as C


class Registry:
    def __init__(self, bp: B.Blueprint) -> None:
        self.bp = bp

    @classmethod
    def from_files(cls, spark: SparkSession, path: str) -> Registry:
        """Of a blueprint in JSON, as blueprint.write_json() writes it."""
        return cls(B.read_json(spark, path))

    @cached_property
    def up(self) -> DataFrame:
        return closure(self.bp.edges)

    @cached_property
    def collections(self) -> DataFrame:
        return settled(C.collections(self.bp.classes, self.bp.individuals))[0]

    @cached_property
    def scalars(self) -> DataFrame:
        bp = self.bp
        data = bp.properties.where("kind = 'DataProperty'").select(F.col("name").alias("property"))
        own = C.fields(self.collections, bp.edges, bp.domains.join(data, "property", "left_semi"), bp.ranges, bp.restrictions, self.up)
        return settled(C.all_fields(self.collections, own))[0]

    @cached_property
    def references(self) -> DataFrame:
        bp = self.bp
        objects = bp.properties.where("kind = 'ObjectProperty'").select(F.col("name").alias("property"))
        domains, ranges = (t.join(objects, "property", "left_semi") for t in (bp.domains, bp.ranges))
        forward = C.references(self.collections, bp.edges, domains, ranges, bp.restrictions, bp.functional, C.explicit_policies(bp.annotations), self.up)
        return settled(C.all_references(forward, C.reverse_references(self.collections, bp.edges, domains, bp.restrictions, self.up)))[0]

    @cached_property
    def targets(self) -> DataFrame:
        return settled(C.target_collections(self.references, self.collections, self.bp.classes, self.bp.edges))[0]

    @cached_property
    def constraints(self) -> DataFrame:
        return C.constraints(self.scalars, self.references)

    @cached_property
    def validators(self) -> DataFrame:
        return C.validators(self.collections, self.scalars, self.references)

    def _has(self, df: DataFrame, **equal) -> bool:
        return not self._where(df, **equal).isEmpty()

    @staticmethod
    def _where(df: DataFrame, **equal) -> DataFrame:
        for k, v in equal.items():
            df = df.where(F.col(k) == F.lit(v))
        return df

    def _list(self, df: DataFrame, column: str, *order: str) -> list:
        return [r[0] for r in df.select(column, *[c for c in order if c != column]).distinct().orderBy(*(order or (column,))).collect()]

    def _one(self, df: DataFrame, *order):
        rows = df.orderBy(*order).limit(1).collect() if order else df.limit(1).collect()
        return rows[0] if rows else None

    # classes and individuals
    def class_exists(self, name: str) -> bool:
        return self._has(self.bp.classes, name=name)

    def individual_exists(self, name: str) -> bool:
        return self._has(self.bp.individuals, name=name)

    def get_individual_asserted_types(self, name: str) -> list[str]:
        return self._list(self._where(self.bp.individuals, name=name), "type", "position", "type")

    def get_individual_data_assertions(self, name: str) -> dict[str, list[str]]:
        return self._assertions(self.bp.data_assertions, name, "value")

    def get_individual_object_assertions(self, name: str) -> dict[str, list[str]]:
        return self._assertions(self.bp.object_assertions, name, "target")

    def _assertions(self, df, name, column):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("position", column))), lambda x: x[column])
        return {r[0]: r[1] for r in self._where(df, name=name).groupBy("property").agg(listed).collect()}

    def is_abstract_class(self, name: str) -> bool:
        return self._has(self.bp.classes, name=name, is_abstract=True)

    def get_parent_classes(self, name: str, transitive: bool = False) -> list[str]:
        return self._list(self._where(self.up if transitive else self.bp.edges, child=name), "parent")

    def get_child_classes(self, name: str, transitive: bool = False) -> list[str]:
        return self._list(self._where(self.up if transitive else self.bp.edges, parent=name), "child")

    def is_subclass_of(self, child: str, parent: str) -> bool:
        return child == parent or self._has(self.up, child=child, parent=parent)

    def is_type_compatible(self, actual: str, allowed: list[str]) -> bool:
        return actual in allowed or not self._where(self.up, child=actual).where(F.col("parent").isin(list(allowed))).isEmpty()

    def get_union_members(self, name: str) -> list[str]:
        return self._list(self._where(self.bp.equivalents, class_name=name, expression_type="ObjectUnionOf").select(F.explode("operands").alias("o")), "o")

    def is_union_parent(self, name: str) -> bool:
        return self._has(self.bp.equivalents.where("size(operands) > 0"), class_name=name, expression_type="ObjectUnionOf")

    def get_disjoint_groups_for_class(self, name: str) -> list[list[str]]:
        return sorted(r[0] for r in self.bp.disjoints.where(F.array_contains("class_names", name)).collect())

    def choose_primary_type(self, types: list[str]) -> str | None:
        """The first concrete one, else the first concrete member of the first union, else the first."""
        if not types:
            return None
        spark = self.bp.classes.sparkSession
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(types)], "position int, name string")
        concrete = self.bp.classes.where("not is_abstract").select("name")
        hit = self._one(rows.join(concrete, "name"), "position")
        if hit is None:
            unions = self.bp.equivalents.where("expression_type = 'ObjectUnionOf'").select(F.col("class_name").alias("name"), F.posexplode("operands").alias("_p", "_m"))
            hit = self._one(rows.join(unions, "name").join(concrete.select(F.col("name").alias("_m")), "_m").select(F.col("_m").alias("name"), "position", "_p"), "position", "_p")
        return hit["name"] if hit else types[0]

    # collections
    def get_collection_for_class(self, name: str) -> str | None:
        row = self._one(self._where(self.collections, **{"class": name}))
        return row["collection"] if row else None

    def get_classes_for_collection(self, collection: str) -> list[str]:
        return self._list(self._where(self.collections, collection=collection), "class")

    def get_primary_class_for_collection(self, collection: str) -> str | None:
        return next(iter(self.get_classes_for_collection(collection)), None)

    def collection_exists(self, collection: str) -> bool:
        return self._has(self.collections, collection=collection)

    def resolve_collection(self, name: str) -> str | None:
        """A collection by its own name, else by a class's."""
        return name if self.collection_exists(name) else self.get_collection_for_class(name)

    def is_vocabulary_type(self, name: str) -> bool:
        return self._has(self.collections, **{"class": name, "kind": "vocabulary_collection"})

    def get_vocabulary_individuals(self, name: str) -> list[str]:
        return self._list(self._where(self.bp.individuals, type=name), "name")

    def is_controlled_individual(self, name: str) -> bool:
        kinds = self.collections.where("kind = 'vocabulary_collection'").select(F.col("class").alias("type"))
        return not self._where(self.bp.individuals, name=name).join(kinds, "type", "left_semi").isEmpty()

    # fields
    @cached_property
    def field_rows(self) -> DataFrame:
        """(collection, class, field, property, kind, bson_type, is_array, required, min_items, max_items, on_delete)."""
        null = lambda t: F.lit(None).cast(t)
        plain = self.scalars.select("class", "field", "property", F.lit("scalar").alias("kind"), "bson_type", F.lit(False).alias("is_array"), "required", null("int").alias("min_items"), null("int").alias("max_items"), null("string").alias("on_delete"))
        linked = self.references.select("class", "field", "property", F.lit("reference").alias("kind"), F.when(F.col("is_array"), "array").otherwise("objectId").alias("bson_type"), "is_array", (F.coalesce("min_items", F.lit(0)) > 0).alias("required"), F.col("min_items").cast("int"), F.col("max_items").cast("int"), "on_delete")
        return settled(plain.unionByName(linked).join(self.collections.select("class", "collection"), "class"))[0]

    def get_required_fields(self, collection: str) -> list[str]:
        return self._list(self._where(self.field_rows, collection=collection, required=True), "field")

    def get_scalar_fields(self, collection: str) -> list[str]:
        return self._list(self._where(self.field_rows, collection=collection, kind="scalar").where("not startswith(field, 'metadata.')"), "field")

    def get_reference_fields(self, collection: str) -> list[str]:
        return self._list(self._where(self.field_rows, collection=collection, kind="reference"), "field")

    def get_metadata_fields(self, collection: str) -> list[str]:
        return self._list(self._where(self.field_rows, collection=collection).where("startswith(field, 'metadata.')"), "field")

    def field_exists(self, collection: str, field: str) -> bool:
        return self._has(self.field_rows, collection=collection, field=field)

    def is_field_allowed_for_class(self, name: str, field: str) -> bool:
        return self._has(self.field_rows, **{"class": name, "field": field})

    def get_allowed_fields_for_class(self, name: str) -> list[str]:
        return self._list(self._where(self.field_rows, **{"class": name}), "field")

    def get_field_origin_for_class(self, name: str, field: str) -> dict | None:
        """The property that a class's field comes from, and the classes that declare it."""
        row = self._one(self._where(self.field_rows, **{"class": name, "field": field}).where("property is not null"))
        return None if row is None else {"property": row["property"], "domains": self._list(self._where(self.bp.domains, property=row["property"]), "value")}

    def is_reference_field(self, collection: str, field: str) -> bool:
        return self._has(self.field_rows, collection=collection, field=field, kind="reference")

    def _spec(self, collection: str, field: str, kind: str) -> dict | None:
        row = self._one(self._where(self.field_rows, collection=collection, field=field, kind=kind), "class")
        return row.asDict() if row else None

    def get_scalar_spec(self, collection: str, field: str) -> dict | None:
        return self._spec(collection, field, "scalar")

    def get_reference_spec(self, collection: str, field: str) -> dict | None:
        spec = self._spec(collection, field, "reference")
        return spec and spec | {"target_classes": self.get_target_classes(collection, field), "target_collections": self.get_target_collections(collection, field)}

    @cached_property
    def target_rows(self) -> DataFrame:
        """(source, field, position, target, collection) for each source collection."""
        own = self.collections.select("class", F.col("collection").alias("source"))
        return settled(self.targets.join(own, "class").groupBy("source", "field", "target", "collection").agg(F.min("position").alias("position")))[0]

    def get_target_classes(self, collection: str, field: str) -> list[str]:
        return self._list(self._where(self.target_rows, source=collection, field=field), "target", "position", "target")

    def get_target_collections(self, collection: str, field: str) -> list[str]:
        return list(dict.fromkeys(self._list(self._where(self.target_rows, source=collection, field=field), "collection", "position", "collection")))

    def get_target_collection(self, collection: str, field: str) -> str | None:
        return next(iter(self.get_target_collections(collection, field)), None)

    def is_multi_reference(self, collection: str, field: str) -> bool:
        return bool((self._spec(collection, field, "reference") or {}).get("is_array"))

    def get_delete_policy(self, collection: str, field: str) -> str | None:
        return (self._spec(collection, field, "reference") or {}).get("on_delete")

    def get_incoming_references(self, collection: str) -> list[dict]:
        """source, field, is_array and on_delete of every reference that may point to the collection."""
        hits = self._where(self.target_rows, collection=collection).select("source", "field").distinct()
        specs = self.field_rows.where("kind = 'reference'").groupBy(F.col("collection").alias("source"), "field").agg(F.max("is_array").alias("is_array"), F.min("on_delete").alias("on_delete"))
        return [r.asDict() for r in hits.join(specs, ["source", "field"]).orderBy("source", "field").collect()]

    # properties
    def _allowed(self, name: str, kind: str) -> list[str]:
        near = [name, *self.get_parent_classes(name, True), *C.THING]
        props = self._where(self.bp.properties, kind=kind).select(F.col("name").alias("property"))
        return self._list(self.bp.domains.where(F.col("value").isin(near)).join(props, "property", "left_semi"), "property")

    def get_allowed_data_properties_for_class(self, name: str) -> list[str]:
        return self._allowed(name, "DataProperty")

    def get_allowed_object_properties_for_class(self, name: str) -> list[str]:
        return self._allowed(name, "ObjectProperty")

    def get_mongo_field_for_property(self, name: str, prop: str) -> str | None:
        """The field that holds a property: of the class itself, else of its ancestors, else of its descendants."""
        rank = F.when(F.col("class") == name, 0).when(F.col("class").isin(self.get_parent_classes(name, True)), 1).when(F.col("class").isin(self.get_child_classes(name, True)), 2)
        row = self._one(self._where(self.field_rows, property=prop).withColumn("_r", rank).where("_r is not null"), "_r", "class", "field")
        return row["field"] if row else None

    def infer_property(self, field: str) -> str | None:
        """The property whose snake-case name a field's name, without _id or _ids, is."""
        stem = F.regexp_replace(F.lit(field), "_ids?$", "")
        row = self._one(self.bp.properties.where((snake_case(F.col("name")) == stem) | (snake_case(F.col("name")) == F.lit(field))), "name")
        return row["name"] if row else None

    def _near_restrictions(self, name: str) -> DataFrame:
        return self.bp.restrictions.where(F.col("subject_class").isin([name, *self.get_parent_classes(name, True)]) & ~F.col("inverse"))

    def get_required_properties_for_class(self, name: str) -> list[str]:
        rules = C.bound_rules(self._near_restrictions(name)).where("lo >= 1")
        return self._list(rules, "property")

    def get_cardinality_rules_for_class(self, name: str) -> dict[str, tuple[int | None, int | None]]:
        """(minimum, maximum) of each property, merged over the class and its ancestors."""
        rules = C.bound_rules(self._near_restrictions(name)).select(F.lit(name).alias("class"), "property", "lo", "hi", "filler")
        return {r["property"]: (r["min_items"], r["max_items"]) for r in C.merge_bounds(rules).collect()}

    def get_required_rule_map_for_class(self, name: str) -> dict[str, list[str]]:
        """Required fields with what requires them: the collection's validator, the ontology, or both."""
        fields = self._where(self.field_rows, **{"class": name})
        spark = self.bp.classes.sparkSession
        props = spark.createDataFrame([(p,) for p in self.get_required_properties_for_class(name)], "property string")
        schema = fields.where("required").select("field", F.lit("validator").alias("source"))
        said = fields.join(props, "property", "left_semi").select("field", F.lit("ontology").alias("source"))
        return {r[0]: r[1] for r in schema.unionByName(said).groupBy("field").agg(F.array_sort(F.collect_set("source"))).collect()}

    def concrete_rows(self, only_self: bool = True) -> DataFrame:
        return concrete_descendants(self.bp.classes, self.bp.edges, only_self)
