"""From ontology files to a store of validated documents: the library's parts put together.

Documents are loaded and created as JSON payloads (columns _id, _ontology_type, payload), as their fields differ by class;
typed collections (one column for each field) are read through Store.
"""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.casts import parse_scalar, reads_as
from ontoloom.operators import changes, create, importing, validation
from ontoloom.operators import documents as D
from ontoloom.operators.graph import discard, settled
from ontoloom.plans import blueprint as B
from ontoloom.plans import collections as C
from ontoloom.plans import enrichment
from ontoloom.plans.registry import Registry
from ontoloom.sources import owl
from ontoloom.sources.store import Store

PAYLOAD = "_id string, _ontology_type string, payload string"


def utc_now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Engine:
    def __init__(self, spark: SparkSession, schema: B.Blueprint, blueprint: B.Blueprint, store: Store, now: str | None = None) -> None:
        self.spark, self.schema, self.blueprint, self.store, self.now = spark, schema, blueprint, store, now or utc_now()

    @classmethod
    def open(cls, spark: SparkSession, source: str, instances: str | None = None, store: str = "store", now: str | None = None) -> Engine:
        """source: the ontology's files; instances: files of individuals, by default those in source themselves. The blueprints are kept as tables beside the store."""
        def blueprint(path, name):
            tree, scratch = settled(owl.nodes(spark, path))  # files are parsed once
            out = B.build(tree).write(f"{store}/_blueprint/{name}")
            discard(spark, [scratch])
            return out

        schema = blueprint(source, "schema")
        more = blueprint(instances, "instances") if instances else schema
        return cls(spark, schema, enrichment.enrich(schema, more).write(f"{store}/_blueprint/enriched"), Store(spark, store), now)

    @cached_property
    def registry(self) -> Registry:
        return Registry(self.blueprint)

    @cached_property
    def collections(self) -> DataFrame:
        """Vocabularies are what the schema's own individuals make so, not what instances do."""
        return settled(C.collections(self.blueprint.classes, self.schema.individuals))[0]

    @cached_property
    def scalars(self) -> DataFrame:
        return settled(C.all_fields(self.collections, self.registry.scalars.where("property is not null")))[0]

    def validators(self, strict: bool = False) -> DataFrame:
        r = self.registry
        return C.validators(self.collections, self.scalars, r.references, not strict)

    @cached_property
    def constraints(self) -> DataFrame:
        return settled(C.constraints(self.scalars, self.registry.references))[0]

    # documents
    def _payloads(self, name: str) -> DataFrame:
        return self.store.read(name) if name in self.store.collections() else self.spark.createDataFrame([], PAYLOAD)

    def all_documents(self) -> DataFrame:
        """(collection, _id, _ontology_type, payload) of every collection in the store."""
        out = self.spark.createDataFrame([], "collection string, " + PAYLOAD)
        for name in self.store.collections():
            docs = self.store.read(name)
            if "payload" in docs.columns:
                out = out.unionByName(docs.select(F.lit(name).alias("collection"), "_id", "_ontology_type", "payload"))
        return out

    def documents(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(prepared, references, payload rows, unreadable): what load() works on. prepared: id, collection, blocked."""
        bp, r, found = self.blueprint, self.registry, self.collections
        routes = importing.choose_type(enrichment.asserted(bp), found.select(F.col("class").alias("type")))
        rows = settled(enrichment.base_documents(bp, found, r.scalars.where("property is not null"), routes))[0]
        need = self.scalars.where("required and not contains(field, '.') and field not in ('name', 'iri', 'label')").select("class", "field")
        ids = rows.select("id", "class", "collection").distinct()
        lost = ids.join(need, "class").join(rows.where("text is not null").select("id", "field"), ["id", "field"], "left_anti").select("id", "field").distinct()
        refs = settled(enrichment.reference_rows(bp, r.references, routes, found))[0]
        wanted = ids.join(r.references.where("coalesce(min_items, 0) > 0").select("class", "field"), "class").select("id", "field")
        bare = wanted.join(refs.select("id", "field").distinct(), ["id", "field"], "left_anti")
        missing = lost.unionByName(bare).distinct()
        blocked = missing.select("id").distinct().withColumn("blocked", F.lit(True))
        return ids.join(blocked, "id", "left").select("id", "collection", F.coalesce("blocked", F.lit(False)).alias("blocked")), refs, rows, missing

    def load(self, drop: bool = False) -> dict:
        """Loads the blueprint's individuals in the order of what they require; gives the counters."""
        if drop:
            self.store.drop()
        prepared, refs, rows, missing = self.documents()
        done = importing.import_fixpoint(prepared, refs)
        state = done.documents
        array = self.registry.references.select("field", "is_array").distinct()
        links = importing.resolved(refs, state).join(array, "field")
        oid = lambda c: F.substring(F.sha1(c), 1, 24)  # noqa: E731  an id that depends on the document alone
        linked = links.select("id", F.struct("field", F.when(F.col("is_array"), F.to_json(F.transform("targets", oid))).otherwise(F.to_json(F.array(oid(F.col("targets")[0])))).alias("json"), "is_array").alias("x"))
        quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
        text = F.when(F.col("bson_type").isin("int", "long", "double", "decimal", "bool") & reads_as(F.col("text"), F.col("bson_type")), parse_scalar(F.col("text"), F.col("bson_type"))).otherwise(quoted(parse_scalar(F.col("text"), F.col("bson_type"))))
        scalars = rows.where("field is not null").select("id", F.concat(quoted(F.col("field")), F.lit(":"), text).alias("m"))
        refs_json = linked.select("id", F.concat(quoted(F.col("x.field")), F.lit(":"), F.when(F.col("x.is_array"), F.col("x.json")).otherwise(F.regexp_extract("x.json", r"^\[(.*)\]$", 1))).alias("m"))
        member = scalars.unionByName(refs_json).groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
        base = rows.select("id", "class", "collection", "name", "iri", "label").distinct().join(state.where("round is not null").select("id"), "id", "left_semi").join(member, "id", "left")
        head = F.array(*[F.concat(F.lit(f'"{k}":'), quoted(F.col(c))) for k, c in (("_ontology_type", "class"), ("name", "name"), ("iri", "iri"), ("label", "label"))], F.concat(F.lit('"_id":'), quoted(oid(F.col("id")))), F.lit(f'"metadata":{{"createdAt":"{self.now}","updatedAt":"{self.now}"}}'))
        docs = base.select(oid(F.col("id")).alias("_id"), F.col("class").alias("_ontology_type"), "collection", F.concat(F.lit("{"), F.array_join(F.concat(head, F.coalesce("ms", F.array().cast("array<string>"))), ","), F.lit("}")).alias("payload"))
        names = sorted(r[0] for r in state.where("round is not null").select("collection").distinct().collect())
        changed = {n: docs.where(F.col("collection") == n).select("_id", "_ontology_type", "payload") for n in names}
        rules = {r["collection"]: r["validator"] for r in self.validators().collect()}
        self.store.ensure({n: v for n, v in rules.items() if n not in names}, PAYLOAD)
        self.store.commit(changed, validators=rules)
        skips = importing.skipped(state, missing).collect()
        lost = importing.unresolved(refs, state)
        totals = lost.agg(F.sum("refs").alias("refs"), F.sum("documents").alias("documents")).first()
        out = {
            "inserted": sum(done.inserted), "inserted_by_round": done.inserted, "rounds": done.rounds, "reference_updates": done.updates,
            "skipped": sum(r["n"] for r in skips), "skipped_by": {f"{r['collection']} :: {r['missing']}": r["n"] for r in skips},
            "unresolved_references": totals["refs"] or 0, "unresolved_documents": totals["documents"] or 0,
        }
        self.store.write_meta(documents=out["inserted"])
        return out

    # requests
    def create_issues(self, class_name: str, payload: str, layers: bool = False) -> DataFrame:
        """Issues of one request; layers: by the layered checks, which give levels."""
        r, bp = self.registry, self.blueprint
        stored = self.all_documents()
        targets = r.targets.select("class", "field", "collection").distinct()
        if layers:
            request = self.spark.createDataFrame([("request", class_name, None, payload)], "doc_id string, class string, subtype string, payload string")
            unions = bp.equivalents.where("expression_type = 'ObjectUnionOf'")
            return create.check_creation(request, bp.classes, bp.edges, unions, self.collections, self.constraints, bp.disjoints, targets, stored, above=r.up)[1]
        request = self.spark.createDataFrame([("request", class_name, payload)], "doc_id string, class string, payload string")
        allowed = r.references.select("class", "field", F.explode("targets").alias("type"))
        return validation.validate_create(request, bp.classes, self.constraints, targets, allowed, stored, bp.edges, bp.equivalents.where("expression_type = 'ObjectUnionOf'"), r.up)

    def create(self, class_name: str, payload: str) -> str:
        """Stores a document and gives its _id, the payload's or one made of the class and the payload."""
        validation.require_valid(self.create_issues(class_name, payload))
        name = self.registry.get_collection_for_class(class_name)
        request = self.spark.createDataFrame([(class_name, payload)], "class string, payload string")
        stamped = changes.normalise_create(request, self.now)
        given = F.lower(validation.text_of(F.element_at(validation.parsed(F.col("payload")), "_id")))
        doc = stamped.select(F.coalesce(given, F.substring(F.sha1(F.concat("class", F.lit("/"), "payload")), 1, 24)).alias("_id"), F.col("class").alias("_ontology_type"), "payload").collect()
        self.store.insert(name, self.spark.createDataFrame(doc, PAYLOAD))
        return doc[0]["_id"]

    def read(self, name: str, query: dict | None = None, limit: int | None = 50, depth: int = 0, metadata: bool = True) -> DataFrame:
        """Documents of a collection or a class; query: over _id, _ontology_type and, by their paths in the payload, other fields. depth: references below are given as related documents, level by level."""
        docs = self._payloads(self.registry.resolve_collection(name))
        for key in _paths(query):
            if key not in docs.columns:
                docs = docs.withColumn(key, F.try_variant_get(F.try_parse_json("payload"), f"$.{key}", "string"))
        found = D.find(docs, query, limit=limit).select("_id", "_ontology_type", "payload")
        if not metadata:
            members = validation.parsed(F.col("payload"))
            found = found.withColumn("payload", changes.to_payload(F.map_filter(members, lambda k, _: k != "metadata")))
        return found if depth <= 0 else self.related(found, depth)

    def related(self, docs: DataFrame, depth: int) -> DataFrame:
        """docs, and for each level below (level, root, field, position, ref) the document found, or circular where the reference leads back on its own way."""
        r = self.registry
        refs = r.references.select(F.col("class").alias("_ontology_type"), "field").distinct()
        stored = self.all_documents().select(F.col("_id").alias("_r"), F.col("collection").alias("_collection"), F.col("_ontology_type").alias("_t"), F.col("payload").alias("_p"))
        null = lambda t: F.lit(None).cast(t)
        front = docs.select(F.lit(0).alias("level"), F.col("_id").alias("root"), null("string").alias("field"), null("int").alias("position"), F.col("_id").alias("ref"), null("string").alias("_collection"), "_ontology_type", "payload", F.lit(False).alias("circular"), F.array("_id").alias("way"))
        out = front
        for level in range(1, depth + 1):
            own = front.where("payload is not null and not circular").select("root", "way", "_ontology_type", F.explode(validation.parsed(F.col("payload"))).alias("field", "v")).join(refs, ["_ontology_type", "field"], "left_semi")
            items = F.when(validation.kind_of(F.col("v")).startswith("ARRAY"), F.transform(validation.items_of(F.col("v")), validation.text_of)).otherwise(F.array(validation.text_of(F.col("v"))))
            each = own.select("root", "way", "field", F.posexplode(items).alias("position", "ref")).withColumn("circular", F.array_contains("way", F.col("ref")))
            met = each.join(stored, (F.col("ref") == F.col("_r")) & ~F.col("circular"), "left")
            front = met.select(F.lit(level).alias("level"), "root", "field", "position", "ref", "_collection", F.col("_t").alias("_ontology_type"), F.col("_p").alias("payload"), "circular", F.concat("way", F.array("ref")).alias("way"))
            out = out.unionByName(front)
        return out.drop("way")

    def plan_update(self, name: str, _id: str, patch: str) -> tuple[DataFrame, DataFrame]:
        collection = self.registry.resolve_collection(name) or name
        given = name if self.registry.class_exists(name) else None
        request = self.spark.createDataFrame([("request", collection, given, _id, patch)], "request string, collection string, class string, _id string, patch string")
        return changes.plan_updates(request, self.all_documents(), self.collections.select("collection", "class"), self.blueprint.edges, self.blueprint.classes, self.constraints, self.now, self.registry.up)

    def apply_update(self, name: str, done: DataFrame) -> None:
        self.store.update(self.registry.resolve_collection(name), done.select("_id", "payload"))

    # deletes
    def _referrers(self, collection: str) -> list[dict]:
        have = set(self.store.collections())
        return [x for x in self.registry.get_incoming_references(collection) if x["source"] in have]

    def _ids(self, _id: str) -> DataFrame:
        return self.spark.createDataFrame([(_id.lower(),)], "_id string")

    def _pointing(self, source: str, field: str, ids: DataFrame) -> DataFrame:
        """(_d, _t): documents of source whose field holds one of the ids."""
        v = F.element_at(validation.parsed(F.col("payload")), field)
        items = F.when(validation.kind_of(v).startswith("ARRAY"), F.transform(validation.items_of(v), validation.text_of)).otherwise(F.array(validation.text_of(v)))
        return self._payloads(source).select(F.col("_id").alias("_d"), F.explode(F.array_distinct(items)).alias("_t")).join(ids.select(F.col("_id").alias("_t")), "_t", "left_semi")

    def preview_delete(self, name: str, _id: str, mode: str = "restrict") -> DataFrame:
        """(level, code, collection, field, action, n, examples)."""
        collection, mode, ids = self.registry.resolve_collection(name), D.normal_mode(mode), self._ids(_id)
        schema = "level string, code string, collection string, field string, action string, n bigint, examples array<string>"
        row = lambda *x: self.spark.createDataFrame([x], schema)
        if mode not in D.MODES:
            return row("error", "unknown_delete_mode", None, None, None, None, None)
        if collection is None:
            return row("error", "unknown_class_or_collection", None, None, None, None, None)
        out = self.spark.createDataFrame([], schema)
        if self._payloads(collection).join(ids, "_id", "left_semi").isEmpty():
            out = out.unionByName(row("error", "document_not_found", collection, "_id", None, None, None))
        for x in self._referrers(collection):
            action, why = D.effective_action(mode, x["on_delete"], x["is_array"])
            found = self._pointing(x["source"], x["field"], ids).select(F.lit("all").alias("g"), "_d")
            counted = found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(D.first_examples(found, ["g"], "_d", 3), "g")
            level = "error" if action == "block" else "warning" if why else "info"
            out = out.unionByName(counted.select(F.lit(level).alias("level"), F.lit(why or "reference_detached").alias("code"), F.lit(x["source"]).alias("collection"), F.lit(x["field"]).alias("field"), F.lit(action).alias("action"), "n", "examples"))
        return out

    def suggest_mode(self, name: str, _id: str) -> str | None:
        return next((m for m in D.MODES if self.preview_delete(name, _id, m).where("level = 'error'").isEmpty()), None)

    def delete(self, name: str, _id: str, mode: str = "restrict") -> dict[str, int]:
        """Deletes a document and takes its id out of all that refer to it, in one commit; in the mode detach_if_valid only if what is left is valid."""
        from ontoloom.sources.store import Blocked

        stops = self.preview_delete(name, _id, mode).where("level = 'error'").select("code").distinct().collect()
        if stops:
            raise Blocked(", ".join(sorted(r[0] for r in stops)))
        collection, ids, changed = self.registry.resolve_collection(name), self._ids(_id), {}
        for x in self._referrers(collection):
            docs = changed.get(x["source"], self._payloads(x["source"]))
            hit = self._pointing(x["source"], x["field"], ids).select(F.col("_d").alias("_hit")).distinct()
            members = validation.parsed(F.col("payload"))
            v = F.element_at(members, x["field"])
            left = F.filter(validation.items_of(v), lambda i: validation.text_of(i) != _id.lower())
            rest = F.map_filter(members, _other_than(x["field"]))
            new = F.when(validation.kind_of(v).startswith("ARRAY"), changes.overlay(rest, F.create_map(F.lit(x["field"]), F.to_variant_object(left)))).otherwise(rest)
            changed[x["source"]] = docs.join(hit, F.col("_id") == F.col("_hit"), "left").select("_id", "_ontology_type", F.when(F.col("_hit").isNotNull(), changes.normalise_update(F.col("payload"), changes.to_payload(new), self.now)).otherwise(F.col("payload")).alias("payload"))
        if D.normal_mode(mode) == "detach_if_valid":
            for source, docs in changed.items():
                touched = docs.join(self._payloads(source).select(F.col("_id"), F.col("payload").alias("_was")), "_id").where("payload != _was")
                if not validation.validate(touched.select(F.col("_id").alias("doc_id"), F.col("_ontology_type").alias("class"), "payload"), self.blueprint.classes, self.constraints).isEmpty():
                    raise Blocked("detach_would_violate_constraints")
        changed[collection] = changed.get(collection, self._payloads(collection)).join(ids, "_id", "left_anti")
        return self.store.commit(changed)

    def run(self, workdir: str, keep: bool = False) -> dict:
        """The whole way: blueprint and validators as JSON below workdir, documents in the store, counters as result. keep: what the store holds already stays."""
        B.write_json(self.blueprint, f"{workdir}/blueprint")
        self.validators().coalesce(1).write.mode("overwrite").json(f"{workdir}/validators")
        out = self.load(drop=not keep)
        self.spark.createDataFrame([(k, str(v)) for k, v in out.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{workdir}/summary")
        return out


def _other_than(field: str):
    return lambda k, _: k != field


def _paths(query) -> list[str]:
    """The field paths that a filter names."""
    out = []
    for k, v in (query or {}).items():
        if k in ("$and", "$or", "$nor"):
            out += [p for q in v for p in _paths(q)]
        else:
            out.append(k)
    return out
