"""The ontology blueprint: all catalogue tables of a set of ontology files, and its JSON form."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.plans import collections as C
from ontoloom.sources import owl

#: The tables of a blueprint and their columns.
SCHEMAS = {
    "classes": "name string, is_abstract boolean",
    "edges": "child string, parent string",
    "properties": "name string, kind string",
    "domains": "property string, value string",
    "ranges": "property string, value string",
    "functional": "property string",
    "inverses": "property string, inverse_of string",
    "restrictions": "subject_class string, restriction_type string, property_name string, inverse boolean, filler string, cardinality int",
    "equivalents": "class_name string, expression_type string, operands array<string>",
    "disjoints": "class_names array<string>",
    "annotations": "subject string, property string, value string, lang string, datatype string, value_type string",
    "individuals": "name string, type string, position int",
    "data_assertions": "name string, property string, position int, value string",
    "object_assertions": "name string, property string, position int, target string, iri string",
    "prefixes": "path string, prefix string, iri string",
    "header": "path string, property string, value string, lang string, datatype string, value_type string",
}


@dataclass(frozen=True)
class Blueprint:
    """One DataFrame for each of SCHEMAS."""

    classes: DataFrame
    edges: DataFrame
    properties: DataFrame
    domains: DataFrame
    ranges: DataFrame
    functional: DataFrame
    inverses: DataFrame
    restrictions: DataFrame
    equivalents: DataFrame
    disjoints: DataFrame
    annotations: DataFrame
    individuals: DataFrame
    data_assertions: DataFrame
    object_assertions: DataFrame
    prefixes: DataFrame
    header: DataFrame
    extra: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "extra"}

    def write(self, root: str) -> Blueprint:
        """The blueprint as Parquet tables below root, read again from there: later steps don't parse the files anew."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        return read(self.classes.sparkSession, root)

    def with_tables(self, **tables: DataFrame) -> Blueprint:
        return replace(self, **tables)


def read(spark: SparkSession, root: str) -> Blueprint:
    return Blueprint(**{n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in SCHEMAS.items()})


def empty(spark: SparkSession) -> Blueprint:
    return Blueprint(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def best_annotations(annotations: DataFrame) -> DataFrame:
    """Of annotations of one subject, property, value and kind, the one that says most: a language counts most, then a datatype, then being no literal."""
    rank = F.struct(F.col("lang").isNotNull().alias("l"), F.col("datatype").isNotNull().alias("d"), (F.col("value_type") != "literal").alias("k"), "lang", "datatype")
    best = annotations.groupBy("subject", "property", "value", "value_type").agg(F.max_by(F.struct("lang", "datatype"), rank).alias("x"))
    return best.select("subject", "property", "value", "x.lang", "x.datatype", "value_type")


def build(tree: DataFrame, ignore_classes=(), ignore_properties=(), ignore_thing: bool = True) -> Blueprint:
    """The blueprint of the files whose elements tree holds. Names that are used but not declared count as declared by use. Ignored properties leave all tables; ignored classes only those of classes, and only with ignore_thing."""
    out_c = list(ignore_classes) + C.THING if ignore_thing else []
    kept = lambda df, c, names: df.where(~F.col(c).isin(list(names))) if names else df
    declared, typed = owl.declarations(tree), owl.typed_descriptions(tree)
    declared = declared.unionByName(typed.where("kind is not null").select("kind", "name")).distinct()
    notes = best_annotations(owl.annotation_assertions(tree).unionByName(owl.rdf_annotations(tree)))
    axioms = owl.property_axioms(tree).unionByName(owl.rdf_property_axioms(tree)).distinct()
    restricted = owl.restrictions(tree)
    kinds = restricted.select(F.col("property_name").alias("name"), F.when(F.col("restriction_type").startswith("Data"), "DataProperty").otherwise("ObjectProperty").alias("kind"))
    used = axioms.select(F.col("property").alias("name")).union(kinds.select("name")).distinct()
    props = declared.where("kind != 'Class'").select("name", "kind")
    by_use = used.join(props.select("name"), "name", "left_anti").join(kinds.distinct(), "name", "left").select("name", F.coalesce("kind", F.lit("ObjectProperty")).alias("kind"))
    names = declared.where("kind = 'Class'").select("name").union(owl.inferred_classes(tree)).where("name is not null").distinct()
    classes = names.join(C.is_abstract(notes).withColumn("_a", F.lit(True)), "name", "left").select("name", F.coalesce("_a", F.lit(False)).alias("is_abstract"))
    individuals = owl.individuals(tree).unionByName(typed.where("kind is null").select("name", "type")).distinct()
    order = individuals.withColumn("position", F.lit(0))
    facts = owl.assertions(tree)
    return Blueprint(
        classes=kept(classes, "name", out_c),
        edges=owl.subclass_axioms(tree),
        properties=kept(props.unionByName(by_use).distinct(), "name", ignore_properties),
        domains=kept(axioms.where("axiom = 'domain'").select("property", "value"), "property", ignore_properties),
        ranges=kept(axioms.where("axiom = 'range'").select("property", "value"), "property", ignore_properties),
        functional=owl.functional_properties(tree),
        inverses=owl.inverse_properties(tree),
        restrictions=kept(restricted, "property_name", ignore_properties),
        equivalents=owl.equivalent_axioms(tree),
        disjoints=owl.disjoint_axioms(tree),
        annotations=notes,
        individuals=order,
        data_assertions=facts.where("value is not null").select("name", "property", F.col("position").cast("int"), "value"),
        object_assertions=facts.where("target is not null").select("name", "property", F.col("position").cast("int"), "target", "iri"),
        prefixes=owl.prefixes(tree),
        header=owl.header_annotations(tree),
    )


def counts(bp: Blueprint) -> DataFrame:
    """(name, n) of every table, and of individuals with assertions."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    out = [one(n, df) for n, df in bp.tables().items()]
    out += [one("individuals_with_data", bp.data_assertions.select("name").distinct()), one("individuals_with_objects", bp.object_assertions.select("name").distinct())]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.orderBy("name")


def to_json(bp: Blueprint) -> DataFrame:
    """(table, rows): each table as one JSON array, rows in their text's order. The catalogue of an ontology is small."""
    out = None
    for name, df in bp.tables().items():
        x = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.array_sort(F.collect_list("j")).alias("j")).select(F.lit(name).alias("table"), F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")).alias("rows"))
        out = x if out is None else out.unionByName(x)
    return out


def write_json(bp: Blueprint, path: str) -> None:
    to_json(bp).coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> Blueprint:
    saved = spark.read.schema("table string, rows string").json(path)
    tables = {}
    for name, schema in SCHEMAS.items():
        row = saved.where(F.col("table") == name).select(F.explode(F.from_json("rows", f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(', '))}>>")).alias("r"))
        tables[name] = row.select("r.*")
    return Blueprint(**tables)


def report(bp: Blueprint, limit: int = 20) -> str:
    """A short text of the blueprint: counts, and the first classes with their parents."""
    lines = [f"{r['name']}: {r['n']}" for r in counts(bp).collect()]
    parents = bp.edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    rows = bp.classes.join(parents, F.col("name") == F.col("child"), "left").orderBy("name").limit(limit).collect()
    return "\n".join([*lines, *(f"{r['name']}{' (abstract)' if r['is_abstract'] else ''} < {', '.join(r['parents'] or [])}" for r in rows)])
