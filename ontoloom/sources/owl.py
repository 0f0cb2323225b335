"""Ontology files as catalogue tables. A file is one small XML tree, so each is parsed in the task that reads it; rows of all files form one table."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.names import local_name, prefix_name

NODE = "path string, node_id int, parent_id int, depth int, ordinal int, ns string, local string, attrs map<string,string>, text string"


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each XML element below path (a file, folder or pattern). Attributes go by their local names; the root has the file's namespaces too, as xmlns:<prefix>."""

    def parse(frames):
        import pandas as pd

        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                root = ET.fromstring(bytes(content))
                spaces = {f"xmlns:{k}": v for _, (k, v) in ET.iterparse(io.BytesIO(bytes(content)), events=("start-ns",))}
                rows, stack, n = [], [(root, None, 0, 0)], 0
                while stack:
                    e, parent, depth, ordinal = stack.pop()
                    ns, _, local = e.tag[1:].rpartition("}") if e.tag[0] == "{" else ("", "", e.tag)
                    rows.append((p, n, parent, depth, ordinal, ns, local, {k.rpartition("}")[2]: v for k, v in e.attrib.items()} | (spaces if parent is None else {}), (e.text or "").strip() or None))
                    stack += [(c, n, depth + 1, k) for k, c in reversed(list(enumerate(e)))]
                    n += 1
                yield pd.DataFrame(rows, columns=["path", "node_id", "parent_id", "depth", "ordinal", "ns", "local", "attrs", "text"]).astype({"parent_id": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, NODE)


def _ref(c: str):
    a = F.col(f"{c}.attrs")
    return local_name(F.coalesce(a["IRI"], a["abbreviatedIRI"], a["about"], a["resource"], a["ID"]))


def children(tree: DataFrame, local: str, n: int) -> DataFrame:
    """p and its children c0 ... of elements named local."""
    out = tree.where(F.col("local") == local).select("path", F.col("node_id").alias("_p"), F.struct("*").alias("p"))
    for k in range(n):
        c = tree.where(F.col("ordinal") == k).select(F.col("path"), F.col("parent_id").alias("_p"), F.struct("*").alias(f"c{k}"))
        out = out.join(c, ["path", "_p"])
    return out


OWL, RDF, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
#: Kinds of declared entities by what RDF/XML names them.
KINDS = {"Class": "Class", "DatatypeProperty": "DataProperty", "DataProperty": "DataProperty", "ObjectProperty": "ObjectProperty", "AnnotationProperty": "AnnotationProperty"}


def owl_xml(tree: DataFrame) -> DataFrame:
    """(path, is_owl_xml): whether a file is OWL/XML, that is an owl:Ontology with a declaration; all others are read as RDF/XML."""
    root = tree.where("parent_id is null").select("path", ((F.col("local") == "Ontology") & (F.col("ns") == OWL)).alias("_o"))
    declared = tree.where("local = 'Declaration'").select("path").distinct().withColumn("_d", F.lit(True))
    return root.join(declared, "path", "left").select("path", (F.col("_o") & F.coalesce("_d", F.lit(False))).alias("is_owl_xml"))


def prefixes(tree: DataFrame) -> DataFrame:
    """(path, prefix, iri) of Prefix elements; of files without any, the XML namespaces."""
    said = tree.where("local = 'Prefix'").select("path", prefix_name(F.col("attrs")["name"]).alias("prefix"), F.col("attrs")["IRI"].alias("iri"))
    spaces = tree.where("parent_id is null").select("path", F.explode("attrs").alias("k", "iri")).where("startswith(k, 'xmlns:')")
    return said.unionByName(spaces.join(said.select("path").distinct(), "path", "left_anti").select("path", F.substring("k", 7, 1 << 20).alias("prefix"), "iri"))


def ontologies(tree: DataFrame) -> DataFrame:
    """(path, iri) of each file's ontology."""
    return tree.where("local = 'Ontology'").select("path", F.coalesce(F.col("attrs")["ontologyIRI"], F.col("attrs")["about"], F.col("attrs")["base"]).alias("iri")).where("iri is not null").distinct()


def namespaces(tree: DataFrame) -> DataFrame:
    """(iri) that count as the ontologies' own: their IRIs, their bases and all prefixes, without fragments."""
    base = tree.where("parent_id is null").select(F.col("attrs")["base"].alias("iri"))
    return ontologies(tree).select("iri").union(base).union(prefixes(tree).select("iri")).select(F.substring_index("iri", "#", 1).alias("iri")).where("iri != ''").distinct()


def header_annotations(tree: DataFrame) -> DataFrame:
    """(path, property, value, lang, datatype, value_type) of the ontologies themselves."""
    root = tree.where("local = 'Ontology'").select("path", F.col("node_id").alias("_o"))
    xml = children(tree, "Annotation", 2).withColumn("_o", F.col("p.parent_id")).join(root, ["path", "_o"], "left_semi")
    xml = xml.select("path", _ref("c0").alias("property"), F.coalesce("c1.text", _ref("c1")).alias("value"), F.col("c1.attrs")["lang"].alias("lang"), F.col("c1.attrs")["datatypeIRI"].alias("datatype"), F.when(F.col("c1.local") == "Literal", "literal").otherwise("iri").alias("value_type"))
    rdf = tree.join(root.withColumnRenamed("_o", "parent_id"), ["path", "parent_id"], "left_semi").where(annotation_tag()).select("path", F.col("local").alias("property"), *_rdf_value())
    return xml.unionByName(rdf)


def annotation_tag():
    """Whether an element's tag is one that RDF/XML uses to annotate."""
    return ((F.col("ns") == RDFS) & F.col("local").isin("label", "comment", "seeAlso", "isDefinedBy")) | ((F.col("ns") == OWL) & F.col("local").isin("versionInfo", "priorVersion", "deprecated", "backwardCompatibleWith")) | F.col("ns").startswith("http://purl.org/dc/")


def _rdf_value():
    """value, lang, datatype, value_type of an RDF/XML property element; a datatype wins over a language."""
    a = F.col("attrs")
    link = a["resource"].isNotNull()
    return [F.coalesce("text", local_name(a["resource"])).alias("value"), F.when(a["datatype"].isNull(), a["lang"]).alias("lang"), a["datatype"].alias("datatype"), F.when(link & F.col("text").isNull(), "iri").otherwise("literal").alias("value_type")]


def rdf_annotations(tree: DataFrame) -> DataFrame:
    """(subject, property, value, lang, datatype, value_type) of annotation elements below RDF/XML subjects."""
    about = F.coalesce(F.col("attrs")["ID"], F.col("attrs")["about"])
    subjects = tree.where(about.isNotNull() & (F.col("local") != "Ontology")).select("path", F.col("node_id").alias("parent_id"), local_name(about).alias("subject"))
    return tree.where(annotation_tag()).join(subjects, ["path", "parent_id"]).select("subject", F.col("local").alias("property"), *_rdf_value())


def typed_descriptions(tree: DataFrame) -> DataFrame:
    """(name, type, kind) of rdf:Description elements with rdf:type; kind: what they declare, null for individuals."""
    about = F.coalesce(F.col("attrs")["ID"], F.col("attrs")["about"])
    subjects = tree.where(F.col("local") == "Description").where(about.isNotNull()).select("path", F.col("node_id").alias("parent_id"), local_name(about).alias("name"))
    types = tree.where("local = 'type'").join(subjects, ["path", "parent_id"]).select("name", local_name(F.col("attrs")["resource"]).alias("type"), F.col("attrs")["resource"].startswith(OWL).alias("_owl"))
    kinds = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return types.select("name", "type", F.when(F.col("_owl"), kinds[F.col("type")]).alias("kind"), "_owl").where("kind is not null or not _owl").drop("_owl").distinct()


def rdf_property_axioms(tree: DataFrame) -> DataFrame:
    """(property, axiom, value): domain and range given inside RDF/XML properties and descriptions."""
    about = F.coalesce(F.col("attrs")["ID"], F.col("attrs")["about"])
    subjects = tree.where(about.isNotNull()).select("path", F.col("node_id").alias("parent_id"), local_name(about).alias("property"))
    return tree.where((F.col("ns") == RDFS) & F.col("local").isin("domain", "range")).join(subjects, ["path", "parent_id"]).select("property", F.col("local").alias("axiom"), local_name(F.col("attrs")["resource"]).alias("value")).where("value is not null").distinct()


def inferred_classes(tree: DataFrame) -> DataFrame:
    """(name) of classes that nothing declares, but that are domains, ranges of object properties, types or in axioms."""
    objects = declarations(tree).where("kind = 'ObjectProperty'").select(F.col("name").alias("property"))
    axioms = property_axioms(tree).unionByName(rdf_property_axioms(tree))
    named = axioms.where("axiom = 'domain'").select("value").union(axioms.where("axiom = 'range'").join(objects, "property", "left_semi").select("value")).union(individuals(tree).select("type")).union(subclass_axioms(tree).select("child")).union(subclass_axioms(tree).select("parent"))
    declared = declarations(tree).where("kind = 'Class'").select("name")
    return named.select(F.col("value").alias("name")).where("name is not null and name not in ('Thing', 'owl:Thing', 'NamedIndividual')").distinct().join(declared, "name", "left_anti")


def top_level(tree: DataFrame) -> DataFrame:
    """The subjects that stand right below the root, and their properties; what these nest is left out."""
    return tree.where("depth <= 2")


def declarations(tree: DataFrame) -> DataFrame:
    """(kind, name) of OWL/XML declarations and of RDF/XML classes and properties."""
    xml = children(tree, "Declaration", 1).select(F.col("c0.local").alias("kind"), _ref("c0").alias("name"))
    rdf = tree.where(F.col("local").isin("Class", "DatatypeProperty", "ObjectProperty", "AnnotationProperty") & (F.col("attrs")["about"].isNotNull() | F.col("attrs")["ID"].isNotNull()))
    kind = F.when(F.col("local") == "DatatypeProperty", "DataProperty").otherwise(F.col("local"))
    return xml.unionByName(rdf.select(kind.alias("kind"), local_name(F.coalesce(F.col("attrs")["about"], F.col("attrs")["ID"])).alias("name"))).distinct()


def subclass_axioms(tree: DataFrame) -> DataFrame:
    """(child, parent) of named classes."""
    xml = children(tree, "SubClassOf", 2).where("c0.local = 'Class' and c1.local = 'Class'").select(_ref("c0").alias("child"), _ref("c1").alias("parent"))
    rdf = children(tree, "Class", 1).where("c0.local = 'subClassOf'").select(_ref("p").alias("child"), _ref("c0").alias("parent"))
    return xml.unionByName(rdf).where("child is not null and parent is not null").distinct()


def restrictions(tree: DataFrame) -> DataFrame:
    """(subject_class, restriction_type, property_name, inverse, filler, cardinality)."""
    x = children(tree, "SubClassOf", 2).where("c0.local = 'Class' and c1.local != 'Class'").select("path", _ref("c0").alias("subject_class"), F.col("c1.node_id").alias("_r"), F.col("c1.local").alias("restriction_type"), F.col("c1.attrs")["cardinality"].cast("int").alias("cardinality"))
    parts = tree.select("path", F.col("parent_id").alias("_r"), "ordinal", "local", "node_id", F.struct("*").alias("c"))
    prop = parts.where("ordinal = 0").select("path", "_r", _ref("c").alias("_name"), (F.col("local") == "ObjectInverseOf").alias("inverse"), F.col("node_id").alias("_i"))
    inner = parts.where("ordinal = 0").select("path", F.col("_r").alias("_i"), _ref("c").alias("_inner"))
    filler = parts.where("ordinal = 1").select("path", "_r", _ref("c").alias("filler"))
    joined = x.join(prop, ["path", "_r"]).join(inner, ["path", "_i"], "left").join(filler, ["path", "_r"], "left")
    return joined.select("subject_class", "restriction_type", F.coalesce("_name", "_inner").alias("property_name"), "inverse", "filler", "cardinality")


def property_axioms(tree: DataFrame) -> DataFrame:
    """(property, axiom, value): domain and range of object and data properties."""
    names = [f"{k}Property{a}" for k in ("Object", "Data") for a in ("Domain", "Range")]
    out = None
    for n in names:
        x = children(tree, n, 2).select(_ref("c0").alias("property"), F.lit("domain" if n.endswith("Domain") else "range").alias("axiom"), _ref("c1").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def individuals(tree: DataFrame) -> DataFrame:
    """(name, type) from class assertions and from RDF/XML subjects at any depth."""
    xml = children(tree, "ClassAssertion", 2).select(_ref("c1").alias("name"), _ref("c0").alias("type"))
    rdf = tree.where(~F.col("ns").rlike("(owl|rdf-syntax-ns)#$") & (F.col("attrs")["ID"].isNotNull() | F.col("attrs")["about"].isNotNull())).select(local_name(F.coalesce(F.col("attrs")["ID"], F.col("attrs")["about"])).alias("name"), F.col("local").alias("type"))
    return xml.unionByName(rdf).distinct()


def _operands(tree: DataFrame, parents: DataFrame) -> DataFrame:
    """(path, _p, names): sorted names of each parent's children. parents: path, _p."""
    kids = tree.select("path", F.col("parent_id").alias("_p"), F.struct("*").alias("c"))
    return parents.join(kids, ["path", "_p"]).groupBy("path", "_p").agg(F.array_sort(F.collect_set(_ref("c"))).alias("names"))


def equivalent_axioms(tree: DataFrame) -> DataFrame:
    """(class_name, expression_type, operands) of the binary form: a named class, and another or a union of classes."""
    x = children(tree, "EquivalentClasses", 2).where("c0.local = 'Class'")
    named = x.where("c1.local = 'Class'").select(_ref("c0").alias("class_name"), F.lit("named").alias("expression_type"), F.array(_ref("c1")).alias("operands"))
    unions = x.where("c1.local = 'ObjectUnionOf'").select("path", F.col("c1.node_id").alias("_p"), _ref("c0").alias("class_name"))
    ops = _operands(tree, unions.select("path", "_p"))
    return named.unionByName(unions.join(ops, ["path", "_p"]).select("class_name", F.lit("ObjectUnionOf").alias("expression_type"), F.col("names").alias("operands")))


def disjoint_axioms(tree: DataFrame) -> DataFrame:
    """(class_names): sorted distinct names, two at least."""
    return _operands(tree, tree.where("local = 'DisjointClasses'").select("path", F.col("node_id").alias("_p"))).where("size(names) >= 2").select(F.col("names").alias("class_names"))


def inverse_properties(tree: DataFrame) -> DataFrame:
    """(property, inverse_of), in both directions."""
    x = children(tree, "InverseObjectProperties", 2).select(_ref("c0").alias("property"), _ref("c1").alias("inverse_of"))
    y = children(tree, "ObjectProperty", 1).where("c0.local = 'inverseOf'").select(_ref("p").alias("property"), _ref("c0").alias("inverse_of"))
    both = x.unionByName(y)
    return both.unionByName(both.select(F.col("inverse_of").alias("property"), F.col("property").alias("inverse_of"))).distinct()


def functional_properties(tree: DataFrame) -> DataFrame:
    xml = children(tree, "FunctionalObjectProperty", 1).unionByName(children(tree, "FunctionalDataProperty", 1)).select(_ref("c0").alias("property"))
    rdf = tree.where("local = 'FunctionalProperty'").select(local_name(F.coalesce(F.col("attrs")["about"], F.col("attrs")["ID"])).alias("property"))
    return xml.unionByName(rdf).distinct()


def annotation_assertions(tree: DataFrame) -> DataFrame:
    """(subject, property, value, lang, datatype, value_type)."""
    x = children(tree, "AnnotationAssertion", 3)
    literal = F.col("c2.local") == "Literal"
    subject = local_name(F.coalesce(F.col("c1.text"), F.col("c1.attrs")["IRI"]))
    return x.select(subject.alias("subject"), _ref("c0").alias("property"), F.coalesce("c2.text", _ref("c2")).alias("value"), F.col("c2.attrs")["lang"].alias("lang"), F.col("c2.attrs")["datatypeIRI"].alias("datatype"), F.when(literal, "literal").otherwise("iri").alias("value_type"))


def imports(tree: DataFrame) -> DataFrame:
    """(path, iri), once each."""
    found = tree.where("local in ('imports', 'Import')").select("path", F.coalesce(F.col("attrs")["resource"], F.col("text")).alias("iri"))
    return found.where("iri is not null").distinct()


def assertions(tree: DataFrame) -> DataFrame:
    """(name, property, position, value, target, iri): literals, and resources that are named (iri as written) or nested, of RDF/XML subjects at any depth.

    A subject's properties stand one level below it, and what they nest two levels below, so two joins serve all depths.
    """
    about = F.coalesce(F.col("attrs")["ID"], F.col("attrs")["about"])
    subjects = tree.where(about.isNotNull() & ~F.col("ns").rlike("(owl|rdf-syntax-ns)#$")).select("path", F.col("node_id").alias("_s"), local_name(about).alias("name"))
    props = tree.where((F.col("ns") != RDF) & ~annotation_tag()).select("path", F.col("parent_id").alias("_s"), F.col("node_id").alias("_p"), F.col("local").alias("property"), "ordinal", "text", F.col("attrs")["resource"].alias("resource"))
    nested = subjects.select("path", F.col("_s").alias("_n"), F.col("name").alias("nested")).join(tree.select("path", F.col("node_id").alias("_n"), F.col("parent_id").alias("_p")), ["path", "_n"])
    joined = subjects.join(props, ["path", "_s"]).join(nested.drop("_n"), ["path", "_p"], "left")
    target = F.coalesce(local_name(F.col("resource")), F.col("nested"))
    return joined.select("name", "property", F.col("ordinal").alias("position"), F.when(target.isNull(), F.col("text")).alias("value"), target.alias("target"), F.col("resource").alias("iri"))


def placeholders(facts: DataFrame, named: DataFrame, ranges: DataFrame) -> DataFrame:
    """(name, type): targets that no individual stands for, typed by the ranges of the properties that point to them."""
    lost = facts.where("target is not null").select(F.col("target").alias("name"), "property").distinct().join(named.select("name"), "name", "left_anti")
    return lost.join(ranges.select("property", F.col("value").alias("type")), "property", "left").select("name", "type").distinct()
