from ontoloom.operators import documents as D
from ontoloom.sources import owl

OWL = """<?xml version="1.0"?><Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://x.org/o">
<Declaration><Class IRI="#Animal"/></Declaration><Declaration><ObjectProperty IRI="#eats"/></Declaration>
<SubClassOf><Class IRI="#Dog"/><Class IRI="#Animal"/></SubClassOf>
<SubClassOf><Class IRI="#Dog"/><ObjectMaxCardinality cardinality="2"><ObjectProperty IRI="#eats"/><Class IRI="#Food"/></ObjectMaxCardinality></SubClassOf>
<SubClassOf><Class IRI="#Food"/><ObjectSomeValuesFrom><ObjectInverseOf><ObjectProperty IRI="#eats"/></ObjectInverseOf><Class IRI="#Dog"/></ObjectSomeValuesFrom></SubClassOf>
<ObjectPropertyDomain><ObjectProperty IRI="#eats"/><Class IRI="#Animal"/></ObjectPropertyDomain>
<ClassAssertion><Class IRI="#Dog"/><NamedIndividual IRI="#rex"/></ClassAssertion></Ontology>"""


def test_owl_tables(spark, tmp_path):
    (tmp_path / "a.owl").write_text(OWL)
    tree = owl.nodes(spark, f"file://{tmp_path}/a.owl")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(owl.declarations(tree)) == [("Class", "Animal"), ("ObjectProperty", "eats")]
    assert got(owl.subclass_axioms(tree)) == [("Dog", "Animal")]
    assert got(owl.restrictions(tree)) == [("Dog", "ObjectMaxCardinality", "eats", False, "Food", 2), ("Food", "ObjectSomeValuesFrom", "eats", True, "Dog", None)]
    assert got(owl.property_axioms(tree)) == [("eats", "domain", "Animal")]
    assert got(owl.individuals(tree)) == [("rex", "Dog")]


def test_filters_and_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x")], "_id int, a string, b string")
    assert [r["_id"] for r in D.find(df, {"a": {"$exists": True}}).collect()] == [1]
    assert [r["_id"] for r in D.find(df, {"$nor": [{"a": "a"}]}).collect()] == [2]
    assert [r[0] for r in df.select(D.missing_fields(df, ["b", "a"])).collect()] == ["b", "a"]


MORE = """<Ontology xmlns="http://www.w3.org/2002/07/owl#"><Import>http://x/i</Import>
<EquivalentClasses><Class IRI="#A"/><ObjectUnionOf><Class IRI="#C"/><Class IRI="#B"/></ObjectUnionOf></EquivalentClasses>
<DisjointClasses><Class IRI="#B"/><Class IRI="#C"/></DisjointClasses>
<InverseObjectProperties><ObjectProperty IRI="#p"/><ObjectProperty IRI="#q"/></InverseObjectProperties>
<FunctionalObjectProperty><ObjectProperty IRI="#p"/></FunctionalObjectProperty>
<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:comment"/><IRI>#A</IRI><Literal xml:lang="en">hey</Literal></AnnotationAssertion></Ontology>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://x/o#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<Recording rdf:ID="r1"><label>first</label><of><Person rdf:ID="p1"><sex rdf:resource="#male"/></Person></of></Recording></rdf:RDF>"""


def test_more_axioms_and_instances(spark, tmp_path):
    (tmp_path / "b.owl").write_text(MORE)
    (tmp_path / "c.owl").write_text(RDF)
    tree, rdf = owl.nodes(spark, f"file://{tmp_path}/b.owl"), owl.nodes(spark, f"file://{tmp_path}/c.owl")
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got(owl.equivalent_axioms(tree)) == [("A", "ObjectUnionOf", ["B", "C"])]
    assert got(owl.disjoint_axioms(tree)) == [(["B", "C"],)]
    assert got(owl.inverse_properties(tree)) == [("p", "q"), ("q", "p")]
    assert got(owl.functional_properties(tree)) == [("p",)]
    assert [r[:3] for r in got(owl.annotation_assertions(tree))] == [("A", "rdfs:comment", "hey")]
    assert [r[1] for r in got(owl.imports(tree))] == ["http://x/i"]
    facts = owl.assertions(rdf)
    assert got(facts.drop("iri")) == [("p1", "sex", 0, None, "male"), ("r1", "label", 0, "first", None), ("r1", "of", 1, None, "p1")]
    named = owl.individuals(rdf)
    assert got(named) == [("p1", "Person"), ("r1", "Recording")]
    assert got(owl.placeholders(facts, named, spark.createDataFrame([("sex", "Sex")], "property string, value string"))) == [("male", "Sex")]
