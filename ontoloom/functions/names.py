"""Names of collections, fields and ontology entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Collections of vocabulary classes that don't follow the plural rule, and the one class name that is spelled anew.
COLLECTION_OVERRIDES = {"Sex": "sexes", "Channel": "channels", "LifeActivity": "life_activities", "Modality": "modalities"}
CLASS_SPELLINGS = {"Apperance": "appearance"}


def snake_case(c: Column) -> Column:
    """An underscore before each capital that follows a lower-case letter or precedes one."""
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(c, "([^_])([A-Z])(?=[a-z])", "$1_$2"))


def snake_case_words(c: Column) -> Column:
    """An underscore between a capital that begins a word and what precedes it, and between lower case or digit and capital; hyphens become underscores, repeated ones fold."""
    c = F.regexp_replace(F.regexp_replace(c, "-", "_"), "(.)([A-Z][a-z]+)", "$1_$2")
    return F.regexp_replace(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")), "_+", "_")


def pluralize(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("s")), F.concat(c, F.lit("es"))).when(F.regexp_like(c, F.lit("[^aeiou]y$")), F.regexp_replace(c, "y$", "ies")).otherwise(F.concat(c, F.lit("s")))


def pluralize_english(c: Column, greek: bool = False) -> Column:
    """Plurals of the registry, where any y becomes ies and hisses take es; greek: sis becomes ses, as in the importer."""
    rule = F.when(F.endswith(c, F.lit("y")), F.regexp_replace(c, "y$", "ies"))
    if greek:
        rule = rule.when(F.endswith(c, F.lit("sis")), F.regexp_replace(c, "sis$", "ses"))
    return rule.when(F.regexp_like(c, F.lit("(s|x|z|ch|sh)$")), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def _mapped(c: Column, table: dict[str, str], other: Column) -> Column:
    for k, v in table.items():
        other = F.when(c == k, v).otherwise(other)
    return other


def collection_name(c: Column, overrides: dict[str, str] = COLLECTION_OVERRIDES, spellings: dict[str, str] = CLASS_SPELLINGS) -> Column:
    """The collection of a class: its override, or the plural of its snake-case name."""
    return _mapped(c, overrides, pluralize(_mapped(c, spellings, snake_case(c))))


def collection_candidates(c: Column) -> Column:
    """Names under which the importer seeks a class's collection, best first."""
    snake = snake_case_words(c)
    mass = F.when(F.regexp_like(snake, F.lit("(_series|data|name)$")), snake)
    return F.array_distinct(F.array_compact(F.array(collection_name(c), pluralize_english(snake, greek=True), mass, pluralize(snake), snake)))


def match_collection(c: Column, available: Column) -> Column:
    """The first candidate that is among the available collections, else null."""
    return F.get(F.filter(collection_candidates(c), lambda x: F.array_contains(available, x)), F.lit(0))


def local_name(iri: Column) -> Column:
    """What follows the last # or /, without a closing slash."""
    return F.regexp_extract(F.regexp_replace(iri, "/+$", ""), "[^#/]*$", 0)


def reference_name(ref: Column) -> Column:
    """Like local_name, but a closing slash leaves nothing, and prefix:name stays as it is."""
    return F.regexp_extract(ref, "[^#/]*$", 0)


def name_after_prefix(ref: Column) -> Column:
    """Like local_name, and without the prefix of prefix:name."""
    return F.regexp_extract(local_name(ref), "[^:]*$", 0)


def name_or_iri(iri: Column) -> Column:
    """local_name, or the whole IRI where that is empty."""
    name = local_name(iri)
    return F.when(name == "", iri).otherwise(name)


def fragment(iri: Column) -> Column:
    """What follows the last #, else the whole text."""
    return F.substring_index(iri, "#", -1)


def without_fragment(iri: Column) -> Column:
    return F.substring_index(iri, "#", 1)


def tag_namespace(tag: Column) -> Column:
    """The namespace of a {namespace}local tag; empty without one."""
    return F.regexp_extract(tag, r"^\{([^}]*)\}", 1)


def tag_local(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def prefix_name(prefix: Column) -> Column:
    """A declared prefix without its closing colon."""
    return F.regexp_replace(F.trim(prefix), ":$", "")


def blank_to_null(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t != "", t)


def class_iri(name: Column) -> Column:
    return F.concat(F.lit("#"), name)


def unresolved_field(field: Column) -> Column:
    """<x>_unresolved for <x>_id and <x>_ids, and for any other <x>."""
    return F.when(F.regexp_like(field, F.lit("_ids?$")), F.regexp_replace(field, "_ids?$", "_unresolved")).otherwise(F.concat(field, F.lit("_unresolved")))


def object_id_of(number: Column) -> Column:
    """24 hexadecimal digits of a number."""
    return F.lpad(F.lower(F.hex(number)), 24, "0")


def document_identity(iri: Column, name: Column, kind: Column) -> Column:
    """What tells documents apart: the IRI, or name and type where it is null or empty."""
    return F.when(F.coalesce(iri, F.lit("")) != "", F.struct(iri.alias("iri"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"))).otherwise(F.struct(F.lit(None).cast("string").alias("iri"), name.alias("name"), kind.alias("type")))
