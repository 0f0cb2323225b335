"""Import of documents in the order of what they require, as a fixpoint over any graph of references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators.documents import first_examples
from ontoloom.operators.graph import discard, settled


@dataclass
class Imported:
    """documents: id, collection, round (null: never loaded). inserted: by round; rounds counts the last one, which brought nothing. updates: how often loaded documents were written again in later rounds."""

    documents: DataFrame
    inserted: list[int]
    rounds: int
    updates: int


def import_fixpoint(documents: DataFrame, references: DataFrame) -> Imported:
    """Loads documents round by round. documents: id, collection, blocked (a required scalar is missing). references: id, field, target, required.

    A document loads in the round after the last of its required fields has got a loaded target; one target for each field
    is enough, whichever comes first. What waits on a cycle, a missing or a blocked document never loads. A round reads only
    the required references that are still open, and the last round's documents; its results are tables in the shared folder.
    """
    spark = documents.sparkSession
    waiting, path = settled(documents.where("not coalesce(blocked, false)").select("id"))
    open_refs, ref_path = settled(references.where("required and id is not null").select("id", "field", "target").distinct())
    unmet, unmet_path = settled(open_refs.select("id", "field").distinct())
    paths, loaded, inserted = [path, ref_path, unmet_path], None, []
    while True:
        front, front_path = settled(waiting.join(unmet.select("id").distinct(), "id", "left_anti").withColumn("round", F.lit(len(inserted) + 1)))
        paths.append(front_path)
        inserted.append(front.count())
        if not inserted[-1]:
            break
        loaded = front if loaded is None else loaded.unionByName(front)
        waiting, path = settled(waiting.join(front.select("id"), "id", "left_anti"))
        met = open_refs.join(front.select(F.col("id").alias("target")), "target", "left_semi").select("id", "field").distinct()
        unmet, unmet_path = settled(unmet.join(met, ["id", "field"], "left_anti"))
        open_refs, ref_path = settled(open_refs.join(unmet, ["id", "field"], "left_semi"))
        paths += [path, unmet_path, ref_path]
    state = documents.select("id", "collection").join(loaded, "id", "left") if loaded is not None else documents.select("id", "collection", F.lit(None).cast("int").alias("round"))
    state, _ = settled(state)
    discard(spark, paths)
    rounds = len(inserted)
    return Imported(state, inserted, rounds, sum(n * (rounds - k) for k, n in enumerate(inserted, 1)))


def resolved(references: DataFrame, state: DataFrame) -> DataFrame:
    """(id, field, targets): loaded targets of each field, in the order of position. references: id, field, position, target."""
    known = state.where("round is not null").select(F.col("id").alias("target"))
    one = F.struct("position", "target")
    return references.join(known, "target", "left_semi").groupBy("id", "field").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["target"]).alias("targets"))


def unresolved(references: DataFrame, state: DataFrame, examples: int = 8) -> DataFrame:
    """(field, documents, refs, examples): references of loaded documents to targets that never loaded."""
    done = state.where("round is not null")
    lost = references.join(done.select("id"), "id", "left_semi").join(done.select(F.col("id").alias("target")), "target", "left_anti")
    counts = lost.groupBy("field").agg(F.countDistinct("id").alias("documents"), F.count(F.lit(1)).alias("refs"))
    return counts.join(first_examples(lost.select("field", "target").distinct(), ["field"], "target", examples), "field")


def skipped(state: DataFrame, missing: DataFrame) -> DataFrame:
    """(collection, missing, n): documents that never loaded, by the fields they lack. missing: id, field."""
    named = missing.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("missing"))
    return state.where("round is null").join(named, "id", "left").groupBy("collection", F.coalesce("missing", F.lit("")).alias("missing")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "collection", "missing")


def match_sources(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(iri, source): for each external IRI the first source it begins with, else its own namespace. sources: position, source; a short list, checked as one array so that no pairs are formed."""
    listed = [r["source"] for r in sources.orderBy("position").limit(10_000).collect()]
    hit = F.get(F.filter(F.array(*map(F.lit, listed)), lambda s: F.startswith(F.col("iri"), s)), F.lit(0)) if listed else F.lit(None).cast("string")
    return targets.select("iri", F.coalesce(hit, F.regexp_replace("iri", "[^#/]*$", "")).alias("source"))


def choose_type(types: DataFrame, routable: DataFrame) -> DataFrame:
    """(name, type): of an individual's types that have a collection, the one with most underscores, then the longest, then the first. types: name, type, position; routable: type."""
    n = F.length("type") - F.length(F.replace("type", F.lit("_"), F.lit("")))
    return types.join(routable.select("type").distinct(), "type", "left_semi").groupBy("name").agg(F.min_by("type", F.struct((-n).alias("u"), (-F.length("type")).alias("l"), F.col("position"))).alias("type"))
