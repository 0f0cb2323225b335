"""Closure over class and reference graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset (as in tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def settled(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, where its lineage ends, and the table's path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ontoloom-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def closure(edges: DataFrame) -> DataFrame:
    """(child, parent, depth): all ancestors, each at its least depth; a node that lies on a cycle is an ancestor of itself.

    Every level is one join of the last level's new pairs, written to the shared folder, so that neither plan nor
    recomputation grows with the depth. It ends when a level brings nothing new: cycles end, chains may have any length.
    """
    spark = edges.sparkSession
    edges, first = settled(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    front, levels, depth = edges.withColumn("depth", F.lit(1)), [], 1
    found = front
    while True:
        depth += 1
        step = front.select("child", F.col("parent").alias("via")).join(edges.select(F.col("child").alias("via"), "parent"), "via").select("child", "parent").distinct()
        front, path = settled(step.join(found, ["child", "parent"], "left_anti").withColumn("depth", F.lit(depth)))
        levels.append(path)
        if front.isEmpty():
            break
        found = found.unionByName(front)
    out, _ = settled(found)
    discard(spark, [first, *levels])
    return out


def is_subclass(pairs: DataFrame, edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """pairs (child, parent) with is_subclass; reflexive: each class is one of itself, whether a cycle holds it or not."""
    up = closure(edges).select("child", "parent").distinct().withColumn("_known", F.lit(True))
    same = F.col("child") == F.col("parent") if reflexive else F.lit(False)
    return pairs.join(up, ["child", "parent"], "left").select(*pairs.columns, (F.coalesce("_known", F.lit(False)) | same).alias("is_subclass"))


def concrete_descendants(classes: DataFrame, edges: DataFrame, only_self: bool = False) -> DataFrame:
    """(class, concrete): each class's concrete descendants and, if concrete, itself; only_self: a concrete class has itself alone. classes: name, is_abstract."""
    concrete = classes.where("not is_abstract").select(F.col("name").alias("concrete"))
    below = closure(edges).select(F.col("parent").alias("class"), F.col("child").alias("concrete")).join(concrete, "concrete", "left_semi")
    if only_self:
        below = below.join(concrete.select(F.col("concrete").alias("class")), "class", "left_anti")
    return concrete.select(F.col("concrete").alias("class"), "concrete").unionByName(below.select("class", "concrete")).distinct()


def resolve_targets(references: DataFrame, classes: DataFrame, edges: DataFrame, union: bool = False) -> DataFrame:
    """references (with ranges and fillers, arrays of classes) with targets: the concrete classes below the fillers, or below the ranges where there are no fillers; union: below both."""
    fillers, ranges = F.coalesce("fillers", F.array().cast("array<string>")), F.coalesce("ranges", F.array().cast("array<string>"))
    said = F.array_union(ranges, fillers) if union else F.when(F.size(fillers) > 0, fillers).otherwise(ranges)
    keyed = references.withColumn("_said", said).withColumn("_row", F.xxhash64(*references.columns))
    below = concrete_descendants(classes, edges).groupBy("class").agg(F.array_sort(F.collect_set("concrete")).alias("_below"))
    found = keyed.select("_row", F.explode("_said").alias("class")).distinct().join(below, "class").groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_below")))).alias("targets"))
    return keyed.join(found, "_row", "left").select(*references.columns, F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
