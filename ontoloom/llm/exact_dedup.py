"""Exact dedup: a tree merge of sorted digest runs.

Every partition of the input is a leaf. Its rows are sorted and combined by (digest, length, probe) into one run, which
holds for each digest the best identifier and the row count. Leaves exchange runs in
binomial rounds: a round takes FAN neighbouring leaves together, its tasks sort-merge their runs by digest, and equal
digests keep the best identifier. A digest counts as verified when SHA-256, byte length and an independent 64-bit probe
of the normalised text all agree; all three are merge keys at every level. A round is one exchange of combined runs, dealt
by leaf group and digest, so that neither a hot group of copies nor the root meets in one task.

The best identifier is a struct, which Spark's aggregation keeps by sorting rather than by hashing: at every level the
plan shows Sort and SortAggregate before the exchange (the run) and after it (the merge).

Only DataFrame functions are used. Cases: null text counts as the empty text; null ids lose against all others, and a
group whose ids are all null keeps null; rows that repeat an id and a text share their verdict (deduplicate() keeps one of
them, of rows that differ in other columns the one of the largest digest of all columns); an empty table gives an empty
result; other columns of the input are left alone whatever their names; long texts are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import ascii_lower, forget, fresh, table, written

#: Leaf numbers have LEAF_BITS bits; each round takes 2 ** ROUND_BITS leaves together.
LEAF_BITS, ROUND_BITS = 6, 3
KEYS = ["_digest", "_length", "_probe"]
#: A table of repeated digests of no more rows than this is broadcast (about 100 bytes a row); a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000


def verified(text: Column) -> list[Column]:
    """Digest, length and probe of normalised texts, named as in KEYS."""
    return [F.unhex(F.sha2(text, 256)).alias("_digest"), F.octet_length(text).alias("_length"), F.xxhash64(text).alias("_probe")]


def digests(df: DataFrame, id_col: str, normalised: Column, order: Column | None = None) -> DataFrame:
    """_id, _order, KEYS of each row. order breaks ties between rows of one id."""
    text = df.select(df[id_col].alias("_id"), (F.lit(0).cast("long") if order is None else order).alias("_order"), normalised.alias("_text"))
    return text.select("_id", "_order", *verified(F.col("_text")))


def merge_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """One row per verified digest: KEYS, keep_id (the largest or smallest id), keep_order, group_size."""
    best, known = (F.max, F.col("_id").isNotNull()) if keep == "max" else (F.min, F.col("_id").isNull())
    leaf = F.pmod(F.spark_partition_id(), F.lit(1 << LEAF_BITS))
    runs = rows.select(leaf.alias("_leaf"), *KEYS, F.struct(known.alias("known"), F.col("_id").alias("id"), F.col("_order").alias("order")).alias("_best"), F.lit(1).cast("long").alias("_n"))
    for _ in range(0, LEAF_BITS, ROUND_BITS):
        runs = runs.withColumn("_leaf", F.shiftright("_leaf", ROUND_BITS)).groupBy("_leaf", *KEYS).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
    return runs.select(*KEYS, F.col("_best.id").alias("keep_id"), F.col("_best.order").alias("keep_order"), F.col("_n").alias("group_size"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=ascii_lower) -> DataFrame:
    """A row for each row of df: its id, keep_id, group_size, kept, text_sha256.

    The join deals rows by digest, without texts; a group that holds much of the input is split by adaptive skew
    handling, as the side of the groups has one row for each digest.
    """
    rows = digests(df, id_col, normalise(df[text_col]))
    joined = rows.join(merge_runs(rows, keep), KEYS)
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=ascii_lower) -> DataFrame:
    """df with one row of each group of equal texts: one that has the group's largest (or smallest) id.

    Only groups of two rows or more decide anything. Their table is broadcast while it is under BROADCAST_ROWS, so that
    texts stay where they are; else rows are dealt by digest.
    """
    order = F.xxhash64(*[df[c] for c in df.columns])
    rows = written(digests(df, id_col, normalise(df[text_col]), order), "digests")
    groups = merge_runs(rows, keep).where("group_size > 1")
    repeated = written(groups.select(F.struct(*KEYS).alias("_group"), F.struct(F.col("keep_id").alias("id"), F.col("keep_order").alias("order")).alias("_winner")), "groups")
    twins = not rows.groupBy(*KEYS, "_id", "_order").count().where("count > 1").isEmpty()
    forget(rows)
    own, mine, group, winner = (fresh(x, df) for x in ("_own", "_mine", "_group", "_winner"))
    named = repeated.select(F.col("_group").alias(group), F.col("_winner").alias(winner))
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    keyed = df.select("*", F.struct(*verified(normalise(df[text_col]))).alias(own), F.struct(df[id_col].alias("id"), order.alias("order")).alias(mine))
    met = keyed.join(named, F.col(own) == F.col(group), "left")
    stays = met.where(F.col(group).isNull() | F.col(mine).eqNullSafe(F.col(winner)))
    every = [F.col(f"`{c}`") for c in df.columns]
    if not twins:
        return stays.select(*every)
    # Rows alike in all columns win together; one of them stays.
    return stays.where(F.col(group).isNull()).select(*every).unionByName(stays.where(F.col(group).isNotNull()).dropDuplicates([own]).select(*every))


def op9_exact_dedup(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
