"""From documents to packed training sequences. Each stage takes (spark, docs, sf_dir)."""

from ontoloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from ontoloom.llm.common import table, written


def keep_quality(spark, docs, sf_dir):
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.deduplicate(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]
#: SQL can't train the classifier or run the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
