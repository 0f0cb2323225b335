"""License scans: an exact set-similarity join of text blocks with licence templates, beside fixed phrases.

A template is a set of words. Blocks are runs of words, whatever the lines: for templates of up to b / 2 words, b words
from every multiple of b / 2 on (b a power of two), so that a notice of the template's length always lies in one block.
A template is found in a block that holds THRESHOLD of its words at least. Words of the templates are ordered by global
document frequency, rarest first. A template of n words needs a = ceil(THRESHOLD * n) of them, so one of its first
n - a + 1 must occur (prefix filter: only blocks around such words are made at all), the block must hold a words of the
vocabulary at least (length filter), and the words left in both after the meeting ones must suffice (positional filter);
what is left is counted in full. Templates are a table of at most MAX_TEMPLATES rows, so their broadcast is bounded.

Only DataFrame functions are used. Cases: null text counts as empty and has no words, labels or places; repeated rows, null
ids and ids that repeat share the matches of their text; an empty table gives an empty result; long texts are scanned
whole; other columns are not read. Templates that tie in a block are all found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ontoloom.llm.common import ascii_lower, row_key, table
from ontoloom.llm.license_texts import TEXTS

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD, MAX_TEMPLATES = 0.9, 2000


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NON_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def template_sets(texts) -> list[tuple[str, list[str], int]]:
    """(label, sorted distinct words, block size) of each template. texts: (label, text) pairs or a DataFrame of them."""
    if hasattr(texts, "limit"):
        texts = [tuple(r) for r in texts.limit(MAX_TEMPLATES + 1).collect()]
    found = [(label, words) for label, t in texts if (words := template_words(t or ""))]
    if len(found) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return [(label, sorted(set(w)), 2 << (len(w) - 1).bit_length()) for label, w in found]


def matches(docs, templates=TEXTS, threshold=THRESHOLD):
    """(_id, _key, label, score): the best containment of each label's templates in a block. docs: _id, _key, _text (lower-cased)."""
    spark, sets = docs.sparkSession, template_sets(templates)
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    words = F.split("_text", NON_WORD)
    count = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("t")).groupBy("t").count()
    counts = {r["t"]: r["count"] for r in count.collect()}  # no more rows than the vocabulary
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    rank, index, prefix = {t: k for k, t in enumerate(order)}, [], {}
    for label, tokens, b in sets:
        ordered, need = sorted(tokens, key=rank.get), math.ceil(threshold * len(tokens) - 1e-9)
        for i, t in enumerate(ordered[: len(tokens) - need + 1]):
            index.append((b, t, label, i, need, ordered))
            prefix.setdefault(b, set()).add(t)
    index = F.broadcast(spark.createDataFrame(index, "_b int, _t string, label string, _i int, _need int, _all array<string>"))
    some = F.array(*map(F.lit, sorted(set().union(*prefix.values()))))
    held = docs.select("_id", "_key", F.filter(words, lambda w: w != "").alias("_words")).where(F.arrays_overlap("_words", some))

    def spots(b):  # the blocks of size b around words of its prefixes
        at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(*sorted(prefix[b])), F.floor(i / F.lit(b // 2)).cast("int"))), lambda k: k.isNotNull())
        return F.transform(F.array_distinct(F.concat(at, F.filter(F.transform(at, lambda k: k - 1), lambda k: k >= 0))), lambda k: F.struct(F.lit(b).alias("b"), k.alias("k")))

    blocks = held.withColumn("_spot", F.explode(F.concat(*[spots(b) for b in sorted(prefix)])))
    inside = F.slice("_words", F.col("_spot.k") * F.col("_spot.b") / 2 + 1, F.col("_spot.b"))
    blocks = blocks.select("_id", "_key", F.col("_spot.b").alias("_b"), F.array_intersect(F.array(*map(F.lit, order)), inside).alias("_held"))
    met = blocks.select("*", F.posexplode("_held").alias("_j", "_t")).join(index, ["_b", "_t"])
    left = F.lit(1) + F.least(F.size("_all") - F.col("_i") - 1, F.size("_held") - F.col("_j") - 1)
    # The first meeting word bounds the overlap; later ones of the same pair are bounded by what is before them too.
    near = met.where((F.size("_held") >= F.col("_need")) & (left + F.least("_i", "_j") >= F.col("_need")))
    overlap = F.size(F.array_intersect("_held", "_all"))
    found = near.where(overlap >= F.col("_need")).select("_id", "_key", "label", (overlap / F.size("_all")).alias("score"))
    return found.groupBy("_id", "_key", "label").agg(F.max("score").alias("score"))


def scan_licenses(df, id_col="doc_id", text_col="text", templates=TEXTS, threshold=THRESHOLD):
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    docs = df.select(df[id_col].alias("_id"), row_key(df[id_col], df[text_col]).alias("_key"), ascii_lower(df[text_col]).alias("_text"))
    by_doc = matches(docs, templates, threshold).groupBy(F.col("_id").alias("_id2"), F.col("_key").alias("_key2")).agg(F.array_sort(F.collect_set("label")).alias("_found"), F.max("score").alias("_best"))
    words = F.trim(F.regexp_replace("_text", NON_WORD, " "))
    base = docs.select("_id", "_key", F.concat(F.lit(" "), words, F.lit(" ")).alias("_w"))
    n = F.when(F.col("_w") == "  ", 0).otherwise(F.regexp_count("_w", F.lit(" ")) - 1)
    base = base.withColumn("n_words", n.cast("long"))
    cut = {p: F.when(F.contains("_w", F.lit(f" {p} ")), F.split("_w", f" {p}(?= )")) for p in PHRASES}
    spaces = lambda c: F.regexp_count(c, F.lit(" "))
    base = base.withColumns({f"_c{k}": c for k, c in enumerate(cut.values())})
    cs = [F.col(f"_c{k}") for k in range(len(cut))]
    base = base.select(
        "_id", "_key", "n_words",
        sum((F.when(c.isNotNull(), F.size(c) - 1).otherwise(0) for c in cs), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[spaces(c[0]) for c in cs]).cast("long").alias("first_word"),
        F.greatest(*[F.col("n_words") - len(p.split()) - spaces(F.element_at(c, -1)) + 1 for p, c in zip(cut, cs, strict=True)]).cast("long").alias("last_word"),
        F.array_sort(F.filter(F.array(*[F.when(c.isNotNull(), v) for v, c in zip(PHRASES.values(), cs, strict=True)]), lambda x: x.isNotNull())).alias("_labels"),
    )
    both = base.join(by_doc, base["_id"].eqNullSafe(by_doc["_id2"]) & (base["_key"] == by_doc["_key2"]), "left")
    every = F.array_sort(F.array_union("_labels", F.coalesce("_found", F.array().cast("array<string>"))))
    return both.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))


def op3_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACES = {p: f"list_filter(range(len(ws)), lambda i: ws[i + 1 : i + {len(p.split())}] = {p.split()})" for p in PHRASES}
_EVERY = "list_concat(" + ", ".join(f"p{k}" for k in range(len(PHRASES))) + ")"
_SETS = ", ".join(f"('{k}', {s}, {b})" for k, s, b in template_sets(TEXTS))
ORACLE = f"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (SELECT r, doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM low),
placed AS (SELECT r, doc_id, ws, {', '.join(f'{x} AS p{k}' for k, x in enumerate(_PLACES.values()))} FROM worded),
templates(label, tokens, b) AS (VALUES {_SETS}),
cuts AS (SELECT r, b, ws, unnest(range(0, len(ws), b // 2)) AS k FROM worded, (SELECT DISTINCT b FROM templates)),
blocks AS (SELECT DISTINCT r, b, list_sort(list_distinct(ws[k + 1 : k + b])) AS held FROM cuts),
found AS (SELECT r, label, max(len(list_intersect(held, tokens)) / len(tokens)) AS s FROM blocks JOIN templates USING (b)
          WHERE len(list_intersect(held, tokens)) / len(tokens) >= {THRESHOLD} GROUP BY ALL),
per AS (SELECT r, list(DISTINCT label) AS labels, max(s) AS s FROM found GROUP BY r),
based AS (SELECT *, list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS bl, {_EVERY} AS every FROM placed)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
       array_to_string(list_sort(bl), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0.0)::DOUBLE END AS score
FROM based LEFT JOIN per USING (r)
"""
