"""Quality classifier by hierarchical empirical Bayes.

Document evidence: a logistic model over style measures and hashed words, fitted on at most TRAIN_ROWS labelled rows (the
ones with the smallest hashes). Site evidence: labelled rows of each host (source) and path (source, lang) are counted by
grouped aggregation over all of them; a path's rate shrinks to its host's and a host's to the global one, each level with
a prior weight of its own, from the spread of its rates. The posterior adds the path's log odds, less the global ones, to the document's; a
path without labels has its host's.
A document is accepted when its posterior of quality reaches ACCEPT and its probability of being toxic stays below TOXIC.

Cases: null text counts as empty, a null source or lang is a group of its own; a host without labels takes the global
prior; repeated rows are scored alike; labels of a repeated id count by their mean; with no labels at all everything is
accepted; an empty table gives an empty result; long texts are scored whole; other columns are kept, but columns named like
the operator's own (names) are replaced by them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ontoloom.llm.common import fresh, table
from ontoloom.llm.textbatch import U, Words, slices, texts_of

TRAIN_ROWS, BUCKETS, ACCEPT, TOXIC = 6000, 1 << 14, 0.5, 0.5
#: Site tables of no more rows than this are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
DENSE = 9


def features(texts: list[bytes]):
    """Dense measures (n x DENSE), and for each text its distinct word buckets."""
    w, dense, words = Words(texts), np.zeros((len(texts), DENSE)), []
    for k, t in enumerate(texts):
        h = w.hash[w.at[k] : w.at[k + 1]]
        raw = np.frombuffer(t, dtype=np.uint8)
        n, m = max(1, len(raw)), max(1, len(h))
        c = np.bincount(raw, minlength=256)
        upper, lower, digits = c[65:91].sum(), c[97:123].sum() + c[128:].sum(), c[48:58].sum()
        symbols = n - upper - lower - digits - c[[32, 10, 44, 46]].sum()
        distinct = len(np.unique(h))
        dense[k] = [1.0, upper / n * 5, symbols / n * 10, digits / n * 5, distinct / m, distinct / math.sqrt(m) / 5, math.log1p(m) / 5, min(n / m, 30) / 10, c[124] / m * 5]
        words.append(np.unique((h % U(BUCKETS)).astype(np.int64)))
    return dense, words


def described(batches):
    """The features of each text in place of the text; they are bounded, however long it is."""
    for b in batches:
        for p in slices(b, 0, 500):
            dense, words = features(texts_of(p.column(0)))
            packed = [pa.array([x.tobytes() for x in dense], pa.binary()), pa.array([x.astype(np.uint16).tobytes() for x in words], pa.binary())]
            yield pa.RecordBatch.from_arrays([*packed, *p.columns[1:]], ["_dense", "_words", *p.schema.names[1:]])


def fit(dense, words, y, epochs=12, rate=0.3, decay=1e-5):
    """Weights of a logistic model by AdaGrad, in a fixed order: DENSE, then BUCKETS."""
    wd, ww = np.zeros(DENSE), np.zeros(BUCKETS)
    gd, gw = np.full(DENSE, 1e-2), np.full(BUCKETS, 1e-2)
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            ix, s = words[k], 1 / math.sqrt(len(words[k]) + 1)
            e = 1 / (1 + math.exp(-max(-30, min(30, dense[k] @ wd + ww[ix].sum() * s)))) - y[k]
            g = e * dense[k]
            gd += g * g
            wd -= rate * g / np.sqrt(gd)
            g = e * s + decay * ww[ix]
            gw[ix] += g * g
            ww[ix] -= rate * g / np.sqrt(gw[ix])
    return wd, ww


def score(dense, words, model):
    wd, ww = model
    return np.clip(dense @ wd + np.array([ww[ix].sum() / math.sqrt(len(ix) + 1) for ix in words]), -30, 30)


def prior_weight(rate, spread, noise) -> float:
    """How many labels the prior of a level counts for: few where the rates below it spread, many where they don't. spread: the variance of the rates; noise: the mean of 1 / labels."""
    own = max((spread or 0) - rate * (1 - rate) * (noise or 0), 1e-6)  # without the noise of their counts
    return float(min(max(rate * (1 - rate) / own - 1, 5.0), 1000.0))


def site_posteriors(labelled):
    """(_s, _l, _site) of the paths and (_hs, _host) of the hosts with labels: log odds of the rate less the global ones. labelled: source, lang, _q."""
    paths = labelled.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("good"))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    one = F.lit(1.0)
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good"), F.var_pop(F.col("hgood") / F.col("hn")).alias("v"), F.avg(one / F.col("hn")).alias("inv")).first()
    rate = (g["good"] + 1) / (g["n"] + 2)
    weight = prior_weight(rate, g["v"], g["inv"])
    logit = lambda p: F.log(p / (one - p))
    host = (F.col("hgood") + F.lit(weight * rate)) / (F.col("hn") + F.lit(weight))
    joined = paths.join(hosts.select(F.col("source").alias("_hs"), host.alias("_h")), F.col("source").eqNullSafe(F.col("_hs")))
    below = joined.agg(F.avg(F.pow(F.col("good") / F.col("n") - F.col("_h"), 2)).alias("v"), F.avg(one / F.col("n")).alias("inv")).first()
    inner = F.lit(prior_weight(rate, below["v"], below["inv"]))  # of a host's posterior over its paths
    path = (F.col("good") + inner * F.col("_h")) / (F.col("n") + inner)
    base = math.log(rate / (1 - rate))
    of_paths = joined.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), (logit(path) - F.lit(base)).alias("_site"))
    return of_paths, hosts.select(F.col("source").alias("_hs"), (logit(host) - F.lit(base)).alias("_host"))


NAMES = ("p_quality", "p_toxic", "accepted")


def classify(docs, labels, train_rows=TRAIN_ROWS, names=NAMES):
    """docs (doc_id, text, lang, source and more) with the columns of names: p_quality, p_toxic and accepted. The text is not shuffled, but for the labelled rows that train."""
    docs = docs.drop(*names)
    known = labels.groupBy(F.col("doc_id").alias("_ld")).agg(F.avg("quality").alias("_q"), F.avg("toxic").alias("_t")).where("_ld is not null and _q is not null")
    keys = docs.select(F.col("doc_id").alias("_dd"), "source", "lang").join(known, F.col("_dd") == F.col("_ld")).select("source", "lang", "_q")
    sample = F.broadcast(known.orderBy(F.xxhash64("_ld"), "_ld").limit(train_rows))
    plain = docs.select(F.col("text"), F.col("doc_id").alias("_dd"))
    rows = plain.join(sample, F.col("_dd") == F.col("_ld")).select("text", "_q", "_t", F.xxhash64("_ld", "text").alias("_o"))
    rows = rows.mapInArrow(described, "_dense binary, _words binary, _q double, _t double, _o long").sort("_o").limit(train_rows).toPandas()
    if not len(rows):
        return docs.withColumns(dict(zip(names, (F.lit(1.0), F.lit(0.0), F.lit(True)), strict=True)))
    dense = np.stack([np.frombuffer(x) for x in rows["_dense"]])
    words = [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in rows["_words"]]
    models = [fit(dense, words, rows[c].fillna(0).to_numpy()) for c in ("_q", "_t")]
    held = docs.sparkSession.sparkContext.broadcast([(d, w.astype(np.float32)) for d, w in models])
    at = docs.columns.index("text")
    zq, zt, s, l, site, hs, host = (fresh(x, docs) for x in ("_zq", "_zt", "_s", "_l", "_site", "_hs", "_host"))

    def scored(batches):
        for b in batches:
            for p in slices(b, at, 500):
                dense, words = features(texts_of(p.column(at)))
                yield pa.RecordBatch.from_arrays([*p.columns, *(pa.array(score(dense, words, m)) for m in held.value)], [*p.schema.names, zq, zt])

    schema = StructType([*docs.schema.fields]).add(zq, "double").add(zt, "double")
    paths, hosts = site_posteriors(keys)
    paths, hosts = paths.select(F.col("_s").alias(s), F.col("_l").alias(l), F.col("_site").alias(site)), hosts.select(F.col("_hs").alias(hs), F.col("_host").alias(host))
    few = lambda t: t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few_paths := few(paths):
        paths = F.broadcast(paths)
    if few_paths or few(hosts):  # each host has a path at least
        hosts = F.broadcast(hosts)
    both = docs.mapInArrow(scored, schema).join(paths, F.col("source").eqNullSafe(F.col(s)) & F.col("lang").eqNullSafe(F.col(l)), "left")
    both = both.join(hosts, F.col("source").eqNullSafe(F.col(hs)), "left")
    p = lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    quality, toxic = p(F.col(zq) + F.coalesce(site, host, F.lit(0.0))), p(F.col(zt))
    verdicts = zip((quality, toxic, (quality >= ACCEPT) & (toxic < TOXIC)), names, strict=True)
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(n) for v, n in verdicts])


def keep_accepted(docs, labels):
    """The rows of docs that classify() accepts, with all their columns, whatever their names."""
    names = tuple(fresh(n, docs) for n in NAMES)
    return classify(docs, labels, names=names).where(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic", "accepted")
