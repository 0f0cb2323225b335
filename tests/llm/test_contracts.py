"""Whole results against plain versions, and odd tables: nulls, repeats, long texts, empty tables, clashing names."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality, queries, secret_scan, suffix_dedup

DATA = "/root/testdata"
small = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables here")


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    w = fold(text).encode().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def classes(sets, links):
    comp = dict.fromkeys(sets)
    for i in comp:
        comp[i] = i
    find = lambda i: i if comp[i] == i else find(comp[i])
    for a, b in links:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def similar(sets):
    """All pairs that reach the threshold, through an index of shingles."""
    by, pairs = {}, set()
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for v in by.values():
        pairs.update(itertools.combinations(sorted(v), 2))
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


@small
def test_secret_query(spark):
    kinds = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    least = {"assign": 8, "access": 16, "hex": 32}
    want = []
    for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect():
        found = []
        for n, (kind, p) in enumerate(kinds.items()):
            for m in re.finditer(p, r["text"] or "", re.I | re.A if kind == "assign" else 0):
                if len(m[2] if kind == "assign" else m[0]) >= least[kind]:
                    found.append((m.start(), n, m.end(), kind))
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        want.append((r["doc_id"], *(sum(f[3] == k for f in found) for k in kinds), hashlib.sha256(said.encode()).hexdigest()))
    got = queries.QUERIES["op1_secret_scan"](spark, f"{DATA}/sf0.01")
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr) and sum(w[1] + w[2] + w[3] for w in want) > 10


def test_secrets_in_odd_tables(spark):
    long = "z" * 400_000 + " login: bob key " + "Ab1" * 8 + " " + "q" * 400_000
    docs = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (None, None, "z")], "doc_id long, text string, base string")
    got = secret_scan.scan_secrets(docs).collect()
    assert [[x["kind"] for x in r["linked"]] for r in sorted(got, key=lambda r: r["doc_id"] or 0)] == [[], ["identifier", "secret"], ["identifier", "secret"]]
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def distance(p, t):
    """The least edit distance between p and a substring of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_edit_matching_against_the_full_table(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    items = [(k, letters(rng.randint(20, 90))) for k in range(25)] + [(100, "o"), (101, None), (None, letters(40)), (7, "short one")]

    def spoiled(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["x"], [t[k], "y"]])
        return "".join(t)

    texts = [None, "", "o"] + [letters(30) + spoiled(items[rng.randrange(25)][1].upper(), rng.randint(0, 6)) + letters(30) for _ in range(120)] + ["w " * 30_000 + items[3][1] + " w" * 10]
    fold_ = lambda t: " ".join(fold(t).split())
    want = set()
    for k, t in enumerate(texts[:-1]):
        for i, x in items:
            x, f = fold_(x), fold_(t)
            if len(x) >= decontaminate.LEAST and f and (d := distance(x, f)) <= len(x) // decontaminate.ERROR_SHARE:
                want.add((k, i, d))
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(5, texts[5], "again")], "doc_id int, text string, distance string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    last = len(texts) - 1
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got if r["doc_id"] != last} == want and (last, 3) in {(r["doc_id"], r["item_id"]) for r in got}
    assert len([r for r in got if r["doc_id"] == 5]) == 2 * len([w for w in want if w[0] == 5]) and len(want) > 40
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(last)) - {w[0] for w in want}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count() and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


@small
def test_near_duplicates_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    links = similar(sets)
    want = classes(sets, links)
    got = queries.QUERIES["op5_near_dedup"](spark, f"{DATA}/sf0.01").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert len(links) > 100


def test_deduplications_keep_odd_columns(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    data = [(1, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 1, "x"), (2, "a b c d e f g", 2, "y"), (3, long, 3, "z"), (4, long.upper(), 4, "z"), (None, "one", 5, None), (None, "one", 5, None), (5, None, 6, "n"), (6, "", 7, "e"), (2, "A b c d e f G", 8, "t")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _dg int, _rk string").withColumnRenamed("_rk", "_key").withColumn("_group", F.lit("g")).withColumn("_own", F.lit(0))
    exact, near = exact_dedup.deduplicate(docs), near_dedup.deduplicate(docs)
    for out in (exact, near):
        assert out.columns == docs.columns
        left = [(r["doc_id"], r["text"], r["_dg"], r["_key"], r["_group"], r["_own"]) for r in out.collect()]
        assert set(left) <= {(*r, "g", 0) for r in data} and len(left) == len(set(left))
    assert [r["doc_id"] for r in sorted(exact.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [2, 4, 6, None]
    assert sorted((r["doc_id"] for r in near.collect()), key=repr) == sorted([1, 3, 5, 6, None], key=repr)
    assert exact_dedup.deduplicate(docs.limit(0)).count() == near_dedup.deduplicate(docs.limit(0)).count() == 0
    few = exact_dedup.BROADCAST_ROWS, near_dedup.BROADCAST_ROWS
    try:
        exact_dedup.BROADCAST_ROWS = near_dedup.BROADCAST_ROWS = 0
        assert rows(exact_dedup.deduplicate(docs)) == rows(exact) and rows(near_dedup.deduplicate(docs)) == rows(near)
    finally:
        exact_dedup.BROADCAST_ROWS, near_dedup.BROADCAST_ROWS = few


def test_runs_are_sorted_and_merged(spark):
    docs = spark.createDataFrame([(k, str(k % 7)) for k in range(50)], "doc_id long, text string").repartition(5)
    plan = exact_dedup.merge_runs(exact_dedup.digests(docs, "doc_id", exact_dedup.ascii_lower(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    rounds = -(-exact_dedup.LEAF_BITS // exact_dedup.ROUND_BITS)
    assert plan.count("SortAggregate") == 2 * rounds and plan.count("Exchange hashpartitioning") == rounds
    smallest = exact_dedup.duplicate_groups(docs, keep="min")
    assert {r["keep_id"] for r in smallest.collect()} == set(range(7))


def test_suffixes_of_odd_tables(spark):
    rng = random.Random(2)
    block = "".join(rng.choice("abcdefgh ") for _ in range(900))
    data = [(1, block + "x" * 2000, 1), (2, "q" + block, 2), (2, "q" + block, 2), (3, None, 3), (4, "é" * 300, 4), (None, block[:399], 5), (5, "".join(rng.choice("ab") for _ in range(300_000)) + block[100:600], 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ranges int")
    seen = {}
    texts = [(i, (t or "").encode()) for i, t, _ in data]
    for _, t in texts:
        for k in range(len(t) - 399):
            seen[t[k : k + 400]] = seen.get(t[k : k + 400], 0) + 1
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want.append((i, sum(gone)))
    got = [(r["_id"], sum(int(z - a) for a, z in suffix_dedup.removed(b"", r["spans"]))) for r in suffix_dedup.repeated_spans(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(n for _, n in want) > 4000


@small
def test_suffix_query(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(6)) for _ in range(n))
    short, long = prose(51).replace("é", "e"), prose(58).replace("é", "e")  # both over 50 words; 356 and 405 bytes
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    texts |= {-k: f"{prose(20 * k)} {long if k > 3 else short} {prose(150 // k)}" for k in range(1, 7)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw, seen = {i: (t or "").encode() for i, t in texts.items()}, {}
    for t in raw.values():
        for k in range(len(t) - 399):
            h = hash(t[k : k + 400])
            seen[h] = seen.get(h, 0) + 1
    want = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        want[i] = (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    got = queries.QUERIES["op2_suffix_dedup"](spark, str(tmp_path))
    assert {r[0]: tuple(r)[1:] for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want and got.count() == len(texts)
    # A passage of over 50 words goes where it has 400 bytes, and only there; n_bytes is the whole text's length in either case.
    assert [want[-k][1] for k in range(1, 4)] == [0] * 3 and all(want[-k][1] >= 405 and want[-k][2] == 1 for k in range(4, 7))


def test_order_of_ties_against_plain_sorting():
    rng = random.Random(3)
    for _ in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(rng.choice([450, 700])))
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) + base[rng.randint(0, 30) :] + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 500))) for _ in range(rng.randint(1, 12))]
        texts = [t for t in dict.fromkeys(texts) if len(t) >= 400]
        n = [len(t) - 399 for t in texts]
        count = {}
        for t, m in zip(texts, n, strict=True):
            for k in range(m):
                count[t[k : k + 400]] = count.get(t[k : k + 400], 0) + 1
        got = suffix_dedup.repeats(texts, n) if texts else []
        assert [x.tolist() for x in got] == [[count[t[k : k + 400]] > 1 for k in range(m)] for t, m in zip(texts, n, strict=True)]


@small
def test_packing_query(spark):
    import array

    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], p, s, len(ids[s : s + 2048]), zlib.crc32(array.array("I", ids[s : s + 2048]).tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = queries.QUERIES["op8_best_fit_packing"](spark, f"{DATA}/sf0.001")
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    bins = {}
    for r in got.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048 for v in bins.values())
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_packing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "w" * 300_000, 1), (1, "w" * 300_000, 1), (None, None, 2), (2, "", 3)], "doc_id long, text string, piece int")
    got = packing.pack(docs).collect()
    assert sorted({(r["doc_id"], r["piece"]) for r in got if r["doc_id"] is None or r["doc_id"] == 2}, key=repr) == [(2, 0), (None, 0)]
    big = [r for r in got if r["doc_id"] == 1]
    assert len(big) % 2 == 0 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    chunks = packing.Chunks(packing_path())
    for k in range(3):  # chunks that are met again are kept, and give the same ids
        assert chunks.encode(f"alpha beta, alpha {k}").tolist() == chunks.tokenizer.encode(f"alpha beta, alpha {k}", add_special_tokens=False).ids + [0]
    assert "alpha" in chunks.words.to_pylist()


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_quality_of_odd_tables(spark):
    text = "plain words of some length here"
    docs = spark.createDataFrame([(1, text, "en", "s", 9.0, "q"), (1, text, "en", "s", 9.0, "q"), (2, None, None, None, 1.0, None), (3, "x " * 200_000, "en", "s", 2.0, "a"), (None, text, "en", "s", 3.0, "b")], "doc_id long, text string, lang string, source string, p_quality double, accepted string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and len({r["p_quality"] for r in got if r["doc_id"] == 1}) == 1 and all(0 <= r["p_quality"] <= 1 for r in got)
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and set(rows(kept, "doc_id", "accepted")) <= {(1, "q"), (2, None), (3, "a"), (None, "b")}
    assert quality.keep_accepted(docs.limit(0), labels).count() == 0


@small
def test_pipeline_against_plain_stages(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, d).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    last = {}
    for i, t in sorted(texts.items()):
        last[fold(t)] = i
    texts = {i: texts[i] for i in last.values()}
    sets = {i: shingles(t) for i, t in texts.items()}
    near = classes(sets, similar(sets))
    texts = {i: t for i, t in texts.items() if near[i] == i}
    items = [x for x in (decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()) if len(x) >= decontaminate.LEAST]
    clean = {i for i, t in texts.items() if not any(decontaminate.myers(x, decontaminate.fold(t))[0] <= len(x) // decontaminate.ERROR_SHARE for x in items)}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == clean and len(clean) < len(good) < docs.count()


def test_pipeline_on_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some plain words that stand here", "en", "s", 5, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (2, "", "en", "s", 0, "y")], "doc_id long, text string, lang string, source string, n_chars long, accepted string")
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, None)], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    for table, n in ((docs, 2), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, f"file://{tmp_path}")
            assert table.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, table, f"file://{tmp_path}").count() == n
