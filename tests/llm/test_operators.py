import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from ontoloom.llm import decontaminate, exact_dedup, license_scan, near_dedup, packing, quality, secret_scan, suffix_dedup, url_filter, warc
from ontoloom.llm.textbatch import shingle_sets

WORDS = [f"w{k}" for k in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, node int"


def corpus(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, rows = text(150), [None, "", "one", "One", "two words", "ÀÉ é\u0301 \x1c😀"]
    for _ in range(12):
        t = text(rng.randint(5, 120))
        rows += [t, t.upper(), t + " end", t.replace("w1", "x", 1)]
    rows += [text(40) + " " + passage + " " + text(30) for _ in range(5)] + [passage * 3, "a" * 1500]
    out = [(k, t, "en", f"s{k % 3}", 0, "clash", 1) for k, t in enumerate(rows)]
    return out + [out[8], (None, "one", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_exact_dedup(spark, docs):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for r in corpus():
        groups.setdefault(norm(r[1]), []).append(r[0])
    best = {t: max((i for i in v if i is not None), default=None) for t, v in groups.items()}
    want = [(r[0], best[t := norm(r[1])], len(groups[t]), r[0] == best[t], hashlib.sha256(t.encode()).hexdigest()) for r in corpus()]
    assert rows(exact_dedup.duplicate_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0


def crowd(seed=9):
    """Texts that share a passage and are mostly just below the threshold to each other, with chains of near copies between."""
    rng = random.Random(seed)
    word = lambda: f"u{rng.randrange(10**6)}"
    passage, out = [word() for _ in range(80)], []
    for k in range(220):
        own = [word() for _ in range(rng.randint(14, 30))]
        if out and k % 5 == 0:
            own = out[rng.randrange(len(out))][80:]
            own[rng.randrange(len(own))] = word()
        out.append(passage + own)
    return [(k, " ".join(t), "en", "s", 0, "clash", 1) for k, t in enumerate(out)]


@pytest.mark.parametrize("data", [corpus, crowd])
def test_near_dedup_against_all_pairs(spark, data):
    docs = spark.createDataFrame(data(), DOCS).repartition(3)
    sets = {}
    for r in data():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        sets.setdefault(r[0], {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    inf = 10**9
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if (x := len(sets[a] & sets[b])) and 100 * x >= 75 * len(sets[a] | sets[b])]
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b], key=lambda i: inf if i is None else i)
                changed = True
    got = near_dedup.near_duplicates(docs).collect()
    assert all(r["component_id"] == comp[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    assert len(got) == len(data()) and len(set(comp.values())) > 20
    if data is corpus:
        assert near_dedup.deduplicate(docs).columns == docs.columns
        assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def variants(n, seed=4):
    """A text of 150 words and n copies, each with up to 5 words changed: copies with few changes are linked, others with some of these only."""
    rng = random.Random(seed)
    base, out = [f"v{rng.randrange(10**6)}" for _ in range(150)], []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(150)] = f"c{rng.randrange(10**6)}"
        out.append((k, " ".join(t), "en", "s", 0, "clash", 1))
    return out


def test_near_dedup_confirms_few_pairs_of_a_large_group(spark, monkeypatch):
    counts = []
    real = near_dedup.confirm

    def confirm(pairs, *rest):
        counts.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirm", confirm)
    near_dedup.near_duplicates(spark.createDataFrame(variants(600), DOCS).repartition(3))
    assert sum(counts) < 40 * 600


def test_suffix_dedup_against_counting(spark, docs):
    texts, seen = [(r[0], (r[1] or "").encode()) for r in corpus()], {}
    for _, t in texts:
        for k in range(len(t) - 399):
            seen[t[k : k + 400]] = seen.get(t[k : k + 400], 0) + 1
    want = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        want.append((i, list(map(tuple, edge.reshape(-1, 2).tolist()))))
    got = [(r["_id"], list(map(tuple, suffix_dedup.removed(b"", r["spans"]).tolist()))) for r in suffix_dedup.repeated_spans(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(len(x[1]) for x in got) >= 7
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_difference_cover():
    v, d = suffix_dedup.difference_cover(5)
    assert v == 31 and sorted((i - j) % v for i in d for j in d if i != j) == list(range(1, 31))


def test_secrets(spark):
    weak = "Ab1" * 8
    texts = [None, "", "secret:token:abcdefgh1", "PASSWORD = 'abcd.efgh' AKIA" + "A1" * 8, "x" + "0a" * 16 + "g", f"key {weak} only", f"login: bob\nkey {weak}", "login: bob", "ſecret=abcdefghij"]
    got = {r["k"]: ([tuple(x) for x in r["base"]], [tuple(x) for x in r["linked"]]) for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()}
    assert got[0] == got[1] == got[2] == got[8] == ([], [])
    assert [x[1] for x in got[3][0]] == ["assign", "access"] and got[4][0] == [(1, "hex", 33)]
    assert got[5][1] == got[7][1] == [] and [x[1] for x in got[6][1]] == ["identifier", "secret"]


def test_linked_secrets_against_all_pairs():
    rng, some = random.Random(6), 0
    parts = ["login: bob", " key " + "Ab1" * 8 + " ", "token=" + "aB1" * 8 + "." * 500, " " * 300, "." * 250, "\n\n", " AKIA" + "A1" * 8 + " ", " https://api.example.com/x "]
    texts = ["token=" + "aB1" * 8 + "." * 500 + " login: bob"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    for t in texts:
        base = secret_scan.base_spans(t)
        find = lambda k, p: [(m.start(), k, m.end()) for m in p.finditer(t)]
        secrets, others = find(4, secret_scan.WEAK_SECRET), find(3, secret_scan.WEAK_ID) + find(5, secret_scan.ENDPOINT)
        scope = lambda x: len(re.findall(r"\n[ \t]*\n", t[: x[0]]))
        near = lambda xs, ys: [x for x in xs if any(scope(x) == scope(y) and max(y[0] - x[2], x[0] - y[2]) <= secret_scan.WINDOW for y in ys)]
        want = near(secrets, others + [b for b in base if b[1] == 1]) + near(others, secrets + [b for b in base if b[1] != 1])
        assert secret_scan.linked_spans(t, base) == sorted(want)
        some += len(want)
    assert some > 100 and (531, 3, 541) in secret_scan.linked_spans(texts[0], secret_scan.base_spans(texts[0]))


def test_licenses_against_scan(spark):
    rng = random.Random(1)
    pool = "under the mit license apache version 2 0 cc by nc 4 licensed released all rights reserved gnu general public 3 Ünder x".split()
    texts = [None, "", "UNDER the MIT-License under the mit license"] + [" ".join(rng.choice(pool) + rng.choice(["", ".", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    wrapped = "This work is licensed under the GNU General\nPublic License version 3"
    mit = dict(license_scan.TEXTS[:1])["mit"]
    texts += [wrapped, mit.replace(" ", "\n"), "x " * 3000 + mit.replace("software", "thing", 1) + " y" * 3000, "all " + "z " * 40 + "rights reserved"]
    data = [(k, t, "clash") for k, t in enumerate(texts)] + [(2, texts[2], "a"), (None, "all rights reserved", "b")]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    want, seen = [], set()
    for k, t, _ in data:
        words = find(t or "")
        places = [(i, v) for p, v in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        found = {}
        for label, x in license_scan.TEXTS:
            own = find(x)
            size = 2
            while size < 2 * len(own):
                size *= 2
            for i in range(0, len(words), size // 2):
                share = len(set(words[i : i + size]) & set(own)) / len(set(own))
                if share >= license_scan.THRESHOLD:
                    found[label] = max(share, found.get(label, 0))
        base, at = {v for _, v in places}, [i for i, _ in places]
        seen |= set(found)
        want.append((k, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if at else max(found.values(), default=0.0)))
    docs = spark.createDataFrame(data, "doc_id long, text string, label string")
    got = rows(license_scan.scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == sorted(want, key=repr)
    assert {"gpl-3", "mit", "all-rights-reserved"} <= seen and next(w for w in want if w[0] == len(texts) - 1)[6] == ""
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    own = license_scan.scan_licenses(docs, templates=spark.createDataFrame([("mine", "x x x"), (None, None)], "label string, text string"))
    assert own.where("contains(labels, 'mine')").count() >= 1


def test_edit_matching(spark):
    rng = random.Random(2)
    for _ in range(50):
        p, t = ("".join(rng.choice("ab ") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 25)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        assert decontaminate.myers(p, t)[0] == min(row)
    item = " ".join(rng.choice(WORDS) for _ in range(50))
    docs = spark.createDataFrame([(1, None), (2, item[:100]), (3, "a " + item.upper() + " z"), (4, "q" + item[:90] + "#" + item[91:])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert rows(decontaminate.find_leaks(docs, bench), "doc_id", "item_id", "distance") == [(3, 7, 0), (4, 7, 1)]
    assert rows(decontaminate.decontaminate(docs, bench), "doc_id") == [(1,), (2,)]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_warc_round_trip(spark):
    import base64

    data = [(1, "http://a", "x" * 10), (2, None, None), (3, "u", "x" * 10), (3, "u", "x" * 10), (4, "u", ""), (5, "u\r\nv", "é" * 300_000), (None, None, "y"), (6, "u", "z" * 3_000_000)]
    best = {}
    for i, _, p in data:
        best[p or ""] = max((x for x in (i, best.get(p or "")) if x is not None), default=None)
    many = {p: sum((q or "") == p for _, _, q in data) for p in best}
    want = []
    for i, _, p in data:
        raw = (p or "").encode()
        revisit = many[p or ""] > 1 and i != best[p or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best[p or ""] if revisit else None))
    pages = spark.createDataFrame([(*r, "q", 1, 2) for r in data], "page_id long, url string, html string, _record string, _id int, _digest int")
    index, folder = warc.archive(pages)
    got = rows(warc.read_bundles(index, folder), "_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(want, key=repr)
    names = [r["_record"] for r in index.collect()]
    assert len(set(names)) == len(names) == len(data)
    one = index.where("_page = '6'").select("_record")
    found = warc.lookup(index, folder, one).collect()
    assert len(found) == 1 and bytes(found[0]["payload"]) == b"z" * 3_000_000 and found[0]["headers"]["WARC-Type"] == "response"
    assert warc.lookup(index, folder, one.limit(0)).count() == 0 and warc.archive(pages.limit(0))[0].count() == 0
    odd = spark.createDataFrame([("", "u", "a"), ("a b%/é", "u", "a"), (None, "u", "c")], "page_id string, url string, html string")
    assert rows(warc.read_bundles(*warc.archive(odd), "string"), "_id", "refers_to") == sorted([("", "a b%/é"), ("a b%/é", None), (None, None)], key=repr)


def test_seek_table_finds_frames(tmp_path):
    import io

    import zstandard

    press, data = zstandard.ZstdCompressor(), [b"a" * 1000, b"b" * 5, b""]
    frames = [press.compress(d) for d in data]
    raw = b"".join(frames) + warc.seek_table([(len(f), len(d)) for f, d in zip(frames, data, strict=True)])
    table = warc.read_seek_table(io.BytesIO(raw), len(raw))
    assert [zstandard.ZstdDecompressor().decompress(raw[a : a + n], max_output_size=2000) for a, n in table] == data
    with pytest.raises(ValueError):
        warc.read_seek_table(io.BytesIO(b"x" * 50), 50)


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    rng = random.Random(4)
    for _ in range(5):
        counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(20)}
        plan = packing.plan_bins(counts, 100)
        used = {}
        for combo, times in plan:
            assert sum(n * k for n, k in combo) <= 100
            for n, k in combo:
                used[n] = used.get(n, 0) + k * times
        assert used == counts
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    chunks = packing.Chunks(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus() + [(0, "it's  <|endoftext|> A\u00a0b\tΣΑΣ x\x85y 12.5%\r\n")]:
        assert chunks.encode(r[1] or "").tolist() == t.encode(r[1] or "", add_special_tokens=False).ids + [0]
    got = packing.pack(docs, capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    room = []  # first fit decreasing
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, x in enumerate(room) if x >= n), None)
        if k is None:
            room.append(64 - n)
        else:
            room[k] -= n
    assert len(by) <= len(room)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_texts_that_are_not_folded_at_once():
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t, chunks = Tokenizer.from_file(path), packing.Chunks(path)
    for text in ["İstanbul Is A City", "The sum Σ Is Hello, World.", "ΟΔΟΣ Hello", "<|ENDOFTEXT|> Hello", "Hello <|endoftext|> World", "Hello World"]:
        assert chunks.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids + [0]


def test_packing_takes_ids_in_blocks(monkeypatch):
    import tracemalloc

    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t, chunks = Tokenizer.from_file(path), packing.Chunks(path)
    texts = [f"Lorem ipsum, dolor {k % 97} sit amet. " * 50 for k in range(1500)]
    tracemalloc.start()
    ids, at = chunks.encode_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(map(len, texts))  # 10.5 times where all ids are put together at once
    assert len(at) == len(texts) + 1 and at[-1] == len(ids)
    monkeypatch.setattr(packing, "GROUP", 2)
    for block in (1, 2, 3, 5):  # texts that end in, at and beyond the edges of blocks
        monkeypatch.setattr(packing, "BLOCK", block)
        some = ["", "a b", "One two. three, four", "", "x.", " ", "five  six\nseven.", "e"]
        ids, at = packing.Chunks(path).encode_all(some)
        want = [t.encode(x, add_special_tokens=False).ids + [0] for x in some]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert [x.tolist() for x in chunks.encode_all([])] == [[], [0]]


def test_url_filter_against_all_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/en/12?x", "https://a.example.org/es/x", "http://org/", "http://org", "http://b.com/fr/#z", "http://b.com/de/", "http://m.free-bets.example.com/x", "x://notexample.org/en/1", "http://xorg/"]
    urls += ["http://a b.org/", "http://a\nb.org/x", "http://.org/", "http://x.net/CASINO/1", "http://casinos2.net/", "http://casino.org/", "http://example.org/EN/1", "http://org/" + "a" * 100_000, "http://é.com/fr/", "http://Example.ORG/en/12?x"]

    def judge(url):
        host, path = url_filter.split_url(url)
        fits = [(len(a), v, a) for v, a in url_filter.ADDRESSES for h, p in [a.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fits:
            return host, path, max(fits)[2], max(fits)[1]
        spam = set(re.findall("[0-9a-z]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in host + path))) & set(url_filter.SPAM_WORDS)
        return host, path, None, "block" if spam else "allow"

    pages = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(urls)] + [(1, "http://org/", "r", "v")], "page_id long, url string, rule string, host string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()), key=repr)
    assert got == sorted([(k, *judge(u)) for k, u in enumerate(urls)] + [(1, *judge("http://org/"))], key=repr)
    by = {g[0]: g for g in got}
    assert by[3][3] == "example.org/en/1" and by[6][3] is None and by[9][4] == "block" and by[10][3] == "org/" and by[12][3] == "org/" and by[15][4] == "block" and by[17][4] == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_rules():
    fits = lambda rule, host, path: bool(re.search(url_filter.parse_rule(rule).pattern, (host + path).lower(), re.S))
    assert fits("||ads.com^", "ads.com", "/x") and fits("||ads.com^", "a.ads.com", "") and not fits("||ads.com^", "bads.com", "/") and not fits("||ads.com^", "ads.com.net", "/")
    assert fits("||x.com/a*z^", "x.com", "/abcz/") and not fits("||x.com/a*z^", "x.com", "/abczy") and fits("/banner/*/img", "h", "/q/banner/1/img") and fits("^pills^", "cheap-pills.com", "/")
    assert url_filter.parse_rule("@@||x.com/ab").verdict == "allow" and url_filter.parse_rule("||x.com/ab/cd").tokens == ("x", "com", "ab") and url_filter.parse_rule("ab-cd-ef").tokens == ("cd",)
    index = url_filter.RuleIndex([url_filter.parse_rule("||a.com/x/"), url_filter.parse_rule("||b.com/x/")], {"com": 99, "x": 50, "a": 1, "b": 2})
    assert set(index.by_token) == {"a", "b"} and index.judge("a.com", "/x/y")[1:] == (1, 1) and index.judge("c.com", "/x/")[1:] == (0, 0)


def test_url_rules_from_a_table(spark):
    lines = spark.createDataFrame([("! comment",), (None,), (" ||a.com^ ",), ("||a.com^",), ("",)], "rule string")
    assert [r.pattern for r in url_filter.read_rules(lines)] == [url_filter.parse_rule("||a.com^").pattern]


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((got["p_quality"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95
    assert got["accepted"].sum() > 0
    odd = spark.createDataFrame([(1, None, None, None, "z"), (2, "", "en", "q", "z")], "doc_id long, text string, lang string, source string, extra string")
    assert quality.classify(odd, labels).count() == 2
    assert quality.classify(odd, labels.limit(0)).where("accepted").count() == 2
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_quality_of_a_path_without_labels(spark, monkeypatch):
    good = {"bad": 40, "a": 170, "b": 180, None: 160}
    docs = [(1000 * h + k, "some plain words", "en", s) for h, s in enumerate(good) for k in range(200)]
    labels = [(1000 * h + k, int(k < n), 0) for h, n in enumerate(good.values()) for k in range(200)]
    odd = [(9001, "some plain words", "fr", "bad"), (9002, "some plain words", None, "bad"), (9003, "some plain words", "fr", None), (9004, "some plain words", "fr", "new")]
    docs = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rate = (sum(good.values()) + 1) / 802
    rates = [n / 200 for n in good.values()]
    weight = min(max(rate * (1 - rate) / (np.var(rates) - rate * (1 - rate) / 200) - 1, 5), 1000)
    logit = lambda p: np.log(p / (1 - p))
    host = lambda n: logit((n + weight * rate) / (200 + weight)) - logit(rate)
    for most in (quality.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        got = {r["doc_id"]: logit(r["p_quality"]) for r in quality.classify(docs, labels).where("doc_id > 9000").collect()}
        assert got[9001] - got[9004] == pytest.approx(host(40)) and got[9002] == got[9001] and host(40) < -1.5
        assert got[9003] - got[9004] == pytest.approx(host(160))


def test_shingles_of_short_texts():
    assert [len(s) for s in shingle_sets([b"", b" ", b"a", b"a b c d", b"a b c d e", b"a a a a a a"])] == [0, 0, 1, 1, 1, 1]
