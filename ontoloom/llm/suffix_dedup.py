"""Suffix-array dedup: repeated byte strings of LENGTH or more, by blockwise sorting with difference covers.

1. Cover samples of the texts. Of every PERIOD positions, those in a perfect difference cover are sampled: whatever the
   distance of two equal strings, within PERIOD bytes of their starts both have a sample at the same offset. Samples are
   grouped by a fingerprint of their first LENGTH - PERIOD + 1 bytes, a bucket at a time. A suffix can repeat for LENGTH
   bytes only if a tied sample lies within PERIOD of its start, so the positions of ties alone, without texts, tell which
   suffixes are worth sorting.
2. Suffix buckets. Those suffixes are dealt by the least gram hash of their first LENGTH bytes (equal prefixes share it),
   and neighbouring suffixes with one such anchor travel together as one stretch of text.
3. A bucket is sorted in blocks of whole anchors. Suffixes are ordered by their first DEPTH bytes; longer ties are resolved
   by a second difference cover over the block: its samples are sorted by LENGTH bytes once, with the common prefixes of
   neighbours, and two tied suffixes compare by the ranks of the samples that stand at one offset from both. So a block
   takes DEPTH bytes a suffix and a LENGTH-byte string only for each sample. Neighbours in the order that share LENGTH bytes
   are the repeated strings; every comparison is one of bytes.
Equal stretches of a batch, and of a block, are merged before they are sent or sorted. The distinct stretches around one
anchor meet in one task and one block.

Cases: null text counts as empty; texts shorter than LENGTH lose nothing; rows that repeat an id and a text are copies of
each other; an empty table gives an empty result; long texts are taken whole; other columns are not read. A row is known by
128 bits of its id and text.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ontoloom.llm.common import partitions, row_key, table, written
from ontoloom.llm.near_dedup import among, bucket
from ontoloom.llm.textbatch import BASE, BYTE, INVERSE, U, mix, powers, slices, texts_of

LENGTH, ORDER, GRAM = 400, 17, 32
#: The cover of a block has the period INNER * INNER + INNER + 1, at most DEPTH.
INNER, DEPTH = 5, 32
#: Bytes of text for which one bucket, and one part of the documents, is made; and bytes that are sorted at once.
BUCKET_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20


def difference_cover(p: int = ORDER) -> tuple[int, np.ndarray]:
    """For a prime p: the period p*p + p + 1 and p + 1 residues in which each nonzero difference occurs once (Singer: where powers of a root of a cubic over GF(p) lie in a plane)."""
    v = p * p + p + 1
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                x, found = (1, 0, 0), []
                for k in range(v):
                    if x[2] == 0:
                        found.append(k)
                    x = (c * x[2] % p, (x[0] + b * x[2]) % p, (x[1] + a * x[2]) % p)
                if len(found) == p + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return v, np.array(found)
    raise ValueError(p)


PERIOD, COVER = difference_cover()
KEEP = LENGTH - PERIOD + 1
SMALL, INSIDE = difference_cover(INNER)


class Prefix:
    """Hashes of the substrings of one byte array."""

    def __init__(self, data: np.ndarray, base: int = BASE, inverse: int = INVERSE) -> None:
        self.sum = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * powers(base, len(data))[:-1], out=self.sum[1:])
        self.back = powers(inverse, len(data))

    def at(self, starts, n: int) -> np.ndarray:
        return mix((self.sum[starts + n] - self.sum[starts]) * self.back[starts])


def tied(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def cover_positions(n: int) -> np.ndarray:
    """The samples of a text of n bytes: those with KEEP bytes before its end."""
    at = (np.arange(0, max(0, n - KEEP + 1), PERIOD)[:, None] + COVER).ravel()
    return at[at <= n - KEEP]


def _messages(target, count, who, keys, *columns):
    """One row for each target that occurs: the row keys its entries use, and for each entry the place of its key and the columns, packed."""
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(count + 1))
    out = []
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        at = order[cuts[k] : cuts[k + 1]]
        used, place = np.unique(who[at], return_inverse=True)
        out.append((k, keys[used].tobytes(), place.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes(), *(c[at].tobytes() for c in columns)))
    return out


def _entries(t: pa.Table, *types):
    """Of messages: all keys, for each entry the place of its key, and the columns."""
    keys = [np.frombuffer(x, KEY) for x in t.column("keys").to_pylist()]
    sizes = [len(x) // np.dtype(types[0][1]).itemsize for x in t.column(types[0][0]).to_pylist()]
    who = [np.frombuffer(x, np.uint16 if len(k) < 1 << 16 else np.uint32).astype(np.int64) for x, k in zip(t.column("who").to_pylist(), keys, strict=True)]
    base = np.cumsum([0, *map(len, keys)])
    who = [w + b for w, b in zip(who, base, strict=False)]
    assert list(map(len, who)) == sizes
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(keys, KEY), join(who, np.int64), *(np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in types)


#: A row in messages: its key as two numbers, and the length of its text.
KEY = np.dtype([("k", "u8", 2), ("n", "u4")])
FP = np.dtype("V6")


def samples(docs, buckets: int):
    """docs: _key, _text. Messages (bucket, keys, who, fp, pos, known) of cover samples, dealt by fingerprint. Fingerprints take 48 bits beside the bucket; a chance tie only makes more to sort."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, 4000, 16 << 20):
                rows, fps, pos, who = [], [], [], []
                for key, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                    if len(t) >= LENGTH:
                        at = cover_positions(len(t))
                        fps.append(Prefix(np.frombuffer(t, dtype=np.uint8)).at(at, KEEP))
                        pos.append(at.astype(np.uint32))
                        who.append(np.full(len(at), len(rows)))
                        rows.append((np.frombuffer(key, np.uint64), len(t)))
                if not rows:
                    continue
                keys = np.array(rows, KEY)
                who, fps, pos = map(np.concatenate, (who, fps, pos))
                order = np.argsort(fps, kind="stable")
                who, fps, pos = who[order], fps[order], pos[order]
                again = np.concatenate([[False], fps[1:] == fps[:-1]])
                known = again | np.concatenate([again[1:], [False]])
                target = (np.where(again, mix(keys["k"][who, 0]), fps) % U(buckets)).astype(np.int64)  # later copies need no ranking; they go where their row's key says
                short = (fps // U(buckets)).view(np.uint8).reshape(-1, 8)[:, :6].copy().view(FP).ravel()
                out = _messages(target, buckets, who, keys, short, pos, known)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], ["bucket", "keys", "who", "fp", "pos", "known"])

    return docs.mapInArrow(run, "bucket int, keys binary, who binary, fp binary, pos binary, known binary")


def rank(parts: int):
    """Groups one bucket of samples and hands on the tied ones, dealt by their rows' keys."""

    def run(t: pa.Table) -> pa.Table:
        keys, who, fp, pos, known = _entries(t, ("fp", FP), ("pos", np.uint32), ("known", bool))
        wide = np.zeros((len(fp), 8), np.uint8)
        wide[:, :6] = fp.view(np.uint8).reshape(-1, 6)
        keep = tied(wide.view(np.uint64).ravel()) | known
        who, pos = who[keep], pos[keep]
        out = _messages((mix(keys["k"][who, 0]) % U(parts)).astype(np.int64), parts, who, keys, pos)
        cols = zip(*out, strict=True) if out else ((),) * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "keys", "who", "pos"])

    return run


def open_suffixes(n: int, ties: np.ndarray) -> np.ndarray:
    """[first, last + 1) of the suffixes of a text of n bytes that have a tied sample (by position) within PERIOD."""
    end = n - LENGTH + 1
    step = np.zeros(end + 1, dtype=np.int32)
    np.add.at(step, np.minimum(np.maximum(ties.astype(np.int64) - PERIOD + 1, 0), end), 1)
    np.add.at(step, np.minimum(ties.astype(np.int64) + 1, end), -1)
    free = np.cumsum(step)[:-1] > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).reshape(-1, 2)


def windows(t: pa.Table) -> pa.Table:
    """(_key, ranges): the suffixes worth sorting of each row of one part; rows without any are left out."""
    keys, who, pos = _entries(t, ("pos", np.uint32))
    names, place = np.unique(keys, return_inverse=True)
    row = place[who]
    order = np.argsort(row, kind="stable")
    row, pos = row[order], pos[order]
    cuts, out = np.searchsorted(row, np.arange(len(names) + 1)), []
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        found = open_suffixes(int(names["n"][k]), pos[a:z]) if z > a else ()
        if len(found):
            out.append((names["k"][k].tobytes(), found.astype(np.int64).tobytes()))
    cols = zip(*out, strict=True) if out else ((),) * 2
    return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in cols], ["_k", "ranges"])


def stretches(data: np.ndarray, first: int, end: int) -> np.ndarray:
    """(anchor hash, start, suffixes) of neighbouring suffixes from first up to end that share an anchor."""
    width = LENGTH - GRAM + 1
    grams = Prefix(data[first : end + LENGTH - 1]).at(np.arange(end - first + width - 1), GRAM)
    ranked = (grams >> U(31) << U(31)) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    blocks = np.full(-(-len(ranked) // width) * width, ~U(0))
    blocks[: len(ranked)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = end - first
    anchor = (np.minimum(behind[:n], ahead[width - 1 : n + width - 1]) & U((1 << 31) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return np.stack([grams[anchor[new]].astype(np.int64), first + new, np.diff(np.append(new, n))], axis=1)


CONTEXT = {"bucket": pa.int32(), "anchor": pa.int64(), "_key": pa.binary(), "start": pa.int64(), "n": pa.int64(), "known": pa.bool_(), "ctx": pa.binary()}


def contexts(marked, buckets: int):
    """Each stretch with its text; of equal ones in a batch, one travels with its text and others without. marked: _key, _text, ranges."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, 2000, 4 << 20):
                rows, seen = [], {}
                for key, text, ranges in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                    data = np.frombuffer(text, dtype=np.uint8)
                    for first, end in np.frombuffer(ranges, dtype=np.int64).reshape(-1, 2).tolist():
                        for h, start, n in stretches(data, first, end).tolist():
                            ctx = text[start : start + n + LENGTH - 1]
                            if ctx in seen:
                                rows[seen[ctx]][5] = True
                                rows.append([int.from_bytes(key[:4], "little") % buckets, 0, key, start, n, True, None])
                            else:
                                seen[ctx] = len(rows)
                                rows.append([h % buckets, h, key, start, n, False, ctx])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), CONTEXT.values(), strict=True)], list(CONTEXT))

    return marked.select("_key", "_text", "ranges").mapInArrow(run, "bucket int, anchor long, _key binary, start long, n long, known boolean, ctx binary")


def first_bytes(data: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The rank of each spot's first DEPTH bytes among the spots, by doubling from 8 bytes on. data is padded by DEPTH bytes."""
    n = len(data) - DEPTH
    words = np.zeros(n + DEPTH - 7, dtype=np.uint64)
    for k in range(8):
        words |= data[k : k + len(words)].astype(np.uint64) << U(56 - 8 * k)
    names, depth = np.unique(words, return_inverse=True)[1].astype(np.uint64), 8
    while depth < DEPTH:
        at = spots if 2 * depth == DEPTH else np.arange(len(names) - depth)
        names = np.unique(names[at] << U(32) | names[at + depth], return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    return names


class Cover:
    """Order and common prefixes of the suffixes of a block, by its cover samples. data is padded by LENGTH bytes; ends: where each byte's context ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        v, self.inside = SMALL, np.zeros(SMALL, bool)
        self.inside[INSIDE] = True
        # offset[r, s]: the least d for which positions of the residues r and s both have a sample d further on.
        self.offset = np.array([[next(d for d in range(v) if self.inside[(r + d) % v] and self.inside[(s + d) % v]) for s in range(v)] for r in range(v)])
        at = np.arange(len(ends))
        at = at[self.inside[at % v] & (ends - at >= LENGTH - v)]
        size = np.minimum(ends[at] - at, LENGTH)
        raw = data.tobytes()
        strings = [raw[p : p + n] for p, n in zip(at.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(len(at)), key=strings.__getitem__), dtype=np.int64)
        self.rank = np.zeros(len(ends), dtype=np.int64)
        self.rank[at[order]] = np.arange(len(order))
        at, size = at[order], size[order]
        lcp = np.zeros(len(at), dtype=np.uint16)  # with the one before
        view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        for k in range(1, len(at), 1 << 14):
            z = min(len(at), k + (1 << 14))
            differ = view[at[k:z]] != view[at[k - 1 : z - 1]]
            lcp[k:z] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH), np.minimum(size[k:z], size[k - 1 : z - 1]))
        self.least = [lcp]  # least[j][k]: of lcp[k : k + 2 ** j]
        while 2 << len(self.least) - 1 <= len(at):
            last, w = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-w], last[w:]))

    def compare(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of suffixes that share DEPTH bytes: whether x comes after y, and whether they share LENGTH bytes."""
        d = self.offset[x % SMALL, y % SMALL]
        a, b = self.rank[x + d], self.rank[y + d]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.log2(hi - lo).astype(np.int64) if len(lo) else lo
        common = np.zeros(len(lo), np.int64)
        for j in np.unique(level).tolist():
            k = np.flatnonzero(level == j)
            common[k] = np.minimum(self.least[j][lo[k]], self.least[j][hi[k] - (1 << j)])
        same = common >= LENGTH - d
        return (a > b) & ~same, same


def order_ties(spots: np.ndarray, group: np.ndarray, cover: Cover) -> np.ndarray:
    """spots in the order of their LENGTH bytes within each group (groups stand together), by merge exchange in all groups at once."""
    spots = spots.copy()
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    for t in range(1, int(sizes.max(initial=1) - 1).bit_length() + 1):
        mine = np.flatnonzero((sizes > 1 << t - 1) & (sizes <= 1 << t))
        if not len(mine):
            continue
        size = np.repeat(sizes[mine], sizes[mine])
        at = np.repeat(starts[mine], sizes[mine])
        i = np.arange(len(size)) - np.repeat(np.cumsum(sizes[mine]) - sizes[mine], sizes[mine])
        p = 1 << t - 1
        while p:
            q, r, d = 1 << t - 1, 0, p
            while True:
                k = np.flatnonzero((i + d < size) & (i & p == r))
                x, y = at[k] + i[k], at[k] + i[k] + d
                swap, _ = cover.compare(spots[x], spots[y])
                x, y = x[swap], y[swap]
                spots[x], spots[y] = spots[y], spots[x]
                if q == p:
                    break
                d, q, r = q - p, q >> 1, p
            p >>= 1
    return spots


def repeats(texts: list[bytes], n: list[int]) -> list[np.ndarray]:
    """For each context, which of its n suffixes share LENGTH bytes with another of the block."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + b"\0" * LENGTH, dtype=np.uint8)
    ends = np.repeat(np.cumsum(sizes), sizes)
    start, many = np.cumsum(sizes) - sizes, np.array(n)
    spots = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
    names = first_bytes(data[: len(ends) + DEPTH], spots)
    order = np.argsort(names, kind="stable")
    spots, names = spots[order], names[order]
    pair = names[1:] == names[:-1]
    both = np.concatenate([pair, [False]]) | np.concatenate([[False], pair])
    spots, names = spots[both], names[both]
    hit = np.zeros(len(ends), bool)
    if len(spots):
        cover = Cover(data, ends)
        neighbour = np.flatnonzero(names[1:] == names[:-1])
        _, same = cover.compare(spots[neighbour], spots[neighbour + 1])
        # Where all neighbours are equal, or just two met, the order makes no difference.
        group = np.cumsum(np.concatenate([[True], names[1:] != names[:-1]])) - 1
        unequal = np.bincount(group[neighbour[~same]], minlength=group[-1] + 1)
        loose = ((unequal > 0) & (np.bincount(group) > 2))[group]
        if loose.any():
            spots[loose] = order_ties(spots[loose], group[loose], cover)
            _, same = cover.compare(spots[neighbour], spots[neighbour + 1])
        hit[spots[neighbour[same]]] = True
        hit[spots[neighbour[same] + 1]] = True
    return [hit[a : a + k] for a, k in zip(start.tolist(), n, strict=True)]


def sort_bucket(t: pa.Table) -> pa.Table:
    """Sorts the suffixes of one bucket block by block; (_key, spans): pairs of first and last repeated suffix, as packed integers."""
    anchor, start, n, known = (t.column(c).to_pylist() for c in ("anchor", "start", "n", "known"))
    ctx, keys = t.column("ctx").to_pylist(), t.column("_key").to_pylist()
    out = [(keys[k], np.array([start[k], start[k] + n[k] - 1]).tobytes()) for k in range(len(keys)) if known[k]]
    first, again = {}, set()  # equal contexts of several batches
    for k, c in enumerate(ctx):
        if c is not None:
            if c in first:
                again.update((k, first[c]))
            else:
                first[c] = k
    out += [(keys[k], np.array([start[k], start[k] + n[k] - 1]).tobytes()) for k in again if not known[k]]
    own = sorted(first.values(), key=lambda k: anchor[k])

    def sort(block):
        for k, hit in zip(block, repeats([ctx[k] for k in block], [n[k] for k in block]), strict=True):
            if not known[k] and k not in again and hit.any():
                spans = start[k] + np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2) - [0, 1]
                out.append((keys[k], spans.astype(np.int64).tobytes()))

    block, size = [], 0
    for j, k in enumerate(own):
        if size >= BLOCK_BYTES and anchor[k] != anchor[own[j - 1]]:
            sort(block)
            block, size = [], 0
        block.append(k)
        size += len(ctx[k])
    if block:
        sort(block)
    return pa.Table.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["_key", "spans"])


def removed(text: bytes, spans: list[bytes] | None) -> np.ndarray:
    """Maximal runs [start, end) of removed bytes."""
    s = np.frombuffer(b"".join(spans or []), dtype=np.int64).reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    ends = np.maximum.accumulate(s[:, 1] + LENGTH) if len(s) else s[:, 1]
    first = np.concatenate([[True], s[1:, 0] > ends[:-1]]) if len(s) else np.zeros(0, bool)
    return np.stack([s[first, 0], np.append(ends[np.flatnonzero(first)[1:] - 1], ends[-1:])], axis=1) if len(s) else s


def repeated_spans(df, id_col="doc_id", text_col="text"):
    """_id, _text and spans (a list of packed pairs) of each row. Only texts with suffixes worth sorting are shuffled."""
    docs = df.select(row_key(df[id_col], df[text_col]).alias("_key"), df[id_col].alias("_id"), df[text_col].alias("_text"))
    total = df.agg(F.sum(F.octet_length(df[text_col]))).first()[0] or 0
    parts = max(partitions(df.sparkSession), math.ceil(total / BUCKET_BYTES))
    ties = samples(docs.select("_key", "_text"), parts).groupBy("bucket").applyInArrow(rank(parts), "part int, keys binary, who binary, pos binary")
    found = written(ties.groupBy("part").applyInArrow(windows, "_k binary, ranges binary"), "windows")
    may = among(docs, "_key", found, "_k")
    marked = written(may.join(found, F.col("_key") == F.col("_k"), "left").select("_key", "_id", "_text", "ranges"), "marked")
    spans = contexts(marked.where("ranges is not null"), parts).groupBy("bucket").applyInArrow(sort_bucket, "_key binary, spans binary")
    spans = written(spans.groupBy(F.col("_key").alias("_k")).agg(F.collect_list("spans").alias("spans")), "spans")  # of one text
    some = marked.join(spans, F.col("_key") == F.col("_k"), "left").select("_id", "_text", "spans")
    taken = F.broadcast(found.select(bucket("_k").alias("_bucket")).distinct())
    never = docs.join(taken, bucket("_key") == F.col("_bucket"), "left_anti")
    return some.unionByName(never.select("_id", "_text", F.lit(None).cast("array<binary>").alias("spans")))


def op2_suffix_dedup(spark, sf_dir):
    rows = repeated_spans(table(spark, sf_dir, "documents"))

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                runs = removed(text, spans).tolist()
                keep, at = hashlib.sha256(), 0
                for a, z in runs:
                    keep.update(text[at:a])
                    at = z
                keep.update(text[at:])
                out.append((len(text), sum(z - a for a, z in runs), len(runs), keep.hexdigest()))
            cols = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
