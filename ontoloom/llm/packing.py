"""Best-fit packing by minimum bin slack.

Token pieces are described by their lengths alone, and lengths are at most `capacity`, so the driver plans over a bounded
histogram: for each bin, a subset-sum bitset over the lengths still available finds the fullest feasible combination,
which is removed as often as the counts allow. Pieces then take the places of their length in order of their ordinal,
which comes from counts by (task, length) summed in a window; no group of pieces is gathered.
Tokenising goes by the distinct white-space-separated chunks of a slice of about 1 MB, which the tokenizer never merges,
with a cache bounded in bytes; ids are put together in blocks of chunks, so that a worker holds little besides them.

Cases: null text counts as empty (one closing token); repeated rows are packed as separate documents, null ids too; an empty
table gives an empty result; long texts are cut into pieces of the capacity; pieces of one length tie and take their places
in the order of their tasks; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ontoloom.llm.common import table, written
from ontoloom.llm.textbatch import slices

CAPACITY = 2048
#: Bytes of chunks and ids that a worker keeps; longer chunks than CHUNK are not kept.
CACHE, CHUNK = 24 << 20, 64
#: New chunks tokenised at once, and chunks whose ids are put together at once: these bound the memory besides the texts and ids.
GROUP, BLOCK = 1024, 1 << 15
#: Bits that tell whether a chunk was met before: only those met again are kept.
MET = 1 << 22
#: A full stop or comma after a letter at the end of a chunk is a token of its own.
STOP = r"[a-z][.,]\z"
#: One cache for each worker process and vocabulary; it lives on from task to task.
_CHUNKS: dict[str, Chunks] = {}


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, how many), ...), bins)]: fullest combination first, each taken as often as it can be."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        # Binary splitting of multiplicities; after each item, the bitset of reachable sums. The largest length is in every bin.
        first = max(left)
        rest = capacity - first
        sums, items, full = 1, [], (1 << (rest + 1)) - 1
        for n in sorted(left, reverse=True):
            m, k = min(left[n] - (n == first), rest // n), 1
            while m > 0:
                k = min(k, m)
                items.append((n, k, sums))
                sums |= (sums << (n * k)) & full
                m, k = m - k, 2 * k
            if sums >> rest & 1:
                break
        at, used = sums.bit_length() - 1, defaultdict(int, {first: 1})
        for n, k, before in reversed(items):
            if not before >> at & 1:
                used[n] += k
                at -= n * k
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((tuple(sorted(used.items(), reverse=True)), times))
    return plan


class Chunks:
    """Token ids of texts, by their distinct white-space-separated chunks. The cache is dropped when it holds CACHE bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.met = Tokenizer.from_file(path), np.zeros(MET, bool)
        (self.dot,), (self.comma,) = (self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,")
        self.drop()

    def drop(self) -> None:
        """Empties the cache: words, and for each its number of ids and where they begin in ids."""
        self.words, self.size = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.ids, self.met[:] = np.zeros(0, np.uint32), False

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(many, ids, mark) of words: how many ids each has, the ids one after another, and its bit among met. Python objects live for one group of words only."""
        tokenize, many, ids, mark = self.tokenizer.model.tokenize, np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
        for k in range(0, len(words), GROUP):
            group = words.slice(k, GROUP)
            plain = pc.match_substring_regex(group, "^[a-z]+$").to_pylist()  # nothing splits or changes these before the model
            out = group.to_pylist()
            coded = iter([e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(out, plain, strict=True) if not p], add_special_tokens=False)])
            found = [[t.id for t in tokenize(w)] if p else next(coded) for w, p in zip(out, plain, strict=True)]
            many[k : k + len(out)] = [len(x) for x in found]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, many[k : k + len(out)].sum()))
            mark[k : k + len(out)] = [hash(w) & (MET - 1) for w in out]
        return many, np.concatenate([*ids, np.zeros(0, np.uint32)]), mark

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, ids): the ids of distinct word k are ids[first[k] : first[k] + size[k]]; one 0 follows them all."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        many, fresh, marks = self.tokens(new)
        ids = np.concatenate([self.ids, fresh, np.zeros(1, np.uint32)])
        place = np.asarray(at.fill_null(0)).astype(np.int64)
        place[np.asarray(at.is_null())] = len(self.words) + np.arange(len(new))
        size = np.concatenate([self.size, many])
        first = np.cumsum(size) - size
        again = self.met[marks] & (np.asarray(pc.binary_length(new)) <= CHUNK)
        self.met[marks] = True
        self.words = pa.concat_arrays([self.words, new.filter(pa.array(again))])
        self.size = np.concatenate([self.size, many[again]])
        self.ids = np.concatenate([self.ids, fresh[np.repeat(again, many)]])
        if self.words.nbytes + self.ids.nbytes + self.size.nbytes > CACHE:
            self.drop()
        return first[place], size[place], ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, at): the ids of text k and the closing 0 are ids[at[k]:at[k + 1]]."""
        # The lower case of these two depends on more than themselves, and special tokens are looked for before lower-casing.
        texts = [(t if "\u0130" in t or "\u03a3" in t or "<|" in t else t.lower()).replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        del texts
        ends, coded = np.asarray(split.offsets)[1:], split.flatten().dictionary_encode()
        del split
        words, code = coded.dictionary, np.asarray(coded.indices)
        stop = pc.match_substring_regex(words, STOP)
        stems = pc.if_else(stop, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        first, size, ids = self.learn(stems.dictionary)
        stem, stop = np.asarray(stems.indices), np.asarray(stop)
        first, size = first[stem], size[stem] + stop
        last = np.where(np.asarray(pc.ends_with(words, ".")), self.dot, self.comma)
        out, at, done = np.zeros(np.bincount(code, minlength=len(size)) @ size + len(ends), np.uint32), [np.zeros(1, np.int64)], 0
        for k in range(0, len(code), BLOCK):
            part = code[k : k + BLOCK]
            each = size[part]
            to = np.concatenate([[0], np.cumsum(each)])
            flat = ids.take(np.repeat(first[part] - to[:-1], each) + np.arange(to[-1]), mode="clip")
            closing = stop[part]
            flat[to[1:][closing] - 1] = last[part[closing]]
            over = to[ends[np.searchsorted(ends, k, "right") : np.searchsorted(ends, k + BLOCK, "right")] - k]  # each text has a chunk at least
            flat = np.insert(flat, over, 0)
            out[done : done + len(flat)] = flat
            at.append(done + over + np.arange(1, len(over) + 1))
            done += len(flat)
        return out, np.concatenate(at)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def pieces(df, id_col, text_col, tokenizer, capacity):
    """_id, piece, start, length, ids_crc32, _task, _nth (among the task's pieces of that length)."""

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _CHUNKS:
            _CHUNKS[tokenizer] = Chunks(tokenizer)
        chunks, task, seen = _CHUNKS[tokenizer], TaskContext.get().partitionId(), defaultdict(int)
        for b in (x for whole in batches for x in slices(whole, 1, 4096, 1 << 20)):
            rows, at = [], []
            every, ends = chunks.encode_all([t or "" for t in b.column(1).to_pylist()])
            for k, ids in enumerate(np.split(every, ends[1:-1])):
                for p, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((p, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    at.append(k)
                    seen[len(part)] += 1
            cols = zip(*rows, strict=True) if rows else ((),) * 6
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])

    source = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    return source.mapInArrow(cut, f"_id {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _task int, _nth long")


def pack(df, id_col="doc_id", text_col="text", tokenizer=None, capacity=CAPACITY):
    """id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kept = written(pieces(df, id_col, text_col, tokenizer, capacity), "pieces")
    counts = kept.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("_task").alias("_t"), F.col("length").alias("_l"), (F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")).alias("_base"))
    total = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, base, used = defaultdict(list), 0, defaultdict(int)
    for combination, times in plan_bins(total, capacity):
        offset = 0
        for n, k in combination:  # the places of length n from used[n] on: k in each of these bins
            slots[n].append((used[n], k, base, offset))
            used[n] += k * times
            offset += n * k
        base += times
    tables = {n: np.array(v, dtype=np.int64) for n, v in slots.items()}

    def place(batches):
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("_place").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, t = np.flatnonzero(length == n), tables[int(n)]
                row = t[np.searchsorted(t[:, 0], nth[at], side="right") - 1]
                within = nth[at] - row[:, 0]
                seq[at] = row[:, 2] + within // row[:, 1]
                off[at] = row[:, 3] + within % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = kept.join(before, (kept["_task"] == before["_t"]) & (kept["length"] == before["_l"])).select("_id", "piece", "start", "length", "ids_crc32", (F.col("_nth") + F.col("_base")).alias("_place"))
    kind = kept.schema["_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("_id", id_col)


def op8_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
