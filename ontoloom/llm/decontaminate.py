"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased in A-Z with white space folded to one space. An item of n characters may differ by
e = n // ERROR_SHARE edits; it is cut into e + 1 pieces, of which one at least occurs unchanged in any match. An
automaton finds all piece hits, and each hit's neighbourhood is verified by Myers' bit-parallel distance.
The items are the stated query set: they are collected only while under MAX_ITEM_BYTES; a larger set runs in blocks of
that size, one pass for each.

Cases: null texts and items match nothing; items of fewer than LEAST characters, folded, match nothing, as they occur
everywhere; items repeated match each; item ids may have any type and be null; an empty table of either side gives an empty
result (decontaminate: keeps all documents); long texts are searched whole; decontaminate keeps other columns as they are,
whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ontoloom.llm.common import LOWER, UPPER, table
from ontoloom.llm.textbatch import slices

ERROR_SHARE, LEAST, MAX_ITEM_BYTES = 20, 20, 8 << 20
FOLD = str.maketrans(UPPER, LOWER)


def fold(text):
    return " ".join((text or "").translate(FOLD).split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between pattern and a substring of text, and where the first such substring ends."""
    m = len(pattern)
    mask, top, eq = (1 << m) - 1, 1 << (m - 1), {}
    for k, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << k
    pv, mv, now, best, end = mask, 0, m, m, 0
    for k, c in enumerate(text):
        x = eq.get(c, 0)
        xv, xh = x | mv, (((x & pv) + pv) ^ pv) | x
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        now += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if now < best:
            best, end = now, k + 1
    return best, end


def cut(text: str, n: int) -> list[tuple[int, str]]:
    at = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(at, at[1:], strict=False) if b > a]


class Matcher:
    def __init__(self, items: list[tuple]) -> None:
        import ahocorasick

        self.items = [(i, t, len(t) // ERROR_SHARE) for i, t in ((i, fold(t)) for i, t in items) if len(t) >= LEAST]
        pieces: dict[str, list] = {}
        for k, (_, t, e) in enumerate(self.items):
            for at, p in cut(t, e + 1):
                pieces.setdefault(p, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for p, v in pieces.items():
            self.automaton.add_word(p, (len(p), v))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text) -> list[tuple]:
        """(item's id, distance, end in the folded text) of the best match of each item within its budget."""
        text = fold(text)
        if not self.items or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for end, (n, uses) in self.automaton.iter(text):
            for k, at in uses:
                item, (_, t, e) = end + 1 - n - at, self.items[k]
                if best.get(k, (1,))[0] == 0 or k in tried and 0 <= item - tried[k] <= e:
                    continue
                tried[k] = item
                lo = max(0, item - e)
                d, stop = myers(t, text[lo : item + len(t) + 2 * e])
                if d <= e and d < best.get(k, (e + 1,))[0]:
                    best[k] = (d, lo + stop)
        return [(self.items[k][0], d, stop) for k, (d, stop) in sorted(best.items())]


def item_blocks(benchmark, id_col, text_col):
    """Lists of (id, text) of at most MAX_ITEM_BYTES, or of one item."""
    block, size = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        n = 4 * len(r[1] or "") + 16
        if block and size + n > MAX_ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def find_leaks(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text="text"):
    """doc id, item id, distance, stop (in the folded text): one row for each document and item that match."""
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind, item_type = source.schema[0].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_kind, item_arrow = item_type.simpleString(), to_arrow_type(item_type)

    def over(block):
        def run(batches):
            m = Matcher(block)
            for b in (x for whole in batches for x in slices(whole, 1)):
                found = [(k, *x) for k, t in enumerate(b.column(1).to_pylist()) for x in m.find(t)]
                at, items, d, stop = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_arrow), pa.array(d, pa.int32()), pa.array(stop, pa.int64())], ["_id", "_item", "distance", "stop"])

        return source.mapInArrow(run, f"_id {kind}, _item {item_kind}, distance int, stop long")

    out = None
    for block in item_blocks(benchmark, item_col, item_text):
        out = over(block) if out is None else out.union(over(block))
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def decontaminate(docs, benchmark, text_col="text", item_col="item_id", item_text="text"):
    """docs without the rows that hold an item. No row is shuffled."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text):

        def run(batches, block=block):
            m = Matcher(block)
            for b in (x for whole in batches for x in slices(whole, at)):
                yield b.filter(pa.array([not m.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, StructType(docs.schema.fields))
    return docs


def op4_benchmark_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
