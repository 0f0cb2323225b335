"""MinHash near-dedup by an LSH forest.

Rows with equal shingle sets collapse into one node first. Each of TREES orders sorts the nodes by a label of LEVELS
minhashes (the first DEPTH are the order's own, the deeper ones those of the next orders), so neighbours are the nodes with
the longest common prefix, and the depth at which they meet follows the region:

1. A node meets those of its WINDOW predecessors that share more minhashes than the one WINDOW places before, at least
   one. Where even that one shares DEPTH minhashes, the region is crowded: the node meets its nearest predecessor, which
   shares the longest prefix, and the first node of the region's run.
2. Pairs that a sketch of 128 minhash bits and the set sizes leave open are confirmed on full sets, first the best BEST
   of each node, then those that lie in different components still.
3. Runs of equal labels (DEPTH minhashes) of more than WINDOW nodes, or cut by a task's end, are the only places where nodes
   that share a label have not all met. Where such a run still holds nodes of different components, each component meets
   the run's largest one by a node. What lies in different components even then takes part in an exact similarity
   join: shingles ordered by frequency, rarest first; a pair must share a shingle in the prefixes that the threshold
   leaves, at places that still allow the overlap. Frequent shingles, such as those of a passage that crowds the run, come
   last, and of a shingle's nodes only those outside its largest component seek partners, so a crowd does not become all
   pairs. Nothing is capped or sampled.

So a pair of similarity 0.75 is missed only where it shares no whole label in any order (5 in a million) or the sketch is
5 standard deviations off.

Cases: null text or text without words has an empty set and is linked with nothing; fewer words than a shingle count as
one shingle; long texts are taken whole; null ids rank last for component_id, and a component of null ids alone has a null
one; repeated rows share a component; an empty table gives an empty result; other columns are not read, and deduplicate
keeps them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ontoloom.llm.common import forget, fresh, partitions, row_key, table, written
from ontoloom.llm.textbatch import U, mix, shingle_sets, slices, texts_of

SHINGLE, PER_CENT, TREES, DEPTH, LEVELS, WINDOW, SKETCH_MIN, BEST = 5, 75, 32, 4, 8, 8, 92, 2
#: Texts and keys are sought in tables of this many hash buckets at most, which bounds the broadcast of the buckets.
BUCKETS = 1 << 20
#: A table of no more dropped rows than this (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
_rng = np.random.Generator(np.random.PCG64(5))
FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U(2) + U(1)
#: Bytes of a spot: tree, own minhashes, deeper ones by 16 bits; then the node, its size and its sketch.
LABEL = 1 + 4 * DEPTH + 2 * (LEVELS - DEPTH)
SPOT = np.dtype([("tree", "u1"), ("own", ">u4", DEPTH), ("deep", ">u2", LEVELS - DEPTH), ("node", "V16"), ("n", ">u4"), ("sketch", "u8", 2)])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH minhashes of 32 bits for each set; none may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    scaled = np.empty_like(every)
    least = np.array([np.minimum.reduceat(np.multiply(every, f, out=scaled), starts) for f in FACTORS]).T
    return (mix(np.ascontiguousarray(least)) >> U(32)).astype(">u4")


def sign(docs, size=SHINGLE):
    """docs: _id, _key, _text. Gives _id, _key, n_shingles, node (null for empty sets), labels (TREES * DEPTH * 4 bytes)."""

    def run(batches):
        import xxhash

        for whole in batches:
            for b in slices(whole, 2):
                sets = shingle_sets(texts_of(b.column(2)), size)
                full = [s for s in sets if len(s)]
                found = iter(signatures(full)) if full else iter(())
                labels = [next(found).tobytes() if len(s) else None for s in sets]
                node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(labels, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["_id", "_key", "n_shingles", "node", "labels"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, _key binary, n_shingles long, node binary, labels binary")


def spots(nodes):
    """The places of each node in the orders, as packed SPOTs, whose bytes sort by label and node. nodes: node, n, labels."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                m = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u4").reshape(-1, TREES * DEPTH)
                out = np.zeros((TREES, len(m)), SPOT)
                out["tree"] = np.arange(TREES, dtype=np.uint8)[:, None]
                out["own"] = m.reshape(-1, TREES, DEPTH).swapaxes(0, 1)
                for level in range(LEVELS - DEPTH):
                    out["deep"][:, :, level] = (m[:, (np.arange(TREES) * DEPTH + DEPTH + level) % (TREES * DEPTH)] & 0xFFFF).T
                out["node"] = np.frombuffer(b"".join(b.column(0).to_pylist()), "V16")
                out["n"] = b.column(1).to_numpy()
                out["sketch"] = np.packbits((m & 1).astype(np.uint8), axis=1).view(np.uint64)
                flat = pa.py_buffer(out.tobytes())
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(SPOT.itemsize), out.size, [None, flat]).cast(pa.binary())], ["spot"])

    return nodes.select("node", "n", "labels").mapInArrow(run, "spot binary")


def alike(n, m, x, y):
    """Whether the sizes n and sketch bits m of rows x and y allow the threshold."""
    return (100 * np.minimum(n[x], n[y]) >= PER_CENT * np.maximum(n[x], n[y])) & (m >= SKETCH_MIN)


def neighbours(nodes):
    """(a, b, est, run, edge): pairs a < b of neighbours in the sorted orders with their sketches' agreement; and, with b null, the spots of nodes that share a label, by run (tree and DEPTH minhashes). edge: the run may go on in another task."""
    ordered = spots(nodes).repartitionByRange(partitions(nodes.sparkSession), "spot").sortWithinPartitions("spot")
    types = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.bool_()]

    def batch(a, b, est, run, edge):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, est, run, edge), types, strict=True)], ["a", "b", "est", "run", "edge"])

    def meet(batches):
        head = tail = np.zeros(0, SPOT)  # the first row of the current run; the last WINDOW rows
        held = None  # the last row as a spot: whether it shares its label with the one before
        for b in batches:
            if not b.num_rows:
                continue
            new = np.frombuffer(b"".join(b.column(0).to_pylist()), SPOT)
            t = np.concatenate([head, tail, new])
            lo, base = len(head), len(head) + len(tail)
            row, n = np.arange(base, len(t)), t["n"].astype(np.int64)

            def shared(w, at=row, t=t, lo=lo):
                other = np.maximum(at - w, 0)
                there = (at - w >= lo) & (t["tree"][other] == t["tree"][at])
                same = np.concatenate([t["own"][other] == t["own"][at], t["deep"][other] == t["deep"][at]], axis=1)
                return np.where(there, np.cumprod(same, axis=1).sum(1), 0)

            far, one = shared(WINDOW), shared(1)
            first = np.maximum.accumulate(np.where(one < DEPTH, row, 0))  # 0 is the head
            crowded = far >= DEPTH
            left, right = [row[crowded], row[crowded]], [row[crowded] - 1, first[crowded]]
            for w in range(1, WINDOW + 1):
                near = row[(shared(w) > far) & ~crowded]
                left.append(near)
                right.append(near - w)
            x, y = np.concatenate(left), np.concatenate(right)
            est = 128 - np.bitwise_count(t["sketch"][x] ^ t["sketch"][y]).sum(1, dtype=np.int64)
            fits = alike(n, est, x, y)
            ids = t["node"]
            pairs = {(min(p), max(p)): e for p, q, e in zip(ids[x[fits]].tolist(), ids[y[fits]].tolist(), est[fits].tolist(), strict=True) for p in [(p, q)] if p[0] != p[1]}
            yield batch([p for p, _ in pairs], [q for _, q in pairs], list(pairs.values()), [None] * len(pairs), [False] * len(pairs))
            # Rows that share a label with a neighbour; the last one waits for the next batch, and a task's ends always count.
            back = one >= DEPTH
            runs = [r[: 1 + 4 * DEPTH] for r in (new.tobytes()[k : k + 1 + 4 * DEPTH] for k in range(0, len(new) * SPOT.itemsize, SPOT.itemsize))]
            rows = []
            if held is not None and (held[2] or back[0]):
                rows.append((held[0], held[1], held[3]))
            on = back | np.append(back[1:], False)
            if held is None:
                on[0] = True
            rows += [(new["node"][k].tobytes(), runs[k], held is None and k == 0) for k in np.flatnonzero(on[:-1]).tolist()]
            k = len(new) - 1
            held = (new["node"][k].tobytes(), runs[k], bool(back[k]), held is None and k == 0)
            yield batch([r[0] for r in rows], [None] * len(rows), [None] * len(rows), [r[1] for r in rows], [r[2] for r in rows])
            start = int(first[-1])
            head, tail = t[start : start + 1].copy(), t[max(lo, len(t) - WINDOW) :].copy()
        if held is not None:
            yield batch([held[0]], [None], [None], [held[1]], [True])

    return ordered.mapInArrow(meet, "a binary, b binary, est int, run binary, edge boolean")


def bucket(column):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def among(df, column, keys, key):
    """The rows of df whose column may be one of the keys, by hash buckets: at most BUCKETS integers are broadcast, so what a join then moves is little more than what it needs."""
    taken = F.broadcast(keys.select(bucket(keys[key]).alias("_bucket")).distinct())
    return df.join(taken, bucket(df[column]) == F.col("_bucket"), "left_semi")


def texts_of_nodes(needed, nodes, docs):
    """node, packed (the text in Zstandard) of the needed nodes, as a table."""
    rows = needed.join(nodes.select("node", F.col("_key").alias("_k")), "node")
    found = among(docs, "_key", rows, "_k").join(rows, F.col("_key") == F.col("_k")).select("node", "_text")

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in (x for whole in batches for x in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t) for t in texts_of(b.column(1))], pa.binary())], ["node", "packed"])

    return written(found.mapInArrow(pack, "node binary, packed binary").dropDuplicates(["node"]), "texts")


def unpacked(column):
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(x) for x in column.to_pylist()]


def confirm(pairs, texts, size=SHINGLE):
    """The pairs whose full sets reach the threshold. texts: node, packed."""
    ends = pairs.select(F.col("a").alias("_e")).union(pairs.select("b"))
    few = among(texts, "node", ends, "_e")
    both = pairs.select("a", "b").join(few.withColumnsRenamed({"node": "a", "packed": "_ta"}), "a").join(few.withColumnsRenamed({"node": "b", "packed": "_tb"}), "b").select("a", "b", "_ta", "_tb")

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2, size=1 << 18):
                left, right = (shingle_sets(unpacked(b.column(c)), size) for c in (2, 3))
                keep = []
                for x, y in zip(left, right, strict=True):
                    meet = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * meet >= PER_CENT * (len(x) + len(y) - meet) and meet > 0)
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(edges):
    """(node, comp) of each node with an edge: comp is the smallest node reachable. Labels spread with pointer jumping; each round is a table."""
    first = written(edges, "edges")
    edges = first.union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        near = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        now = written(near.join(jump, "comp").select("node", "was", F.least("comp", "further").alias("comp")), "labels")
        done = now.where("was != comp").isEmpty()
        forget(labels)
        if done:
            forget(first)
            return now.select("node", "comp"), now
        labels = now.select("node", "comp")
        labels._ontoloom_path = now._ontoloom_path


def merged(comps, pairs):
    """comps (node, comp) after pairs (a, b) have linked components. (The new comps, tables to forget.)"""
    ends = comps.select("node", "comp")
    between = pairs.join(ends.withColumnsRenamed({"node": "a", "comp": "ca"}), "a").join(ends.withColumnsRenamed({"node": "b", "comp": "cb"}), "b").where("ca != cb")
    further, kept = components(between.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    out = written(comps.join(further.select(F.col("node").alias("comp"), F.col("comp").alias("_last")), "comp", "left").select("node", F.coalesce("_last", "comp").alias("comp")), "comps")
    forget(kept)
    return out


def apart(pairs, comps):
    """The pairs whose nodes lie in different components."""
    a, b = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where("ca != cb").drop("ca", "cb")


def leading(pairs):
    """(a, b) of the BEST pairs of each node."""
    ends = [pairs.withColumn("node", pairs[c]) for c in ("a", "b")]
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("est"), "a", "b"))
    return ends[0].union(ends[1]).withColumn("_place", place).where(F.col("_place") <= BEST).select("a", "b").distinct()


def introductions(spread):
    """Pairs a < b by which each component of a run meets the run's largest one: of both, the node that shares labels in most runs, as such a node is the likeliest to be linked. At most one for a place, however large the run. spread: node, run, comp."""
    often = spread.join(spread.groupBy("node").agg(F.count(F.lit(1)).alias("runs")), "node")
    ends = often.groupBy("run", "comp").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("runs", "node")).alias("x"))
    main = ends.groupBy("run").agg(F.max(F.struct("m", "comp", "x")).alias("main"), F.count(F.lit(1)).alias("many")).where("many > 1").select("run", "main")
    return ends.join(main, "run").where("comp != main.comp").select(F.least("x.node", "main.x.node").alias("a"), F.greatest("x.node", "main.x.node").alias("b")).distinct()


def similar_pairs(members, texts, size=SHINGLE):
    """Pairs a < b of different components that an exact similarity join leaves to confirm. members: node, comp."""

    def cut(batches):
        for whole in batches:
            for b in slices(whole, 2, size=1 << 18):
                sets = shingle_sets(unpacked(b.column(2)), size)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "comp", "hashes"])

    sets = written(among(texts, "node", members, "node").join(members, "node").select("node", "comp", "packed").mapInArrow(cut, "node binary, comp binary, hashes array<bigint>"), "sets")
    every = sets.select("node", "comp", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = every.join(shared, "h").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("rare"))
    # Shingles of one node alone stand before the shared ones; of n, the first n - ceil(0.75 n) + 1 are the prefix.
    own = F.col("n") - F.size("rare")
    prefix = F.floor(F.col("n") - F.ceil(F.col("n") * F.lit(PER_CENT) / F.lit(100)) + 1).cast("int")
    tokens = listed.withColumns({"own": own, "take": prefix - own}).where("take > 0").select("node", "comp", "n", "own", F.posexplode(F.slice("rare", 1, F.col("take"))).alias("i", "x"))
    tokens = written(tokens.select(F.col("x.h").alias("h"), "node", "comp", "n", (F.col("n") - F.col("own") - F.col("i")).alias("left")), "tokens")
    by_comp = tokens.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_comp.groupBy("h").agg(F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("many")).where("many > 1").select("h", F.col("most.comp").alias("main"))
    some = tokens.join(mixed, "h")
    x, y = (some.withColumnsRenamed({c: f"{c}_{k}" for c in ("node", "comp", "n", "left")}) for k in "xy")
    x = x.where("comp_x != main").drop("main")
    # left: how many shingles stand from the shared one on; the overlap can't be more.
    fits = "comp_x != comp_y and (comp_y = main or node_x < node_y) and 100 * least(n_x, n_y) >= {0} * greatest(n_x, n_y) and least(left_x, left_y) * (100 + {0}) >= {0} * (n_x + n_y)".format(PER_CENT)
    return x.join(y, "h").where(fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), [sets, tokens]


def near_duplicates(df, id_col="doc_id", text_col="text", size=SHINGLE):
    """id, n_shingles, component_id, kept (the id is the component's smallest), _key (of id and text) and _first (of the component's row of smallest id and key) of each row."""
    docs = df.select(df[id_col].alias("_id"), row_key(df[id_col], df[text_col]).alias("_key"), df[text_col].alias("_text"))
    signed = written(sign(docs, size), "signed")
    rank = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("_key", "n_shingles", "labels")).alias("x"), F.min(rank).alias("least"))
    nodes = written(nodes.select("node", "x._key", F.col("x.n_shingles").alias("n"), "x.labels", "least"), "nodes")
    met = written(neighbours(nodes), "met")
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.max("est").alias("est"))
    places = met.where("b is null").select(F.col("a").alias("node"), "run", "edge")
    crowds = places.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.max("edge").alias("edge")).where(F.col("edge") | (F.col("m") > WINDOW)).select("run")
    crowded = written(places.join(crowds, "run").select("node", "run").distinct(), "crowded")
    pairs = written(pairs, "pairs")
    forget(met)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    texts = texts_of_nodes(needed, nodes, docs)
    # The best pairs of each node, then all pairs between components.
    best = written(leading(pairs), "best")
    found, kept = components(confirm(best, texts, size))
    comps = written(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "comps")
    forget(kept)
    second = merged(comps, confirm(written(apart(pairs.join(best, ["a", "b"], "left_anti"), comps), "open"), texts, size))
    # What crowded runs leave open: one link between two components spares all other pairs between them.
    first = written(introductions(crowded.join(second, "node")).join(pairs, ["a", "b"], "left_anti"), "first")
    third = merged(second, confirm(first, texts, size))
    spread = crowded.join(third, "node")
    mixed = spread.groupBy("run").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("run")
    rest, used = similar_pairs(written(spread.join(mixed, "run", "left_semi").select("node", "comp").distinct(), "members"), texts, size)
    rest = written(rest.join(pairs, ["a", "b"], "left_anti").join(first, ["a", "b"], "left_anti"), "rest")
    last = merged(third, confirm(rest, texts, size))
    forget(*used, rest, pairs, best, first, texts, crowded, comps, second, third)
    named = nodes.select("node", "least").join(last, "node")
    least = named.groupBy("comp").agg(F.min("least").alias("least"))
    by_node = written(named.select("node", "comp").join(least, "comp").select(F.col("node").alias("_n"), "least"), "named")
    forget(nodes, last)
    out = signed.select("_id", "_key", "n_shingles", "node").join(by_node, F.col("node") == F.col("_n"), "left")
    comp = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("least.id"))
    alone = F.col("node").isNull()
    return out.select(F.col("_id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("_id").eqNullSafe(comp).alias("kept"), "_key", (alone | F.col("_key").eqNullSafe(F.col("least.key"))).alias("_first"))


def deduplicate(df, id_col="doc_id", text_col="text", size=SHINGLE):
    """df with one row of each component: the one with the smallest id; its own repeats go. Rows without words all stay, but for repeats of one.

    Texts stay where they are while the dropped rows are under BROADCAST_ROWS and no row repeats; else rows are dealt by key.
    """
    found = written(near_duplicates(df, id_col, text_col, size).select("_key", "_first"), "found")
    gone = found.where("not _first").select("_key").distinct()
    twins = not found.where("_first").groupBy("_key").count().where("count > 1").isEmpty()
    key, other = fresh("_key", df), fresh("_gone", df)
    keyed, gone = df.withColumn(key, row_key(df[id_col], df[text_col])), gone.select(F.col("_key").alias(other))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = keyed.join(gone, F.col(key) == F.col(other), "left_anti")
    return (left.dropDuplicates([key]) if twins else left).select(*[F.col(f"`{c}`") for c in df.columns])


def op5_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_key", "_first")
