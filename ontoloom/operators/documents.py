"""Reads, checks and changes of document collections, all set-wise."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

_ORDERED = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$regex": lambda c, v: c.rlike(v)}
#: What $type names, as prefixes of Spark's names.
_TYPES = {"string": ("string",), "int": ("int", "smallint", "tinyint"), "long": ("bigint",), "double": ("double", "float"), "decimal": ("decimal",), "bool": ("boolean",), "date": ("timestamp", "date"), "array": ("array",), "object": ("struct", "map"), "objectId": ("string",)}


def _kind(path: str, schema: StructType | None) -> DataType | None:
    """The type of a dotted path; None where the schema doesn't say."""
    kind = schema
    for part in path.split("."):
        if isinstance(kind, ArrayType):
            kind = kind.elementType
        if not isinstance(kind, StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _equal(c: Column, v, array: bool) -> Column:
    """Scalars equal the value; arrays equal it or hold it; null equals missing."""
    if v is None:
        return c.isNull()
    if isinstance(v, list):
        return c == F.array(*map(F.lit, v))
    return F.array_contains(c, F.lit(v)) if array else c == F.lit(v)


def _test(op: str, c: Column, v, kind: DataType | None) -> Column:
    array = isinstance(kind, ArrayType)
    if op in ("$eq", "$in"):
        return reduce(or_, [_equal(c, x, array) for x in (v if op == "$in" else [v])], F.lit(False)) if array or op == "$eq" or None in v else c.isin(v)
    if op in ("$ne", "$nin"):
        return _no(_test("$eq" if op == "$ne" else "$in", c, v, kind))
    if op == "$exists":
        return c.isNotNull() if v else c.isNull()
    if op == "$not":
        return _no(reduce(and_, [_test(o, c, x, kind) for o, x in v.items()]))
    if op == "$size":
        return F.size(c) == v
    if op == "$all":
        return reduce(and_, [_equal(c, x, array) for x in v], F.lit(True))
    if op == "$type":
        names = [p for n in ([v] if isinstance(v, str) else v) for p in _TYPES[n]]
        return c.isNotNull() & F.lit(kind is None or kind.simpleString().startswith(tuple(names)))
    if op == "$elemMatch":
        inner = kind.elementType if array else None
        if all(k.startswith("$") for k in v):
            return F.exists(c, lambda x: reduce(and_, [_test(o, x, y, inner) for o, y in v.items()], F.lit(True)))
        return F.exists(c, lambda x: compile_filter(v, inner, x))
    if array:
        return F.exists(c, lambda x: _ORDERED[op](x, F.lit(v)))
    return _ORDERED[op](c, v if op == "$regex" else F.lit(v))


def compile_filter(query: dict | None, schema: StructType | None = None, root: Column | None = None) -> Column:
    """A document filter as one column, so that the scan can push it down. The schema tells arrays, of which one item must fit; only negations turn unknown into true."""
    parts = []
    for key, v in (query or {}).items():
        if key in ("$and", "$or", "$nor"):
            inner = reduce(and_ if key == "$and" else or_, [compile_filter(q, schema, root) for q in v])
            parts.append(_no(inner) if key == "$nor" else inner)
            continue
        c = F.col(key) if root is None else reduce(lambda x, p: x[p], key.split("."), root)
        tests = v if isinstance(v, dict) and any(k.startswith("$") for k in v) else {"$eq": v}
        parts += [_test(op, c, x, _kind(key, schema)) for op, x in tests.items()]
    return reduce(and_, parts, F.lit(True))


def find(docs: DataFrame, query: dict | None = None, key: str = "_id", limit: int | None = 50) -> DataFrame:
    """The documents that fit, by key, the first `limit` of them; 0 and None are no limit, and a negative one counts as its absolute."""
    found = docs.where(compile_filter(query, docs.schema)).orderBy(key)
    return found.limit(abs(limit)) if limit else found


def find_one(docs: DataFrame, query: dict | None = None, key: str = "_id") -> DataFrame:
    return find(docs, query, key, 1)


def by_id(docs: DataFrame, value, key: str = "_id") -> DataFrame:
    return docs.where(F.col(key) == F.lit(value))


def without_metadata(docs: DataFrame) -> DataFrame:
    return docs.drop("metadata")


def identity(docs: DataFrame) -> DataFrame:
    """_id, _ontology_type, name and iri; missing ones are null."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("_id", "_ontology_type", "name", "iri")])


def has_path(schema: StructType, path: str) -> bool:
    """Whether documents of the schema have a field at the dotted path."""
    return _kind(path, schema) is not None


def get_path(schema: StructType, path: str) -> Column:
    """The field at the dotted path; null where the schema has none."""
    return F.col(path) if has_path(schema, path) else F.lit(None)


def set_path(docs: DataFrame, path: str, value: Column) -> DataFrame:
    """docs with the value at the dotted path; the structs on the way are there already or become structs of that field alone."""
    head, _, rest = path.partition(".")
    if not rest:
        return docs.withColumn(head, value)
    if head in docs.columns and has_path(docs.schema, path.rpartition(".")[0]):
        base = F.when(F.col(head).isNull(), F.lit(None).cast(docs.schema[head].dataType)).otherwise(F.col(head))
        return docs.withColumn(head, base.withField(rest, value))
    for part in reversed(rest.split(".")):
        value = F.struct(value.alias(part))
    return docs.withColumn(head, value)


def flatten_paths(docs: DataFrame) -> DataFrame:
    """One column for each leaf, named by its dotted path."""

    def leaves(kind: StructType, path: tuple[str, ...]):
        for f in kind.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield reduce(lambda c, p: c[p], [*path[1:], f.name] if path else [], F.col(f"`{path[0] if path else f.name}`")).alias(".".join((*path, f.name)))

    return docs.select(*leaves(docs.schema, ()))


def merge_nested(low: Column, high: Column, kind: StructType) -> Column:
    """Structs of one type, merged field by field: what high holds wins, nested structs are merged themselves."""
    if not isinstance(kind, StructType):
        return F.coalesce(high, low)
    return F.when(low.isNull(), high).when(high.isNull(), low).otherwise(F.struct(*[merge_nested(low[f.name], high[f.name], f.dataType).alias(f.name) for f in kind.fields]))


@dataclass(frozen=True)
class Reference:
    """A field of a collection that holds ids (one, or an array of them) of documents in the target collections, sought in this order."""

    collection: str
    field: str
    targets: tuple[str, ...]
    is_array: bool = False


def expand(docs: DataFrame, collection: str, references: list[Reference], read, depth: int = 1) -> DataFrame:
    """docs with a column <field>_doc for each reference: the document it stands for, down to `depth` references.

    read(collection) gives a collection with its key _id. <field>_doc is a struct of _collection, _circular_ref and one
    struct for each target collection, of which that of the first target that has the id is set; without a match it is
    null, and the raw id stays in <field>. An id that already stands on the way from the document down gives
    _circular_ref and no document, without asking whether it exists. Arrays become arrays of such structs in their order,
    with the raw id as _ref. Each level is one left join for each reference and target.
    """
    return _expand(docs, collection, references, read, depth, [(collection, "_id")], ["_id"])


def _expand(rows, collection, references, read, depth, path, keys):
    if depth > 0:
        for r in [r for r in references if r.collection == collection]:
            rows = _attach(rows, F.col(r.field), f"{r.field}_doc", r, references, read, depth, path, keys)
    return rows


def _attach(rows, value, name, r, references, read, depth, path, keys):
    """rows with the column name: what value, an id or an array of ids, stands for. path: (collection, column of the id) of the documents on the way; keys: columns that tell rows apart."""
    if r.is_array:
        pos, ref = f"_pos{len(path)}", f"_ref{len(path)}"
        items = rows.select(*dict.fromkeys([*keys, *(c for _, c in path)]), F.posexplode(value).alias(pos, ref))
        items = _attach_one(items, ref, "_item", r, references, read, depth, path, [*keys, pos])
        one = F.struct(F.col(pos).alias("pos"), F.col(ref).alias("_ref"), F.col("_item").alias("doc"))
        lists = items.groupBy(*[F.col(k).alias(f"_g{n}") for n, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(one), lambda x, y: x["pos"] - y["pos"]).alias("_list"))
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g{n}")) for n, k in enumerate(keys)])
        return rows.join(lists, on, "left").withColumn(name, F.transform("_list", lambda x: F.struct(x["_ref"].alias("_ref"), x["doc"].alias("doc")))).drop("_list", *[f"_g{n}" for n in range(len(keys))])
    ref = f"_ref{len(path)}"
    return _attach_one(rows.withColumn(ref, value), ref, name, r, references, read, depth, path, keys).drop(ref)


def _attach_one(rows, ref, name, r, references, read, depth, path, keys):
    level = len(path)
    hits = []
    for k, target in enumerate(r.targets):
        doc, found = f"_d{level}_{k}", f"_f{level}_{k}"
        docs = read(target)
        rows = rows.join(docs.select(F.col("_id").alias(found), F.struct(*docs.columns).alias(doc)), F.col(ref) == F.col(found), "left")
        again = reduce(or_, [F.col(c) == F.col(ref) for other, c in path if other == target], F.lit(False))
        hits.append((target, doc, found, F.coalesce(again, F.lit(False))))
    first = F.coalesce(*[F.when(again | F.col(found).isNotNull(), F.lit(k)) for k, (_, _, found, again) in enumerate(hits)])
    rows = rows.withColumn(f"_w{level}", first)
    for k, (target, doc, found, again) in enumerate(hits):
        rows = rows.withColumn(doc, F.when((F.col(f"_w{level}") == k) & ~again, F.col(doc)))
        for inner in [x for x in references if x.collection == target] if depth > 1 else ():
            rows = _attach(rows, F.col(f"{doc}.{inner.field}"), f"_n{level}", inner, references, read, depth - 1, [*path, (target, found)], keys)
            rows = rows.withColumn(doc, F.when(F.col(doc).isNotNull(), F.col(doc).withField(f"{inner.field}_doc", F.col(f"_n{level}")))).drop(f"_n{level}")
    won = F.col(f"_w{level}")
    circular = reduce(or_, [(won == k) & again for k, (*_, again) in enumerate(hits)])
    said = F.element_at(F.array(*[F.lit(t) for t in r.targets]), won + 1)
    out = F.struct(said.alias("_collection"), circular.alias("_circular_ref"), *[F.col(doc).alias(target) for target, doc, _, _ in hits])
    return rows.withColumn(name, F.when(won.isNotNull(), out)).drop(f"_w{level}", *[c for _, doc, found, _ in hits for c in (doc, found)])


def lookup_first(rows: DataFrame, ref: str, targets: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """rows with `target`: the first of the named (name, documents, key) targets that has the id; and `targets`: how many have it."""
    for k, (_, docs, key) in enumerate(targets):
        rows = rows.join(docs.select(F.col(key).alias(f"_k{k}")).distinct(), F.col(ref) == F.col(f"_k{k}"), "left")
    hits = [F.col(f"_k{k}").isNotNull() for k in range(len(targets))]
    first = F.coalesce(*[F.when(h, F.lit(n)) for h, (n, _, _) in zip(hits, targets, strict=True)])
    return rows.withColumns({"target": first, "targets": sum((h.cast("long") for h in hits), F.lit(0))}).drop(*[f"_k{k}" for k in range(len(targets))])


def missing_references(rows: DataFrame, ref: str, docs: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(ref).isNotNull()).join(docs.select(F.col(key).alias("_k")), F.col(ref) == F.col("_k"), "left_anti")


def incompatible_references(rows: DataFrame, ref: str, targets: DataFrame, key: str, kind: str, allowed: list[str], edges: DataFrame) -> DataFrame:
    """(rows, actual): references to documents whose type is none of the allowed classes nor below one. edges: child, parent."""
    from ontoloom.operators.graph import closure

    fine = closure(edges).where(F.col("parent").isin(allowed)).select(F.col("child").alias("_c")).union(edges.sparkSession.createDataFrame([(a,) for a in allowed], "_c string")).distinct()
    met = rows.join(targets.select(F.col(key).alias("_k"), F.col(kind).alias("actual")), F.col(ref) == F.col("_k")).drop("_k")
    return met.join(F.broadcast(fine), F.col("actual") == F.col("_c"), "left_anti")


def _pairs(docs: DataFrame, field: str, key: str) -> DataFrame:
    """(_d, _r): each document and each different id that its field holds."""
    if isinstance(docs.schema[field].dataType, ArrayType):
        return docs.select(F.col(key).alias("_d"), F.explode(F.array_distinct(F.col(field))).alias("_r"))
    return docs.select(F.col(key).alias("_d"), F.col(field).alias("_r"))


def referrers_of(targets: DataFrame, key: str, referrers: list[tuple], few: int = 100_000) -> DataFrame:
    """(key, referrer, field, _d): each document that points to a target. referrers: (name, documents, field[, key of the documents]). Targets of no more rows than `few` are broadcast, so that referrers are filtered where they lie."""
    wanted = targets.select(F.col(key).alias("_t")).distinct()
    if wanted.limit(few + 1).count() <= few:
        wanted = F.broadcast(wanted)
    out = []
    for name, docs, field, *own in referrers:
        met = _pairs(docs, field, own[0]) if own else _rows(docs, field)
        out.append(met.join(wanted, F.col("_r") == F.col("_t")).select(F.col("_t").alias(key), F.lit(name).alias("referrer"), F.lit(field).alias("field"), F.col("_d").cast("string").alias("_d")))
    return reduce(DataFrame.unionByName, out)


def _rows(docs: DataFrame, field: str) -> DataFrame:
    """Like _pairs() for documents without a key: every row is one."""
    if isinstance(docs.schema[field].dataType, ArrayType):
        return docs.select(F.lit(None).cast("string").alias("_d"), F.explode(F.array_distinct(F.col(field))).alias("_r"))
    return docs.select(F.lit(None).cast("string").alias("_d"), F.col(field).alias("_r"))


def incoming(targets: DataFrame, key: str, referrers: list[tuple]) -> DataFrame:
    """(key, referrer, n): how many documents of each referrer point to each target, each counted once."""
    return referrers_of(targets, key, referrers).groupBy(key, "referrer").agg(F.count(F.lit(1)).alias("n"))


def first_examples(rows: DataFrame, by: list[str], value: str, examples: int) -> DataFrame:
    """by, examples: the first values of each group; the rank is limited before the exchange, so no group is gathered."""
    ranked = rows.select(*by, F.col(value).alias("_v")).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_v"))).where(F.col("_n") <= examples)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("examples"))


def incoming_examples(targets: DataFrame, key: str, referrers: list[tuple], examples: int = 3) -> DataFrame:
    """(key, referrer, field, n, examples): counts, and the first ids of referring documents."""
    found, by = referrers_of(targets, key, referrers), [key, "referrer", "field"]
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(first_examples(found, by, "_d", examples), by)


POLICIES, MODES = ("restrict", "unset", "pull", "cascade"), ("restrict", "detach_if_valid", "force_detach")


def effective_action(mode: str, policy: str, is_array: bool) -> tuple[str, str | None]:
    """(action, reason): what a delete does to a referrer. block, unset or pull; why it blocks, or what it overrides."""
    if mode not in MODES:
        return "block", "unknown_delete_mode"
    if mode == "restrict":
        return "block", "incoming_reference_exists"
    if policy == "cascade":
        return "block", "cascade_not_supported"
    if policy == "restrict":
        if mode == "force_detach":
            return ("pull" if is_array else "unset"), "force_detach_policy_override"
        return "block", "incoming_reference_restricts_delete"
    return policy, None


def normal_mode(mode: str) -> str:
    return mode.strip().lower()


def delete_plan(targets: DataFrame, key: str, referrers: list[tuple[str, DataFrame, str, str]], mode: str = "restrict") -> DataFrame:
    """(key, referrer, n, action): block, unset or pull. referrers: (name, documents, field, policy). Cascades are refused; force_detach turns restrict into unset, or pull for arrays."""
    mode = normal_mode(mode)
    found = incoming(targets, key, [(n, d, f) for n, d, f, _ in referrers])
    actions = {n: effective_action(mode, p, isinstance(d.schema[f].dataType, ArrayType))[0] for n, d, f, p in referrers}
    return found.withColumn("action", F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])[F.col("referrer")])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Documents of new set their fields on those of the same key, or come in; fields that new doesn't have stay, and so do documents that only old has."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o = old.select(F.struct(*old.columns).alias("_o"), F.col(key).alias("_ok"))
    n = new.select(F.struct(*new.columns).alias("_n"), F.col(key).alias("_nk"))
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full")
    value = lambda c: F.when(F.col("_nk").isNotNull(), F.col("_n")[c]).otherwise(F.col("_o")[c] if c in old.columns else F.lit(None)) if c in new.columns else F.col("_o")[c]
    return both.select(*[value(c).alias(c) for c in columns])


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns that `changes` holds overwrite those of the same key, nulls too; a struct named metadata is merged field by field."""
    c = changes.select(F.col(key).alias("_k"), F.struct(*[x for x in changes.columns if x != key]).alias("_c"))
    joined = old.join(c, F.col(key) == F.col("_k"), "left")

    def value(x):
        new = F.col("_c")[x]
        if x == "metadata" and isinstance(old.schema[x].dataType, StructType):
            mine, theirs = old.schema[x].dataType.names, changes.schema[x].dataType.names
            new = F.when(new.isNull(), F.col(x)).otherwise(F.struct(*[F.coalesce(new[f], F.col(x)[f]).alias(f) if f in theirs else F.col(x)[f].alias(f) for f in mine]))
        return F.when(F.col("_k").isNotNull(), new).otherwise(F.col(x)).alias(x)

    return joined.select(*[value(x) if x in changes.columns and x != key else F.col(x) for x in old.columns])


def detach(docs: DataFrame, field: str, gone: DataFrame, now=None) -> DataFrame:
    """docs without the ids of gone (_id) in field: arrays lose those items alone, scalars become null. now: the new metadata.updatedAt of changed documents."""
    array = isinstance(docs.schema[field].dataType, ArrayType)
    ids = gone.select(F.col("_id").alias("_gone")).distinct()
    if array:
        hit = docs.select("_id", F.explode(field).alias("_r")).join(ids, F.col("_r") == F.col("_gone")).groupBy(F.col("_id").alias("_hit")).agg(F.collect_set("_r").alias("_drop"))
        met = docs.join(hit, F.col("_id") == F.col("_hit"), "left")
        changed = F.col("_hit").isNotNull()
        value = F.when(changed, F.filter(field, lambda x: ~F.coalesce(F.array_contains("_drop", x), F.lit(False)))).otherwise(F.col(field))
    else:
        met = docs.join(ids, F.col(field) == F.col("_gone"), "left")
        changed = F.col("_gone").isNotNull()
        value = F.when(~changed, F.col(field))
    meta = docs.schema["metadata"].dataType if "metadata" in docs.columns else None
    met = met.withColumn("_changed", changed).withColumn(field, value)
    if now is not None and isinstance(meta, StructType) and "updatedAt" in meta.names:
        stamp = F.lit(now).cast(meta["updatedAt"].dataType)
        met = met.withColumn("metadata", F.when(F.col("_changed") & F.col("metadata").isNotNull(), F.col("metadata").withField("updatedAt", stamp)).otherwise(F.col("metadata")))
    return met.select(docs.columns)


def duplicate_keys(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_of(docs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in the order, picked by an aggregation that combines before the exchange."""
    rest = [c for c in docs.columns if c not in by]
    best = docs.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in docs.columns])


def missing_fields(docs: DataFrame, required: list[str]) -> Column:
    """The missing required fields, comma-joined; empty if none."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))), ",")


def skip_counts(docs: DataFrame, missing: Column, examples: int = 8, key: str = "_id") -> DataFrame:
    """(missing, n, examples): documents by the combination of fields they lack, most first, with the first ids of each."""
    named = docs.select(F.col(key).alias("_k"), missing.alias("missing")).where("missing != ''")
    return named.groupBy("missing").agg(F.count(F.lit(1)).alias("n")).join(first_examples(named, ["missing"], "_k", examples), "missing").orderBy(F.desc("n"), "missing")
