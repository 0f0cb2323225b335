"""Queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.functions import casts
from ontoloom.functions.casts import xsd_type
from ontoloom.functions.names import local_name, pluralize, snake_case
from ontoloom.operators import documents as D
from ontoloom.operators import importing as I
from ontoloom.operators import validation as V
from ontoloom.operators.graph import closure, concrete_descendants
from ontoloom.plans import blueprint, collections

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark, d, *names):
    found = [spark.read.parquet(f"{d}/{n}.parquet") for n in names]
    return found if len(found) > 1 else found[0]


def _count():
    return F.count(F.lit(1)).alias("n")


TREE = [("Root", None, True), ("Left", "Root", True), ("Right", "Root", False), ("Both", "Left", False), ("Both", "Right", False), ("Leaf", "Both", False), ("LoopA", "LoopB", False), ("LoopB", "LoopA", False)]
TREE_SQL = "tree(name, parent, abstract) AS (VALUES " + ", ".join(f"('{n}', {'NULL' if p is None else repr(p)}, {a})" for n, p, a in TREE) + ")"


def _tree(spark):
    rows = spark.createDataFrame(TREE, "name string, parent string, is_abstract boolean")
    return rows.select("name", "is_abstract").distinct(), rows.select(F.col("name").alias("child"), "parent")


REFERENCES = [D.Reference("orders", "o_custkey", ("customer",)), D.Reference("customer", "c_nationkey", ("nation",)), D.Reference("nation", "n_regionkey", ("region",)), D.Reference("lineitem", "l_orderkey", ("orders",)), D.Reference("events", "user_id", ("customer", "supplier"))]
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "events": "event_id"}


def _read(spark, d):
    """Reads a table as a collection: its key is _id."""
    return lambda name: _t(spark, d, name).withColumn("_id", F.col(KEYS[name]))


@query("""SELECT o_orderkey, o_totalprice, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def expand_orders_depth3(spark, d):
    read = _read(spark, d)
    found = D.expand(read("orders"), "orders", REFERENCES, read, 3)
    c = "o_custkey_doc.customer"
    return found.select("o_orderkey", "o_totalprice", f"{c}.c_name", f"{c}.c_nationkey_doc.nation.n_name", f"{c}.c_nationkey_doc.nation.n_regionkey_doc.region.r_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def expand_lineitem_depth1(spark, d):
    lines = _t(spark, d, "lineitem").withColumn("_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    o = "l_orderkey_doc.orders"
    return D.expand(lines, "lineitem", REFERENCES, _read(spark, d), 1).select("l_orderkey", "l_linenumber", "l_quantity", f"{o}.o_custkey", f"{o}.o_orderstatus")


@query("""SELECT a.c_custkey AS id, b.c_custkey AS next, b.c_name AS next_name, c.c_custkey IS NOT NULL AND c.c_custkey = a.c_custkey AS circular, CASE WHEN c.c_custkey != a.c_custkey THEN c.c_name END AS third
FROM customer a LEFT JOIN customer b ON b.c_custkey = (CASE WHEN a.c_custkey % 2 = 0 THEN a.c_custkey + 1 ELSE a.c_custkey - 1 END)
LEFT JOIN customer c ON c.c_custkey = (CASE WHEN b.c_custkey % 2 = 0 THEN b.c_custkey + 1 ELSE b.c_custkey - 1 END)""")
def expand_cycle(spark, d):
    """Customers in pairs that refer to each other: the second step leads back and stops."""
    c = _t(spark, d, "customer")
    pair = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1).otherwise(F.col("c_custkey") - 1)
    docs = c.select(F.col("c_custkey").alias("_id"), "c_custkey", "c_name", pair.alias("pair"))
    found = D.expand(docs, "c", [D.Reference("c", "pair", ("c",))], lambda _: docs, 2)
    again = "pair_doc.c.pair_doc"
    return found.select(F.col("_id").alias("id"), F.col("pair_doc.c._id").alias("next"), F.col("pair_doc.c.c_name").alias("next_name"), F.coalesce(f"{again}._circular_ref", F.lit(False)).alias("circular"), F.col(f"{again}.c.c_name").alias("third"))


@query("""SELECT o_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey)[1] AS first_part, count(*) AS n, count(p_partkey) AS found FROM orders JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 != 0) ON p_partkey = l_partkey GROUP BY 1""")
def expand_array(spark, d):
    """Orders with the array of their parts, some of which are missing."""
    o, l, p = _t(spark, d, "orders", "lineitem", "part")
    lists = l.groupBy(F.col("l_orderkey").alias("_o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("part_ids"))
    docs = o.select(F.col("o_orderkey").alias("_id")).join(lists, F.col("_id") == F.col("_o")).drop("_o")
    parts = p.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("_id"), "p_name")
    found = D.expand(docs, "o", [D.Reference("o", "part_ids", ("p",), True)], lambda _: parts)
    items = F.col("part_ids_doc")
    return found.select(F.col("_id").alias("id"), items[0]["_ref"].alias("first_part"), F.size(items).cast("long").alias("n"), F.size(F.filter(items, lambda x: x["doc"].isNotNull())).cast("long").alias("found"))


@query("""SELECT c_custkey, c_mktsegment AS actual FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def ref_type_compat(spark, d):
    """Customers' segments as classes, of which only Goods and what lies below it is allowed."""
    c = _t(spark, d, "customer")
    edges = spark.createDataFrame([("BUILDING", "Goods"), ("Tools", "Goods"), ("MACHINERY", "Tools"), ("HOUSEHOLD", "Tools"), ("FURNITURE", "Other"), ("Goods", "Root"), ("Root", "Goods")], "child string, parent string")
    return D.incompatible_references(c.select("c_custkey"), "c_custkey", c, "c_custkey", "c_mktsegment", ["Goods"], edges)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus IN ('F', 'O') OR o_totalprice < 1000)
AND o_totalprice >= 500 ORDER BY o_orderkey LIMIT 50""")
def scan_filter_limit(spark, d):
    q = {"$and": [{"$or": [{"o_orderstatus": {"$in": ["F", "O"]}}, {"o_totalprice": {"$lt": 1000}}]}, {"o_totalprice": {"$gte": 500}}]}
    return D.find(_t(spark, d, "orders"), q, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return D.find(_t(spark, d, "customer"), {"c_custkey": 42}, "c_custkey", 1).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS iri, CAST(NULL AS VARCHAR) AS label FROM customer")
def identity_projection(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("iri"), F.lit(None).cast("string").alias("label"))


def _targets(spark, d):
    e, c, s = _t(spark, d, "events", "customer", "supplier")
    return D.lookup_first(e.select("event_id", "user_id"), "user_id", [("customer", c, "c_custkey"), ("supplier", s, "s_suppkey")])


@query("""SELECT event_id, user_id, CASE WHEN c_custkey IS NOT NULL THEN 'customer' WHEN s_suppkey IS NOT NULL THEN 'supplier' END AS target
FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey""")
def expand_multi_target(spark, d):
    return _targets(spark, d).select("event_id", "user_id", "target")


@query("SELECT DISTINCT user_id FROM events JOIN customer ON user_id = c_custkey JOIN supplier ON user_id = s_suppkey")
def ref_ambiguous(spark, d):
    return _targets(spark, d).where("targets > 1").select("user_id").distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ref_missing_anti(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    return D.missing_references(docs, "doc_id", labels, "doc_id").select("doc_id")


def _referrers(spark, d):
    o, e = _t(spark, d, "orders", "events")
    return [("orders", o, "o_custkey", "restrict"), ("events", e, "user_id", "unset")]


@query("""SELECT c_custkey, 'orders' AS referrer, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT c_custkey, 'events', count(*) FROM customer JOIN events ON c_custkey = user_id GROUP BY ALL""")
def incoming_ref_counts(spark, d):
    return D.incoming(_t(spark, d, "customer"), "c_custkey", [r[:3] for r in _referrers(spark, d)])


@query("""SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, c_custkey LIMIT 3""")
def incoming_ref_top3(spark, d):
    return D.incoming(_t(spark, d, "customer"), "c_custkey", [_referrers(spark, d)[0][:3]]).orderBy(F.desc("n"), "c_custkey").limit(3).select("c_custkey", "n")


_PLAN = """SELECT c_custkey, 'orders' AS referrer, count(*) AS n, '{0}' AS action FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 7 GROUP BY ALL
UNION ALL SELECT c_custkey, 'events', count(*), '{1}' FROM customer JOIN events ON c_custkey = user_id WHERE c_nationkey = 7 GROUP BY ALL"""


def _plan(spark, d, mode):
    return D.delete_plan(_t(spark, d, "customer").where("c_nationkey = 7"), "c_custkey", _referrers(spark, d), mode)


@query(_PLAN.format("block", "block"))
def delete_restrict_blocked(spark, d):
    return _plan(spark, d, "restrict")


@query(_PLAN.format("block", "unset"))
def delete_detach_plan(spark, d):
    return _plan(spark, d, "detach_if_valid")


@query(_PLAN.format("unset", "unset"))
def delete_force_effect(spark, d):
    return _plan(spark, d, "force_detach")


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT name AS child, parent, 1 AS depth FROM tree WHERE parent IS NOT NULL
UNION SELECT up.child, t.parent, depth + 1 FROM up JOIN tree t ON up.parent = t.name WHERE t.parent IS NOT NULL AND depth < 9)
SELECT child, parent, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY child, parent""")
def class_closure(spark, d):
    return closure(_tree(spark)[1])


@query(f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT name AS child, name AS parent FROM tree UNION SELECT up.child, t.parent FROM up JOIN tree t ON up.parent = t.name WHERE t.parent IS NOT NULL)
SELECT DISTINCT up.parent AS class, child AS concrete FROM up JOIN tree t ON child = t.name WHERE NOT abstract""")
def concrete_descendant_classes(spark, d):
    return concrete_descendants(*_tree(spark))


@query("""SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent, 1 AS depth FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def closure_geo(spark, d):
    c, n = _t(spark, d, "customer", "nation")
    p = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    return closure(c.select(p("c", "c_custkey").alias("child"), p("n", "c_nationkey").alias("parent")).unionByName(n.select(p("n", "n_nationkey").alias("child"), p("r", "n_regionkey").alias("parent"))))


@query("""SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_orderkey) NOT BETWEEN 2 AND 6""")
def cardinality_violations(spark, d):
    o, l = _t(spark, d, "orders", "lineitem")
    counts = l.groupBy("l_orderkey").agg(_count())
    return o.join(counts, o.o_orderkey == counts.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")).where("n not between 2 and 6")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_duplicate_id(spark, d):
    return D.duplicate_keys(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT missing, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'a' END, CASE WHEN event_id % 5 = 0 THEN 'b' END) AS missing FROM events) GROUP BY 1""")
def skip_by_combo(spark, d):
    e = _t(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, 1).alias("a"), F.when(F.col("event_id") % 5 != 0, 1).alias("b"))
    return e.select(D.missing_fields(e, ["a", "b"]).alias("missing")).groupBy("missing").agg(_count())


@query("""WITH n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name != 'ASIA')),
c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'region' AS collection, 1 AS round, count(*) AS n FROM region WHERE r_name != 'ASIA' UNION ALL SELECT 'nation', 2, count(*) FROM n
UNION ALL SELECT 'customer', 3, count(*) FROM c UNION ALL SELECT 'orders', 4, count(*) FROM o""")
def import_fixpoint_rounds(spark, d):
    chain = [("region", "r_regionkey", None), ("nation", "n_nationkey", "n_regionkey"), ("customer", "c_custkey", "c_nationkey"), ("orders", "o_orderkey", "o_custkey")]
    name = lambda t, c: F.concat(F.lit(f"{t}#"), F.col(c).cast("string"))
    docs = refs = None
    for k, (t, key, ref) in enumerate(chain):
        rows = _t(spark, d, t)
        blocked = F.col("r_name") == "ASIA" if t == "region" else F.lit(False)
        mine = rows.select(name(t, key).alias("id"), F.lit(t).alias("collection"), blocked.alias("blocked"))
        docs = mine if docs is None else docs.unionByName(mine)
        if ref:
            links = rows.select(name(t, key).alias("id"), F.lit(ref).alias("field"), name(chain[k - 1][0], ref).alias("target"), F.lit(True).alias("required"))
            refs = links if refs is None else refs.unionByName(links)
    state = I.import_fixpoint(docs, refs).documents
    return state.where("round is not null").groupBy("collection", "round").agg(_count())


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_merge(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return D.upsert(c, c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_merge(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return D.patch(c, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment")), "c_custkey")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedupe_first(spark, d):
    return D.first_of(_t(spark, d, "documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], ["doc_id"])


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect_nations(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT c_mktsegment AS name FROM customer UNION SELECT p_type FROM part")
def set_union_names(spark, d):
    c, p = _t(spark, d, "customer", "part")
    return c.select(F.col("c_mktsegment").alias("name")).union(p.select("p_type")).distinct()


@query("SELECT user_id AS k FROM events EXCEPT SELECT s_suppkey FROM supplier")
def set_except_users(spark, d):
    e, s = _t(spark, d, "events", "supplier")
    return e.select(F.col("user_id").alias("k")).subtract(s.select("s_suppkey"))


@query(r"""SELECT name, lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '([^_])([A-Z])([a-z])', '\1_\2\3', 'g')) AS snake
FROM (SELECT DISTINCT c_mktsegment || 'Of' || n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def snake_names(spark, d):
    c, n = _t(spark, d, "customer", "nation")
    names = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat("c_mktsegment", F.lit("Of"), "n_name").alias("name")).distinct()
    return names.select("name", snake_case(F.col("name")).alias("snake"))


@query(r"""SELECT name, CASE WHEN ends_with(name, 's') THEN name || 'es' WHEN regexp_matches(name, '[^aeiou]y$') THEN regexp_replace(name, 'y$', 'ies') ELSE name || 's' END AS plural
FROM (SELECT DISTINCT lower(c_mktsegment) AS name FROM customer)""")
def plural_names(spark, d):
    return _t(spark, d, "customer").select(F.lower("c_mktsegment").alias("name")).distinct().select("name", pluralize(F.col("name")).alias("plural"))


@query(r"SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^#/]*$', 0) AS name FROM pages")
def local_names(spark, d):
    return _t(spark, d, "pages").select("page_id", local_name(F.col("url")).alias("name"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'integer' WHEN event_id % 4 = 1 THEN 'double' WHEN event_id % 4 = 2 THEN 'string' ELSE 'boolean' END AS kind FROM events) GROUP BY 1""")
def infer_scalar_types(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.col("event_id"), F.lit(".5"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit(" True"))
    return _t(spark, d, "events").select(xsd_type(text).alias("kind")).groupBy("kind").agg(_count())


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 1 END AS BIGINT) AS as_int, CASE event_id % 4 WHEN 0 THEN event_id + 0.75 WHEN 1 THEN event_id WHEN 2 THEN 1 END::DOUBLE AS as_float,
CASE WHEN event_id % 4 = 2 THEN TRUE WHEN event_id IN (0, 1) AND event_id % 4 = 1 THEN event_id = 1 END AS as_bool FROM events""")
def cast_scalars(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.col("event_id"), F.lit(".75"))).when(k == 1, F.col("event_id").cast("string")).when(k == 2, F.lit(" 1 ")).otherwise(F.lit("x1"))
    return _t(spark, d, "events").select("event_id", casts.parse_int(text).alias("as_int"), casts.parse_float(text).alias("as_float"), casts.parse_bool(text).alias("as_bool"))


#: Variants of event payloads: what a document of the class Event may get wrong.
_RULES = [("Event", "k", "scalar", "int", True, False, None, None), ("Event", "tags", "scalar", "string", False, True, 1, 2)]
_RULE_COLUMNS = "class string, field string, kind string, bson_type string, required boolean, is_array boolean, min_items int, max_items int"


def _event_issues(spark, d, *codes):
    n = F.col("event_id") % 7
    payload = F.when(n == 0, '{"k": 1}').when(n == 1, '{"k": "one"}').when(n == 2, '{"tags": ["a"]}').when(n == 3, '{"k": 2, "what": 3}').when(n == 4, '{"k": 3, "tags": ["a", "b", "c"]}').when(n == 5, '{"k": " "}').otherwise('{"k": 4, "tags": "a"}')
    docs = _t(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit("Event").alias("class"), payload.alias("payload"))
    classes, rules = spark.createDataFrame([("Event", False)], "name string, is_abstract boolean"), spark.createDataFrame(_RULES, _RULE_COLUMNS)
    return V.validate(docs, classes, rules).where(F.col("code").isin(*codes))


@query("SELECT event_id AS doc_id, 'missing_required_field' AS code, 'k' AS field FROM events WHERE event_id % 7 IN (2, 5)")
def validate_required(spark, d):
    return _event_issues(spark, d, "missing_required_field")


@query("""SELECT event_id AS doc_id, CASE event_id % 7 WHEN 1 THEN 'scalar_type_mismatch' WHEN 4 THEN 'cardinality_too_large' ELSE 'scalar_array_expected' END AS code,
CASE event_id % 7 WHEN 1 THEN 'k' ELSE 'tags' END AS field FROM events WHERE event_id % 7 IN (1, 4, 6)""")
def validate_types(spark, d):
    return _event_issues(spark, d, "scalar_type_mismatch", "scalar_array_expected", "cardinality_too_large")


@query("SELECT event_id AS doc_id, 'unknown_field' AS code, 'what' AS field FROM events WHERE event_id % 7 = 3")
def validate_unknown_fields(spark, d):
    return _event_issues(spark, d, "unknown_field")


@query("""SELECT c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'A,B' ELSE 'B,C' END AS overlap FROM customer WHERE c_custkey % 3 != 1""")
def disjoint_overlap(spark, d):
    """Customers of two classes, which one disjoint group may hold both of."""
    kinds = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("A"), F.lit("D"))).otherwise(F.array(F.lit("C"), F.lit("B")))
    types = _t(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.explode(kinds).alias("type"))
    groups = spark.createDataFrame([(["A", "B", "C"],), (["D", "E"],)], "class_names array<string>")
    return V.disjoint_overlap(types, groups).select("name", F.array_join("overlap", ",").alias("overlap"))


@query("""SELECT p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Long_Part_Type' WHEN p_partkey % 3 = 0 THEN 'Bolt' ELSE 'Screw' END AS type FROM part""")
def route_concrete_type(spark, d):
    """Of the types with a collection, the one with most underscores, the longest, the first."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("name"))
    kinds = F.when(F.col("name") % 2 == 0, F.array(*map(F.lit, ["Bolt", "Long_Part_Type", "Part_Type"]))).when(F.col("name") % 3 == 0, F.array(*map(F.lit, ["Thing_Without_Collection", "Bolt", "Nuts"]))).otherwise(F.array(*map(F.lit, ["Screw", "Bolts", "Nut"])))
    types = p.select("name", F.posexplode(kinds).alias("position", "type"))
    routable = spark.createDataFrame([(x,) for x in ("Bolt", "Long_Part_Type", "Part_Type", "Nuts", "Screw", "Bolts", "Nut")], "type string")
    return I.choose_type(types, routable)


@query("""SELECT l_orderkey AS class, max(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END) AS min_items, min(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END) AS max_items, bool_or(l_linenumber % 2 = 0) AS required
FROM lineitem GROUP BY 1""")
def cardinality_merge(spark, d):
    """Line numbers as bounds of a property: the largest minimum, the least maximum, required where any rule says so."""
    n = F.col("l_linenumber")
    rules = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("class"), F.lit("has").alias("property"), F.when(n % 2 == 0, n).alias("lo"), F.when(n % 3 == 0, n).alias("hi"), F.lit(None).cast("string").alias("filler"))
    return collections.merge_bounds(rules).select("class", "min_items", "max_items", "required")


@query("""SELECT doc_id, max(CASE WHEN quality = 1 THEN 'en' ELSE '' END || CASE WHEN toxic = 1 THEN 'x' ELSE '' END) AS best FROM labels GROUP BY 1""")
def annotation_rank(spark, d):
    """One annotation of each value: with a language before one with a datatype alone, before a bare one."""
    rows = _t(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("subject"), F.lit("comment").alias("property"), F.lit("v").alias("value"), F.when(F.col("quality") == 1, "en").alias("lang"),
        F.when(F.col("toxic") == 1, "x").alias("datatype"), F.lit("literal").alias("value_type"),
    )
    best = blueprint.best_annotations(rows.unionByName(rows.withColumns({"lang": F.lit(None).cast("string"), "datatype": F.lit(None).cast("string")})))
    return best.select(F.col("subject").cast("bigint").alias("doc_id"), F.concat(F.coalesce("lang", F.lit("")), F.coalesce("datatype", F.lit(""))).alias("best"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def catalog_counts(spark, d):
    out = None
    for t in TABLES:
        x = _t(spark, d, t).agg(_count()).select(F.lit(t).alias("name"), "n")
        out = x if out is None else out.unionByName(x)
    return out
