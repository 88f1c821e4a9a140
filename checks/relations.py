"""Lookups, key checks, dependency levels, inference and related tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import duck as D
from itertools import combinations, permutations

from checks.registry import Tables, check
from rowloom.operators.dependency import adjacent, cyclic_nodes, dependency_levels, edge_value, load_order, one_cycle, self_references
from rowloom.operators.keys import check_foreign_key, check_primary_key
from rowloom.operators.lookup import (
    cross_product, fk_sample, lookup_by_position, lookup_one, lookup_scalar, semi_lookup,
)
from rowloom.operators.row_index import with_row_index
from rowloom.plans.discover import discover_references, discover_unique_keys
from rowloom.plans.database import generate_database
from rowloom.plans.generate import project
from rowloom.plans.infer import ForeignKeySpec, KeySpec, infer_from_data, infer_spec
from rowloom.plans.spec import ColumnSpec, ForeignKey, Identity, TableSpec, ValueSet

# -- lookups -----------------------------------------------------------------------


@check("lookup_one", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def lookup_one_(t: Tables):
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return lookup_one(t.orders.select("o_orderkey", "o_custkey"), names, ["o_custkey"], "c_name").select("o_orderkey", "c_name")


@check(
    "lookup_one_lenient",
    """SELECT p_partkey, (SELECT min(l_orderkey) FROM lineitem WHERE l_partkey = p_partkey
       HAVING count(*) = 1) AS l_orderkey FROM part""",
)
def lookup_one_lenient(t: Tables):
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return lookup_one(t.part.select("p_partkey"), lines, ["p_partkey"], "l_orderkey", strict=False)


@check(
    "lookup_scalar",
    "SELECT c_custkey, c_acctbal > (SELECT max(s_acctbal) FROM supplier) AS above_all_suppliers FROM customer",
)
def lookup_scalar_(t: Tables):
    top = lookup_scalar(t.supplier.agg(F.max("s_acctbal")))
    return t.customer.select("c_custkey", (F.col("c_acctbal") > top).alias("above_all_suppliers"))


@check(
    "lookup_by_position",
    """WITH names AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
       SELECT o_orderkey, c_name FROM orders JOIN names ON pos = o_orderkey % 10""",
)
def by_position(t: Tables):
    names = t.customer.select("c_custkey", "c_name")
    found = lookup_by_position(t.orders.select("o_orderkey"), F.col("o_orderkey") % 10, names, ["c_custkey"])
    return found.select("o_orderkey", "c_name")


@check(
    "fk_sample",
    f"""WITH parents AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)
        SELECT id AS o_orderkey, s_suppkey FROM {D.rows('orders', 'o_orderkey', 'orders.supplier')}
        JOIN parents ON pos = {D.bits('d')} % (SELECT count(*) FROM supplier)""",
)
def fk_sample_(t: Tables):
    return fk_sample(t.orders.select("o_orderkey"), F.col("o_orderkey"), t.supplier, ["s_suppkey"], "orders.supplier")


@check("semi_lookup", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi(t: Tables):
    keys = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return semi_lookup(t.customer.select("c_custkey"), keys, ["c_custkey"])


@check(
    "anti_lookup",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def anti(t: Tables):
    keys = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return semi_lookup(t.customer.select("c_custkey"), keys, ["c_custkey"], present=False)


@check(
    "cross_product",
    "SELECT r_name, n_name, p_brand FROM region, nation, (SELECT DISTINCT p_brand FROM part) brands",
)
def cross(t: Tables):
    brands = t.part.select("p_brand").distinct()
    return cross_product(t.spark, (t.region, "r_name"), (t.nation, "n_name"), (brands, "p_brand"))


@check("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_index(t: Tables):
    frame = t.orders.select("o_orderkey", "o_orderdate")
    return with_row_index(frame, ["o_orderdate", "o_orderkey"], small=False).select("o_orderkey", "row_index")


# -- keys ----------------------------------------------------------------------------


@check(
    "check_primary_key",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def primary_key(t: Tables):
    return check_primary_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@check(
    "check_foreign_key",
    "SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer "
    "WHERE c_acctbal > 0) GROUP BY o_custkey",
)
def foreign_key(t: Tables):
    return check_foreign_key(t.orders, t.customer.filter("c_acctbal > 0"), [("o_custkey", "c_custkey")])


# -- dependency levels: each turn of a conversation depends on the one before -----------

TURNS = """(SELECT conv_id * 1000 + turn AS child, conv_id * 1000 + lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)
    AS parent, role FROM conversations)"""


def turn_edges(t: Tables):
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t.conversations.select("conv_id", "turn", "role", before.alias("before")).filter("before IS NOT NULL")
    return pairs.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("child"), (F.col("conv_id") * 1000 + F.col("before")).alias("parent"),
        "role",
    )


LEVELS = f"""WITH RECURSIVE edges AS (SELECT * FROM {TURNS} turns WHERE parent IS NOT NULL),
    reach(node, level) AS (
      SELECT DISTINCT parent, 0::BIGINT FROM edges WHERE parent NOT IN (SELECT child FROM edges)
      UNION SELECT child, level + 1 FROM edges JOIN reach ON parent = node)
    SELECT node, max(level) AS level FROM reach GROUP BY node"""


@check("dependency_levels", LEVELS)
def levels(t: Tables):
    return dependency_levels(turn_edges(t))


@check("load_order", LEVELS)
def ordered(t: Tables):
    return load_order(turn_edges(t))


TYPE_EDGES = """(SELECT DISTINCT event_type AS child, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
    AS parent FROM events)"""


def type_edges(t: Tables):
    """Which event type follows which, over users' whole histories."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select(F.col("event_type").alias("child"), before.alias("parent")).dropna().distinct()


@check(
    "cyclic_nodes",
    f"""WITH RECURSIVE edges AS (SELECT * FROM {TYPE_EDGES} types WHERE parent IS NOT NULL),
        up(node, ancestor) AS (SELECT child, parent FROM edges
          UNION SELECT node, parent FROM up JOIN edges ON ancestor = child)
        SELECT DISTINCT node FROM up WHERE ancestor IN (SELECT node FROM up WHERE node = ancestor)""",
)
def cyclic(t: Tables):
    return cyclic_nodes(type_edges(t))


@check(
    "one_cycle",
    f"""WITH RECURSIVE edges AS (SELECT * FROM {TYPE_EDGES} types WHERE child <> parent),
        up(node, ancestor) AS (SELECT child, parent FROM edges UNION SELECT node, parent FROM up JOIN edges ON ancestor = child),
        cyclic AS (SELECT node FROM up WHERE node = ancestor),
        core AS (SELECT node FROM up WHERE ancestor IN (SELECT node FROM cyclic)
          INTERSECT SELECT ancestor FROM up WHERE node IN (SELECT node FROM cyclic)),
        step AS (SELECT child, min(parent) AS parent FROM edges WHERE child IN (SELECT node FROM core)
          AND parent IN (SELECT node FROM core) GROUP BY child),
        walk(node) AS (SELECT min(child) FROM step UNION SELECT parent FROM walk JOIN step ON node = child),
        round(a, b) AS (SELECT child, parent FROM step UNION SELECT a, parent FROM round JOIN step ON b = child)
        SELECT child, parent FROM step WHERE child IN (SELECT node FROM walk) AND child IN (SELECT a FROM round WHERE a = b)""",
)
def one_cycle_(t: Tables):
    return one_cycle(type_edges(t).filter("child <> parent"))


@check("self_references", f"SELECT child, parent FROM {TYPE_EDGES} types WHERE child = parent")
def selfs(t: Tables):
    return self_references(type_edges(t))


@check("adjacent", f"SELECT DISTINCT parent AS node FROM {TYPE_EDGES} types WHERE child = 'click' AND parent IS NOT NULL")
def adjacent_(t: Tables):
    return adjacent(type_edges(t), "click")


@check("edge_value", f"""SELECT DISTINCT role FROM {TURNS} turns WHERE child = (SELECT min(child) FROM {TURNS} x WHERE parent
    IS NOT NULL) AND parent = (SELECT min(parent) FROM {TURNS} y)""")
def edge_value_(t: Tables):
    edges = turn_edges(t)
    first = edges.agg(F.min("child"), F.min("parent")).first()
    return edge_value(edges, first[0], first[1], "role")


# -- inference and related tables ---------------------------------------------------------


@check(
    "enum_inference",
    f"""WITH brands AS (SELECT list(DISTINCT p_brand ORDER BY p_brand) AS b FROM part)
        SELECT id AS row_number, b[1+{D.bits('d')}%len(b)] AS p_brand FROM {D.rows('part', 'p_partkey', 'part.p_brand')}, brands""",
)
def enum_inference(t: Tables):
    spec = infer_from_data("part", t.part.select("p_brand"), 50)
    return project(spec, t.part.select(F.col("p_partkey").alias("row_number")))


INFERRED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("active", T.BooleanType()), T.StructField("size", T.ShortType()),
    T.StructField("total", T.DecimalType(9, 2)), T.StructField("zip", T.StringType()),
    T.StructField("code", T.StringType(), metadata={"length": 8}),
])


@check(
    "infer_type_map",
    f"""SELECT id+1 AS id, {D.bits(D.cell('t.active', 'id'))}%2=0 AS active, ({D.bits(D.cell('t.size', 'id'))}%32768)::INTEGER AS size,
        (({D.bits(D.cell('t.total', 'id'))}%1000000000)::DECIMAL(10,0)*0.01::DECIMAL(2,2))::DECIMAL(9,2) AS total,
        lpad(({D.bits(D.cell('t.zip', 'id'))}%100000)::VARCHAR,5,'0') AS zip, length(c_name) AS code_length
        FROM (SELECT c_custkey AS id, 'xxxxxxxx' AS c_name FROM customer) src""",
)
def infer_type_map(t: Tables):
    spec = infer_spec("t", INFERRED, KeySpec(primary_key=("id",)))
    made = project(spec, t.customer.select(F.col("c_custkey").alias("row_number")))
    return made.select("id", "active", "size", "total", "zip", F.length("code").cast("bigint").alias("code_length"))


@check(
    "infer_and_generate",
    f"""WITH parents AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
        states AS (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM orders),
        drawn AS (SELECT o_orderkey AS id, {D.bits(D.cell('orders.o_custkey', 'o_orderkey'))} % (SELECT count(*) FROM customer) AS pos,
          {D.bits(D.cell('orders.o_orderstatus', 'o_orderkey'))} AS h FROM orders)
        SELECT 1 + id AS o_orderkey, c_custkey AS o_custkey, (SELECT s FROM states)[1 + h % (SELECT len(s) FROM states)] AS o_orderstatus
        FROM drawn JOIN parents USING (pos)""",
)
def infer_and_generate(t: Tables):
    keys = KeySpec(("o_orderkey",), (ForeignKeySpec(("o_custkey",), "customer", ("c_custkey",)),))
    spec = infer_from_data("orders", t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), 50, keys)
    index = t.orders.select(F.col("o_orderkey").alias("row_number"))
    return project(spec, index, parent_tables={"customer": t.customer}).drop("row_number")


SHOP = (
    TableSpec("buyer", (
        ColumnSpec("id", identity=Identity("unordered")), ColumnSpec("kind", value_set=ValueSet(("A", "B", "C"))),
    )),
    TableSpec("purchase", (
        ColumnSpec("id", identity=Identity("sequence", 1, None, 1)), ColumnSpec("buyer_id", foreign_key=ForeignKey("buyer", "id")),
    )),
    TableSpec("purchase_line", (
        ColumnSpec("purchase_id", foreign_key=ForeignKey("purchase", "id")),
        ColumnSpec("part", foreign_key=ForeignKey("part", "p_partkey")),
    )),
)


def scattered(row: str) -> str:
    return f"(({row})//2147483647)*2147483648+((({row})%2147483647)*1103515245)%2147483647"


@check(
    "generate_database",
    f"""WITH buyer AS (SELECT {scattered('id')} AS id, {D.pick(D.cell('buyer.kind', 'id'), ['A', 'B', 'C'])} AS kind
            FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer)))::BIGINT AS id) r),
        purchase AS (SELECT 1 + id AS id, {scattered(D.bits(D.cell('purchase.buyer_id', 'id')) + '%(SELECT count(*) FROM customer)')}
            AS buyer_id FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders)))::BIGINT AS id) r),
        parts AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
        line AS (SELECT 1 + {D.bits(D.cell('purchase_line.purchase_id', 'id'))}%(SELECT count(*) FROM orders) AS purchase_id,
            {D.bits(D.cell('purchase_line.part', 'id'))}%(SELECT count(*) FROM part) AS pos
            FROM (SELECT unnest(range(0, (SELECT count(*) FROM lineitem)))::BIGINT AS id) r)
        SELECT kind, p_brand, count(*) AS n_lines FROM line JOIN parts USING (pos)
        JOIN purchase ON purchase.id = purchase_id JOIN buyer ON buyer.id = buyer_id GROUP BY kind, p_brand""",
)
def database(t: Tables):
    counts = {"buyer": t.customer.count(), "purchase": t.orders.count(), "purchase_line": t.lineitem.count()}
    specs = [s.with_rows(counts[s.name]) for s in SHOP]
    made = generate_database(t.spark, specs, existing={"part": t.part})
    lines = made["purchase_line"].join(t.part.select(F.col("p_partkey").alias("part"), "p_brand"), "part")
    purchases = made["purchase"].select(F.col("id").alias("purchase_id"), "buyer_id")
    buyers = made["buyer"].select(F.col("id").alias("buyer_id"), "kind")
    joined = lines.join(purchases, "purchase_id").join(buyers, "buyer_id")
    return joined.groupBy("kind", "p_brand").agg(F.count(F.lit(1)).alias("n_lines"))


# -- keys and references read from the data ------------------------------------------------------

KEY_TABLES = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "conversations": "conv_id turn role text",
}


def unique_keys_sql() -> str:
    """Every combination of up to three columns, counted; then the minimal ones."""
    parts = []
    for table, columns in KEY_TABLES.items():
        for size in (1, 2, 3):
            for c in combinations(columns.split(), size):
                no_null = " AND ".join(f"count({x}) = count(*)" for x in c)
                parts.append(f"SELECT '{table}' AS table_name, {list(c)} AS c WHERE (SELECT {no_null} FROM {table}) AND (SELECT count(*) FROM {table}) = "
                             f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM {table}))")
    found = " UNION ALL ".join(parts)
    return (f"WITH f AS ({found}) SELECT table_name, array_to_string(c, ',') AS key_columns, len(c)::INTEGER AS n_columns FROM f a WHERE NOT EXISTS "
            "(SELECT 1 FROM f b WHERE b.table_name = a.table_name AND len(b.c) < len(a.c) AND list_has_all(a.c, b.c))")


@check("discover_unique_keys", unique_keys_sql())
def unique_keys(t: Tables):
    found = [(name, ",".join(k), len(k)) for name in KEY_TABLES for k in discover_unique_keys(getattr(t, name), 3)]
    return t.spark.createDataFrame(found, "table_name string, key_columns string, n_columns int")


REFERENCE_COLUMNS = [
    "region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey "
    "part.p_partkey part.p_size orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber",
    "region.r_name nation.n_name customer.c_name customer.c_mktsegment supplier.s_name part.p_name part.p_brand part.p_type orders.o_orderstatus "
    "orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus",
    "orders.o_orderdate lineitem.l_shipdate",
]


def references_sql() -> str:
    parts = []
    for family in REFERENCE_COLUMNS:
        for child, parent in permutations(family.split(), 2):
            (ct, cc), (pt, pc) = child.split("."), parent.split(".")
            parts.append(f"SELECT '{child}' AS child, '{parent}' AS parent, n AS n_values FROM (SELECT count(DISTINCT {cc}) AS n, "
                         f"bool_and({cc} IN (SELECT {pc} FROM {pt})) AS inside FROM {ct} WHERE {cc} IS NOT NULL) WHERE inside")
    return " UNION ALL ".join(parts)


@check("discover_foreign_keys", references_sql())
def foreign_keys(t: Tables):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return discover_references({name: getattr(t, name) for name in names})
