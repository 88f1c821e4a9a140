"""Sinks, sources, chunked ingest, metrics and streaming over the given tables."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks.registry import Tables, check
from rowloom.operators import ingest as I
from rowloom.operators import metrics as M
from rowloom.sources import text as X
from rowloom.sources.avro import read_avro, write_avro
from rowloom.sources.ids import IdBlocks
from rowloom.sources.target import FileTarget
from rowloom.session import scratch_path
from rowloom.streaming.ingest import read_files, stream_ingest

LINE_KEY = ["l_orderkey", "l_linenumber"]
ARRIVAL = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ORDERS_TEXT = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
)


def orders_text(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
PAGES_DDL = "page_id bigint, url string, html string"

# -- text files ----------------------------------------------------------------------


@check("csv_line", "SELECT '\"' || o_orderkey || '\";\"' || o_custkey || '\";\"' || o_orderstatus || '\"' AS line FROM orders")
def csv_line(t: Tables):
    return t.orders.select(X.csv_line(["o_orderkey", "o_custkey", "o_orderstatus"], ";", '"').alias("line"))


@check(
    "csv_line_nulls",
    "SELECT doc_id || ',' || coalesce(toxic::VARCHAR, 'null') AS line FROM documents LEFT JOIN labels USING (doc_id)",
)
def csv_line_nulls(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select(X.csv_line(["doc_id", "toxic"]).alias("line"))


def csv_round_trip(name: str, sql: str, table, ddl: str, **options):
    @check(name, sql)
    def run(t: Tables):
        path = scratch_path(t.spark, name)
        X.write_csv(table(t), path, **options)
        reader = {"nullValue": "null", "multiLine": "true"} if "html" in ddl else {"nullValue": "null"}
        return X.read_csv_rows(t.spark, path, StructType.fromDDL(ddl), options.get("delimiter", ","), **reader)


csv_round_trip("write_csv", ORDERS_SQL, orders_text, ORDERS_TEXT)
csv_round_trip("write_csv_delimiter", ORDERS_SQL, orders_text, ORDERS_TEXT, delimiter="|", quote="'")
csv_round_trip("write_csv_gzip", ORDERS_SQL, orders_text, ORDERS_TEXT, gzip=True)
csv_round_trip("write_csv_raw", ORDERS_SQL, orders_text, ORDERS_TEXT, raw=True, delimiter=";")


@check("write_csv_escaping", "SELECT page_id, url, html FROM pages")
def csv_escaping(t: Tables):
    path = scratch_path(t.spark, "pages")
    X.write_csv(t.pages, path)
    return t.spark.read.schema(PAGES_DDL).options(header="true", escape='"', multiLine="true", nullValue="null").csv(path)


@check("read_csv_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def read_csv_rows(t: Tables):
    path = scratch_path(t.spark, "padded")
    padded = t.customer.select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), "c_mktsegment")
    X.write_csv(padded, path, raw=True)
    return X.read_csv_rows(t.spark, path, StructType.fromDDL("c_custkey bigint, c_name string, c_mktsegment string"))


@check("parallel_csv_load", f"{ORDERS_SQL} UNION ALL {ORDERS_SQL} UNION ALL {ORDERS_SQL}")
def parallel_csv(t: Tables):
    path = scratch_path(t.spark, "orders")
    X.write_csv(orders_text(t), path)
    return X.read_csv_rows(t.spark, [path] * 3, StructType.fromDDL(ORDERS_TEXT))


@check(
    "load_options",
    "SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders",
)
def load_options(t: Tables):
    path = scratch_path(t.spark, "orders")
    X.write_csv(orders_text(t), path, delimiter="|", raw=True)
    options = {"fields_terminated_by": "|", "skip": "1", "nullif": "5-LOW", "schema": ORDERS_TEXT, "strict_validation": "true"}
    return X.load(t.spark, path, options)


@check(
    "load_options_skip_comment",
    "SELECT c_custkey, c_name FROM customer",
)
def load_skip(t: Tables):
    path = scratch_path(t.spark, "lines")
    body = t.customer.select(F.concat_ws(";", "c_custkey", "c_name").alias("value"))
    # Every file gets two lines ahead of its rows; row ids order the lines inside a file.
    banner = F.array(F.lit("a banner"), F.lit("c_custkey;c_name"))
    parts = body.repartitionByRange(4, "value").withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    heads = parts.select("p").distinct().select(F.explode(banner).alias("value"), "p").withColumn(
        "at", F.when(F.col("value") == "a banner", F.lit(-2)).otherwise(F.lit(-1)).cast("bigint")
    )
    lines = parts.unionByName(heads).repartition(4, "p").sortWithinPartitions("p", "at")
    lines.select("p", "value").write.partitionBy("p").text(path)
    return X.load(t.spark, path, {"delimiter": ";", "skip": "2", "schema": "c_custkey bigint, c_name string"})


@check("load_options_json", "SELECT event_id, user_id, event_type FROM events")
def load_json(t: Tables):
    path = scratch_path(t.spark, "events")
    t.events.select("event_id", "user_id", "event_type").write.json(path)
    return X.load(t.spark, path, {"data_as_json_records": "true", "schema": "event_id bigint, user_id bigint, event_type string"})


@check("insert_append", f"{ORDERS_SQL} UNION ALL {ORDERS_SQL}")
def insert_append(t: Tables):
    path = scratch_path(t.spark, "orders")
    X.insert(orders_text(t), path)
    X.insert(orders_text(t), path)
    return t.spark.read.schema(ORDERS_TEXT).parquet(path)


@check("copy_from", ORDERS_SQL)
def copy_from(t: Tables):
    path = scratch_path(t.spark, "orders")
    X.write_csv(orders_text(t), path)
    return X.copy_from(t.spark, path, scratch_path(t.spark, "table"), StructType.fromDDL(ORDERS_TEXT))


@check(
    "write_avro",
    "SELECT * REPLACE (o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey) FROM orders",
)
def avro(t: Tables):
    path = scratch_path(t.spark, "avro")
    write_avro(orders_text(t).repartition(4), path)
    found = read_avro(t.spark, path, orders_text(t).columns)  # all are text; how a number is spelled is Spark's matter
    return found.withColumns({"o_totalprice": F.col("o_totalprice").cast("double"), "o_orderdate": F.col("o_orderdate").cast("timestamp_ntz")})


@check("write_avro_gzip", "SELECT page_id::VARCHAR AS page_id, url, html FROM pages")
def avro_gzip(t: Tables):
    path = scratch_path(t.spark, "avro")
    write_avro(t.pages, path, zipped=True)
    return read_avro(t.spark, path, t.pages.columns)


# -- chunks and column arrays -----------------------------------------------------------


@check(
    "assign_chunks",
    """SELECT chunk_id, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM
       (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS chunk_id FROM orders) src GROUP BY chunk_id""",
)
def chunks(t: Tables):
    chunked = I.assign_chunks(t.orders.select("o_orderkey"), ["o_orderkey"])
    return chunked.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@check(
    "pack_columns",
    """SELECT chunk_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys,
       string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS states FROM
       (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS chunk_id FROM orders) src GROUP BY chunk_id""",
)
def pack(t: Tables):
    chunked = I.assign_chunks(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    packed = I.pack_columns(chunked, "chunk_id", ["row_index"], ["o_orderkey", "o_orderstatus"])
    return packed.select("chunk_id", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"),
                         F.array_join("o_orderstatus", ",").alias("states"))


@check(
    "unpack_columns",
    "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS chunk_id, o_orderkey, o_orderstatus FROM orders",
)
def unpack(t: Tables):
    columns = ["o_orderkey", "o_orderstatus"]
    chunked = I.assign_chunks(t.orders.select(*columns), ["o_orderkey"])
    return I.unpack_columns(I.pack_columns(chunked, "chunk_id", ["row_index"], columns), "chunk_id", columns)


# -- conflicts ------------------------------------------------------------------------------

ORDER_SQL = ", ".join(ARRIVAL)
FIRSTS = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY {ORDER_SQL}) AS rn FROM lineitem) x WHERE rn = 1)"""
LASTS = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY {', '.join(c + ' DESC' for c in ARRIVAL)}) AS rn FROM lineitem) x WHERE rn = 1)"""
SHOWN = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
SHOWN_COLUMNS = SHOWN.split(", ")


def line_target(t: Tables, start) -> FileTarget:
    target = FileTarget.create(t.spark, scratch_path(t.spark, "lines"), t.lineitem.schema, LINE_KEY)
    if start is not None:
        target.append(start)
    return target


def early_lines(t: Tables):
    """One row per key of the finished lines, which the target holds before the ingest."""
    return I.first_per_key(t.lineitem.filter("l_linestatus = 'F'"), LINE_KEY, ARRIVAL)


def per_key(condition: str, direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ARRIVAL)
    return f"""(SELECT * FROM lineitem WHERE {condition} QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY {order}) = 1)"""


EARLY = per_key("l_linestatus = 'F'", "ASC")
BACK = per_key("l_returnflag = 'R'", "DESC")


@check(
    "insert_conflicts",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows, bool_or(l_linestatus = 'F') AS in_target FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR bool_or(l_linestatus = 'F')""",
)
def insert_conflicts(t: Tables):
    return I.conflicts(t.lineitem, t.lineitem.filter("l_linestatus = 'F'"), LINE_KEY)


@check("insert_error_mode", "SELECT * FROM orders")
def insert_error(t: Tables):
    target = FileTarget.create(t.spark, scratch_path(t.spark, "orders"), t.orders.schema, ["o_orderkey"])
    I.ingest(t.orders.filter("o_orderstatus = 'F'"), target, ["o_orderkey"])
    I.ingest(t.orders.filter("o_orderstatus <> 'F'"), target, ["o_orderkey"])
    try:
        I.ingest(t.orders, target, ["o_orderkey"])
    except I.KeyConflict:
        return target.read()
    raise AssertionError("a repeated key was accepted")


@check(
    "insert_do_nothing",
    f"SELECT {SHOWN} FROM {EARLY} e UNION ALL SELECT {SHOWN} FROM {FIRSTS} f ANTI JOIN {EARLY} e USING (l_orderkey, l_linenumber)",
)
def do_nothing(t: Tables):
    target = line_target(t, early_lines(t))
    I.ingest(t.lineitem, target, ARRIVAL, "do_nothing")
    return target.read().select(*SHOWN_COLUMNS)


@check("upsert", f"SELECT {SHOWN} FROM {LASTS} l")
def upsert(t: Tables):
    target = line_target(t, early_lines(t))
    I.ingest(t.lineitem, target, ARRIVAL, "upsert")
    return target.read().select(*SHOWN_COLUMNS)


@check(
    "upsert_partial",
    f"SELECT {SHOWN} FROM {BACK} b UNION ALL SELECT {SHOWN} FROM {FIRSTS} f ANTI JOIN {BACK} b USING (l_orderkey, l_linenumber)",
)
def upsert_partial(t: Tables):
    base = I.first_per_key(t.lineitem, LINE_KEY, ARRIVAL)
    return I.upsert_rows(t.lineitem.filter("l_returnflag = 'R'"), base, LINE_KEY, ARRIVAL).select(*SHOWN_COLUMNS)


@check(
    "upsert_pruned",
    """WITH top AS (SELECT max(o_orderkey) AS k FROM orders)
       SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey BETWEEN k // 2 AND k // 2 + k // 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       o_orderdate FROM orders, top""",
)
def upsert_pruned(t: Tables):
    """A batch of one hundredth of the keys against a table that grew in key order: few files are opened."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    target = FileTarget.create(t.spark, scratch_path(t.spark, "orders"), rows.schema, ["o_orderkey"])
    top = rows.agg(F.max("o_orderkey")).first()[0]
    for n in range(4):
        target.append(rows.where(F.col("o_orderkey").between(n * top // 4 + (n > 0), (n + 1) * top // 4)))
    batch = rows.where(F.col("o_orderkey").between(top // 2, top // 2 + top // 100)).withColumn("o_orderstatus", F.lit("X"))
    I.ingest(batch, target, ["o_orderkey"], "upsert")
    return target.read()


@check(
    "id_blocks",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderkey) * 10 AS id FROM orders""",
)
def id_blocks(t: Tables):
    """Two loaders number their shares of a table from one allocator."""
    path = scratch_path(t.spark, "ids")
    shares = [t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus <> 'F'")]
    first, second = (IdBlocks(t.spark, path, start=10, step=10).number(s.select("o_orderkey"), ["o_orderkey"]) for s in shares)
    return first.unionByName(second)


# -- insert methods and errors ------------------------------------------------------------------

CHUNKED = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_index, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS chunk_id FROM events)"
BAD = "value < 2"


def chunked_events(t: Tables):
    return I.assign_chunks(t.events, ["event_id"])


def method_query(name: str, method: str, sql: str):
    @check(name, sql)
    def run(t: Tables):
        schema = StructType([*t.events.schema.fields])
        target = FileTarget.create(t.spark, scratch_path(t.spark, name), schema, ["event_id"])
        return I.chunked_insert(t.events, target, ["event_id"], method, "do_nothing", F.expr(BAD), "IGNORE_AND_CONTINUE")


WHOLE = f"""SELECT chunk_id, count(*) AS rows_in, CASE WHEN bool_or({BAD}) THEN 0 ELSE count(*) END AS rows_out
    FROM {CHUNKED} c GROUP BY chunk_id"""
method_query("batch_insert", "batch", WHOLE)
method_query("array_insert", "array", WHOLE)
method_query(
    "singleton_insert", "singleton",
    f"""SELECT chunk_id, count(*) AS rows_in, count(*) FILTER (row_index < coalesce(first_bad, row_index + 1)) AS rows_out
        FROM {CHUNKED} c LEFT JOIN (SELECT chunk_id, min(row_index) AS first_bad FROM {CHUNKED} c WHERE {BAD}
        GROUP BY chunk_id) b USING (chunk_id) GROUP BY chunk_id""",
)


@check("array_insert_target", f"SELECT event_id, user_id, event_type, value FROM {CHUNKED} c WHERE chunk_id NOT IN "
       f"(SELECT chunk_id FROM {CHUNKED} b WHERE {BAD})")
def array_target(t: Tables):
    target = FileTarget.create(t.spark, scratch_path(t.spark, "events"), t.events.schema, ["event_id"])
    I.chunked_insert(t.events, target, ["event_id"], "array", "error", F.expr(BAD), "IGNORE_AND_CONTINUE")
    return target.read().select("event_id", "user_id", "event_type", "value")


@check("drop_bad_chunks", f"SELECT event_id, chunk_id FROM {CHUNKED} c WHERE chunk_id NOT IN (SELECT chunk_id FROM {CHUNKED} b WHERE {BAD})")
def drop_bad_chunks(t: Tables):
    kept = I.apply_error_policy(chunked_events(t), F.expr(BAD), "LOG_AND_CONTINUE", "batch")
    return kept.select("event_id", "chunk_id")


@check("quarantine", f"SELECT event_id, {BAD} AS rejected FROM events")
def quarantine(t: Tables):
    good, rejected = I.split_rejects(t.events, F.expr(BAD))
    return good.select("event_id", F.lit(False).alias("rejected")).unionByName(rejected.select("event_id", F.lit(True).alias("rejected")))


@check(
    "permissive_read",
    "SELECT event_type = 'click' AS corrupt, count(*) AS n_rows, count(*) FILTER (event_type <> 'click') AS n_users FROM events "
    "GROUP BY event_type = 'click'",
)
def permissive(t: Tables):
    path = scratch_path(t.spark, "lines")
    number = F.when(F.col("event_type") == "click", F.lit("not a number")).otherwise(F.col("user_id").cast("string"))
    t.events.select(F.concat_ws(",", "event_id", number).alias("value")).write.text(path)
    schema = X.with_corrupt_column(StructType.fromDDL("event_id bigint, user_id bigint"))
    read = t.spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    # The corrupt column can only be read together with data columns.
    flags = read.select("user_id", F.col("_corrupt_record").isNotNull().alias("corrupt"))
    return flags.groupBy("corrupt").agg(F.count(F.lit(1)).alias("n_rows"), F.count("user_id").alias("n_users"))


@check(
    "statement_counts",
    f"""SELECT chunk_id, count(*) AS n_rows, (count(*) + 127) // 128 AS n_statements FROM
        (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS chunk_id FROM events) c GROUP BY chunk_id""",
)
def statement_counts(t: Tables):
    return I.statements(I.assign_chunks(t.events, ["event_id"], 1000), "batch")


@check(
    "update_counts",
    f"""SELECT chunk_id, CASE WHEN sum(greatest(event_id % 4 - 2, 0)) > 0 THEN sum(greatest(event_id % 4 - 2, 0))::BIGINT
        ELSE count(*) END AS n_updated FROM {CHUNKED} c GROUP BY chunk_id""",
)
def update_counts(t: Tables):
    return I.update_counts(chunked_events(t).withColumn("status", F.col("event_id") % 4 - 2), "status")


# -- metrics ------------------------------------------------------------------------------------

CENTS = "round(value * 100)::BIGINT"


def cents(t: Tables):
    return t.events.select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@check(
    "summarize",
    f"""SELECT event_type, count(*) AS count, sum({CENTS})::BIGINT AS total, avg({CENTS}) AS mean, max({CENTS}) AS max
        FROM events GROUP BY event_type""",
)
def summarize(t: Tables):
    return M.summarize(cents(t), "cents", ["event_type"])


QUANTILES = ", ".join(f"quantile_disc({{v}}, {p}) AS {n}" for n, p in M.PERCENTILES.items())


@check("percentiles", f"SELECT event_type, {QUANTILES.format(v=CENTS)} FROM events GROUP BY event_type")
def percentiles(t: Tables):
    return M.percentiles(cents(t), "cents", ["event_type"])


@check("percentiles_spread", f"SELECT {QUANTILES.format(v='l_extendedprice')} FROM lineitem")
def percentiles_spread(t: Tables):
    return M.percentiles(t.lineitem, "l_extendedprice", small=False)


@check("percentiles_sketch")
def percentiles_sketch(t: Tables):
    return M.percentiles_sketch(cents(t), "cents", ["event_type"])


# log-linear buckets of 8 bits, spelled in SQL
BUCKETED = f"""buckets AS (SELECT event_type, CASE WHEN v < 0 THEN -i - 1 ELSE i END AS bucket, count(*) AS count FROM (
    SELECT event_type, v, s * 128 + (m >> s) AS i FROM (
        SELECT *, greatest(0, length(bin(m)) - 8) AS s FROM (
            SELECT event_type, {CENTS} AS v, CASE WHEN {CENTS} < 0 THEN -{CENTS} - 1 ELSE {CENTS} END AS m
            FROM events WHERE value IS NOT NULL))) GROUP BY ALL)"""


def merged_histogram(t: Tables):
    """Packed histograms of chunks, as they would be stored beside each, merged to those of all rows."""
    by = ["event_type", "chunk"]
    chunks = t.events.select("event_type", F.expr("user_id % 8").alias("chunk"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    packed = M.pack_histograms(M.histogram(chunks, "cents", by), by)
    return M.merge_histograms(M.unpack_histograms(packed, by), ["event_type"])


@check("histogram_merge", f"WITH {BUCKETED} SELECT event_type, bucket::BIGINT AS bucket, count FROM buckets")
def histogram_merge(t: Tables):
    return merged_histogram(t)


# the exact percentile's bucket, and that bucket's greatest number
@check(
    "histogram_percentiles",
    f"""WITH exact AS (UNPIVOT (SELECT event_type, {QUANTILES.format(v=CENTS)} FROM events GROUP BY event_type)
                       ON {", ".join(M.PERCENTILES)} INTO NAME point VALUE v),
             sized AS (SELECT *, CASE WHEN v < 0 THEN -v - 1 ELSE v END AS m FROM exact),
             stepped AS (SELECT *, greatest(0, length(bin(m)) - 8) AS s FROM sized),
             high AS (SELECT event_type, point, CASE WHEN v < 0 THEN -((m >> s) << s) - 1 ELSE (((m >> s) + 1) << s) - 1 END AS h FROM stepped)
        SELECT event_type, {", ".join(f"max(h) FILTER (point = '{n}') AS {n}" for n in M.PERCENTILES)} FROM high GROUP BY event_type""",
)
def histogram_percentiles(t: Tables):
    return M.histogram_percentiles(merged_histogram(t), ["event_type"])


@check(
    "throughput",
    """SELECT user_id, count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS rows_per_second
       FROM events GROUP BY user_id""",
)
def throughput(t: Tables):
    spans = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("seconds"),
    )
    return spans.select("user_id", M.throughput(F.col("n"), F.col("seconds")).alias("rows_per_second"))


@check(
    "reconcile",
    """SELECT l_orderkey // 100 AS batch, count(*) AS produced, count(DISTINCT (l_orderkey, l_linenumber)) AS consumed
       FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT (l_orderkey, l_linenumber))""",
)
def reconcile(t: Tables):
    produced = t.lineitem.select(*LINE_KEY, F.expr("l_orderkey div 100").alias("batch"))
    return M.reconcile(produced, I.first_per_key(produced, LINE_KEY, ["batch"]), ["batch"])


@check(
    "reconcile_contents",
    """WITH damaged AS (SELECT * REPLACE (CASE WHEN l_orderkey % 997 = 0 THEN l_tax ELSE l_discount END AS l_discount,
           CASE WHEN l_orderkey % 997 = 0 THEN l_discount ELSE l_tax END AS l_tax) FROM lineitem),
         sides AS (SELECT *, 1 AS p, 0 AS c FROM lineitem UNION ALL SELECT *, 0, 1 FROM damaged)
       SELECT * EXCLUDE (p, c), sum(p)::BIGINT AS produced, sum(c)::BIGINT AS consumed FROM sides GROUP BY ALL
       HAVING sum(p) <> sum(c)""",
)
def reconcile_contents(t: Tables):
    """Two columns of some orders swapped on the way: counts agree, contents do not."""
    swapped = F.col("l_orderkey") % 997 == 0
    damaged = t.lineitem.withColumns({
        "l_discount": F.when(swapped, F.col("l_tax")).otherwise(F.col("l_discount")),
        "l_tax": F.when(swapped, F.col("l_discount")).otherwise(F.col("l_tax")),
    })
    return M.reconcile_contents(t.lineitem, damaged, LINE_KEY)


# -- streaming ----------------------------------------------------------------------------------


SLICES = (1, 1994, 1996, 1997, 9999)


def stream_query(name: str, mode: str, sql: str):
    @check(name, sql)
    def run(t: Tables):
        source, work = scratch_path(t.spark, "source"), scratch_path(t.spark, "stream")
        # slices in order of arrival, so that keys come back in later batches
        for first, past in zip(SLICES, SLICES[1:]):
            inside = f"l_shipdate >= timestamp_ntz'{first:04d}-01-01 00:00:00' AND l_shipdate < timestamp_ntz'{past:04d}-01-01 00:00:00'"
            part = t.lineitem.filter(f"{inside} OR l_shipdate IS NULL" if past == SLICES[-1] else inside)
            part.coalesce(1).write.mode("append").parquet(source)
        target = line_target(t, None)
        stream = read_files(t.spark, source, t.lineitem.schema, files_per_batch=1)
        stream_ingest(stream, target, ARRIVAL, mode, f"{work}/checkpoint")
        return target.read().select(*SHOWN_COLUMNS)


stream_query("stream_do_nothing", "do_nothing", f"SELECT {SHOWN} FROM {FIRSTS} f")
stream_query("stream_upsert", "upsert", f"SELECT {SHOWN} FROM {LASTS} l")
