"""The whole round: generate related tables, export, ingest in chunks with upsert, reconcile, report."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks import duck as D
from checks.registry import Tables, check
from rowloom.operators.ingest import chunk_of, ingest
from rowloom.operators.metrics import percentiles, reconcile
from rowloom.plans.database import generate_database
from rowloom.plans.spec import Call, ColumnSpec, ForeignKey, Identity, TableSpec
from rowloom.session import scratch_path
from rowloom.sources.target import FileTarget
from rowloom.sources.text import read_csv_rows, write_csv

SALE = "line_no bigint, id bigint, client_id bigint, amount decimal(7,2)"


def shop(clients: int, sales: int) -> list[TableSpec]:
    """Sales whose ids start over after three quarters of the rows, so later ones replace earlier ones."""
    return [
        TableSpec("client", (
            ColumnSpec("id", identity=Identity("unordered")),
            ColumnSpec("name", call=Call("randomFullName")),
            ColumnSpec("nation", foreign_key=ForeignKey("nation", "n_nationkey")),
        ), clients),
        TableSpec("sale", (
            ColumnSpec("line_no", expression="row_number"),
            ColumnSpec("id", identity=Identity("sequence", 1, max(1, sales * 3 // 4), 1)),
            ColumnSpec("client_id", foreign_key=ForeignKey("client", "id")),
            ColumnSpec("amount", call=Call("randomBigDecimal", (0, 50000, 2))),
        ), sales),
    ]


def scattered(row: str) -> str:
    return f"(({row})//2147483647)*2147483648+((({row})%2147483647)*1103515245)%2147483647"


N_CLIENTS, N_SALES = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"


@check(
    "synthesize_and_ingest",
    f"""WITH nations AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation),
        client AS (SELECT {scattered('r')} AS client_id, {D.bits(D.cell('client.nation', 'r'))} % (SELECT count(*) FROM nation) AS pos
          FROM (SELECT unnest(range(0, {N_CLIENTS}))::BIGINT AS r) rows),
        sale AS (SELECT r, 1 + r % greatest(1, {N_SALES} * 3 // 4) AS id,
          {scattered(D.bits(D.cell('sale.client_id', 'r')) + '%' + N_CLIENTS)} AS client_id,
          (({D.bits(D.cell('sale.amount', 'r'))} % 5000000)::DECIMAL(7,0) * 0.01::DECIMAL(2,2))::DECIMAL(7,2) AS amount
          FROM (SELECT unnest(range(0, {N_SALES}))::BIGINT AS r) rows),
        kept AS (SELECT * FROM sale QUALIFY row_number() OVER (PARTITION BY id ORDER BY r DESC) = 1)
        SELECT n_name, count(*) AS n_sales, sum(amount)::DECIMAL(38,2) AS total, quantile_disc(amount, 0.9) AS p90,
          quantile_disc(amount, 0.99) AS p99, 0::BIGINT AS unmatched_chunks
        FROM kept JOIN client USING (client_id) JOIN nations USING (pos) GROUP BY n_name""",
)
def synthesize_and_ingest(t: Tables):
    spark = t.spark
    made = generate_database(spark, shop(t.customer.count(), t.orders.count()), existing={"nation": t.nation})
    exported = scratch_path(spark, "sale")
    write_csv(made["sale"], exported)
    arrived = read_csv_rows(spark, exported, StructType.fromDDL(SALE))
    target = FileTarget.create(spark, scratch_path(spark, "sales"), arrived.schema, ["id"])
    ingest(arrived, target, ["line_no"], "upsert")
    stored = target.read()

    # The exported and the generated rows must agree in every chunk.
    chunk = chunk_of(F.col("line_no")).alias("chunk_id")
    unmatched = reconcile(made["sale"].select(chunk), arrived.select(chunk), ["chunk_id"])
    clients = made["client"].select(F.col("id").alias("client_id"), F.col("nation").alias("n_nationkey"))
    sales = stored.join(clients, "client_id").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    totals = sales.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n_sales"), F.sum("amount").cast("decimal(38,2)").alias("total")
    )
    shares = percentiles(sales, "amount", ["n_name"], {"p90": 0.9, "p99": 0.99})
    gaps = unmatched.agg(F.count(F.lit(1))).scalar()
    return totals.join(shares, "n_name").select("n_name", "n_sales", "total", "p90", "p99", gaps.alias("unmatched_chunks"))
