"""Steps shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.session import freed_shuffles, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Store ``df`` in the shared folder and read it back: cuts lineage, outlives lost executors; its shuffle files go."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.__dict__["kept_at"] = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete what ``keep`` stored for these ``frames``. Nothing that is still to be computed may read them."""
    for frame in frames:
        if path := frame.__dict__.get("kept_at"):
            jvm = frame.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_rows(df: DataFrame, group: str, per_group: int) -> DataFrame:
    """About ``per_group`` rows of each value of ``group``, chosen by a hash of ``doc_id``.

    The sample is the same in every run and needs no shuffle of the rows. ``group``
    must have few values (labels, languages): their counts go to the driver.
    """
    counts = df.groupBy(group).count().collect()
    if not counts:
        return df
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, per_group / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(place < share)


def linked_groups(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected groups of the nodes in ``edges``: (node, component), the group's smallest node.

    Large-star and small-star rounds: every round moves each node's neighbours to the
    smallest of them, so the number of rounds grows with the logarithm of the size of a
    group. Minima are aggregated before they are shuffled and each step is stored, so that
    both sides of a join are plain exchanges and a node with very many links is split by
    Spark's skew join. Nodes of any orderable type; links to null are ignored. No edges: no rows.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    def minima(df: DataFrame) -> DataFrame:
        return keep(df.groupBy("u").agg(F.min("v").alias("m")), "minima")

    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = keep(pairs(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both)
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        old, edges = edges, keep(pairs(moved), "links")
        discard(old, low)
        roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
            edges.select("v", F.lit(0), F.lit(1))
        )
        roles = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if roles.where("leaf > 1 or leaf = 1 and centre = 1").isEmpty():
            break
        low = minima(edges)
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, keep(pairs(moved.union(low.select("u", F.col("m").alias("v")))), "links")
        discard(old, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def banded_links(
    pool: DataFrame, verify: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, fits: Callable[[Column, Column], Column] | None = None,
    most: int | None = None, crowded: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(a, b): links that join the same groups as all true links between nodes with a band in common.

    ``pool`` has (node, bands) and is read once, ``verify`` gives the true ones of stored pairs (a, b).
    ``known`` are stored true links found in another way: they are among the result, and nodes
    that they join are not compared again.
    First each node is compared with one node of each of its buckets; then all nodes of a bucket
    that are not in one group by that. So a large group of close nodes costs no pair for every two.

    With ``fits`` the pool has a row for each band, (node, bucket, place), and only nodes whose places
    in a bucket fit are compared. With ``most`` the rows (bucket, node, place) of larger buckets whose nodes are not
    in one group after the first comparison go, stored, with the stored links to ``crowded``, which compares them
    without a row for each pair, and gives all links.
    """
    if fits is None:
        pool, fits = pool.select("node", F.explode("bands").alias("bucket"), F.lit(0).alias("place")), lambda p, q: F.lit(True)
    # one shuffle serves the counts and the join
    dealt = pool.select("node", "bucket", "place").repartition("bucket")
    leads = dealt.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.min_by("place", "node").alias("lead_place"))
    leads = leads.where("lead < last").select("bucket", "lead", "lead_place")
    shared = keep(dealt.join(leads.hint("shuffle_hash"), "bucket"), "shared_buckets")
    star = shared.where(F.expr("node <> lead") & fits(F.col("place"), F.col("lead_place"))).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    if known is not None:
        joined = keep(linked_groups(known), "known_groups")
        for end in ("a", "b"):
            star = star.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
        star = star.where("a_part is null or b_part is null or a_part <> b_part").select("a", "b")
    star = keep(star, "candidates")
    links = verify(star)
    links = keep(links if known is None else links.union(known), "lead_links")
    groups = linked_groups(links)
    placed = shared.join(groups.withColumnRenamed("component", "part"), "node", "left")
    placed = keep(placed.select("bucket", "lead", "node", "place", F.coalesce("part", "node").alias("part")), "placed")
    discard(shared)
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where("low < high and n > 2")
    if most is not None:
        mixed = keep(mixed, "mixed_buckets")
        crowd = keep(placed.join(mixed.where(F.col("n") > most), "bucket", "left_semi").select("bucket", "node", "place"), "crowd")
        mixed = mixed.where(F.col("n") <= most)
    left = placed.join(mixed, "bucket", "left_semi").where("node <> lead")
    a, b = left.alias("a"), left.alias("b")
    rest = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.part") != F.col("b.part")) & fits(F.col("a.place"), F.col("b.place")))
    rest = rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    rest = keep(rest, "candidates")
    discard(star, placed)
    links = links.union(verify(rest))
    return links if most is None else crowded(crowd, keep(links, "links"))
