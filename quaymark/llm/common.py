"""Helpers that the corpus operators share: tables, durable intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset (tests), a temporary folder of this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = getattr(spark, "_quaymark_dir", None)
        if place is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            place = spark._quaymark_dir = "file://" + tempfile.mkdtemp(prefix="spark-quaymark-")
    return place


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back, so lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quaymark/{name}-{uuid.uuid4().hex}"
    spark._quaymark_written = [*getattr(spark, "_quaymark_written", []), path]
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """As written(), of rows that are dealt by these columns already, as after a grouping: they are written in buckets, so later joins and groupings by the columns
    shuffle nothing of them."""
    spark = df.sparkSession
    path, made, n = f"{shared_dir(spark)}/quaymark/{name}-{uuid.uuid4().hex}", f"quaymark_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark._quaymark_written = [*getattr(spark, "_quaymark_written", []), path]
    spark._quaymark_tables = [*getattr(spark, "_quaymark_tables", []), made]
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *columns).saveAsTable(made)
    return spark.table(made)


def remove_written(spark: SparkSession) -> int:
    """Deletes the tables that written() has made in this session, once the results that read them are stored; returns their number."""
    paths, spark._quaymark_written = getattr(spark, "_quaymark_written", []), []
    tables, spark._quaymark_tables = getattr(spark, "_quaymark_tables", []), []
    for made in tables:
        spark.sql(f"DROP TABLE IF EXISTS {made}")
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links of long ids -> (node, component) for every node that isn't the smallest of its component.

    Each round hooks every node to its smallest neighbour, jumps those pointers twice and contracts the links; links that lie inside one component vanish, so
    the rounds are about the logarithm of the longest chain. Nothing is collected; every round is written to the shared folder.
    """
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-links"
    )
    members: DataFrame | None = None
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        hook = written(hook, f"{name}-hook")
        for _ in range(2):
            above = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hook = hook.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        hook = written(hook, f"{name}-jump")
        roots = hook.withColumnRenamed("parent", "component")
        if members is not None:
            moved = hook.select(F.col("node").alias("component"), "parent")
            roots = roots.unionByName(members.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        members = written(roots, f"{name}-members")
        for side in "ab":
            moved = hook.select(F.col("node").alias(side), "parent")
            edges = edges.join(moved, side, "left").withColumn(side, F.coalesce("parent", side)).drop("parent")
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        edges = written(edges, f"{name}-links")
    if members is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members


def merged_components(members: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """Members, as of connected_components(), after further (a, b) links: only components that these join are worked on."""
    of = lambda n: members.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = connected_components(between, name)
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("parent"))
    kept = members.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return written(kept.unionByName(more), f"{name}-members")
