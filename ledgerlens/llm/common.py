"""Helpers that several operators share: tables in the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only characters that separate words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the context's checkpoint folder.

    Only where neither is set and Spark runs in one process, as in tests, is a folder of our own made and set; on a
    cluster, whose executors would not see it, this fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerlens-"))
            held = context._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/ledgerlens/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, short lineage, survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() from which nothing is read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, a written table of few short columns, marked for broadcast if it has at most so many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rank_within(df: DataFrame, key: str, order: list[str], chunk_rows: int, out: str) -> DataFrame:
    """Adds out: the rank from 0 of each row among those of its key, without gathering a key in one task.

    df should be a written table, as it is read twice. A key's rows are dealt over as many chunks as they fill, by a hash
    of the order columns; a chunk is ranked by itself and starts where the counts of the earlier chunks end. Rows that
    tie in all order columns get different ranks.
    """
    chunks = df.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / chunk_rows).alias("_chunks"))
    dealt = df.join(chunks, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_chunk", F.pmod(F.xxhash64(*order), F.col("_chunks"))).drop("_k", "_chunks")
    counts = dealt.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order)) - 1)
    joined = local.join(starts, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn(out, F.col("_start") + F.col("_local")).drop("_chunk", "_k", "_c", "_start", "_local")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node it reaches.

    Each round hooks a node to its smallest neighbour, follows three doublings of those pointers and contracts the
    edges, so that even a path in sorted order shrinks eightfold. Minima are combined before the shuffle; loops and
    repeated edges go after each contraction. Rounds are written tables, deleted when the next one stands; no edge or
    label comes to the driver.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = written(ends, "edges")
    mapping = None
    while ends.limit(1).count():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        for _ in range(3):
            above = parent.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            further = written(parent.join(above, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")), "parents")
            discard(parent)
            parent = further
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = ends.join(left, "a").join(right, "b").where("ua <> ub")
        contracted = written(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        discard(ends)
        ends = contracted
        if mapping is None:
            mapping = written(parent.withColumnRenamed("up", "root"), "roots")
        else:
            step = parent.select(F.col("node").alias("root"), F.col("up").alias("_up"))
            longer = written(mapping.join(step, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "roots")
            discard(mapping)
            mapping = longer
        discard(parent)
    discard(ends)
    if mapping is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return mapping


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
