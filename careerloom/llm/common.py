"""Shared plumbing of the corpus operators: tables, shared storage, bounded Arrow slices."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at once; one longer text is worked on alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one process, a temporary folder takes its place; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='careerloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/careerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "shared_path", None)
        if path:
            with contextlib.suppress(Exception):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in row slices of at most ``limit`` bytes of ``column``, so memory has a bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            # copied: some Arrow kernels misread slices
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return ["" if x is None else x for x in col.to_pylist()]


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def filtered(docs: DataFrame, mask: Callable[[list[str]], np.ndarray], column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose texts ``mask`` keeps, with all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, limit):
            yield batch.filter(pa.array(mask(strings(batch, column))))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2: rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, comp)``, comp the least node reachable.

    Alternates large-star and small-star steps; every step is a partial aggregate and a join,
    so no neighbour list is gathered. Each round is written to the shared folder. The rounds
    end when the edges form stars around their least nodes.
    """
    spark = edges.sparkSession

    def stars(e: DataFrame, name: str) -> DataFrame:
        """Large-star, then small-star."""
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        out = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        return written(out, name)

    now = written(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), f"{tag}-edges")
    while True:
        # stars: each node points at one centre, and no centre points on
        n, nodes, chained = (
            now.groupBy("a").agg(F.count("*").alias("c"), F.lit(1).alias("one")).agg(F.sum("c"), F.sum("one")).crossJoin(now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi").agg(F.count("*").alias("chained"))).first()
        )
        if not n or (n == nodes and not chained):
            break
        after = stars(now, f"{tag}-stars")
        dropped(now)
        now = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    out.shared_path = now.shared_path
    return out
