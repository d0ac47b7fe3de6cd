"""Sources and sinks: pruned scans, partitioned corpora, fallbacks, entity documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTING = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "ats", "company", "title", "url", "jd_markdown", "level", "function")],
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("country_code", T.StringType()),
        T.StructField("jd_embedding", T.ArrayType(T.FloatType())),
    ]
)

#: Levels that count as entry level.
ENTRY_LEVELS = ("intern", "entry", "junior")

# Functions without a corpus of their own, and the function that stands in.
FALLBACK = (
    ("arts-media", "design"), ("agriculture", "other"), ("building-grounds", "other"), ("personal-care", "other"),
    ("protective-service", "security"), ("science", "technology"), ("social-service", "education"), ("administrative", "ops"),
    ("food-service", "other"), ("hospitality", "other"), ("logistics", "ops"), ("manufacturing", "ops"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``; where it is unset and all runs in one process, a temporary one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='careerloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/careerloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table at a shared path, for what several branches of a plan read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pruned(df: DataFrame, columns: list[str], where: Column) -> DataFrame:
    """Columns and filter reach the scan."""
    return df.where(where).select(*columns)


def entry_postings(postings: DataFrame, functions: list[str]) -> DataFrame:
    """US or unplaced postings at entry level of the functions, whatever their case."""
    level, country = F.lower(F.coalesce("level", F.lit(""))), F.upper(F.coalesce("country_code", F.lit("")))
    return postings.where(F.lower("function").isin([f.lower() for f in functions]) & level.isin(*ENTRY_LEVELS, "") & country.isin("US", ""))


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns meet by name, missing ones are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_by_function(postings: DataFrame, path: str) -> None:
    """One folder for each function, so that a function's postings are found without a scan."""
    postings.repartition("function").write.mode("overwrite").partitionBy("function").parquet(path)


def write_clustered(postings: DataFrame, path: str, group_rows: int = 20_000) -> None:
    """Postings in the order of function, level and country, so that the statistics of row groups leave out all others.

    ``function_key``, ``level_key`` and ``country_key`` are the columns without regard to case, null as empty, and come first in the files: a filter on a
    function of a column could not reach the scan. Ranges are cut by a hash of the id too, so a function that holds a third of all rows lies in many files; groups hold
    ``group_rows`` rows at most.
    """
    keys = {"function_key": F.lower(F.coalesce("function", F.lit(""))), "level_key": F.lower(F.coalesce("level", F.lit(""))), "country_key": F.upper(F.coalesce("country_code", F.lit("")))}
    keyed = postings.select(*[c.alias(k) for k, c in keys.items()], *postings.columns)
    order = [*keys, F.xxhash64("id")]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.row.count.limit", group_rows).parquet(path)


def clustered_entry_postings(spark: SparkSession, path: str, functions: list[str]) -> DataFrame:
    """``entry_postings`` of a corpus that ``write_clustered`` wrote: all three filters reach the scan and its row groups."""
    keyed = spark.read.parquet(path)
    wanted = F.col("function_key").isin([f.lower() for f in functions]) & F.col("level_key").isin(*ENTRY_LEVELS, "") & F.col("country_key").isin("US", "")
    return keyed.where(wanted).drop("function_key", "level_key", "country_key")


def resolve_partition(df: DataFrame, wanted: str, existing: DataFrame, key: str, fallback: DataFrame) -> DataFrame:
    """Adds ``resolved``: the wanted partition if it exists, else its fallback if that exists, else null.

    ``fallback(src, dst)``. The partition lists are tables; small ones are broadcast by size.
    """
    have = existing.select(F.col(key).alias("_have")).distinct()
    one = df.join(have, df[wanted] == F.col("_have"), "left")
    two = one.join(fallback.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")), one[wanted] == F.col("_src"), "left")
    second = have.withColumnRenamed("_have", "_second")
    three = two.join(second, F.col("_dst") == F.col("_second"), "left")
    return three.withColumn("resolved", F.coalesce("_have", "_second")).drop("_have", "_src", "_dst", "_second")


def read_entities(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON documents, one an entity, with the file's name as ``entity``."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(pattern)
    return df.withColumn("entity", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_[a-z]+_data)?\.json$", 1))


def write_entities(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Quoted CSV with a header, all columns as strings; blank tokens become null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin("", "nan", "--", "N/A", "n/a"), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_text_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole text files as rows ``path, text``."""
    return spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_split(df: DataFrame, complete: Column, path: str) -> None:
    """CSV of complete and of pending rows, each in a folder of its own, in one pass."""
    df.withColumn("state", F.when(complete, "complete").otherwise("pending")).write.mode("overwrite").partitionBy("state").option("header", True).csv(path)


def resolve_column(df: DataFrame, names: list[str] = (), keywords: list[str] = ()) -> str | None:
    """The first listed column that exists, else the first whose name holds all keywords."""
    for n in names:
        if n in df.columns:
            return n
    if keywords:
        for c in df.columns:
            if all(k.lower() in c.lower() for k in keywords):
                return c
    return None
