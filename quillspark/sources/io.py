"""Readers and writers with declared schemas: JSON lines, CSV with a byte-order mark, Parquet with a declared file set.

Inferred schemas are never used. Polygons are nested arrays inside, JSON text in CSV.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYGON = T.ArrayType(T.ArrayType(T.DoubleType()))
BOX = T.ArrayType(T.DoubleType())
#: O-42: fixed values, the columns of the object table as a stable superset; fields absent from a source come out null.
OBJECTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("schedule_id", "split", "template_id", "layout_family", "object_type", "display_text", "canonical_code", "registration_profile", "row_id", "source_domain", "image_path")]
    + [T.StructField(n, T.LongType()) for n in ("cv_fold", "row_index", "day", "image_width", "image_height")]
    + [T.StructField(n, T.DoubleType()) for n in ("visibility", "text_polygon_margin_px")]
    + [T.StructField(n, T.BooleanType()) for n in ("ignore", "registration_high_confidence")]
    + [T.StructField("bbox_px", BOX), T.StructField("cell_polygon", POLYGON), T.StructField("text_polygon", POLYGON)]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """O-01: blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    """O-20, O-25: an existing target is refused; null fields are written."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """O-19, O-21, O-40: declared columns only, after a byte-order mark; nested ones as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields]
    out = df.select(*flat).withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    out.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """O-02, O-147: header names may start with a byte-order mark; nested columns are JSON text; blanks are null."""
    nested = {f.name for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema.fields])
    raw = spark.read.schema(text).csv(path, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=True)
    return raw.select(*(F.from_json(f.name, f.dataType).alias(f.name) if f.name in nested else F.col(f.name) for f in schema.fields))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """O-07: a JSON document with an array ``schedules``, one row each."""
    whole = T.StructType([T.StructField("schedules", T.ArrayType(schema))])
    return spark.read.schema(whole).json(path, multiLine=True, mode="FAILFAST").select(F.explode("schedules").alias("s")).select("s.*")


def read_registrations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """O-08: every ``*.registration.json`` below ``path``, with its file name."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.registration.json").option("multiLine", True)
    return reader.json(path).withColumn("file", F.input_file_name())


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """O-42, O-148: the schema's columns in order, missing ones null."""
    empty = df.sparkSession.createDataFrame([], schema)
    return empty.unionByName(df, allowMissingColumns=True).select(*schema.fieldNames())


def write_shards(df: DataFrame, path: str, partition: str, order: Sequence[str], max_rows: int = 250_000) -> None:
    """O-23, O-186: Parquet by partition, ranged and sorted by ``order`` so that row groups prune, ZSTD, bounded files."""
    spread = df.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order)
    spread.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", max_rows).partitionBy(partition).parquet(path)


def read_declared(spark: SparkSession, path: str, names: Sequence[str], schema: T.StructType) -> DataFrame:
    """O-03, O-04: the declared Parquet files, which must be plain, distinct and exactly those that are there.

    The listing goes through Hadoop's file system, so any store works.
    """
    if any(os.path.basename(n) != n or n in ("", ".", "..") for n in names) or len(set(names)) != len(names):
        raise ValueError("declared names must be plain and distinct")
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    found = {s.getPath().getName() for s in target.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(target)}
    found = {n for n in found if n.endswith(".parquet")}
    if found != set(names):
        raise ValueError(f"missing {sorted(set(names) - found)}, unexpected {sorted(found - set(names))}")
    return spark.read.schema(schema).parquet(*(f"{path}/{n}" for n in names))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """O-115, O-181: path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def charset(spark: SparkSession, path: str) -> DataFrame:
    """O-09: characters of a text file of ``@range HEX-HEX`` and ``@chars ...`` lines and # comments; repeats are an error."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    ends = F.split(F.trim(F.expr("substring(value, 8)")), "-")
    ranges = lines.where(F.col("value").startswith("@range ")).select(F.explode(F.sequence(F.conv(ends[0], 16, 10).cast("int"), F.conv(ends[1], 16, 10).cast("int"))).alias("c"))
    # chr() stops at Latin-1: code points are decoded from UTF-32
    wide = ranges.select(F.decode(F.unhex(F.lpad(F.hex("c"), 8, "0")), "UTF-32").alias("ch"))
    listed = lines.where(F.col("value").startswith("@chars ")).select(F.explode(F.split(F.expr("substring(value, 8)"), "")).alias("ch")).where("ch <> ''")
    counted = wide.union(listed).groupBy("ch").agg(F.count("*").alias("n"))
    return counted.select(F.when(F.col("n") == 1, F.col("ch")).otherwise(F.raise_error(F.concat(F.lit("repeated character "), "ch"))).alias("ch"))
