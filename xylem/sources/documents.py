"""Document sources: files, table columns, typed rows, expectations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: doc_id (its path), content as bytes.  For files over 2 GB, or few large ones, see `large`."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).select(F.col("path").alias("doc_id"), "content")


def from_column(table: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Documents that a table holds as a string or binary column."""
    return table.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))


def typed_rows(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    """Records of one tag as typed columns, by Spark's own XML reader."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest of expected results: filename, query, type, expected."""
    return spark.read.schema("filename string, query string, type string, expected string").option("multiLine", "true").json(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: spark.checkpoint.dir; where it is unset, a local one on a single machine, an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set, and executors share no folder otherwise")
    top = top or "/tmp/xylem-checkpoint"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
