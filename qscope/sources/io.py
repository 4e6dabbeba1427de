"""Sources and sinks: readers by extension, stable row ids, and lineage writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "txt": "text", "text": "text", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}


def read(spark: SparkSession, path: str, schema: str | None = None, fmt: str | None = None) -> DataFrame:
    """A file or folder by its extension (parquet where there is none). CSV without a schema
    has a header and inferred types."""
    fmt = fmt or FORMATS.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet", "parquet")
    reader = spark.read.format(fmt)
    if schema:
        return reader.schema(schema).load(path)
    return (reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader).load(path)


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Row ids that hold between runs over the same files: file and row for Parquet, file and
    running number for other formats."""
    number = F.monotonically_increasing_id()
    for file, row in (("_metadata.file_path", F.col("_metadata.row_index")), ("_metadata.file_path", number)):
        try:
            return df.withColumn(name, F.struct(F.xxhash64(file).alias("f"), row.alias("r")))
        except AnalysisException:
            continue
    return df.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), number.alias("r")))


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    flat = edges.select(*[c for c in edges.columns if c != "rid"], F.col("rid.f").alias("rid_file"), F.col("rid.r").alias("rid_row"))
    flat.write.mode("errorifexists").format(fmt).save(path)


def write_edges_jdbc(edges: DataFrame, url: str, table: str, batch: int = 1000) -> None:
    edges.select(*[c for c in edges.columns if c != "rid"], F.col("rid.f").alias("rid_file"), F.col("rid.r").alias("rid_row")).write.option("batchsize", batch).jdbc(url, table)
