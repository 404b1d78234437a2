"""Result sinks. Output is written in parallel (no forced single file) and replaces
what was there (``mode('overwrite')``), which is what deleting the old output folder
before each run achieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",",
                 header: bool = False) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("sep", sep).option("header", header).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def read_result(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: str | None = None, sep: str = ",", header: bool = False) -> DataFrame:
    if fmt == "csv":
        reader = spark.read.option("sep", sep).option("header", header)
        if schema:
            reader = reader.schema(schema)
        return reader.csv(path)
    return spark.read.parquet(path)
