"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkfold.storage import drop_path, new_scratch_path, write_table

#: ASCII white space, the word separators of the corpus contracts
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` and nothing else, null text as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back: cuts the
    lineage, and keeps row numbers given by Spark stable however often it is read."""
    return write_table(df, new_scratch_path(df.sparkSession, tag))


def boxed(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``: the whole row in one column, so no name in it can clash with an operator's own."""
    return docs.select(_whole_row(docs).alias("row"), "doc_id", text_or_empty().alias("text"))


def _whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _with_place(docs: DataFrame, tag: str) -> tuple[DataFrame, Column, Column]:
    """The rows, the file each lies in and the number in it, the same at every reading: a plain Parquet scan is taken as it is,
    anything else is stored first."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        docs = stored(docs, tag)
    at = docs.metadataColumn("_metadata")
    return docs, at["file_path"], at["row_index"]


def placed(docs: DataFrame, tag: str) -> DataFrame:
    """``(row, doc_id, source, text, _place)``: boxed rows and where each lies, the file (128 bits of its path) and the number in it,
    so narrow results can be joined back without a second copy of the texts."""
    docs, path, n = _with_place(docs, tag)
    place = F.struct(F.xxhash64(path, F.lit(1)).alias("a"), F.xxhash64(path, F.lit(2)).alias("b"), n.alias("n"))
    return docs.select(_whole_row(docs).alias("row"), "doc_id", "source", text_or_empty().alias("text"), place.alias("_place"))


def in_id_order(docs: DataFrame, tag: str, partitions: int | None = None) -> DataFrame:
    """``(doc_id, text)`` in range partitions, sorted: by id (nulls first), the first 64 characters of the text, its digest. Rows equal
    in all of these go by where they lie, so neither a null id nor copies under one id fill a partition. Spark's sample for the
    ranges holds the keys, not the texts."""
    docs, path, n = _with_place(docs, tag)
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(path, n).alias("_at"))
    keys = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text"), F.col("_at")
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *keys)
    return (dealt.select("doc_id", "text", keys[1].alias("_start"), keys[2].alias("_digest"), "_at")
            .sortWithinPartitions(keys[0], "_start", "_digest", "_at").select("doc_id", "text"))


def release(table: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more, and let Spark drop the shuffle files of finished plans."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        drop_path(table.sparkSession, path)
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, tag: str, col: str = "_row") -> DataFrame:
    """``stored`` with a unique row number, so repeated rows stay apart in later joins."""
    return stored(df.withColumn(col, F.monotonically_increasing_id()), tag)


def running_total(df: DataFrame, key: str, bucket: str, order: list[str], value: str,
                  out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the earlier rows of the same ``key``, in
    the order ``(bucket, *order)``.

    One key may hold a third of all rows, so no window spans a whole key: rows are summed in
    (key, bucket) windows, and the bucket totals, one row per key and bucket, give the rest.
    """
    before = Window.unboundedPreceding, -1
    totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_rt_total"))
    offsets = totals.select(
        F.col(key).alias("_rt_key"), F.col(bucket).alias("_rt_bucket"),
        F.coalesce(F.sum("_rt_total").over(
            Window.partitionBy(key).orderBy(bucket).rowsBetween(*before)), F.lit(0)).alias("_rt_off"))
    local = df.withColumn("_rt_in", F.coalesce(F.sum(value).over(
        Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(*before)), F.lit(0)))
    return (local.join(offsets, (F.col(key) == F.col("_rt_key")) & (F.col(bucket) == F.col("_rt_bucket")))
            .withColumn(out, F.col("_rt_off") + F.col("_rt_in"))
            .drop("_rt_key", "_rt_bucket", "_rt_off", "_rt_in"))
