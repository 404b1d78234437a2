"""Readers for edge lists and labelled vectors, and the graphs built from the driver tables.

Text readers always take an explicit schema (no inference pass over the input) and a
separator parameter; ids are ``long`` for numeric files and ``string`` where the order
of ids must be lexical. No row is lost in silence: see ``read_edges_csv``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.operators.ordering import previous_in_group
from linkfold.storage import new_scratch_path, write_table

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- text edge lists

MAX_STARTS = 200_000   # files whose first rows are broadcast: a path and a number each, some 30 MB

def _raw_edges(spark: SparkSession, path, sep: str, header: bool, comment: str | None, skip_lines: int) -> DataFrame:
    """``(src, dst, _lead)``: the first two fields of every line as strings, null where a line has fewer; ``_lead`` marks lead
    lines. They are dropped by the same expression that judges the other rows, as a filter of its own could run after it."""
    if not skip_lines:
        reader = spark.read.schema("src string, dst string").option("sep", sep).option("header", header)
        raw = (reader.option("comment", comment) if comment else reader).csv(path)
        return raw.withColumn("_lead", F.lit(False))
    if header:
        raise ValueError("count the header among skip_lines")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_at"),
                                         F.monotonically_increasing_id().alias("_mid"))
    # a file's lead lines are the first rows of its first split; one row per file says where that begins
    starts = write_table(lines.where("_at = 0").groupBy(F.col("_file").alias("_f")).agg(F.min("_mid").alias("_start")),
                         new_scratch_path(spark, "file-starts"))
    place = (F.col("_file") == F.col("_f")) & (F.col("_at") == 0)
    if starts.count() <= MAX_STARTS:   # matched map-side: no line moves
        body = lines.join(F.broadcast(starts), place, "left")
    else:   # only lines of first splits meet their file's row, at most one split of them for each file
        first = lines.where("_at = 0").join(starts.hint("merge"), F.col("_file") == F.col("_f"), "left")
        body = first.unionByName(lines.where("_at <> 0").withColumns({"_f": F.lit(None).cast("string"), "_start": F.lit(None).cast("long")}))
    body = (body.where("trim(value) <> ''")
            .withColumn("_lead", F.coalesce((F.col("_at") == 0) & (F.col("_mid") - F.col("_start") < skip_lines), F.lit(False))))
    if comment:
        body = body.where(~F.col("value").startswith(comment))
    parts = F.split("value", "\\Q" + sep + "\\E")
    field = lambda i: F.when(F.get(parts, F.lit(i)) != "", F.get(parts, F.lit(i)))
    return body.select(field(0).alias("src"), field(1).alias("dst"), "_lead")


def _problem(id_type: str) -> Column:
    """Why a raw row is no edge: ``short`` (a field is missing), ``unreadable`` (not of the id type), else null."""
    unread = F.lit(False)
    if id_type != "string":
        unread = F.expr(f"try_cast(src as {id_type}) is null or try_cast(dst as {id_type}) is null")
    return F.when(F.col("src").isNull() | F.col("dst").isNull(), "short").when(unread, "unreadable")


def edge_report(spark: SparkSession, path, sep: str = ",", header: bool = False, id_type: str = "long",
                comment: str | None = None, skip_lines: int = 0) -> DataFrame:
    """One row: ``n_rows, n_short, n_unreadable`` of an edge file: what a reader with ``on_bad='drop'`` leaves out."""
    raw = (_raw_edges(spark, path, sep, header, comment, skip_lines).where(~F.col("_lead"))
           .select(_problem(id_type).alias("problem")))
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("problem") == "short", 1)).alias("n_short"),
                   F.count(F.when(F.col("problem") == "unreadable", 1)).alias("n_unreadable"))


def read_edges_csv(spark: SparkSession, path, sep: str = ",", header: bool = False,
                   id_type: str = "long", comment: str | None = None, skip_lines: int = 0,
                   on_bad: str = "fail") -> DataFrame:
    """Delimited edge file with an explicit id type, fields past the second ignored.

    ``header`` is never guessed: reading a headerless file with ``header=True`` would lose its first edge.
    ``skip_lines`` leaves out that many lead lines of every file. A row with a missing field or one that is
    not of the id type ends the run (``on_bad='fail'``); ``on_bad='drop'`` leaves it out, and ``edge_report`` counts such rows.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError(f"on_bad must be 'fail' or 'drop', got {on_bad!r}")
    raw = _raw_edges(spark, path, sep, header, comment, skip_lines).withColumn("_problem", _problem(id_type))
    if on_bad == "drop":
        good = raw.where(~F.col("_lead") & F.col("_problem").isNull())
    else:
        message = F.concat(F.col("_problem"), F.lit(" edge row: "), F.coalesce("src", F.lit("")), F.lit(" "), F.coalesce("dst", F.lit("")))
        good = raw.where(F.when(F.col("_lead"), False)
                         .when(F.col("_problem").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
        # and in the ids themselves: a later null filter may run before this one
        return good.select(*[F.when(F.col("_problem").isNotNull(), F.raise_error(message).cast(id_type))
                             .otherwise(F.expr(f"try_cast({c} as {id_type})")).alias(c) for c in ("src", "dst")])
    return good.select(*[F.expr(f"try_cast({c} as {id_type})").alias(c) for c in ("src", "dst")])


def read_edges_text(spark: SparkSession, path, sep: str = "\t", id_type: str = "string", **options) -> DataFrame:
    """``read_edges_csv`` with the defaults of plain edge lists: tab-separated string ids."""
    return read_edges_csv(spark, path, sep=sep, id_type=id_type, **options)


def write_edges_text(df: DataFrame, path: str, sep: str = "\t", header: bool = False,
                     preamble: list[str] | None = None) -> None:
    """Write ``(src, dst)`` as delimited text. ``preamble`` lines (``#`` comments, as in
    published graph dumps) go to their own file in the same folder."""
    df.select("src", "dst").write.mode("overwrite").option("sep", sep) \
        .option("header", header).csv(f"{path}/edges")
    if preamble:
        spark = df.sparkSession
        spark.createDataFrame([(line,) for line in preamble], "value string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/preamble")


def _raw_vectors(spark: SparkSession, path, n_features: int, sep: str) -> DataFrame:
    """``(f0, .., f{n-1}, label)`` of every line as strings and why it is no labelled vector: ``short`` (a field is missing),
    ``unreadable`` (a feature is no number), else null."""
    names = [f"f{i}" for i in range(n_features)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in [*names, "label"])).option("sep", sep).csv(path)
    holds = lambda test: F.exists(F.array(*names), test) if names else F.lit(False)
    return raw.withColumn("_problem", F.when(F.col("label").isNull() | holds(lambda x: x.isNull()), "short")
                          .when(holds(lambda x: x.try_cast("double").isNull()), "unreadable"))


def vector_report(spark: SparkSession, path, n_features: int = 4, sep: str = ",") -> DataFrame:
    """One row: ``n_rows, n_short, n_unreadable`` of a vector file: what ``read_vectors_csv`` with ``on_bad='drop'`` leaves out."""
    raw = _raw_vectors(spark, path, n_features, sep).select("_problem")
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_problem") == "short", 1)).alias("n_short"),
                   F.count(F.when(F.col("_problem") == "unreadable", 1)).alias("n_unreadable"))


def read_vectors_csv(spark: SparkSession, path, n_features: int = 4, sep: str = ",", on_bad: str = "fail") -> DataFrame:
    """``f0..f{n-1}`` doubles then a label string per line -> ``(features array<double>, label string)``; later fields are ignored.

    A row with a missing field or a feature that is no number ends the run where it is read (``on_bad='fail'``), so no null reaches
    a distance; ``on_bad='drop'`` leaves it out, and ``vector_report`` counts such rows.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError(f"on_bad must be 'fail' or 'drop', got {on_bad!r}")
    raw = _raw_vectors(spark, path, n_features, sep)
    names = [f"f{i}" for i in range(n_features)]
    features = F.array(*[F.col(c).try_cast("double") for c in names]) if names else F.array().cast("array<double>")
    if on_bad == "drop":
        return raw.where(F.col("_problem").isNull()).select(features.alias("features"), "label")
    fields = F.concat_ws(sep, *names, "label")
    message = F.concat(F.col("_problem"), F.lit(" vector row: "), fields)
    # in both columns, so that whichever is read meets the check
    checked = lambda value, kind: F.when(F.col("_problem").isNotNull(), F.raise_error(message).cast(kind)).otherwise(value)
    return raw.select(checked(features, "array<double>").alias("features"), checked(F.col("label"), "string").alias("label"))


# ---------------------------------------------------------------- driver-table graphs

def order_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1: order -- part of every line item (orders even ids, parts odd ids)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))


def user_property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2: user -- property ``k`` of every event that has one."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return (ev.select((F.col("user_id") * 2).alias("src"), (k * 2 + 1).alias("dst"))
            .where(F.col("dst").isNotNull()))


def duplicate_doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3: each document -> the previous ``doc_id`` with the same text (by md5).

    Copies of one text can be a large share of all documents, so the predecessor is
    found by a global range sort rather than a window per text (see
    ``previous_in_group``). Whole texts are read and hashed once; only hashes that occur again are sorted.
    """
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    keyed = write_table(docs.select(F.md5("text").alias("h"), "doc_id"), new_scratch_path(spark, "doc-hashes"))
    again = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    keyed = keyed.join(again, "h", "left_semi")
    prev = previous_in_group(keyed, "h", "doc_id", "prev")
    return (prev.where(F.col("prev").isNotNull())
            .select(F.col("doc_id").alias("src"), F.col("prev").alias("dst")))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: ``(id, features array<double>, label)`` from ``embeddings``."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"),
                      F.col("embedding").cast("array<double>").alias("features"),
                      F.col("label").cast("string").alias("label"))


GRAPHS = {"e1": order_part_edges, "e2": user_property_edges, "e3": duplicate_doc_edges}
