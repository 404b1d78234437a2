"""Id order. Numeric ids compare as numbers, string ids byte-wise ("10" < "9"); the root
of a component is the smallest id under the column's own order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_string_ids(df: DataFrame, cols=("src", "dst")) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols])
