"""SQL-body temporary functions: Catalyst inlines them, so unlike Python UDFs they stay
inside whole-stage code generation and keep the id type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def register_relabel(df: DataFrame, id_col: str = "n1", prefix: str = "lf_relabel") -> str:
    """The name of a function ``(key, mn, value)`` for ids of the type of ``df``'s column ``id_col``: the key where the value is the
    minimum, else the value.

    The type is part of the name, so a graph of string ids leaves the function of one of long ids as it is.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    name = f"{prefix}_{re.sub(r'[^a-z0-9]+', '_', id_type.lower()).strip('_')}"
    df.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k {id_type}, mn {id_type}, v {id_type}) "
                        f"RETURNS {id_type} RETURN CASE WHEN v = mn THEN k ELSE v END")
    return name
