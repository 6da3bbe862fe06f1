"""Result normalisation for cross-engine comparison.

Registered queries hand their results through :func:`tidy`: doubles are
rounded to a fixed number of decimals (log10 and summation order differ in
the last bits between engines), integers become BIGINT, dates become ISO
text. The SQL oracle applies the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def tidy(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            e = f"round(CAST({q} AS DOUBLE), {overrides.get(f.name, digits)})"
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            e = f"CAST({q} AS BIGINT)"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            e = f"CAST({q} AS STRING)"
        else:
            e = q
        out.append(f"{e} AS {q}")
    return df.selectExpr(*out)
