"""Significant-digit rounding shared by result tables and their SQL checks.

Floating sums differ in the last bits between engines (summation order), so
published tables round doubles to 10 significant digits. The rounding is
written as SQL text so that any engine computes it the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 10


def sround_sql(x: str, digits: int = DIGITS) -> str:
    """Round to ``digits`` significant digits using only exact powers of ten.

    ``10^k`` for integer 0 <= k <= 22 is exact in IEEE doubles, so scaling up
    (negative exponents) multiplies and then divides by the same exact power.
    """
    e = f"FLOOR(LOG10(ABS({x})))"
    d = digits - 1
    return (f"(CASE WHEN {x} IS NULL OR ISNAN({x}) OR {x} = 0.0E0 "
            f"OR ABS({x}) = CAST('Infinity' AS DOUBLE) THEN {x} "
            f"WHEN {e} < 0 THEN ROUND({x} * POWER(10.0E0, -{e}), {d}) / POWER(10.0E0, -{e}) "
            f"ELSE ROUND({x} / POWER(10.0E0, {e}), {d}) * POWER(10.0E0, {e}) END)")


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.expr(sround_sql(f"CAST(`{f.name}` AS DOUBLE)", digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
