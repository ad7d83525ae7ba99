"""Numbers compared across engines and scales."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values, as the SQL check has them: significant bits of an order key, and the
# smallest power of two it distinguishes ----------------------------------------------
ORDER_BITS, LEAST_POWER = 28, -900
# -------------------------------------------------------------------------------------


def order_key(value) -> Column:
    """``value`` rounded to ``ORDER_BITS`` significant bits: equal up to the rounding of
    sums, whatever the scale of the weights. Null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    unit = F.pow(F.lit(2.0), ORDER_BITS - 1 - F.greatest(F.floor(F.log2(F.abs(v))), F.lit(LEAST_POWER)))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.floor(v * unit + 0.5) / unit)


def order_key_sql(value: str) -> str:
    unit = f"pow(2.0, {ORDER_BITS - 1} - greatest(floor(log2(abs({value}))), {LEAST_POWER}))"
    return f"(CASE WHEN {value} = 0 THEN 0.0 ELSE floor({value} * {unit} + 0.5) / {unit} END)"
