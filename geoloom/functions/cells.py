"""Cell-by-cell functions as SQL text that Spark and other engines read alike.

NULL is NoData: it passes through every function unless its entry says otherwise. ``z``
is the raster's value; ``a`` and ``b`` are those of two rasters, or a
raster and a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: expression of z.
UNARY: dict[str, str] = {
    "absolute_value": "abs(z)",
    "arc_cos": "CASE WHEN z BETWEEN -1 AND 1 THEN acos(z) END",
    "arc_sin": "CASE WHEN z BETWEEN -1 AND 1 THEN asin(z) END",
    "arc_tan": "atan(z)",
    "arcosh": "CASE WHEN z >= 1 THEN acosh(z) END",
    "arsinh": "asinh(z)",
    "artanh": "CASE WHEN z > -1 AND z < 1 THEN atanh(z) END",
    "ceil": "CAST(ceil(z) AS DOUBLE)",
    "convert_nodata_to_zero": "coalesce(z, CAST(0 AS DOUBLE))",
    "cos": "cos(z)",
    "cosh": "cosh(z)",
    "decrement": "z - 1",
    "exp": "exp(z)",
    "exp2": "power(CAST(2 AS DOUBLE), z)",
    "floor": "CAST(floor(z) AS DOUBLE)",
    "increment": "z + 1",
    "is_nodata": "CASE WHEN z IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "ln": "CASE WHEN z > 0 THEN ln(z) END",
    "log10": "CASE WHEN z > 0 THEN log10(z) END",
    "log2": "CASE WHEN z > 0 THEN log2(z) END",
    "negate": "-z",
    "negate_boolean": "CASE WHEN z <> 0 THEN CAST(0 AS DOUBLE) WHEN z = 0 THEN CAST(1 AS DOUBLE) END",
    "reciprocal": "CASE WHEN z = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 1 / z END",
    "round": "round(z)",
    "sin": "sin(z)",
    "sinh": "sinh(z)",
    "square": "z * z",
    "square_root": "CASE WHEN z < 0 THEN CAST('NaN' AS DOUBLE) ELSE sqrt(z) END",
    "tan": "tan(z)",
    "tanh": "tanh(z)",
    "to_degrees": "degrees(z)",
    "to_radians": "radians(z)",
}

_FLAG = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN {} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"

#: name: expression of a and b; both must have a value.
BINARY: dict[str, str] = {
    "add": "a + b",
    "subtract": "a - b",
    "multiply": "a * b",
    "divide": "CASE WHEN b <> 0 THEN a / b END",
    "integer_division": "CASE WHEN trunc_b <> 0 THEN CAST(sign(trunc_a / trunc_b) * floor(abs(trunc_a / trunc_b)) AS DOUBLE) END".replace("trunc_a", "(sign(a) * floor(abs(a)))").replace("trunc_b", "(sign(b) * floor(abs(b)))"),
    "modulo": "CASE WHEN b <> 0 THEN a % b END",
    "power": "power(a, b)",
    "atan2": "atan2(a, b)",
    "max": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END",
    "min": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END",
    "equal_to": _FLAG.format("a = b"),
    "not_equal_to": _FLAG.format("a <> b"),
    "greater_than": _FLAG.format("a > b"),
    "greater_than_or_equal": _FLAG.format("a >= b"),
    "less_than": _FLAG.format("a < b"),
    "less_than_or_equal": _FLAG.format("a <= b"),
    "logical_and": _FLAG.format("a <> 0 AND b <> 0"),
    "logical_or": _FLAG.format("a <> 0 OR b <> 0"),
    "logical_xor": _FLAG.format("(a <> 0) <> (b <> 0)"),
    "logical_not": _FLAG.format("a <> 0 AND b = 0"),
    "in_place_add": "a + b",
    "in_place_subtract": "a - b",
    "in_place_multiply": "a * b",
    "in_place_divide": "CASE WHEN b <> 0 THEN a / b END",
    "update_nodata_cells": "coalesce(a, b)",
    "wetness_index": "CASE WHEN b <> 0 THEN ln(a / tan(radians(b))) END",
    "stream_power_index": "power(a, CAST(1 AS DOUBLE)) * tan(radians(b))",
    "sediment_transport_index": "1.4 * power(a / 22.13, 0.4) * power(sin(radians(b)) / 0.0896, 1.3)",
    "normalized_difference_index": "CASE WHEN a + b <> 0 THEN (a - b) / (a + b) END",
}


def quotient(a: Column, b: Column) -> Column:
    """a / b by the rules of floating point: infinite or NaN where b is zero, which Spark's own division makes an error."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)
