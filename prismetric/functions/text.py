"""Values as text, in the form that Python gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _float(v: Column) -> Column:
    """Spark writes an exponent from 1e7 on and below 1e-3; the form wanted has one from 1e16 on and below 1e-4."""
    s, size = v.cast("string"), F.abs(v)
    mantissa, power = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(v.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    digits = F.abs(power).cast("string")
    short = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    out = F.when(F.contains(s, F.lit("E")), F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)).otherwise(s)
    return F.when(F.isnan(v), "nan").when(size == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(out)


def as_text(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(v, "True").when(~v, "False")
    if isinstance(kind, T.DoubleType):
        return _float(v)
    if isinstance(kind, T.FloatType):
        return _float(v.cast("double"))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        s = v.cast("string")
        return F.when(F.contains(s, F.lit(".")), F.rpad(s, 26, "0")).otherwise(s)
    if isinstance(kind, T.BinaryType):
        return F.when(F.is_valid_utf8(v.cast("string")), v.cast("string")).otherwise(F.lower(F.hex(v)))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(v)
    return v.cast("string")
