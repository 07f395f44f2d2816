"""Type names as reports show them."""

from __future__ import annotations

from pyspark.sql import types as T

# The name of each simple type.
NAMES = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.VarcharType: "VARCHAR",
    T.CharType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.BinaryType: "BLOB",
    T.DayTimeIntervalType: "INTERVAL",
    T.YearMonthIntervalType: "INTERVAL",
    T.NullType: "INTEGER",
}
NUMBERS = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT", "FLOAT", "DOUBLE", "REAL", "DECIMAL", "NUMERIC")
WHOLE = NUMBERS[:9]


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)}[]"
    if isinstance(kind, T.MapType):
        return f"MAP({type_name(kind.keyType)}, {type_name(kind.valueType)})"
    if isinstance(kind, T.StructType):
        inside = ", ".join(f'"{f.name}" {type_name(f.dataType)}' for f in kind)
        return f"STRUCT({inside})"
    return NAMES.get(type(kind), kind.simpleString().upper())


def nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def countable(kind: T.DataType) -> bool:
    """Whether values can be grouped by: maps, and what holds them, can't."""
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return countable(kind.elementType)
    return all(countable(f.dataType) for f in kind) if isinstance(kind, T.StructType) else True


def family(name: str) -> str:
    """The kind of a type by its name: numeric, text, temporal, bool or other."""
    name = name.upper()
    if name.startswith(NUMBERS):
        return "numeric"
    if name.startswith(("VARCHAR", "CHAR", "TEXT", "STRING", "BLOB")):
        return "text"
    if "DATE" in name or "TIME" in name:
        return "temporal"
    return "bool" if name.startswith("BOOL") else "other"
