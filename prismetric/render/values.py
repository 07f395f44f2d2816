"""Values as JSON can hold them."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any


def jsonable(value: Any) -> Any:
    """Numbers that aren't finite are null, decimals floats, times ISO text, bytes text (or hex), others text."""
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float | Decimal):
        number = float(value)
        return number if abs(number) < float("inf") else None
    if isinstance(value, dt.datetime | dt.date | dt.time):
        return value.isoformat()
    if isinstance(value, bytes | bytearray):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return value.hex()
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return jsonable(value.asDict(recursive=True))
    if isinstance(value, list | tuple | set):
        return [jsonable(v) for v in value]
    return str(value)
