"""Predicates on trimmed text: what personal data and other values look like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and words of the detectors.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
PHONE = r"(?U)^\+?[\d][\d \-().]{6,20}$"
SSN = r"(?U)^(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
SSN_LOOSE = r"(?U)^\d{9}$"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
IPV4 = rf"(?U)^(?:{OCTET}\.){{3}}{OCTET}$"
IPV6 = r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|:(:[0-9a-fA-F]{1,4}){1,7}|::)$"
NAME = r"^[A-Z][a-z'’\-]{1,}(?:[ \-][A-Z][a-z'’\-]{1,}){0,3}$"
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir")
DATE_START, DATE_WHOLE = r"(?U)^\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"(?U)^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"
NUMBER = r"(?U)^-?\d+(?:\.\d+)?$"
BOOLEAN = r"(?i)^(true|false|yes|no|y|n|0|1)$"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D+", "")


def card(v: Column, d: Column | None = None) -> Column:
    d = digits(v) if d is None else d
    return F.length(d).between(12, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def phone(v: Column, d: Column | None = None) -> Column:
    return F.length(digits(v) if d is None else d).between(7, 15) & v.rlike(PHONE)


def name(v: Column) -> Column:
    first = F.rtrim(F.lower(F.regexp_extract(v, r"(?U)^\S+", 0)), F.lit("."))
    return (v != "") & (F.length(v) <= 60) & (first.isin(*TITLES) | v.rlike(NAME))


def date(v: Column) -> Column:
    return v.rlike(DATE_START) | v.rlike(DATE_WHOLE)


def has(sign: str, pattern: str) -> Callable[..., Column]:
    """Values that fit the pattern, which none without the sign does."""
    return lambda v, d=None: F.contains(v, F.lit(sign)) & v.rlike(pattern)


#: In the order in which findings are made. A detector takes a value, and its digits if they are known.
DETECTORS: dict[str, Callable[..., Column]] = {
    "email": has("@", EMAIL),
    "credit_card": card,
    "ipv4": has(".", IPV4),
    "ipv6": has(":", IPV6),
    "phone": phone,
    "ssn": has("-", SSN),
}
#: Evidence that counts only beside a column's name or type.
WEAK: dict[str, Callable[..., Column]] = {
    "ssn_loose": lambda v, d=None: (F.length(v) == 9) & v.rlike(SSN_LOOSE),
    "name": lambda v, d=None: name(v),
    "date": lambda v, d=None: date(v),
}


def shape(v: Column) -> Column:
    """The class of a trimmed value; numbers come before truth values, so 0 and 1 are numbers."""
    return F.when(v == "", "empty").when(v.rlike(NUMBER), "numeric").when(date(v), "date").when(v.rlike(BOOLEAN), "bool").otherwise("string")


SHAPES = ("numeric", "date", "bool", "string")


def date_shaped(v: Column) -> Column:
    """Whether trimmed text could be a date or time by its length, digits and separators."""
    n_digits = F.length(F.regexp_replace(v, r"(?U)[^\d]", ""))
    separators = F.length(F.regexp_replace(v, "[^-/:T ]", ""))
    return F.length(v).between(6, 40) & (n_digits >= 4) & ((separators >= 2) | F.contains(v, F.lit("T")))


# The formats that are tried, in this order.
FORMATS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d H:m:s", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyyMMdd")
_SHAPE = {
    "yyyy-M-d'T'H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s.SSSSSS": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-M-d H:m:s.SSSSSS": r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$",
}


def parsed(v: Column) -> Column:
    """A timestamp without zone from text, or null: a final Z and an offset like +02:00 are dropped, not applied."""
    v = F.trim(v)
    v = F.when(v.endswith("Z"), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)
    v = F.when(v.rlike(r"[+-].{2}:.{2}$"), F.substring(v, F.lit(1), F.length(v) - 6)).otherwise(v)
    tries = []
    for form in FORMATS:
        text = v
        if "S" in form:  # as many digits as the format has
            text = F.concat(F.substring_index(v, ".", 1), F.lit("."), F.rpad(F.substring_index(v, ".", -1), 6, "0"))
        got = F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")
        tries.append(F.when(v.rlike(_SHAPE[form]), got) if form in _SHAPE else got)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"), v.try_cast("timestamp_ntz"))
    return F.coalesce(*tries, iso)
