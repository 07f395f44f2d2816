"""Redacted forms of text, as expressions: nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is done by default with each kind, and how much of a hash is kept.
STRATEGIES = ("mask", "hash", "null", "keep", "year")
DEFAULTS = {"email": "mask", "phone": "mask", "credit_card": "mask", "ssn": "mask", "ipv4": "mask", "ipv6": "mask", "name": "hash", "dob": "year"}
HASH_DIGITS = 16
HIDDEN = "***"


def email(v: Column) -> Column:
    domain = F.substring(v, F.instr(v, "@") + 1, F.length(v))
    top = F.substring_index(domain, ".", -1)
    return F.when(~F.contains(v, F.lit("@")), HIDDEN).when(F.contains(domain, F.lit(".")) & (top != ""), F.concat(F.lit("***@***."), top)).otherwise("***@***")


def last_four(v: Column) -> Column:
    d = F.regexp_replace(v, r"(?U)\D", "")
    return F.when(F.length(d) <= 4, F.repeat(F.lit("*"), F.length(d))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(d) - 4), F.right(d, F.lit(4))))


def ipv4(v: Column) -> Column:
    return F.when(F.size(F.split(v, r"\.", -1)) == 4, F.concat(F.substring_index(v, ".", 3), F.lit(".0"))).otherwise(HIDDEN)


def ipv6(v: Column) -> Column:
    kept = F.slice(F.filter(F.split(F.substring_index(v, "::", 1), ":", -1), lambda g: g != ""), 1, 3)
    return F.concat(F.array_join(kept, ":"), F.lit("::"))


MASKS: dict[str, Callable[[Column], Column]] = {
    "email": email,
    "phone": last_four,
    "credit_card": last_four,
    "ssn": lambda v: F.when(v.isNotNull(), "***-**-****"),
    "ipv4": ipv4,
    "ipv6": ipv6,
}


def redacted(v: Column, kind: str, strategy: str) -> Column:
    """The redacted form of a text column; null stays null."""
    hidden = F.lit(HIDDEN)
    if strategy == "keep":
        return v
    if strategy == "null":
        return F.lit(None).cast("string")
    if strategy == "hash":
        out = F.left(F.sha2(v, 256), F.lit(HASH_DIGITS))
    elif strategy == "year":
        year = F.regexp_extract(v, r"(?U)(\d{4})", 1)
        out = F.when(year != "", year).otherwise(hidden)
    else:
        out = MASKS.get(kind, lambda _: hidden)(v)
    return F.when(v.isNotNull(), out)
