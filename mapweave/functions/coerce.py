"""Strings into typed columns: the flexible and the older rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = {"int2": (-(1 << 15), (1 << 15) - 1, "smallint"), "int4": (-(1 << 31), (1 << 31) - 1, "int"), "int8": (-(1 << 63), (1 << 63) - 1, "bigint")}
#: Declared types and their other names.
ALIASES = {"smallint": "int2", "int": "int4", "integer": "int4", "bigint": "int8", "bool": "boolean"}


def to_bool(s: Column) -> Column:
    """yes, true, 1; no, false, 0; case counts; anything else is null."""
    return F.when(s.isin("yes", "true", "1"), True).when(s.isin("no", "false", "0"), False)


def to_int(s: Column, kind: str = "int4") -> Column:
    """Leading blanks and a sign are fine; anything after the digits, or out of range, is null."""
    low, high, sql = RANGES[ALIASES.get(kind, kind)]
    n = F.regexp_extract(s, r"^\s*([-+]?[0-9]{1,19})$", 1).try_cast("bigint")
    return F.when((n >= low) & (n <= high), n).cast(sql)


def to_real(s: Column) -> Column:
    """Decimal and exponent forms, 0x integers, inf and nan; anything after them is null."""
    t = F.lower(F.regexp_replace(s, r"^\s+", ""))
    number = F.when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?$"), t.try_cast("double"))
    hexa = F.when(t.rlike(r"^[-+]?0x[0-9a-f]{1,13}$"), F.conv(F.regexp_extract(t, "0x([0-9a-f]+)$", 1), 16, 10).cast("double") * F.when(t.startswith("-"), -1).otherwise(1))
    word = F.when(t.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf"))).when(t.rlike(r"^[-+]?nan$"), F.lit(float("nan")))
    return F.coalesce(number, hexa, word)


def to_direction(s: Column) -> Column:
    return F.when(s.isin("yes", "1"), 1).when(s.isin("no", "0"), 0).when(s == "-1", -1).cast("smallint")


def number_to(v: Column, kind: str) -> Column:
    """A numeric value into a declared integer, boolean or direction; out of range is null."""
    kind = ALIASES.get(kind, kind)
    if kind == "boolean":
        return v != 0
    if kind == "direction":
        return F.signum(v).cast("smallint")
    low, high, sql = RANGES[kind]
    return F.when((v >= low) & (v <= high), v).cast(sql)


def to_timestamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def coerce(s: Column, kind: str) -> Column:
    """A string into a declared type."""
    kind = ALIASES.get(kind.lower(), kind.lower())
    if kind in RANGES:
        return to_int(s, kind)
    if kind in ("real", "double"):
        return to_real(s).cast("float" if kind == "real" else "double")
    return {"boolean": to_bool, "direction": to_direction, "timestamp": lambda c: c.try_cast("timestamp_ntz"), "timestamptz": lambda c: c.try_cast("timestamp")}.get(kind, lambda c: c)(s)


def legacy_int(s: Column) -> Column:
    """The first number, or the mean of 'a-b', rounded down; what follows is ignored; outside 32 bits: null."""
    a = F.regexp_extract(s, r"^\s*([-+]?[0-9]{1,18})", 1).try_cast("bigint")
    b = F.regexp_extract(s, r"^\s*[-+]?[0-9]{1,18}-\s*([-+]?[0-9]{1,18})", 1).try_cast("bigint")
    v = F.when(b.isNotNull(), F.floor((a.cast("decimal(20,0)") + b.cast("decimal(20,0)")) / 2)).otherwise(a).cast("bigint")
    return F.when((v >= -(1 << 31)) & (v <= (1 << 31) - 1), v).cast("int")


def legacy_real(s: Column) -> Column:
    """A number or the mean of 'a-b', comma or point; 'ft' behind it converts feet to metres; else null."""
    t = F.replace(s, F.lit(","), F.lit("."))
    a = F.regexp_extract(t, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    b = F.regexp_extract(t, r"^\s*[-+]?[0-9]*\.?[0-9]+\s*-\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    v = F.when(b.isNotNull(), (a + b) / 2).otherwise(a)
    return F.when(t.rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+(\s*-\s*[-+]?[0-9]*\.?[0-9]+)?\s*ft\s*$"), v * 0.3048).when(t.rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+(\s*-\s*[-+]?[0-9]*\.?[0-9]+)?"), v)


def accepted_rejected(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others with a message and the first column at fault."""
    first = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]) if required else F.lit(None)
    marked = df.withColumn("rejected_column", first)
    bad = marked.where(F.col("rejected_column").isNotNull()).withColumn("message", F.lit("null value in not null column."))
    return marked.where(F.col("rejected_column").isNull()).drop("rejected_column"), bad
