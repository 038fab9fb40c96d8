"""Terms as columns.

A term is a string, int, float, bool, keyword, instant or a triple of terms. Spark has no recursive type, so a term is a
struct: key, an injective text that identifies it (a nested triple is nothing but its key), kind, and the payload of
an atom: s (string, keyword), i (int, bool as 0 and 1, an instant's seconds), f (float), n (an instant's nanoseconds).
Equality, joins, grouping and distinct use key alone; comparisons, arithmetic, order and text use the payload.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOL, INT, FLOAT, STRING, KEYWORD, INSTANT, TRIPLE = range(7)
TERM = "struct<key:string,kind:tinyint,s:string,i:bigint,f:double,n:int>"


class Keyword(str):
    """A keyword, with its colon."""


@dataclass(frozen=True)
class Instant:
    seconds: int
    nanos: int = 0


@dataclass(frozen=True)
class Triple:
    t1: object
    t2: object
    t3: object


def _sized(c: Column) -> Column:
    return F.concat(F.length(c).cast("string"), F.lit(":"), c)


def _term(key: Column, kind: int, s=None, i=None, f=None, n=None) -> Column:
    null = F.lit(None)
    return F.struct(
        key.alias("key"),
        F.lit(kind).cast("tinyint").alias("kind"),
        (null if s is None else s).cast("string").alias("s"),
        (null if i is None else i).cast("bigint").alias("i"),
        (null if f is None else f).cast("double").alias("f"),
        (null if n is None else n).cast("int").alias("n"),
    )


def string(c: Column) -> Column:
    return _term(F.concat(F.lit("s"), _sized(c)), STRING, s=c)


def keyword(c: Column) -> Column:
    return _term(F.concat(F.lit("k"), _sized(c)), KEYWORD, s=c)


def integer(c: Column) -> Column:
    return _term(F.concat(F.lit("i"), c.cast("bigint").cast("string"), F.lit(";")), INT, i=c)


def floating(c: Column) -> Column:
    return _term(F.concat(F.lit("f"), c.cast("double").cast("string"), F.lit(";")), FLOAT, f=c)


def boolean(c: Column) -> Column:
    return _term(F.when(c, "b1;").otherwise("b0;"), BOOL, i=c.cast("int"))


def instant(seconds: Column, nanos: Column) -> Column:
    return _term(F.concat(F.lit("m"), seconds.cast("string"), F.lit(":"), nanos.cast("string"), F.lit(";")), INSTANT, i=seconds, n=nanos)


def timestamp(c: Column) -> Column:
    micros = F.unix_micros(c.cast("timestamp"))
    seconds = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    return instant(seconds, ((micros - seconds * 1_000_000) * 1000).cast("int"))


def triple_key(a: Column, b: Column, c: Column) -> Column:
    """The key of the triple of three keys."""
    inner = F.concat(_sized(a), _sized(b), _sized(c))
    return F.concat(F.lit("t"), _sized(inner))


def triple(a: Column, b: Column, c: Column) -> Column:
    return _term(triple_key(a["key"], b["key"], c["key"]), TRIPLE)


def literal(value) -> Column:
    """The term of a Python value."""
    if isinstance(value, bool):
        return boolean(F.lit(value))
    if isinstance(value, Keyword):
        return keyword(F.lit(str(value)))
    if isinstance(value, str):
        return string(F.lit(value))
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise TypeError(f"{value} has more than 64 bits")
        return integer(F.lit(value))
    if isinstance(value, float):
        return floating(F.lit(value))
    if isinstance(value, Instant):
        return instant(F.lit(value.seconds), F.lit(value.nanos))
    if isinstance(value, Triple):
        return triple(literal(value.t1), literal(value.t2), literal(value.t3))
    raise TypeError(f"no term: {value!r}")


def is_term(value) -> bool:
    if isinstance(value, Triple):
        return all(map(is_term, (value.t1, value.t2, value.t3)))
    return isinstance(value, (bool, str, float, Instant)) or isinstance(value, int) and -(1 << 63) <= value < 1 << 63


def of_type(c: Column, kind: str) -> Column:
    """The term of a table's column by its Spark type."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return integer(c)
    if kind in ("float", "double") or kind.startswith("decimal"):
        return floating(c)
    if kind.startswith("timestamp") or kind == "date":
        return timestamp(c)
    return boolean(c) if kind == "boolean" else string(c)


def number(t: Column) -> Column:
    """A term as a double: ints, floats, and strings that spell a number; else null."""
    s = t["s"]
    spelled = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint").cast("double")).when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return F.when(t["kind"] == INT, t["i"].cast("double")).when(t["kind"] == FLOAT, t["f"]).when(t["kind"] == STRING, spelled)


def whole(t: Column) -> Column:
    """A term as a 64-bit integer if it is one or a string that spells one; else null."""
    return F.when(t["kind"] == INT, t["i"]).when((t["kind"] == STRING) & t["s"].rlike(r"^[+-]?\d+$"), t["s"].try_cast("bigint"))


def order_columns(t: Column) -> list[Column]:
    """Sort columns for the natural order: bool, number, string, keyword, instant, triple; within a kind by value.

    Ints compare exactly with ints; with floats as doubles. Triples compare by key.
    """
    rank = F.when(t["kind"] == FLOAT, INT).otherwise(t["kind"].cast("int"))
    double = F.when(t["kind"] == INT, t["i"].cast("double")).otherwise(t["f"])
    exact = F.when(t["kind"] == FLOAT, t["f"].try_cast("bigint")).otherwise(t["i"])
    text = F.when(t["kind"] == TRIPLE, t["key"]).otherwise(t["s"])
    return [rank, double, exact, t["n"], text]


def order(t: Column, descending: bool = False) -> list[Column]:
    return [c.desc() if descending else c.asc() for c in order_columns(t)]


def row_key(*terms: Column) -> Column:
    """The text by which rows are ordered when nothing else is asked for."""
    return F.concat(*(_sized(t["key"]) for t in terms))


def shift_seconds(t: Column, by: Column) -> Column:
    return instant(t["i"] + by, t["n"])


def seconds_between(a: Column, b: Column) -> Column:
    return b["i"] - a["i"]
