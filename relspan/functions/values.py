"""Comparison with total, two-valued semantics on Spark columns.

NULL equals itself and is least. Values of unlike kinds are never equal; their order is that of the kinds: null,
integer, real, text, blob. Every result is a non-null boolean. Shapes are chosen so that
Parquet can be asked: ``c <=> v`` and ``c IS NULL OR c < v`` push down, CASE would not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank of a kind; types that have no kind of their own compare as Spark does among themselves, after all others.
KINDS = {T.NullType: 0, T.ByteType: 1, T.ShortType: 1, T.IntegerType: 1, T.LongType: 1, T.FloatType: 2, T.DoubleType: 2, T.StringType: 3, T.BinaryType: 4}


def kind(t: T.DataType) -> int:
    return 1 if isinstance(t, T.BooleanType) else KINDS.get(type(t), 5)


def equal(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    if kind(ta) == kind(tb) or 0 in (kind(ta), kind(tb)):
        return a.eqNullSafe(b)
    return a.isNull() & b.isNull()


def less(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    ka, kb = kind(ta), kind(tb)
    if kb == 0:
        return F.lit(False)
    if ka == 0:
        return b.isNotNull()
    if ka == kb:
        return b.isNotNull() & (a.isNull() | (a < b))
    return b.isNotNull() if ka < kb else b.isNotNull() & a.isNull()


def truthy(a: Column, t: T.DataType) -> Column:
    """All but integer 0 (and false) holds, NULL included."""
    if isinstance(t, T.BooleanType):
        return ~a.eqNullSafe(F.lit(False))
    return ~a.eqNullSafe(F.lit(0)) if kind(t) == 1 else F.lit(True)


def glob_to_regex(pattern: str) -> str:
    """An anchored Java regex for a case-sensitive GLOB of *, ?, [...] and [^...]."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            m = re.compile(r"\[(\^?)(\]?[^\]]*)\]").match(pattern, k)
            if m is None:
                return r"(?!)"  # an open class matches nothing
            inside = "".join("\\" + x if x in r"\[]&^" else x for x in m[2])
            out.append(f"[{m[1]}{inside}]")
            k = m.end() - 1
        else:
            out.append("\\" + c if c in r"\^$.|+(){}" else c)
        k += 1
    return "(?s)^" + "".join(out) + "$"


def glob(a: Column, pattern: str, t: T.DataType) -> Column:
    """Whole-string GLOB; what isn't text never matches. A plain prefix is left to startswith, which Parquet can be asked."""
    if kind(t) != 3:
        return F.lit(False)
    head = pattern[:-1]
    found = a.startswith(head) if pattern.endswith("*") and not set(head) & set("*?[") else a.rlike(glob_to_regex(pattern))
    return a.isNotNull() & found


def boxed(a: Column, t: T.DataType) -> Column:
    """A dynamically typed cell: struct<t, i, r, s, b>, whose own equality and order are those of this module."""
    null = {"i": F.lit(None).cast("long"), "r": F.lit(None).cast("double"), "s": F.lit(None).cast("string"), "b": F.lit(None).cast("binary")}
    k = kind(t)
    field = {1: "i", 2: "r", 3: "s", 4: "b"}.get(k)
    if field is None and k != 0:
        raise TypeError(f"{t.simpleString()} has no boxed form")
    cells = null | ({field: a.cast({"i": "long", "r": "double", "s": "string", "b": "binary"}[field])} if field else {})
    tag = F.when(a.isNull(), F.lit(0)).otherwise(F.lit(k)).cast("tinyint")
    return F.struct(tag.alias("t"), *(c.alias(n) for n, c in cells.items()))
