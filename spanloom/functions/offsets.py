"""Match offsets without a Python function.

Spark returns matches and what lies between them, but no positions. Both lists have lengths, and sums over them, made a
stretch at a time so that a text with very many matches stays cheap, are the positions. A text is first asked whether
it matches at all, which most do not. Offsets count code points; spans are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import java

SPAN = "struct<start:int,end:int,text:string>"


#: Lengths that are summed in one stretch.
STRETCH = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column) -> Column:
    """array<int>: the sum of all lengths before each one."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    summed = lambda x: F.aggregate(x, zero, step)

    def stretches(x):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRETCH).cast("int")), lambda k: summed(F.slice(x, k * STRETCH + 1, F.lit(STRETCH))))
        return _let(parts, lambda q: F.flatten(F.zip_with(q, summed(F.transform(q, lambda y: y["at"]))["out"], lambda y, o: F.transform(y["out"], lambda v: v + o))))

    return _let(lengths, lambda x: F.when(F.size(x) <= STRETCH, summed(x)["out"]).otherwise(stretches(x)))


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the non-overlapping matches of ``pattern``, which must not match nothing."""
    p = java(pattern)
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    between = F.transform(F.split(text, p, -1), lambda g: F.length(g))
    steps = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), lambda m, g: F.struct(g.alias("gap"), m.alias("m")))

    def placed(x):
        before = running(F.transform(x, lambda y: y["gap"] + F.length(y["m"])))
        return F.zip_with(x, before, lambda y, at: F.struct((at + y["gap"]).alias("start"), (at + y["gap"] + F.length(y["m"])).alias("end"), y["m"].alias("text")))

    return F.when(text.rlike(p), _let(F.filter(steps, lambda x: x["m"].isNotNull()), placed)).otherwise(F.array().cast(f"array<{SPAN}>"))
