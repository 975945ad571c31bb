"""Regular-expression spans as plain column expressions.

Spark gives the matches of a pattern (``regexp_extract_all``) and the stretches between them (``split``), but no
positions. Both walk the text alike, leftmost and without overlap, so that running sums of their lengths give every
span in code points, end exclusive. Patterns must not match the empty string.

Java's engine calls itself once per turn of a group that can match in several ways; thousands of turns overflow its
stack. The patterns here therefore repeat single characters only, with lookaheads in place of repeated groups.

All of it takes time in proportion to the text, however many matches it has: running values are taken in blocks, and
stretches of a text are cut from short pieces of it (Spark's ``substring`` counts from the start of its string).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,ord:int,stop:int,kind:string,value:string>>"
NONE = f"cast(array() as {SPAN})"
BLOCK, PIECE = 32, 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, kind: str, op: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """Running values of an associative ``op`` over an array of ``kind``; the array grows by copies within blocks only."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def fold(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, -1), x)))))

    def level(array: Column, left: int) -> Column:
        if not left:
            return fold(array)
        parts = let(array, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK))))

        def join(inner: Column) -> Column:
            ends = level(F.transform(inner, lambda a: F.element_at(a, -1)), left - 1)
            return let(ends, lambda e: F.flatten(F.transform(inner, lambda a, i: F.when(i == 0, a).otherwise(F.transform(a, lambda x: op(F.element_at(e, i), x))))))

        return let(F.transform(parts, fold), join)

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, fold(v)).otherwise(level(v, depth)))


def pieces_of(text: Column) -> Column:
    """``text`` as pieces of ``PIECE`` code points, for ``stretch``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def stretch(pieces: Column, start: Column, stop: Column) -> Column:
    """The text from ``start`` to ``stop`` (exclusive)."""
    first = F.floor(start / PIECE).cast("int")
    many = F.floor((stop - 1) / PIECE).cast("int") - first + 1
    cut = F.substring(F.array_join(F.slice(pieces, first + 1, many), ""), start - first * PIECE + 1, stop - start)
    return F.when(stop > start, cut).otherwise(F.lit(""))


def find_spans(text: Column, kind: str, order: int, pattern: str, keep=None, group: int = 0, lead: str = "") -> Column:
    """Spans of ``pattern`` in ``text``; ``keep`` takes (whole match, group) and drops matches that fail it.

    With ``lead`` a span starts where ``lead`` first stands in the match; what comes before it is only passed over.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))

    def spans(rows: Column) -> Column:
        stops = running(F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["m"])), "int", lambda a, b: a + b)
        placed = F.zip_with(rows, stops, lambda x, stop: F.struct(x["m"].alias("m"), x["part"].alias("part"), stop.alias("stop")))
        if keep is not None:
            placed = F.filter(placed, lambda x: keep(x["m"], x["part"]))
        if lead:
            placed = F.transform(placed, lambda x: x.withField("m", F.substring(x["m"], F.instr(x["m"], lead), F.length(x["m"]))))
        return F.transform(
            placed,
            lambda x: F.struct((x["stop"] - F.length(x["m"])).alias("start"), F.lit(order).alias("ord"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("value")),
        )

    return F.when(text.rlike(pattern), let(F.arrays_zip(whole.alias("m"), gaps.alias("gap"), part.alias("part")), spans)).otherwise(F.expr(NONE))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
