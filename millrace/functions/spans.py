"""Places of pattern matches in a text, in native expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let

SPAN = "array<struct<start: int, end: int, kind: string, value: string>>"
#: Matches whose places are summed together; places within a chunk are appended one by one, chunks all at once.
CHUNK = 256


def no_spans() -> Column:
    return F.array().cast(SPAN)


def _appended(sizes: Column) -> Column:
    """Running sums of an array, from 0 to the total, each appended to those before it."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _summed(sizes: Column) -> Column:
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda i: _appended(F.slice(sizes, i * CHUNK + 1, CHUNK)))

    def joined(parts: Column) -> Column:
        before = _appended(F.transform(parts, lambda p: F.element_at(p, -1)))
        shifted = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + b))
        return F.flatten(shifted)

    return F.when(F.size(sizes) > 0, let(chunks, joined)).otherwise(F.array().cast("array<int>"))


def running(sizes: Column) -> Column:
    """The sum of the elements before each element of an array of whole numbers, in steps that grow with its size."""
    return let(sizes, _summed)


def starts(found: Column, gaps: Column) -> Column:
    """Where each match starts, from the matches and the gaps that a split at the pattern leaves."""

    def placed(own: Column) -> Column:
        before = running(F.zip_with(found, own, lambda m, g: F.length(m) + F.length(g)))
        return F.zip_with(before, own, lambda at, g: at + F.length(g))

    return let(F.slice(gaps, F.lit(1), F.size(found)), placed)


def matches(text: Column, pattern: str, kind: str, good: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, kind, value>> of the leftmost non-overlapping matches that `good` accepts.

    The places come from the lengths of the gaps that a split at the pattern leaves; texts without a match are not
    split. Null texts have no spans.
    """

    def placed(found: Column) -> Column:
        span = lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
        every = F.zip_with(found, starts(found, F.split(text, pattern, -1)), span)
        return every if good is None else F.filter(every, lambda s: good(s["value"]))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(no_spans())
