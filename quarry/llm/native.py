"""Column building blocks of the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: A word: a run of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often and wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ints() -> Column:
    return F.array().cast("array<int>")


def _running(xs: Column) -> Column:
    """Sums up to and with each element of a short array."""
    return F.aggregate(xs, ints(), lambda acc, x: F.array_append(acc, x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))).cast("array<int>"))


def running(xs: Column, block: int = 64) -> Column:
    """Sums up to and with each element; blocks keep the steps well under the square of the length."""

    def of(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int"))
        return let(
            F.transform(F.transform(starts, lambda b: F.slice(xs, b * block + 1, F.lit(block))), _running),
            lambda inner: let(
                _running(F.transform(inner, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))),
                lambda ends: F.flatten(F.zip_with(inner, ends, lambda p, e: F.transform(p, lambda x: x + e - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))),
            ),
        )

    return let(xs, of)


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, match>>, in code points, end exclusive.

    Places come from the lengths of the matches and of what `split` leaves
    between them.
    """

    def of(m: Column, gaps: Column) -> Column:
        def build(ends: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                match = F.element_at(m, i + 1)
                return F.struct((e - F.length(match)).alias("start"), e.alias("end"), match.alias("match"))

            return F.transform(ends, one)

        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: (F.length(g) + F.length(x)).cast("int"))
        return let(running(steps), build)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda gaps: of(m, gaps)))


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of array<struct<start, kind, end>>, by start and then kind, comma-joined."""
    label = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(label, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column, labels: list[str]) -> Column:
    """Text with the spans (array<struct<start, kind, end>>) replaced by their kind's label; what lies in an earlier one is passed over."""
    label = F.array(*(F.lit(n) for n in labels))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        piece = F.concat(F.substring(text, acc["at"] + 1, start - acc["at"]), F.element_at(label, s["kind"] + 1))
        more = F.array_append(acc["out"], piece).cast("array<string>")
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), more.alias("out")))

    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")
