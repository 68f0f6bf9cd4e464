"""Text expressions shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACES = r"[\x20\x09-\x0D]+"  # the white space that separates words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def whole_text(text: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for an empty text."""
    return F.array_remove(F.split(text, SPACES), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def running_totals(steps: Column, block: int = 256) -> Column:
    """Inclusive prefix sums of an array, block by block, so that a long array costs n * block and not n * n."""
    zero = F.lit(0).cast("bigint")
    total = lambda part: F.aggregate(part, zero, lambda a, b: a + b)

    def within(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda part, b: let(
            total(F.slice(sums, 1, b)),
            lambda before: F.transform(part, lambda _, i: before + total(F.slice(part, 1, i + 1))),
        ))))

    count = F.ceil(F.size(steps) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(steps, (b - 1) * block + 1, block))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, within))
