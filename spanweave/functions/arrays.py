"""Array helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it often within ``body``."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, 0 and all numbers before it, combined; n ** 1.5 in time.

    ``combine`` is associative and has 0 as its neutral value, as sums and
    maxima of natural numbers have.  Blocks of about the root of the length
    spare the copy of a growing result that a plain fold would make for every
    element.
    """
    fold = lambda v: F.aggregate(v, F.lit(0).cast("long"), combine)

    def by_blocks(v: Column, width: Column) -> Column:
        heads = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: fold(F.slice(v, b * width + 1, width))
        )

        def each(before: Column) -> Column:
            block = lambda k: F.floor(k / width).cast("int")
            return F.transform(v, lambda _, k: combine(F.get(before, block(k)), fold(F.slice(v, block(k) * width + 1, k % width))))

        return let(heads, lambda h: let(F.transform(h, lambda _, b: fold(F.slice(h, F.lit(1), b))), each))

    none = F.array().cast("array<bigint>")
    whole = lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: by_blocks(v, width))
    return F.when(F.size(values) == 0, none).otherwise(let(values.cast("array<bigint>"), whole))


def offsets(lengths: Column) -> Column:
    """The sum before each element and, last, the whole sum."""
    return let(lengths.cast("array<bigint>"), lambda v: F.concat(running(v, lambda a, x: a + x), F.array(total(v))))
