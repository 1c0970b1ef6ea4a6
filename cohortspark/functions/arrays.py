"""Array helpers: a binding, a scan, and code-point slices of a text in constant time.

A column named inside a lambda may be computed again for each element, and a fold copies its whole
accumulator, arrays included, at each step. ``let`` binds a value once; ``scan`` keeps accumulators small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a fold step copies the numbers of at most this many items
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column | bool, list[Column]]]) -> Column:
    """Numbers that ``step`` puts out over ``items``, from left to right, as one flat array of ints; null for
    null items.

    ``step(state, item)`` gives (next state, whether it puts out, the numbers, equally many each time).
    States should be a few numbers too: items may be large, they are never copied. The items are folded
    block by block, so that n items cost n * BLOCK / 2 + n * n / (2 * BLOCK) copied numbers and not n * n / 2."""
    none = F.array().cast("array<int>")

    def blocks(xs):
        last = F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / BLOCK).cast("int")
        return F.when(xs.isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))

    def one(acc, x):
        new, emits, numbers = step(acc["s"], x)
        out = F.concat(acc["out"], F.array(*[n.cast("int") for n in numbers]))
        return F.struct(new.alias("s"), (out if emits is True else F.when(emits, out).otherwise(acc["out"])).alias("out"))

    def block(acc, xs):
        done = F.aggregate(xs, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], d["out"]).alias("out")))

    return F.aggregate(let(items, blocks), F.struct(state.alias("s"), none.alias("out")), block, lambda acc: acc["out"])


def nth(flat: Column, i: Column, width: int, place: int) -> Column:
    """The number at ``place`` of the i-th output of ``width`` numbers."""
    return F.get(flat, i * width + place)


def wide(text: Column) -> Column:
    """The text with four bytes for each code point, for ``wide_slice``."""
    return F.encode(text, "UTF-32")


def wide_slice(wide_text: Column, start: Column, length: Column) -> Column:
    """Code points [start, start + length) of a ``wide`` text; the time does not grow with the text."""
    return F.decode(F.substring(wide_text, start * 4 + 1, length * 4), "UTF-32")
