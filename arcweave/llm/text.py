"""Column expressions on texts shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space between words: space, and U+0009 to U+000D.
SPACE = " \t-\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than white space; empty for null."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """The text cut at each line end; empty for null."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def has_word(text: Column) -> Column:
    return text.rlike(f"[^{SPACE}]")


def hash128(*parts: Column) -> Column:
    """Two 64-bit hashes as a struct (a, b): wide enough to stand for the values themselves."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(0x9E37), *parts).alias("b"))


def shifted(a: Column, b: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f(a[i], b[i + by])`` for all i where both are there."""
    n = F.size(b) - by
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f)


def run_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; the array must have k or more.

    Longer runs are composed from shorter ones by doubling, so each takes a few
    passes over arrays of longs, whatever k is.
    """

    def of(single: Column) -> Column:
        def build(have: Column | None, length: int, power: Column, size: int) -> Column:
            """``have`` covers ``length`` words from i on; ``power`` covers ``size``; bits of k not yet used lie at or above ``size``."""
            if k & size:
                have, length = (power, size) if have is None else (shifted(have, power, length, lambda x, y: F.xxhash64(x, y)), length + size)
            if length == k:
                return have
            return let(shifted(power, power, size, lambda x, y: F.xxhash64(x, y)), lambda p: build(have, length, p, 2 * size))

        return build(None, 0, single, 1)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)
