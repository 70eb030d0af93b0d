"""Codes for integers and sequences as column expressions; code words are strings of 0 and 1.

Every encoder has a decoder of one word. Values out of a code's range give null.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), body)[0]


def _power(exponent: Column) -> Column:
    """2 to a power from 0 to 62."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))


def _long(bits: Column) -> Column:
    """The number that a string of bits stands for; 0 for none."""
    return F.when(F.length(bits) > 0, F.conv(bits, 2, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def gamma(x: Column) -> Column:
    """Elias gamma of x >= 1: as many zeros as the binary form has digits but one, then the binary form."""
    return F.when(x >= 1, F.concat(F.repeat(F.lit("0"), F.length(F.bin(x)) - 1), F.bin(x)))


def gamma_decode(word: Column) -> Column:
    return _long(F.substring(word, F.instr(word, "1"), F.instr(word, "1")))


def delta(x: Column) -> Column:
    """Elias delta of x >= 1: gamma of the binary length, then the binary form without its first digit."""
    return F.when(x >= 1, F.concat(gamma(F.length(F.bin(x))), F.substring(F.bin(x), 2, 64)))


def delta_decode(word: Column) -> Column:
    zeros = F.instr(word, "1") - 1
    size = gamma_decode(word)
    return _long(F.concat(F.lit("1"), F.substring(word, 2 * zeros + 2, (size - 1).cast("int"))))


def nibble(x: Column) -> Column:
    """Variable-length nibbles of x >= 0: three bits each, the last marked 1, others 0."""

    def blocks(bits: Column) -> Column:
        n = F.ceil(F.length(bits) / 3).cast("int")
        padded = F.lpad(bits, n * 3, "0")
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.when(i == n, "1").otherwise("0"), F.substring(padded, i * 3 - 2, F.lit(3)))), "")

    return F.when(x >= 0, _let(F.bin(x), blocks))


def nibble_decode(word: Column) -> Column:
    n = (F.length(word) / 4).cast("int")
    return _long(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i * 4 - 2, F.lit(3))), ""))


def minimal_binary(x: Column, z: Column) -> Column:
    """Minimal binary of 0 <= x < z: with s = ceil(log2 z), the first 2^s - z values take s - 1 bits, the rest s."""

    def word(s: Column) -> Column:
        short = _power(s) - z
        return F.when(x < short, F.when(s > 1, F.lpad(F.bin(x), s - 1, "0")).otherwise("")).otherwise(F.lpad(F.bin(x + short), s, "0"))

    return F.when((x >= 0) & (x < z), _let(F.when(z > 1, F.length(F.bin(z - 1))).otherwise(0), word))


def minimal_binary_decode(word: Column, z: Column) -> Column:
    def value(s: Column) -> Column:
        return F.when(F.length(word) < s, _long(word)).otherwise(_long(word) - (_power(s) - z) * (F.length(word) > 0).cast("long"))

    return _let(F.when(z > 1, F.length(F.bin(z - 1))).otherwise(0), value)


def zeta(x: Column, k: int) -> Column:
    """zeta_k of x >= 1: h + 1 in unary, where 2^(hk) <= x < 2^((h+1)k), then x - 2^(hk) in minimal binary of that block."""

    def word(h: Column) -> Column:
        low = _power(h * k)
        return F.concat(F.repeat(F.lit("0"), h), F.lit("1"), minimal_binary(x - low, low * (1 << k) - low))

    return F.when(x >= 1, _let(F.floor((F.length(F.bin(x)) - 1) / k).cast("int"), word))


def zeta_decode(word: Column, k: int) -> Column:
    def value(h: Column) -> Column:
        low = _power(h * k)
        return low + minimal_binary_decode(F.substring(word, h + 2, F.length(word)), low * (1 << k) - low)

    return _let((F.instr(word, "1") - 1).cast("int"), value)


def move_to_front(symbols: Column, alphabet: Column) -> Column:
    """Array of the places, from 0, of symbols in an alphabet whose last used symbol moves to its front; null outside it."""
    start = F.struct(alphabet.alias("a"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        place = F.array_position(acc["a"], s)
        return F.struct(F.when(place > 0, F.concat(F.array(s), F.array_remove(acc["a"], s))).otherwise(acc["a"]).alias("a"), F.concat(acc["out"], F.array(F.when(place > 0, place - 1))).alias("out"))

    return F.aggregate(symbols, start, step, lambda acc: acc["out"])


def move_to_front_decode(places: Column, alphabet: Column) -> Column:
    start = F.struct(alphabet.alias("a"), F.slice(alphabet, 1, 0).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = F.get(acc["a"], p.cast("int"))
        return F.struct(F.concat(F.array(s), F.array_remove(acc["a"], s)).alias("a"), F.concat(acc["out"], F.array(s)).alias("out"))

    return F.aggregate(places, start, step, lambda acc: acc["out"])


def run_lengths(symbols: Column) -> Column:
    """Array of (value, n) for the maximal runs of an array, in one pass over its run starts."""

    def runs(a: Column) -> Column:
        n = F.size(a)
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(a, i - 1)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(a, i).alias("value"), (F.coalesce(F.get(s, k + 1), n) - i).cast("long").alias("n"))))

    return _let(symbols, runs)


def run_lengths_decode(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"].cast("int"))))


def binary_runs(bits: Column) -> Column:
    """Run lengths of a string of bits: the number of runs, the length of the first run of ones (0 if it begins with 0), then lengths less one."""

    def of(runs: Column) -> Column:
        ones = F.get(runs, F.lit(0))["value"] == "1"
        rest = F.transform(F.when(ones, F.slice(runs, F.lit(2), F.size(runs))).otherwise(runs), lambda r: r["n"] - 1)
        first = F.when(ones, F.get(runs, F.lit(0))["n"]).otherwise(0)
        return F.concat(F.array(F.size(runs).cast("long"), F.coalesce(first, F.lit(0)).cast("long")), rest)

    return _let(run_lengths(F.split(bits, "")), of)


def binary_runs_decode(code: Column) -> Column:
    def of(c: Column) -> Column:
        first = F.get(c, F.lit(1))
        rest = F.transform(F.slice(c, F.lit(3), F.size(c)), lambda n, i: F.repeat(F.when(i % 2 == 0, "0").otherwise("1"), (n + 1).cast("int")))
        return F.concat(F.repeat(F.lit("1"), first.cast("int")), F.array_join(rest, ""))

    return _let(code, of)


def huffman_codes(counts: dict[str, int]) -> dict[str, str]:
    """An optimal prefix code; equal weights join in order of their smallest symbol. One symbol alone gets ``0``."""
    heap = [(n, s, [s]) for s, n in sorted(counts.items())]
    heapq.heapify(heap)
    codes = dict.fromkeys(counts, "" if len(counts) > 1 else "0")
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, part in (("0", a), ("1", b)):
            for s in part[2]:
                codes[s] = bit + codes[s]
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return codes


def huffman(df: DataFrame, symbol: str, most: int = 100_000) -> DataFrame:
    """(symbol, n, code) for the values of a column. The alphabet, not the rows, is coded on the driver; over ``most`` symbols is an error."""
    counts = df.groupBy(F.col(symbol).cast("string").alias("symbol")).agg(F.count(F.lit(1)).alias("n")).where("symbol is not null")
    table = {r[0]: r[1] for r in counts.limit(most + 1).collect()}
    if len(table) > most:
        raise ValueError(f"the alphabet has more than {most} symbols")
    codes = huffman_codes(table)
    return df.sparkSession.createDataFrame([(s, n, codes[s]) for s, n in sorted(table.items())], "symbol string, n long, code string")
