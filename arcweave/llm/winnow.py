"""Document fingerprints by winnowing.

The words of a text (maximal runs without white space) give a rolling hash for
every ``K`` consecutive words: the hashes of the words, each rotated by its
distance from the last, combined by exclusive or, so that a run's hash follows
from the one before, or from those of its two halves. In every window of ``W``
such hashes the smallest is chosen, the rightmost among equal ones. The chosen
hashes are kept with their word positions. Two texts that share ``W + K - 1``
words in a row share a chosen hash, whatever surrounds them. A text of fewer than
``FEW`` words gives such points of its bytes as well, by ``BYTES`` in place of
``K``, so short texts and texts without spaces are not a hash or two.

A point is a 64-bit hash and a position. Hashes are compared by 32 of their bits,
packed with the position (reversed) in one number, so that one minimum gives both
the smallest hash and the rightmost place. Windows take logarithmically many
passes over an array and nothing leaves the row. The fingerprint as a string is
the points in text order, hash and position in hexadecimal, those of bytes last.

The likeness of two fingerprints is Dice's: twice the shared hashes over the sum
of the distinct hashes of both.

Defined results: a null text is an empty one; a text without words or bytes has the
empty fingerprint; with fewer than ``K`` words its one word hash is that of all its
words; with fewer than ``W`` hashes there is one window; a very long text is
fingerprinted whole; two empty fingerprints have likeness 1, an empty and another
one 0. Neighbours are in ascending order of id, then text, null ids last; the
first document follows the last; a document alone is its own neighbour; repeated
rows are documents of their own; further columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.text import SPACE, let, shifted

K = 5
W = 8
#: Consecutive bytes of a hash, and the words from which a text has no hashes of bytes.
BYTES = 8
FEW = 48
LOW = (1 << 31) - 1
HIGH = ((1 << 32) - 1) << 31

#: Rows that a sorted run of neighbours holds, about; the most runs; the places looked at for each bound of a run; and the characters of a text in a place.
RUN = 500
MAX_RUNS = 1 << 16
LOOKS = 16
TIE = 32


def _words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return let(parts, lambda p: F.when(F.array_contains(p, ""), F.filter(p, lambda w: w != "")).otherwise(p))


def _joined(before: Column, after: Column, length: int) -> Column:
    """The rolling hash of a run, from that of its first part and of the ``length`` tokens after it."""
    turned = F.shiftleft(before, length % 64).bitwiseOR(F.shiftrightunsigned(before, 64 - length % 64)) if length % 64 else before
    return turned.bitwiseXOR(after)


def _rolled(single: Column, k: int) -> Column:
    """Rolling hashes of all runs of k tokens, from an array of k hashes of tokens or more."""

    def build(have: Column | None, length: int, power: Column, size: int) -> Column:
        """``have`` covers ``length`` tokens from each place on, ``power`` covers ``size``; bits of k not yet used lie at or above ``size``."""
        if k & size:
            have, length = (power, size) if have is None else (shifted(have, power, length, lambda x, y: _joined(x, y, size)), length + size)
        if length == k:
            return have
        return let(shifted(power, power, size, lambda x, y: _joined(x, y, size)), lambda p: build(have, length, p, 2 * size))

    return build(None, 0, single, 1)


def _grams(tokens: Column, k: int) -> Column:
    """Hashes of all runs of k tokens, from the tokens' hashes; a shorter text gives one hash of all."""
    return F.when(F.size(tokens) >= k, _rolled(tokens, k)).when(F.size(tokens) > 0, F.array(F.xxhash64(tokens))).otherwise(tokens)


def _window_minima(values: Column, w: int) -> Column:
    """Minimum of every w consecutive values; of all if there are fewer."""

    def build(a: Column, size: int) -> Column:
        if size == w:
            return a
        step = min(size, w - size)
        return let(shifted(a, a, step, lambda x, y: F.least(x, y)), lambda b: build(b, size + step))

    return F.when(F.size(values) >= w, build(values, 1)).when(F.size(values) > 0, F.array(F.array_min(values))).otherwise(values)


def _chosen(tokens: Column, k: int, w: int) -> Column:
    """The points (h, i) of the minima of all windows over runs of tokens, in order."""

    def of(grams: Column) -> Column:
        packed = F.transform(grams, lambda x, i: x.bitwiseAND(F.lit(HIGH)).bitwiseOR(F.lit(LOW).cast("bigint") - i))
        places = F.transform(F.array_distinct(let(packed, lambda v: _window_minima(v, w))), lambda p: (F.lit(LOW).cast("bigint") - p.bitwiseAND(F.lit(LOW))).cast("int"))
        return F.transform(places, lambda i: F.struct(F.get(grams, i).alias("h"), i.alias("i")))

    return let(_grams(tokens, k), of)


def points(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen points (hash h, position i) of a text: those of words, then those of bytes if words are few."""
    text = F.coalesce(text, F.lit(""))

    def octet_hashes(octets: Column) -> Column:
        places = F.when(F.length(octets) > 0, F.sequence(F.lit(1), F.length(octets))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.substring(octets, i, F.lit(1)), F.lit(BYTES)))

    def of(words: Column) -> Column:
        own = let(F.transform(words, lambda x: F.xxhash64(x)), lambda x: _chosen(x, k, w))
        return F.when(F.size(words) < FEW, F.concat(own, let(let(F.encode(text, "UTF-8"), octet_hashes), lambda x: _chosen(x, BYTES, w)))).otherwise(own)

    return let(_words(text), of)


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p: F.concat_ws(".", F.hex(p["h"]), F.hex(p["i"]))), " ")


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda p: p["h"]))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of distinct hashes."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def fingerprints(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, points and fingerprint of every document."""
    found = docs.select(F.col(id_col).alias("doc_id"), points(F.col(text_col), k, w).alias("points"))
    return found.select("doc_id", "points", as_string(F.col("points")).alias("fingerprint"))


def with_next(rows: DataFrame, columns: list[str], id_col: str = "doc_id", tie_col: str = "text", derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``next_<column>`` of the following row in the order of id, then ``tie_col``; one shuffle of the rows.

    ``derive`` may add columns once rows are dealt to runs, so that they are not shuffled.

    Places in the order (whether the id is null, the id, the first ``TIE``
    characters of the tie), picked by hash, bound the runs: some ``LOOKS`` for each
    run, of which every ``LOOKS``-th is taken, so runs come out even, those of
    null ids too; there are at most some ``MAX_RUNS``. A subquery gathers the
    bounds, so the plan doesn't grow with them. A run's first place is its bound,
    so a row knows by itself whether it opens a run and goes to the run before as
    well, where it ends the sequence. Rows of one place are one run.
    """
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.substring(tie_col, 1, TIE).alias("tie"))
    every = max(1, max(RUN, -(-rows.count() // MAX_RUNS)) // LOOKS)
    picked = F.collect_set(F.when(F.pmod(F.xxhash64("place"), F.lit(every)) == 0, F.col("place")))
    ends = rows.select(place.alias("place")).agg(F.min("place").alias("least"), F.array_sort(picked).alias("picked"))
    sparse = F.filter("picked", lambda _, i: (i > 0) & (i % LOOKS == 0))
    bounds = ends.select(F.array_union(F.array("least"), sparse)).scalar()
    steps = F.array(*[F.lit(1 << s) for s in range(MAX_RUNS.bit_length(), -1, -1)])

    def dealt(starts: Column) -> Column:
        """The runs that a row goes to: (run, late); late rows end the run before."""
        run = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(starts, at + s) <= place, at + s).otherwise(at))

        def both(at: Column) -> Column:
            here = F.struct(at.alias("run"), F.lit(0).alias("late"))
            before = F.struct(F.when(at > 0, at - 1).otherwise(F.size(starts) - 1).alias("run"), F.when(at > 0, 1).otherwise(2).alias("late"))
            return F.when(F.get(starts, at) == place, F.array(here, before)).otherwise(F.array(here))

        return let(run, both)

    placed = rows.withColumn("_starts", bounds).withColumn("_at", let(F.col("_starts"), dealt)).drop("_starts").withColumn("_at", F.explode_outer("_at"))
    placed = placed.select(*rows.columns, F.col("_at.run").alias("_run"), F.col("_at.late").alias("_late")).repartition("_run")
    placed = derive(placed) if derive else placed
    order = Window.partitionBy("_run").orderBy("_late", F.col(id_col).asc_nulls_last(), F.col(tie_col))
    found = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_late = 0")
    return found.drop("_run", "_late")


def compare_edited(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the start of the next document's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    paired = with_next(own, ["text", "points"], derive=lambda rows: rows.withColumn("points", points(F.col("text"), k, w))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    edited = paired.select("doc_id", "n_chars", edited.alias("edited"), "points", F.col("next_points").alias("next_points"))
    done = edited.withColumn("edited_points", points(F.col("edited"), k, w))
    near = lambda other: let(hashes(F.col("points")), lambda a: likeness(a, hashes(F.col(other))))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_string(F.col("points")).alias("fingerprint"), as_string(F.col("edited_points")).alias("edited_fingerprint"),
        near("edited_points").alias("near_edited"), near("next_points").alias("near_next"),
    )
