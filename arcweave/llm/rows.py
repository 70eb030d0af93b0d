"""Carrying decisions about rows back to them, without an id that tells rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_key(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, _a and _b; only rows equal in all columns share them."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*every).alias("_a"), F.xxhash64(F.lit(1), *every).alias("_b")]


#: Bits of the table that says which rows may be meant: 1 MB, whatever the number of rows.
MAYBE = 1 << 23


def maybe_among(rows: DataFrame, wanted: DataFrame, key: str = "_a") -> DataFrame:
    """``rows`` and ``_maybe``: false only if a row's ``key``, a hash, is not in ``wanted``.

    A table of fixed size is broadcast, at most ``MAYBE / 64`` numbers, so that most
    rows need no shuffle where few are wanted; the rest is for an exact join to tell.
    """
    place = F.pmod(F.col(key), F.lit(MAYBE))
    word, bit = F.shiftright(place, 6).cast("int"), (place % 64).cast("int")
    table = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    marked = rows.withColumn("_at", word).join(F.broadcast(table), F.col("_at") == F.col("_word"), "left")
    return marked.withColumn("_maybe", F.coalesce(F.call_function("bit_get", "_bits", bit) == 1, F.lit(False))).drop("_at", "_word", "_bits")


def only_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with ``wanted`` on _a and _b; few others are shuffled."""
    return maybe_among(rows, wanted).where("_maybe").drop("_maybe").join(wanted, ["_a", "_b"])


def drop_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` without what ``decisions`` (_a, _b, _copies below _rows) takes away; keys that it doesn't name stay."""
    from arcweave.plans.lineage import materialize

    decisions = materialize(decisions.select("_a", "_b", "_copies", "_rows"), "decisions")
    marked = maybe_among(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *row_key(docs)), decisions)
    named = marked.where("_maybe").join(decisions, ["_a", "_b"], "left").select("_doc", "_a", "_b", "_copies")
    rank = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("_copies"))
    left = named.withColumn("_k", rank).where("_copies is null or _k <= _copies")
    kept = marked.where("not _maybe").select("_doc").union(left.select("_doc"))
    return kept.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def repeat_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each row as often as decided. ``decisions`` has _a, _b, _copies and _rows: copies in all of the _rows rows of a key.

    Rows of one key share the copies evenly; where these don't divide, the first
    rows give one more, and rows of one key are equal, so which is no matter.
    """
    rows = docs.select(*row_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).join(decisions.where("_copies > 0"), ["_a", "_b"])
    each = F.floor(F.col("_copies") / F.col("_rows")).cast("int")
    whole = rows.where("_copies % _rows = 0").select("_doc", each.alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("_rows"))
    split = rows.where("_copies % _rows != 0").withColumn("_k", rank).select("_doc", (each + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("int")).alias("_n"))
    taken = whole.union(split).where("_n > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return taken.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
