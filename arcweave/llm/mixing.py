"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document of it is wanted
``target / source size`` times. The whole part is taken; the fractional parts
are rounded dependently: two documents meet, probability mass is moved at
random between them, keeping the expected number of words, until one is 0 or 1,
and the other meets the next document. Documents meet in falling order of size;
one that is still open when the next is less than half its size is settled by a
draw, and the words that the draw gave too many or too few are spread over the
documents that follow. Such an error is 0 on average, so a document's mean
number of copies is what it is wanted, but where a chance would leave 0 to 1, or
where those that follow are too few to make a draw good, so that it goes the
other way.
So a source's words come out at its target up to about the size of its last
document, and no document is taken less often than the whole part says, or more
often than once above it.

The rounding is a reduction tree, the same for every source and document: open
documents are dealt to groups of a bounded size, each group leaves one of them
open, with the words it has yet to make good, and these meet again, level by
level, until one is left for each source. A hot source is many groups.

All draws are hashes of a seed and stable keys, so reruns agree.

Defined results: null text has size 0; a document of size 0 is taken 0 words; a
source without words gets target 0; null sources are one source, ordered last;
a very long document is one document like any other; rows equal in all columns
are counted first and share their copies evenly, so they are no hot group; an
empty table gives an empty table; further columns are ignored by ``mix`` and
kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.rows import repeat_rows, row_key
from arcweave.llm.text import n_words
from arcweave.plans.lineage import materialize
from arcweave.plans.ordering import number_rows

WEIGHTS = (5.0, 2.0, 1.0)
EPSILON = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target; ``sized`` has source and size.

    A target that is above ``most`` times its source's size stops there and the
    rest is shared again by weight; each round is one aggregate over sources.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(per_source, F.col("source").asc_nulls_last(), name="_rank")
    pick = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        pick = F.when(F.col("_rank") % len(weights) == k, w).otherwise(pick)
    table = materialize(ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * most).alias("limit")), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, capped = 0.0, -1
    while True:
        full = F.col("limit") <= F.col("weight") * rate
        n, taken, free = table.agg(F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, rate = n, max(0.0, total - (taken or 0)) / free
    return table.select("source", "source_size", F.least("limit", F.col("weight") * rate).cast("double").alias("target"))


def draw(*key: object) -> float:
    """A number in [0, 1) from a key."""
    return xxhash.xxh64_intdigest(":".join(map(str, key))) / 2.0**64


def meet(a: float, p: float, b: float, q: float, u: float) -> tuple[float, float]:
    """New probabilities of two documents of sizes a and b; one is 0 or 1, and a*p + b*q stays."""
    mass = a * p + b * q
    low, high = max(0.0, (mass - b) / a), min(1.0, mass / a)
    p = low if u * (high - low) < high - p else high
    return p, (mass - a * p) / b


def settled(p: float) -> bool:
    return p <= EPSILON or p >= 1 - EPSILON


def round_group(sizes: list[int], chances: list[float], error: float, *key: object) -> tuple[list[int], int, float, float]:
    """Rounds documents in falling order of size, some words being due besides (or, if negative, too many).

    Gives 0 or 1 for each, the index of the one left open (-1: none), its chance, and the words still due.
    """
    out = [0] * len(sizes)
    held, p, left = -1, 0.0, float(sum(sizes))
    due = sum(a * q for a, q in zip(sizes, chances, strict=True))  # words that those not yet met give
    for i, size in enumerate(sizes):
        if held >= 0 and sizes[held] > 2 * size:
            out[held] = int(draw(*key, held, "alone") < p)
            beyond = [max(0.0, -due - e, e - (left - due)) for e in (error + sizes[held] * p, error + sizes[held] * (p - 1))]
            if beyond[out[held]] > beyond[1 - out[held]]:
                out[held] = 1 - out[held]
            error += sizes[held] * (p - out[held])
            held = -1
        due -= size * chances[i]
        q = min(1.0, max(0.0, chances[i] + error / left))
        error -= size * (q - chances[i])
        left -= size
        if settled(q):
            out[i] = round(q)
        elif held < 0:
            held, p = i, q
        else:
            p, q = meet(sizes[held], p, size, q, draw(*key, i))
            if settled(p):
                out[held] = round(p)
                held, p = i, q
            else:
                out[i] = round(q)
            if settled(p):
                out[held] = round(p)
                held = -1
    return out, held, p, error


def _round_groups(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds a group of documents of one source; the last level leaves none open."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "_tie"], ascending=[False, True], kind="stable").reset_index(drop=True)
        key = (seed, level, rows["source"].iloc[0], int(rows["_group"].iloc[0]))
        out, held, p, error = round_group(rows["size"].tolist(), rows["_p"].tolist(), float(rows["_due"].sum()), *key)
        if last and held >= 0:
            out[held], held = int(draw(*key, "last") < p), -1
        rows["_copies"] = rows["_whole"] + np.array(out, dtype=np.int64)
        rows["_open"] = False
        if held < 0 and not last and abs(error) > EPSILON:
            held, p = len(rows) - 1, float(out[-1])  # the smallest takes along what is due
        if held >= 0:
            rows.loc[held, ["_p", "_due", "_open"]] = [p, error, True]
        return rows.drop(columns="_group")

    return run


def copies(sized: DataFrame, targets: DataFrame, seed: int = 0, group: int = 500) -> DataFrame:
    """Distinct rows of ``sized`` (id columns, source, size) with source_size, target, the number of ``_rows`` equal to each and the ``_copies`` of them all."""
    names = sized.columns
    counted = sized.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"))
    keyed = counted.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # rows that are equal are wanted together: the whole part of all, and one chance of another
    wanted = F.col("_rows") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = keyed.withColumn("_tie", F.xxhash64(*names)).withColumn("_whole", F.least(F.floor(wanted + EPSILON), 2 * F.col("_rows")).cast("long"))
    keyed = keyed.withColumn("_p", F.greatest(F.lit(0.0), wanted - F.col("_whole"))).withColumn("_due", F.lit(0.0))
    keyed = materialize(keyed, "sized")
    whole = (F.col("size") <= 0) | (F.col("_p") <= EPSILON)
    done = [*names, "source_size", "target", "_rows", "_copies"]
    open_ = keyed.where(~whole)
    results = [keyed.where(whole).withColumn("_copies", F.col("_whole")).select(*done)]
    level, kinds = 0, ", ".join(f"`{c}` {t}" for c, t in open_.dtypes)
    while True:
        groups = materialize(open_.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumn("_groups", F.ceil(F.col("_n") / group)).withColumnRenamed("source", "_source"), "groups")
        most = groups.agg(F.max("_n")).first()[0]
        if not most:
            break
        dealt = open_.join(groups, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_group", F.pmod(F.xxhash64("_tie", F.lit(level)), "_groups"))
        dealt = dealt.drop("_source", "_n", "_groups")
        rounded = materialize(dealt.groupBy("source", "_group").applyInPandas(_round_groups(seed, level, most <= group), f"{kinds}, _copies long, _open boolean"), "rounded")
        results.append(rounded.where("not _open").select(*done))
        open_ = rounded.where("_open").drop("_copies", "_open")
        level += 1
        if most <= group:
            break
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = materialize(sized, "sizes")
    taken = copies(sized, source_targets(sized), seed)
    each = taken.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    each = each.withColumn("copies", (F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("int")).cast("int"))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, columns unchanged."""
    sized = docs.select(*row_key(docs), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))
    sized = materialize(sized, "sizes")
    return repeat_rows(docs, copies(sized, source_targets(sized), seed).select("_a", "_b", "_copies", "_rows"))
