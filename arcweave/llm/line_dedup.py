"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a document (lines without a word are passed
over) form a window. A window that occurs again later, in the order of document
id and position, is a repeat there; all lines that repeats cover are removed,
so the first occurrence stays and later ones go.

Windows travel as 128-bit hashes with the place they come from, never as text.
The first place of a window is a minimum that combines before the shuffle, so a
passage shared by a third of all documents is no hot spot there; the join that
marks the later places has two plain exchanges, which adaptive execution splits.

Defined results: a null text stays null and an empty one empty; a document with
fewer than three worded lines has no window and stays as it is; lines without a
word are removed only between two removed lines; rows equal in id and text
count as one document and are treated alike; null ids come last in the order;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.text import has_word, hash128, let, lines
from arcweave.plans.lineage import materialize

WINDOW = 3


def _worded(text: Column) -> Column:
    """Positions, from 0, of the lines with a word."""
    return F.transform(F.filter(F.transform(lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: has_word(x["line"])), lambda x: x["i"])


def _windows(text: Column, size: int) -> Column:
    """A struct (hash, i) for each window; i counts worded lines."""

    def of(found: Column) -> Column:
        starts = F.when(F.size(found) >= size, F.sequence(F.lit(0), F.size(found) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(hash128(*[F.get(found, i + k) for k in range(size)]).alias("hash"), i.alias("i")))

    return let(F.filter(lines(text), has_word), of)


def repeated_lines(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document (its id and text hash) with repeats: the positions where repeated windows start."""
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    windows = docs.select(place.alias("doc"), F.explode(_windows(F.col(text_col), size)).alias("w")).select("doc", "w.hash.a", "w.hash.b", "w.i")
    at = F.struct("doc", "i")
    first = windows.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("final")).where("first != final")
    first = materialize(first.select("a", "b", "first"), "windows")
    later = windows.join(first, ["a", "b"]).where(at != F.col("first"))
    return later.groupBy("doc").agg(F.sort_array(F.collect_set("i")).alias("starts"))


def dedup_lines(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with repeated lines taken from ``text``, and ``n_lines`` and ``n_removed`` beside it."""
    names = docs.columns
    repeats = repeated_lines(docs, size, id_col, text_col).select(F.col("doc.id").alias("_id"), F.col("doc.text").alias("_hash"), "starts")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(f"`{id_col}`").alias("_key"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text"))
    joined = keyed.join(repeats, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    text = F.col("_doc")[text_col]

    def without(every: Column, worded: Column) -> Column:
        """The lines that stay: those before the first worded one, and each worded one that no repeat covers with the blank ones after it."""
        gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + size - 1))))
        stay = F.array_except(F.sequence(F.lit(0), F.size(worded) - 1), gone)
        after = lambda k: F.coalesce(F.get(worded, k + 1), F.size(every))
        blocks = F.transform(stay, lambda k: F.slice(every, F.get(worded, k) + 1, after(k) - F.get(worded, k)))
        return F.concat(F.slice(every, 1, F.get(worded, F.lit(0))), F.flatten(blocks))

    total = F.size(lines(text))
    kept = let(lines(text), lambda every: let(_worded(text), lambda worded: without(every, worded)))
    new = let(kept, lambda x: F.struct(total.cast("long").alias("n_lines"), (total - F.size(x)).cast("long").alias("n_removed"), F.array_join(x, "\n").alias("text")))
    same = F.struct(F.when(text.isNull(), 0).otherwise(total).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), text.alias("text"))
    out = joined.select("_doc", F.when(F.col("starts").isNull(), same).otherwise(new).alias("_new"))
    others = [c for c in names if c not in ("n_lines", "n_removed")]
    return out.select(*[(F.col("_new.text") if c == text_col else F.col("_doc")[c]).alias(c) for c in others], "_new.n_lines", "_new.n_removed")


#: DuckDB SQL for the rows of ``dedup_lines`` over ``documents`` with ids that differ.
SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), owned AS (
    SELECT doc_id, line, i, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded,
        sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l
), windows AS (
    SELECT doc_id, k, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM owned WHERE worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
    SELECT doc_id, k FROM windows WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) > 1
), gone AS (
    SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) AS t(d)
)
SELECT o.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.k) AS BIGINT) AS n_removed,
    coalesce(string_agg(o.line, chr(10) ORDER BY o.i) FILTER (WHERE g.k IS NULL), '') AS text
FROM owned o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.k = g.k GROUP BY o.doc_id
"""
