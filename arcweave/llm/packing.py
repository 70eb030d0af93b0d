"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document becomes its token ids and a closing id 0. Documents of more than
``capacity`` ids are cut into pieces of ``capacity`` (the first may be shorter).
Pieces are then packed by length patterns:

1. the histogram of piece lengths is counted (at most ``capacity`` rows),
2. few-document patterns that fill a sequence exactly are enumerated: all pairs,
   and triples, at first some for each longest length, then those that the
   residual of the fit asks for,
3. non-negative least squares fits a repeat count for each pattern to the
   histogram, and the whole parts of the counts are taken as far as the histogram
   holds the pieces,
4. remainders are rounded in two ways: the largest first as far as pieces are left,
   and longest piece first, each in its pattern of largest remainder; what has no
   pattern is packed best-fit, and of the two plans the shorter is kept,
5. pieces of one length are numbered across partitions, and ranges of these
   numbers are dealt to the slots of the patterns.

Steps 2 to 4 see the histogram alone, so their cost doesn't grow with the rows.
The plan has at most a few slots a pattern and is the only thing broadcast.

Defined results: a null text is an empty one; an empty text is the single id 0;
the text of a special token is that token, as the tokenizer has it; a very long
text is encoded in parts, cut where no token can span; an empty table gives an
empty table; repeated rows are packed once each; an id that is no number is null
in the result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.plans.lineage import materialize

CAPACITY = 2048

# The split pattern of the byte-level tokenizer file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts made of these characters alone take the rank-based encoder; others the tokenizer itself.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞]*")

#: Triples enumerated for each longest length before the fit asks for more; rounds of asking; counts taken for nothing.
PARTNERS = 12
ASKED = 6
LEAST = 1e-3

#: A piece that leaves no more than this share of a sequence is taken before any pair.
CLOSE = 0.05

#: A text is encoded in parts of about so many characters, cut where a token can't span.
PART = 1_000_000
CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of a text as the tokenizer of a byte-level BPE file gives them, without special tokens."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        to_byte = _byte_of_char()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _part(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text, then id 0."""
        out, at = [], 0
        while len(text) - at > PART and (m := CUT.search(text, at + PART)):
            out.append(np.array(self._part(text[at : m.start()]), dtype="<u4"))
            at = m.start()
        out += [np.array(self._part(text[at:] if at else text), dtype="<u4"), np.zeros(1, dtype="<u4")]
        return np.concatenate(out)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: list[int], capacity: int) -> np.ndarray:
    """Patterns of two or three lengths that fill a sequence exactly; a row each, 0 for no third.

    All pairs are taken; of the triples, ``PARTNERS`` for each longest length.
    """
    have = set(lengths)
    pairs = [(a, capacity - a, 0) for a in lengths if a >= capacity - a and capacity - a in have]
    triples = []
    for a in lengths:
        room = capacity - a
        fits = [b for b in lengths if room - b in have and room - b <= b <= a]
        triples += [(a, b, room - b) for b in fits[:: max(1, -(-len(fits) // PARTNERS))]]
    return np.array(pairs + triples, dtype=np.int64).reshape(-1, 3)


def asked(lengths: np.ndarray, residual: np.ndarray, known: set[tuple[int, ...]], capacity: int) -> list[tuple[int, ...]]:
    """For each longest length the triple with the largest residual, if it is above 0 and new: a column that improves the fit."""
    out = []
    here = np.zeros(capacity + 1, dtype=bool)
    here[lengths] = True
    for a in lengths.tolist():
        b = lengths[(lengths <= a) & (2 * lengths >= capacity - a) & (lengths < capacity - a)]
        b = b[here[capacity - a - b]]
        if len(b):
            price = residual[a] + residual[b] + residual[capacity - a - b]
            k = int(np.argmax(price))
            row = (a, int(b[k]), capacity - a - int(b[k]))
            if price[k] > LEAST and row not in known:
                out.append(row)
    return out


def fit(table: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, rounds: int = 800) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - counts|^2, by accelerated projected gradient.

    ``counts`` is indexed by length; slot 0 stands for an absent third document.
    """
    if not len(table):
        return np.zeros(0)
    size, used = len(counts), table > 0
    target = counts.astype(float)
    target[0] = 0.0
    columns = np.bincount(table[used], minlength=size)
    step = 1.0 / (3.0 * max(1, columns.max()))
    x = np.zeros(len(table))
    if start is not None:
        x[: len(start)] = start
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        made = np.bincount(table.ravel(), weights=np.repeat(y, 3), minlength=size)
        made[0] = 0.0
        slope = (made - target)[table].sum(axis=1)
        new = np.maximum(0.0, y - step * slope)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); uses every piece of the histogram once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    table = patterns(lengths.tolist(), capacity)
    repeats = fit(table, left)
    for _ in range(ASKED):
        made = np.bincount(table.ravel(), weights=np.repeat(repeats, 3), minlength=len(left))
        new = asked(lengths, left - made, set(map(tuple, table.tolist())), capacity)
        if not new:
            break
        table = np.concatenate([table, np.array(new, dtype=np.int64)])
        repeats = fit(table, left, repeats)
    times = np.zeros(len(table), dtype=np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        times[j] = _take(left, _row(table[j]), int(repeats[j]))
    out += [(_row(table[j]), int(times[j])) for j in np.flatnonzero(times)]
    part = repeats - np.floor(repeats)
    order = [_row(table[j]) for j in np.argsort(-part, kind="stable") if part[j] > LEAST]
    # the largest remainders first
    now, ends = left.copy(), []
    for row in order:
        if _take(now, row, 1):
            ends.append((row, 1))
    ends += _best_fit(now, capacity)
    # the longest pieces first
    fitted: dict[int, list[tuple[int, ...]]] = {}
    for row in order:
        fitted.setdefault(row[0], []).append(row)
    return out + min(ends, _best_fit(left, capacity, fitted), key=lambda x: sum(n for _, n in x))


def _row(pattern: np.ndarray) -> tuple[int, ...]:
    return tuple(int(n) for n in pattern if n)


def _take(left: np.ndarray, row: tuple[int, ...], most: int) -> int:
    """Fills a pattern up to ``most`` times from the pieces that are left."""
    times = min(most, *(int(left[n]) // row.count(n) for n in row))
    for n in row:
        left[n] -= times
    return times


def _best_fit(left: np.ndarray, capacity: int, fitted: dict[int, list[tuple[int, ...]]] | None = None) -> list[tuple[tuple[int, ...], int]]:
    """The longest piece first, in one of its ``fitted`` patterns, each once; else with one that all but fills its room, else two that fill it exactly, else the longest that fits."""
    out = []
    sizes = [int(n) for n in np.flatnonzero(left)]
    while sizes:
        own = (fitted or {}).get(sizes[-1])
        if own:
            row = own.pop(0)
            if _take(left, row, 1):
                out.append((row, 1))
                for n in set(row):
                    if not left[n]:
                        sizes.remove(n)
            continue
        row, room = [sizes[-1]], capacity - sizes[-1]
        free = {sizes[-1]: int(left[sizes[-1]]) - 1}
        has = lambda n: free.get(n, int(left[n]) if n > 0 else 0) > 0

        def take(n: int) -> None:
            row.append(n)
            free[n] = free.get(n, int(left[n])) - 1

        while room and sizes[0] <= room:
            if has(room):
                take(room)
                break
            upper = bisect_right(sizes, room)
            single = next((a for a in reversed(sizes[:upper]) if has(a)), None)
            if single and room - single <= CLOSE * capacity:
                take(single)
                room -= single
                continue
            pair = next((a for a in reversed(sizes[:upper]) if 2 * a >= room and has(a) and has(room - a) and (2 * a != room or free.get(a, int(left[a])) > 1)), None)
            if pair:
                take(pair)
                take(room - pair)
                break
            if not single:
                break
            take(single)
            room -= single
        times = min(int(left[n]) // row.count(n) for n in set(row))
        out.append((tuple(row), times))
        for n in row:
            left[n] -= times
        for n in set(row):
            if not left[n]:
                sizes.remove(n)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``."""
    spark = pieces.sparkSession
    kept = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    kept = kept.withColumn("_part", F.shiftright("_row", 33))
    by_part = kept.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    slots, base, dealt = [], 0, {}
    for row, times in plan({r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("_n")).collect()}, capacity):
        at = 0
        for n in row:
            low = dealt.get(n, 0)
            dealt[n] = low + times
            slots.append((n, low, low + times, base, at))
            at += n
        base += times
    slots = spark.createDataFrame(slots, "length long, _low long, _high long, _base long, offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = by_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row"))
    ranked = kept.withColumn("_rank", rank - 1).join(start, ["length", "_part"]).withColumn("_rank", F.col("_start") + F.col("_rank"))
    # the plan's size is bounded by the capacity, whatever the number of pieces
    placed = ranked.join(F.broadcast(slots), "length").where("_rank >= _low and _rank < _high")
    return placed.select(*pieces.columns, (F.col("_base") + F.col("_rank") - F.col("_low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
