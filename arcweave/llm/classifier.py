"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A document is a sparse vector: hashed words with damped, length-normalised
counts, and dense statistics of its structure and size. The score is
``sigmoid(w0 + w.x + sum over pairs <v_i, v_j> x_i x_j)``; the pairwise part is
taken in linear time as half of ``|sum v_i x_i|^2 - sum |v_i x_i|^2``.

The machine is fitted on the driver by mini-batch Adagrad to at most
``max_rows`` labelled rows whose vectors have ``max_entries`` entries together (documented
bounds; the rows with the smallest id hashes), and applied to every whole text. Labels, language, source and id are
never features. Rows with ``crc32(id as text) mod 5 = 0`` are never learned from.

Defined results: a null text is an empty one; empty texts are scored by their
statistics; without labelled rows, or with one class alone, the score is the
smoothed share of good labels; a label of null is no label; several labels of one
id are several rows to learn from, equal rows of texts one; repeated rows give repeated rows; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.plans.lineage import drop_materialized, materialize

BUCKETS = 1 << 16
RANK = 8
REMEMBERED = 400_000
HELD_OUT = 5
STATISTICS = (
    "log_words log_chars word_length distinct_words repeated_neighbours repeated_windows repeated_lines log_lines line_length "
    "capitals digits symbols marks bars exclamations non_ascii ended_lines short_words long_words function_words empty"
).split()
SIZE = BUCKETS + len(STATISTICS)
# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset("the of and to in is that for it with was on as are be this from at by an de la le les des et un une du que en est pour dans qui sur par au pas der die und das den von zu mit sich auf ist im dem nicht ein eine als auch el los las una por con del se no es al lo como más".split())
ENDED = re.compile(r"[.!?…:;][\"'»”)]?\s*$")


class Words(dict):
    """Bucket of a word, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        if len(word) <= 64:
            self[word] = bucket
        return bucket


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's vector; statistics come last."""
    found = text.split()
    n, chars = len(found), len(text)
    ids = np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=n)
    index, counts = np.unique(ids, return_counts=True)
    value = np.log1p(counts).astype(np.float32)
    value /= max(1e-6, float(np.sqrt((value * value).sum())))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    size, each = max(1, n), max(1, chars)
    if n >= 4:
        windows = ids[:-3] * 1_000_003 + ids[1:-2] * 10_007 + ids[2:-1] * 101 + ids[3:]
        repeated = 1 - len(np.unique(windows)) / len(windows)
    else:
        repeated = 0.0
    lengths = [len(w) for w in found]
    stats = (
        np.log1p(n) / 5, np.log1p(chars) / 8, chars / size / 8, len(index) / size, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, repeated,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 3, min(5.0, chars / max(1, len(lines)) / 300),
        3 * raw[65:91].sum() / each, 3 * raw[48:58].sum() / each, 5 * sum(raw[ord(c)] for c in "#*$%&<>") / size, sum(raw[ord(c)] for c in ".,;:") / size, 3 * raw[ord("|")] / size, 3 * raw[ord("!")] / size,
        raw[128:].sum() / each, sum(1 for x in lines if ENDED.search(x)) / max(1, len(lines)), sum(1 for k in lengths if k <= 3) / size, sum(1 for k in lengths if k >= 15) / size,
        3 * sum(1 for w in found if w.lower() in FUNCTION_WORDS) / size, float(n == 0),
    )
    dense = np.array(stats, dtype=np.float32)
    return np.concatenate([index, np.arange(BUCKETS, SIZE)]), np.concatenate([value, dense])


@dataclass
class Machine:
    """Parameters of a fitted factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of a good label for each row."""
        if not rows:
            return np.zeros(0)
        index, value, starts = stacked(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, starts)[0], -30, 30)))

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of factors of each row."""
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One index and one value array for all rows, and where each row starts."""
    sizes = [len(i) for i, _ in rows]
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.2, decay: float = 1e-5, seed: int = 0) -> Machine:
    """Adagrad on the logistic loss."""
    good = (labels.sum() + 1) / (len(labels) + 2)
    draw = np.random.default_rng(seed)
    machine = Machine(float(np.log(good / (1 - good))), np.zeros(SIZE), draw.normal(0, 0.02, (SIZE, RANK)))
    if not len(labels) or labels.min() == labels.max():
        machine.factors[:] = 0
        return machine
    g_bias, g_linear, g_factors = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for low in range(0, len(rows), batch):
            chosen = order[low : low + batch]
            index, value, starts = stacked([rows[k] for k in chosen])
            raw, sums = machine.raw(index, value, starts)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            sizes = np.diff(np.append(starts, len(index)))
            each = np.repeat(slope, sizes) * value
            used, place = np.unique(index, return_inverse=True)
            d_linear = np.bincount(place, weights=each) + decay * machine.linear[used]
            pair = each[:, None] * (np.repeat(sums, sizes, axis=0) - machine.factors[index] * value[:, None])
            d_factors = np.stack([np.bincount(place, weights=pair[:, k]) for k in range(RANK)], axis=1) + decay * machine.factors[used]
            d_bias = float(slope.sum())
            g_bias += d_bias**2
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            machine.bias -= rate * d_bias / g_bias**0.5
            machine.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            machine.factors[used] -= 0.3 * rate * d_factors / np.sqrt(g_factors[used])
    return Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_entries: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Fits the machine to at most ``max_rows`` labelled rows outside the held-out fold, and ``max_entries`` entries of vectors, 8 bytes each."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # the smallest hashes of the ids: a sample of at most max_rows rows, whatever the table's size
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(marks), "doc_id")

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            rows = [features(x.as_py() or "", words) for x in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "index", "value"])

    made = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(vectors, "doc_id long, label int, index binary, value binary")
    keys = [F.xxhash64("doc_id").alias("hash"), F.col("doc_id"), F.col("label"), F.md5(F.concat("index", "value")).alias("digest")]
    made = materialize(made.select(F.struct(*keys).alias("key"), F.octet_length("value").alias("bytes"), "index", "value"), "vectors")
    # sizes come first, so that the driver asks for no more vectors than it can hold
    sizes = made.groupBy("key").agg(F.first("bytes").alias("bytes")).orderBy("key").limit(max_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["bytes"] // 4
        if total > max_entries:
            break
        last = r["key"]
    chosen = made.where(F.col("key") <= F.struct(*[F.lit(x).alias(n) for n, x in last.asDict().items()])) if last else made.limit(0)
    rows = chosen.groupBy("key").agg(F.first("index").alias("index"), F.first("value").alias("value")).select("key.doc_id", "key.label", "index", "value").collect()
    drop_materialized(made)
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["value"]))
    return fit([(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4")) for r in rows], np.array([r["label"] for r in rows], dtype=float))


def score(docs: DataFrame, machine: Machine, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by BUCKETS and RANK

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            out = []
            rows: list[tuple[np.ndarray, np.ndarray]] = []
            for text in batch.column(1):
                rows.append(features(text.as_py() or "", words))
                if len(rows) >= 256:
                    out.append(shared.value.score(rows))
                    rows = []
            out.append(shared.value.score(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).astype(float), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, limit: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """Trains on the labelled rows and scores every document."""
    return score(docs, train(docs, labels, max_rows), limit)
