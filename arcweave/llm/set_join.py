"""Links between documents whose sets of word runs have a Jaccard similarity of a limit or more; no such link is lost.

1. All sets share one order of shingles, frequent ones last. Two sets of n and m
   shingles over the limit t have a shingle in common among the first
   n - ceil(t n) + 1 of the one and m - ceil(t m) + 1 of the other; these are
   the buckets. Any order gives the same links; this one keeps buckets small.
   Members of a bucket are sorted by size, and those whose neighbours' sizes
   rule a link out leave it.
2. The first candidates are the links of SimHash fingerprints, found with pivot
   distance tables, and in each bucket the neighbours by size. They are verified,
   and pairs within a component so found need no further look.
3. Then all others of a bucket meet. A pair is discarded only if it can't reach the
   limit: by its sizes, by the shingles left after the shared one, and by the
   parities of counts of shingles, at least half as many counts as shingles, which
   differ in no more places than the sets do.
4. What is left is verified on the sets themselves.
5. Buckets above ``MOST`` members are compared in blocks of chunks, all pairs of
   chunks; before that, buckets of shingles known to be frequent are in chunks.

A set is named by 64 bits of hash: of 10^9 different sets, two share a name with
probability 0.03.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.rows import maybe_among, only_among
from arcweave.llm.simhash import FEW, MOST, links, majority, mixed, shingle_hashes
from arcweave.operators.components import component_labels
from arcweave.plans.lineage import drop_materialized, materialize

#: Counts, at least, whose parities are compared.
PLACES = 1024
#: Shingles that are counted at once, and the count from which one is told as frequent.
PART, OFTEN = 1 << 20, 8
#: Frequent shingles that the order tells apart by their counts; others count as rare.
KNOWN = 50_000
#: Candidates of one set that a task verifies.
BLOCK = 256
#: Pairs whose sketches are compared at once.
AT_ONCE = 1 << 14


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    return np.unique(shingle_hashes(text or "", words))


def frequent(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that many documents have; only the order of shingles hangs on them."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(held: list[np.ndarray]) -> Iterator:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN].astype(np.int64))], names=["shingle", "n"])

        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(shingle_set(x.as_py(), words))
                size += len(held[-1])
                if size >= PART:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(KNOWN).toPandas()
    found = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], top["n"].to_numpy(dtype=np.int64)[order]


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall in each of a power of two places."""
    places = PLACES
    while 2 * places < len(shingles):
        places *= 2
    parity = np.bincount((mixed(shingles) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of several sizes; a larger one folds to the parities of half as many places."""

    def __init__(self, raw: list[bytes]) -> None:
        self.words = np.array([len(x) // 8 for x in raw], dtype=np.int64)
        self.at = np.zeros(len(raw), dtype=np.int64)
        self.held = {}
        for size in np.unique(self.words):
            own = np.flatnonzero(self.words == size)
            self.at[own] = np.arange(len(own))
            self.held[size] = np.frombuffer(b"".join(raw[k] for k in own), dtype="<u8").reshape(len(own), size)

    def _folded(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        out = self.held[size][self.at[rows]]
        while out.shape[1] > to:
            half = out.shape[1] // 2
            out = out[:, :half] ^ out[:, half:]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in which the sketches of each pair differ; at most the shingles in which the sets do."""
        out = np.zeros(len(a), dtype=np.int64)
        for x in self.held:
            for y in self.held:
                every = np.flatnonzero((self.words[a] == x) & (self.words[b] == y))
                for low in range(0, len(every), AT_ONCE):
                    part = every[low : low + AT_ONCE]
                    out[part] = np.bitwise_count(self._folded(a[part], x, min(x, y)) ^ self._folded(b[part], y, min(x, y))).sum(axis=1, dtype=np.int64)
        return out


def _profiles(others: int, words: int, limit: Fraction, known: np.ndarray, counts: np.ndarray) -> Callable[[Iterator], Iterator]:
    """Rows with vertex, print, size, sketch and prefix instead of the text, which is the last column."""

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vertex, prints, size, sketches, prefix = [], [], [], [], []
            for x in batch.column(others):
                s = shingle_set(x.as_py(), words)
                n = len(s)
                vertex.append(xxhash.xxh64_intdigest(s.tobytes()))
                prints.append(majority(s))
                size.append(n)
                sketches.append(sketch(s))
                at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                often = np.where(known[at] == s, counts[at], 0) if len(known) else np.zeros(n, dtype=np.int64)
                first = n - -(-limit.numerator * n // limit.denominator) + 1 if n else 0
                prefix.append(s[np.lexsort((s, often))[:first]].view(np.int64))
            names = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (vertex, prints)]
            columns = [*names, pa.array(size, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:others], *columns], names=[*batch.schema.names[:others], "vertex", "print", "size", "sketch", "prefix"])

    return compute


def _by_bucket(work: Callable[[dict[str, np.ndarray]], Iterator], names: tuple[str, ...]) -> Callable[[Iterator], Iterator]:
    """Runs ``work`` on whole buckets; rows are sorted by bucket, and ``chunk`` if they have it."""

    def run(batches: Iterator) -> Iterator:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {}
            for name in names:
                column = batch.column(batch.schema.get_field_index(name))
                if name == "sketch":
                    new[name] = np.empty(batch.num_rows, dtype=object)
                    new[name][:] = column.to_pylist()
                else:
                    new[name] = column.to_numpy(zero_copy_only=False)
            held = {k: np.concatenate([held[k], v]) for k, v in new.items()} if held else new
            last = held["bucket"] == held["bucket"][-1]
            if "chunk" in held:
                last &= held["chunk"] == held["chunk"][-1]
            done = int(np.argmax(last))  # the last bucket may go on
            if done:
                yield from work({k: v[:done] for k, v in held.items()})
                held = {k: v[done:] for k, v in held.items()}
        if held:
            yield from work(held)

    return run


def _sizes(rows: dict[str, np.ndarray]) -> np.ndarray:
    return rows["place"] >> 32


def _next(rows: dict[str, np.ndarray], limit: Fraction) -> np.ndarray:
    """Whether the row after each is in its bucket and, by the sizes, may be linked to it; one shorter than the rows."""
    bucket, size = rows["bucket"], _sizes(rows)
    same = bucket[1:] == bucket[:-1]
    if "chunk" in rows:
        same &= rows["chunk"][1:] == rows["chunk"][:-1]
    return same & (limit.denominator * size[:-1] >= limit.numerator * size[1:])


def _shared(limit: Fraction) -> Callable[[dict[str, np.ndarray]], Iterator]:
    """Members with a neighbour, by size, that may be linked to them."""

    def work(rows: dict[str, np.ndarray]) -> Iterator:
        import pyarrow as pa

        near = _next(rows, limit)
        keep = np.r_[near, False] | np.r_[False, near]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[x][keep]) for x in ENTRY], names=list(ENTRY))

    return work


ENTRY = ("bucket", "chunk", "vertex", "place")


def _told(u: np.ndarray, v: np.ndarray) -> Iterator:
    import pyarrow as pa

    u, v = np.minimum(u, v), np.maximum(u, v)
    if (u != v).any():
        both = np.unique(np.stack([u, v], axis=1)[u != v], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])


def _some(limit: Fraction) -> Callable[[dict[str, np.ndarray]], Iterator]:
    """Pairs (u, v), u < v, of each member of a bucket with the one before it by size, and with the first of such a run."""

    def work(rows: dict[str, np.ndarray]) -> Iterator:
        near, vertex = _next(rows, limit), rows["vertex"]
        opens = np.r_[True, ~near]
        first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        place = np.flatnonzero(~opens)
        yield from _told(np.r_[vertex[first[place]], vertex[place - 1]], np.r_[vertex[place], vertex[place]])

    return work


def _possible(rows: dict[str, np.ndarray], sketches: Sketches, a: np.ndarray, b: np.ndarray, limit: Fraction) -> np.ndarray:
    """Which of the pairs (a, b), of one bucket each, can reach the limit; one that does passes in the bucket of its first common shingle."""
    t, d = limit.numerator, limit.denominator
    keep = np.arange(max(len(a), len(b)))
    a, b = np.broadcast_arrays(a, b)
    size, pos = _sizes(rows), rows["place"] & 0xFFFFFFFF
    need = -(-t * (size[a] + size[b]) // (t + d))
    keep = keep[(np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need) & (rows["component"][a] != rows["component"][b])]
    a, b, need = a[keep], b[keep], need[keep]
    return keep[sketches.apart(a, b) <= size[a] + size[b] - 2 * need]


def _every(limit: Fraction) -> Callable[[dict[str, np.ndarray]], Iterator]:
    """Pairs (u, v), u < v, of all members of a bucket that can reach the limit."""

    def work(rows: dict[str, np.ndarray]) -> Iterator:
        bucket, size = rows["bucket"], _sizes(rows)
        sketches = Sketches(list(rows["sketch"]))
        n = len(bucket)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, n])
        out = []

        def test(a: np.ndarray, b: np.ndarray) -> None:
            hit = _possible(rows, sketches, a, b, limit)
            a, b = (x[hit] for x in np.broadcast_arrays(a, b))
            out.append((rows["vertex"][a], rows["vertex"][b]))

        place = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
        for step in range(1, min(FEW, int(sizes.max(initial=1)))):
            place = place[place + step < n]
            place = place[(bucket[place] == bucket[place + step]) & (limit.denominator * size[place] >= limit.numerator * size[place + step])]
            if not len(place):
                break
            test(place, place + step)
        for start, count in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
            own = size[start : start + count]
            ends = start + np.searchsorted(own, own * limit.denominator // limit.numerator, "right")
            for i in range(start, start + count - 1):
                if ends[i - start] > i + 1:
                    test(np.array([i]), np.arange(i + 1, ends[i - start]))
        if out:
            yield from _told(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return work


def _near(pairs: DataFrame, vertices: DataFrame, limit: Fraction) -> DataFrame:
    """The ``pairs`` that can reach the limit by their sizes and sketches."""
    t, d = limit.numerator, limit.denominator
    side = lambda x: vertices.select(F.col("vertex").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    rows = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            sketches = Sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist())
            x, y = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            need = -(-t * (x + y) // (t + d))
            kept = (np.minimum(x, y) >= need) & (sketches.apart(np.arange(n), np.arange(n, 2 * n)) <= x + y - 2 * need)
            yield batch.select([0, 1]).filter(pa.array(kept))

    return rows.mapInArrow(keep, "u long, v long")


def similar(x: np.ndarray, y: np.ndarray, limit: Fraction) -> bool:
    common = len(x) + len(y) - len(np.union1d(x, y))
    return limit.denominator * common >= limit.numerator * (len(x) + len(y) - common)


def verified(pairs: DataFrame, keys: DataFrame, docs: DataFrame, words: int, limit: Fraction) -> DataFrame:
    """The ``pairs`` whose sets reach the limit; sets are made again from the texts of these documents only, which ``keys`` names.

    A set with many candidates is repeated for each ``BLOCK`` of them.
    """
    wanted = pairs.select(F.col("u").alias("vertex")).union(pairs.select("v")).distinct()
    key = materialize(keys.join(wanted, "vertex", "left_semi").select("vertex", "k._a", "k._b"), "keys")
    texts = only_among(docs.select("_a", "_b", F.col("_text").cast("string").alias("_text")), key).select("vertex", "_text")

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())], names=["vertex", "shingles"])

    sets = materialize(texts.mapInArrow(compute, "vertex long, shingles binary"), "sets")
    blocks = materialize(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k")), "blocks")
    other = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64("v"), "_k").cast("int").alias("block"), "v").join(sets, F.col("v") == F.col("vertex")).select("u", "block", "v", "shingles")
    own = sets.join(blocks, F.col("vertex") == F.col("u")).select("u", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("block"), F.lit(None).cast("long").alias("v"), "shingles")

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mine = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for u, v, s in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                shingles = np.frombuffer(s, dtype=np.uint64)
                if v is None:
                    mine = shingles
                elif similar(mine, shingles, limit):
                    out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["u", "v"])

    rows = own.union(other).repartition("u", "block").sortWithinPartitions("u", "block", F.col("v").asc_nulls_first())
    found = materialize(rows.mapInArrow(check, "u long, v long"), "links")
    drop_materialized(sets)
    return found


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` of buckets with more than one component; large buckets as blocks, one for each pair of chunks."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l < _h")
    # written, so that the join has two plain exchanges and a large bucket can be split
    open_ = materialize(members.join(materialize(sizes.select("bucket", "_n"), "buckets"), "bucket"), "open")
    few = open_.where(F.col("_n") <= MOST)
    chunks = F.ceil(F.col("_n") / MOST).cast("int")
    many = open_.where(F.col("_n") > MOST).select("*", F.pmod(F.xxhash64("vertex"), chunks).cast("int").alias("_a"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_b"))
    many = many.withColumn("bucket", F.xxhash64("bucket", F.least("_a", "_b"), F.greatest("_a", "_b")))
    return few.select(*members.columns).union(many.select(*members.columns))


def _print_pairs(vertices: DataFrame) -> DataFrame:
    """(u, v): sets of one fingerprint with the first of them, and the first ones of fingerprints that SimHash links."""
    first = materialize(vertices.groupBy("print").agg(F.min("vertex").alias("first"), F.count(F.lit(1)).alias("_n")), "prints")
    equal = vertices.join(first.where("_n > 1"), "print").where("vertex <> first").select(F.col("first").alias("u"), F.col("vertex").alias("v"))
    of = lambda x: first.select(F.col("print").alias(x), F.col("first").alias(f"_{x}"))
    linked = links(first.select("print"), 4).join(of("u"), "u").join(of("v"), "v").select("_u", "_v")
    both = equal.union(linked)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (with _a, _b, _text) without the text, with ``_group``: the component of links at ``similarity`` or more."""
    limit = Fraction(str(similarity))
    known, counts = frequent(docs, words, "_text")
    others = [c for c in docs.columns if c != "_text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    made = docs.select(*others, F.col("_text").cast("string")).mapInArrow(_profiles(len(others), words, limit, known, counts), f"{kinds}, vertex long, print long, size long, sketch binary, prefix array<long>")
    made = materialize(made, "prefixes")
    profiles = materialize(made.select(*others, "vertex"), "profiles")
    # equal sets are one vertex; few rows move, as most sets are alone
    keys = materialize(profiles.groupBy("vertex").agg(F.min(F.struct("_a", "_b")).alias("k"), F.count(F.lit(1)).alias("_n")), "keys")
    marked = maybe_among(made.select("vertex", "print", "size", "sketch", "prefix"), keys.where("_n > 1"), "vertex")
    once = marked.where("_maybe").groupBy("vertex").agg(*[F.first(c).alias(c) for c in ("print", "size", "sketch", "prefix")])
    sets = marked.where("not _maybe").drop("_maybe").unionByName(once)
    vertices = materialize(sets.drop("prefix"), "vertices")
    hot = docs.sparkSession.createDataFrame([(int(b), -(-int(n) // MOST)) for b, n in zip(known.view(np.int64), counts, strict=True) if n > MOST], "bucket long, _k int")  # at most KNOWN rows
    place: Column = F.shiftleft("size", 32).bitwiseOR(F.col("pos").cast("long"))
    entries = sets.select("vertex", "size", F.posexplode("prefix").alias("pos", "bucket")).join(F.broadcast(hot), "bucket", "left")
    entries = entries.select("bucket", F.coalesce(F.pmod(F.xxhash64("vertex", "bucket"), "_k"), F.lit(0)).cast("int").alias("chunk"), "vertex", place.alias("place"))
    sorted_ = lambda rows, *by: rows.repartition(*by).sortWithinPartitions(*by, "place", "vertex")
    schema = "bucket long, chunk int, vertex long, place long"
    shared = materialize(sorted_(entries, "bucket", "chunk").mapInArrow(_by_bucket(_shared(limit), ENTRY), schema), "shared")
    drop_materialized(made)
    some = materialize(sorted_(shared, "bucket", "chunk").mapInArrow(_by_bucket(_some(limit), ENTRY), "u long, v long").distinct(), "pairs")
    # of each kind one for a document here; whatever this leaves in different components meets below
    first = [materialize(_near(pairs, vertices, limit).groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "near") for pairs in (materialize(_print_pairs(vertices), "prints"), some)]
    found = verified(materialize(first[0].union(first[1]).distinct(), "near"), keys, docs, words, limit)
    labels = materialize(component_labels(found), "labels")
    told = shared.join(labels.withColumnRenamed("id", "vertex"), "vertex", "left").select("bucket", "vertex", "place", F.coalesce("component", "vertex").alias("component"))
    rest = sorted_(_blocks(told).join(vertices.select("vertex", "sketch"), "vertex"), "bucket").select("bucket", "vertex", "place", "component", "sketch")
    rest = rest.mapInArrow(_by_bucket(_every(limit), ("bucket", "vertex", "place", "component", "sketch")), "u long, v long")
    found = found.union(verified(materialize(rest.distinct(), "pairs"), keys, docs, words, limit))
    labels = component_labels(found).withColumnRenamed("id", "vertex")
    return profiles.join(labels, "vertex", "left").select(*others, F.coalesce("component", "vertex").alias("_group"))
