"""SimHash near-duplicates with pivot distance tables.

A fingerprint has one bit for each bit of the shingle hashes: 1 if it is set in
over half of them. Documents link if their fingerprints differ in at most
``max_distance`` bits, and groups are the connected components of the links.

Search, without ever meeting all pairs:

1. Equal fingerprints are one vertex, named by the fingerprint itself; the
   smallest id stands for it.
2. Tables bring together fingerprints that agree on some of their bits: blocks
   of the bits, one more than can differ, so no link is lost.
3. Within a bucket a pivot table is computed, the Hamming distances to fixed
   reference fingerprints; by the triangle inequality a pair whose coordinates
   differ by more than ``max_distance`` anywhere is discarded, and the rest are
   verified on all bits. A member that is linked leaves the search, so a dense
   bucket costs about its size and gives a tree of links, not all pairs.
4. Buckets above ``MOST`` members are dealt out again by further bits, then by
   cells of their pivot distances, each member into two cells a pivot; what is
   still too large is compared in blocks of chunks, all pairs of chunks, so no
   bucket is dropped and no task holds more than two chunks.
5. Components come from star contraction in the cluster.

Defined results: null and empty texts have fingerprint zero and link like any
other; with fewer words than a shingle has, the whole sequence is one shingle;
repeated shingles count each time; bits set in exactly half are 0; a very long
text is hashed whole, its bits counted ``PART`` shingles at a time; repeated rows
are rows of one group; a null id is never a group's smallest unless all are
null; an empty table gives an empty table; further columns stay, but for those
named print, fingerprint or component_id, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.rows import drop_rows, row_key
from arcweave.operators.components import component_labels
from arcweave.plans.lineage import materialize

SEED = 42
BITS = 64
PIVOTS = 16
#: Members of a bucket that one task compares.
MOST = 2048
#: Up to so many members, a bucket's pairs are compared at once.
FEW = 48
#: Pivots whose distances deal a large bucket out.
CELLS = 4
#: Shingles whose bits are counted at once.
PART = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = 0x9E3779B97F4A7C15

Tables = tuple[tuple[int, ...], ...]


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-mixed function of 64-bit hashes (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lowered."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    hash_ = xxhash.xxh64_intdigest
    last = ends[min(words, len(ends)) - 1 :]
    return np.fromiter((hash_(joined[a:b], SEED) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last))  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    counts = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), PART):
        counts += np.unpackbits(hashes[low : low + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    return majority(shingle_hashes(text or "", words))


def fingerprints(docs: DataFrame, words: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and ``print``: the fingerprint's bits as a long."""
    others = [c for c in docs.columns if c != text_col]

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(len(others))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(prints.view(np.int64))], names=[*others, "print"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").cast("string")).mapInArrow(compute, f"{kinds}print long")


def exact_tables(max_distance: int, rows: int) -> Tables:
    """Bit positions of each table: all ways to keep blocks of which ``max_distance`` may differ; more, finer blocks for more rows."""
    blocks = max_distance + 1
    while blocks < max_distance + 4 and rows >> (BITS * (blocks - max_distance) // blocks) > MOST // 4:
        blocks += 1
    cut = [tuple(range(BITS * k // blocks, BITS * (k + 1) // blocks)) for k in range(blocks)]
    return tuple(sum(keep, ()) for keep in combinations(cut, blocks - max_distance))


def _buckets(prints: np.ndarray, tables: Tables) -> np.ndarray:
    """A 64-bit bucket for each fingerprint and table."""
    out = np.empty((len(prints), len(tables)), dtype=np.uint64)
    for t, positions in enumerate(tables):
        out[:, t] = mixed(mixed(prints & np.uint64(sum(1 << p for p in positions))) + np.uint64((t + 1) * MIX % (1 << 64)))
    return out


def _pivots(n: int = PIVOTS) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(MIX))


def _cells(prints: np.ndarray, max_distance: int) -> np.ndarray:
    """Buckets by the distances to ``CELLS`` pivots: two neighbouring cells a pivot, one of which any link shares."""
    out = np.zeros((len(prints), 1), dtype=np.uint64)
    for pivot in _pivots(CELLS):
        cell = np.bitwise_count(prints ^ pivot).astype(np.uint64) // np.uint64(max_distance + 1)
        out = np.concatenate([mixed(out * np.uint64(MIX) + (cell + np.uint64(k))[:, None] + np.uint64(1)) for k in (0, 1)], axis=1)
    return out


def _dealt(deal: Callable[[np.ndarray], np.ndarray], salted: bool) -> Callable[[Iterator], Iterator]:
    """Rows (bucket, print) from (print), or from such rows, whose bucket is then a salt."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                prints = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = deal(prints)
                if salted:
                    keys = mixed(keys + mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(prints, keys.shape[1]).view(np.int64))], names=["bucket", "print"])

    return run


def _close(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_distance: int) -> np.ndarray:
    """Which of the pairs (a, b) are links: coordinate by coordinate, then on all bits."""
    keep = np.arange(max(len(a), len(b)))
    a, b = np.broadcast_arrays(a, b)
    for pivot in range(table.shape[1]):
        if len(keep) < 64 and pivot:
            break
        keep = keep[np.abs(table[a[keep], pivot] - table[b[keep], pivot]) <= max_distance]
    return keep[np.bitwise_count(prints[a[keep]] ^ prints[b[keep]]) <= max_distance]


def link_buckets(bucket: np.ndarray, prints: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, each a link, that connect within each bucket what its links connect; rows are sorted by bucket."""
    n = len(bucket)
    table = np.stack([np.bitwise_count(prints ^ p).astype(np.int16) for p in _pivots()], axis=1)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    out = []
    few = np.repeat(sizes <= FEW, sizes)
    place = np.flatnonzero(few)
    for step in range(1, min(FEW, int(sizes.max(initial=1)))):
        place = place[place + step < n]
        place = place[bucket[place] == bucket[place + step]]
        if not len(place):
            break
        hit = _close(prints, table, place, place + step, max_distance)
        out.append((place[hit], place[hit] + step))
    for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        open_ = np.arange(start, start + size)
        while len(open_):
            queue, open_ = [open_[0]], open_[1:]
            while queue and len(open_):
                at = queue.pop()
                hit = _close(prints, table, np.array([at]), open_, max_distance)
                if len(hit):
                    queue += open_[hit].tolist()
                    out.append((np.full(len(hit), at), open_[hit]))
                    open_ = np.delete(open_, hit)
    return out


def _linked(max_distance: int) -> Callable[[Iterator], Iterator]:
    """Links (u, v) from rows (bucket, print) that are sorted by bucket and print."""

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

        def found(bucket: np.ndarray, prints: np.ndarray) -> Iterator:
            pairs = link_buckets(bucket, prints.view(np.uint64), max_distance) if len(bucket) else []
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = tuple(np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held))
            done = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            yield from found(*(x[:done] for x in held))
            held = tuple(x[done:] for x in held)
        yield from found(*held)

    return link


def links(prints: DataFrame, max_distance: int) -> DataFrame:
    """(u, v): pairs of fingerprints, each a link, whose components are those of all links; ``prints`` has distinct prints."""
    schema = "bucket long, print long"
    tables = exact_tables(max_distance, prints.count())
    again = tuple(tuple(range(k, BITS, max_distance + 1)) for k in range(max_distance + 1))
    dealers = [lambda x: _buckets(x, again), lambda x: _cells(x, max_distance)]
    rows = prints.select("print").mapInArrow(_dealt(lambda x: _buckets(x, tables), False), schema)
    ready = []
    while True:
        # only bucket names and counts are shuffled
        large = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST), "large")
        if large.isEmpty():
            ready.append(rows)
            break
        marked = rows.join(large, "bucket", "left")
        ready.append(marked.where("_n is null").select("bucket", "print"))
        marked = marked.where("_n is not null")
        if not dealers:
            # what is still large: chunks, and every pair of chunks a bucket of its own
            chunks = F.ceil(F.col("_n") / MOST).cast("int")
            chunk = F.pmod(F.xxhash64("print"), chunks).cast("int")
            blocks = marked.select("*", chunk.alias("_a"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_b"))
            ready.append(blocks.select(F.xxhash64("bucket", F.least("_a", "_b"), F.greatest("_a", "_b")).alias("bucket"), "print"))
            break
        rows = marked.select("bucket", "print").mapInArrow(_dealt(dealers.pop(0), True), schema)
    every = ready[0]
    for more in ready[1:]:
        every = every.union(more)
    return every.repartition("bucket").sortWithinPartitions("bucket", "print").mapInArrow(_linked(max_distance), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (hexadecimal) and ``component_id``."""
    docs = docs.drop("print", "fingerprint", "component_id")
    rows = materialize(fingerprints(docs, words, text_col), "prints")
    vertices = materialize(rows.groupBy("print").agg(F.min(id_col).alias("least")), "vertices")
    labels = component_labels(links(vertices, max_distance)).withColumnRenamed("id", "print")
    grouped = materialize(vertices.join(labels, "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")), "labels")
    # written, so that the join below has two plain exchanges and a large component can be split
    smallest = materialize(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "groups")
    known = grouped.join(smallest, "component").select("print", "component_id")
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(known, "print").select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], shown.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id.

    Documents link if the Jaccard similarity of their sets of runs of ``words`` words
    is ``similarity`` or more. SimHash links are the first candidates, an exact join
    of the sets finds what fingerprints miss, and every link is verified on the sets.
    Texts without a word are one group; rows equal in all columns count as copies;
    of equal ids the smaller row key stays; null ids come last.
    """
    from arcweave.llm.set_join import similar_groups

    rows = docs.select(*row_key(docs), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    groups = materialize(similar_groups(rows, words, similarity), "similar")
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    sizes = groups.groupBy("_group").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # written, so that the join has two plain exchanges and a large group can be split
    member = groups.join(materialize(sizes.select("_group", "f"), "groups"), "_group")
    first = (F.col("_a") == F.col("f.a")) & (F.col("_b") == F.col("f.b"))
    return drop_rows(docs, member.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_rows"), F.max(first.cast("int")).alias("_copies")).where("_copies < _rows"))
