import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


def check(found, capacity):
    """No gaps, overlaps or overfull sequences."""
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces(docs, sample, exact, capacity):
    texts = [*sample, None, "", " ", "😀日本\x1c\x85 　x", "a  b   c \n\n d ", "x" * 3000, "word " * 3000]
    found = packing.pack_documents(docs(texts), PATH, capacity).collect()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        rows = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and rows[0]["start"] == 0
        assert sum(r["length"] for r in rows) == len(ids) and len(rows) == -(-len(ids) // capacity)
        assert all(r["length"] == capacity for r in rows[1:])
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    n = check(found, capacity)
    assert n <= 1.02 * sum(r["length"] for r in found) / capacity + 2


def test_encoder_is_exact(exact, monkeypatch):
    encoder = packing.Encoder(PATH)
    draw = random.Random(0)
    letters = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    for _ in range(5000):
        text = "".join(draw.choice(letters + [" "] * 80 + ["\n"] * 20) for _ in range(draw.randint(0, 14)))
        assert packing.PLAIN.fullmatch(text)
        assert encoder.ids(text)[:-1].tolist() == exact.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "PART", 50)
    text = "the cat's  house \n and 12 dogs, " * 40
    assert encoder.ids(text)[:-1].tolist() == exact.encode(text, add_special_tokens=False).ids
    for special in ("a <|endoftext|> b", "<|endoftext|>", "word " * 30 + "<|endoftext|>" + " word" * 30):
        ids = exact.encode(special, add_special_tokens=False).ids
        assert 50256 in ids and encoder.ids(special)[:-1].tolist() == ids


def test_plans():
    draw = random.Random(1)
    for capacity in (8, 50, 300):
        for _ in range(20):
            histogram = Counter(draw.randint(1, capacity) for _ in range(draw.randint(0, 500)))
            made = packing.plan(dict(histogram), capacity)
            used = Counter()
            for row, times in made:
                assert sum(row) <= capacity and times > 0
                for n in row:
                    used[n] += times
            assert used == histogram
            # about as few as first fit decreasing, which sees every piece
            bins = []
            for n in sorted(histogram.elements(), reverse=True):
                k = next((k for k, x in enumerate(bins) if x + n <= capacity), None)
                if k is None:
                    bins.append(n)
                else:
                    bins[k] += n
            assert sum(t for _, t in made) <= 1.02 * len(bins) + 1


@pytest.mark.parametrize("times", [1, 26, 1000])
def test_patterns_carry_the_load(times, exact):
    """Most tokens of short pieces are in patterns, and there are no more sequences than best fit alone makes, at any size."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    histogram = Counter(n for t in texts for _, n in packing.cut(len(exact.encode(t or "", add_special_tokens=False).ids) + 1, 2048))
    histogram = {n: c * times for n, c in histogram.items()}
    made = packing.plan(histogram)
    left = np.zeros(2049, dtype=np.int64)
    left[list(histogram)] = list(histogram.values())
    full, left[2048] = left[2048], 0
    assert sum(t for _, t in made) <= full + sum(t for _, t in packing._best_fit(left, 2048))
    short = sum(n * c for n, c in histogram.items() if n < 2048)
    assert sum(2048 * t for row, t in made if 1 < len(row) < 4 and sum(row) == 2048) > 0.9 * short


def test_odd_tables(docs, spark):
    assert packing.pack_documents(docs([]), PATH).count() == 0
    rows = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2)], "doc_id long, text string, length int")
    found = packing.pack_documents(rows, PATH).collect()
    assert len(found) == 3 and check(found, 2048) == 1
    named = spark.createDataFrame([("x", "a b"), ("7", "a b")], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in packing.pack_documents(named, PATH).collect()) == ["7", "None"]
