import zlib

import numpy as np
import pytest

from arcweave.llm import classifier as c


def test_linear_time_form_is_the_sum_over_pairs():
    draw = np.random.default_rng(0)
    machine = c.Machine(0.3, draw.normal(size=c.SIZE), draw.normal(size=(c.SIZE, c.RANK)))
    rows = [(draw.choice(c.SIZE, 7, replace=False), draw.normal(size=7)) for _ in range(4)]
    raw, _ = machine.raw(*c.stacked(rows))
    for k, (i, x) in enumerate(rows):
        pairs = sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(7) for b in range(a + 1, 7))
        assert raw[k] == pytest.approx(0.3 + machine.linear[i] @ x + pairs)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    found = {r["doc_id"]: r for r in c.classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).collect()}
    assert len(found) == docs.count()
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["quality"], found[r["doc_id"]]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert np.mean([q == r["predicted"] for q, r in held]) > 0.95


def test_labels_held_out_are_not_learned(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(c.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = c.train(docs, labels, 200), c.train(docs, turned, 200)
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_entries_are_bounded(docs, spark, monkeypatch):
    """Rows beyond the bound are not learned from, and equal rows are one."""
    seen = []
    monkeypatch.setattr(c, "fit", lambda rows, labels: seen.append(sum(len(i) for i, _ in rows)))
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    each = 40 + len(c.STATISTICS)
    c.train(docs(texts), labels, max_entries=3 * each + 5)
    c.train(docs(texts).union(docs(texts)), labels)
    c.train(docs(texts), labels, max_entries=5)
    assert 3 * each - 3 <= seen[0] <= 4 * each and seen[1] <= 20 * each and seen[2] == 0


def test_odd_tables(docs, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (1, 0)], "doc_id long, quality int")
    texts = ["a b c", "### $$$", "", None, "w " * 50_000, "é\n\n😀"]
    found = c.classify(docs(texts), labels).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    assert c.classify(docs([]), labels).count() == 0
    none = c.classify(docs(texts), labels.limit(0)).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in none)
    rows = spark.createDataFrame([(7, "x y", 1), (7, "x y", 1), (None, "z", 2)], "doc_id long, text string, score int")
    found = c.classify(rows, labels).collect()
    assert len(found) == 3 and found[0]["score"] == found[1]["score"]
