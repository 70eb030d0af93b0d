import random
from collections import defaultdict

import pytest

from arcweave.llm import mixing


def water_fill(sizes, weights=mixing.WEIGHTS, share=1.5, most=2.0):
    """Targets by giving out what is left, by weight, until nothing is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] >= most * sizes[s]]
        if not over:
            return capped | part
        capped |= {s: most * sizes[s] for s in over}


def make(spark, n, sources, seed=0, longest=200):
    draw = random.Random(seed)
    rows = [(k, " ".join(["w"] * draw.choice([0, 1, 5, 30, draw.randint(1, longest)])), draw.choice(sources)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


@pytest.mark.parametrize("n,group", [(400, 2000), (3000, 50)])
def test_mix(spark, n, group, monkeypatch):
    sources = ["a"] * 6 + ["B", "é", "zz", None, "c"]
    docs, rows = make(spark, n, sources)
    if group < 2000:  # many groups and levels
        whole = mixing.copies
        monkeypatch.setattr(mixing, "copies", lambda s, t, seed=0: whole(s, t, seed, group))
    found = mixing.mix(docs).collect()
    assert len(found) == n
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = water_fill(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        wanted = target[r["source"]] / sizes[r["source"]]
        assert int(wanted) <= r["copies"] <= int(wanted) + 1
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 5
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in found}


def words(sizes, counts):
    return sum(s * c for s, c in zip(sizes, counts, strict=True))


@pytest.mark.parametrize(
    "sizes,chances",
    [
        ([10] * 50, [0.25] * 50),
        ([500, 200, 200, 100, 60, *[20] * 200], [0.6, 0.2, 0.5, 0.8, 0.5, *[0.5] * 200]),
    ],
)
def test_means_are_the_chances(sizes, chances):
    """Over many draws each document's mean is its chance, and words with what is open and due are those wanted, to the last digit."""
    hits, n = [0.0] * len(sizes), 4000
    wanted = words(sizes, chances)
    for seed in range(n):
        out, held, p, due = mixing.round_group(sizes, chances, 0.0, seed)
        assert set(out) <= {0, 1} and (held < 0 or 0 < p < 1)
        whole = [p if k == held else c for k, c in enumerate(out)]
        assert words(sizes, whole) + due == pytest.approx(wanted)
        hits = [h + c for h, c in zip(hits, whole, strict=True)]
    assert all(abs(h / n - c) < 0.04 for h, c in zip(hits, chances, strict=True))


def test_few_documents_come_near_their_words():
    """In a source of few documents nearness goes before chances: seven documents of 335 words, of which 100.5 are wanted."""
    sizes = [100, 90, 60, 50, 20, 10, 5]
    off, hits = [], [0] * len(sizes)
    for seed in range(2000):
        out, held, p, due = mixing.round_group(sizes, [0.3] * 7, 0.0, seed)
        if held >= 0:
            out[held] = int(mixing.draw(seed, "last") < p)
        off.append(abs(words(sizes, out) - 100.5))
        hits = [h + c for h, c in zip(hits, out, strict=True)]
    assert max(off) < 50 and sum(off) / len(off) < 15
    assert all(0 < h < 2000 for h in hits)


def test_due_words_are_made_good():
    sizes = [400, 300, *[10] * 200]
    for seed in range(200):
        out, held, p, due = mixing.round_group(sizes, [0.5] * len(sizes), 250.0, seed)
        assert abs(words(sizes, [p if k == held else c for k, c in enumerate(out)]) - 0.5 * sum(sizes) - 250) < 1e-6 and abs(due) < 1e-6


def test_equal_rows_are_no_group(spark):
    """A thousand equal rows are one vertex of the tree; copies are shared evenly."""
    rows = [(7, "a b c", "s")] * 1000 + [(k, "w " * k, "t") for k in range(1, 60)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    same = [r["copies"] for r in found if r["source"] == "s"]
    assert len(same) == 1000 and max(same) - min(same) <= 1
    target = next(r["target"] for r in found if r["source"] == "s")
    assert abs(3 * sum(same) - target) <= 3


def test_odd_tables(docs, spark):
    assert mixing.mix(docs([])).count() == 0
    zero = mixing.mix(docs(["", None, " "])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in zero] == [(0, 0, 0.0)] * 3
    assert mixing.mixed_documents(docs([])).count() == 0
    same = spark.createDataFrame([(1, "a b", "s", 4), (1, "a b", "s", 4), (1, "a b", "s", 4), (None, "c", None, 5)], "doc_id long, text string, source string, _n int")
    found = mixing.mixed_documents(same)
    assert found.columns == same.columns
    assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in same.collect()}
    assert sum(len(r["text"].split()) for r in found.collect()) in range(8, 13)


def test_documents_are_taken_as_decided(spark):
    docs, _ = make(spark, 300, ["a", "a", "b", "c"], 3)
    docs = docs.dropDuplicates(["doc_id"])
    decided = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    words = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - n) <= 0.03 * n + 5 for s, n in decided.items())
