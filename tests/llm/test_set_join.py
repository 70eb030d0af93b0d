"""Groups of the near-duplicate stage against all pairs of shingle sets."""

import random
from fractions import Fraction

import pytest

from arcweave.llm import set_join, simhash
from arcweave.llm.rows import row_key


def runs(text, words=5):
    found = text.split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def groups(texts, limit=Fraction(4, 5)):
    """Smallest index of each component of the pairs at the limit or above."""
    sets = [runs(t) for t in texts]
    name = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(name[i], name[j])
            changed |= name[i] != name[j]
            name[i] = name[j] = low
    return name


def changed(draw, text, n):
    """``text`` with ``n`` words in different places replaced."""
    words = text.split()
    for k in draw.sample(range(len(words)), n):
        words[k] = f"z{draw.getrandbits(40)}"
    return " ".join(words)


@pytest.fixture
def near(docs):
    """Pairs of every similarity from 0.6 to 1, a dense group, a passage that many share, and texts of a few words."""
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(5000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(draw.randint(60, 500)) for _ in range(120)]
    texts += [changed(draw, t, max(1, round(len(t.split()) * draw.uniform(0.01, 0.06)))) for t in texts]
    core = text(150)
    texts += [changed(draw, core, draw.randint(0, 12)) for _ in range(70)]
    passage = text(60)
    texts += [passage + " " + text(draw.randint(20, 60)) for _ in range(70)]
    texts += ["", " ", "a b", "a b", "a b c d e", "a b c d e f"]
    return texts


def found(docs, texts):
    table = docs(texts).select("doc_id", "text")
    rows = table.select(*row_key(table), "doc_id", table.text.alias("_text"))
    least = {}
    out = set_join.similar_groups(rows).collect()
    for r in out:
        least[r["_group"]] = min(least.get(r["_group"], r["doc_id"]), r["doc_id"])
    return [least[r["_group"]] for r in sorted(out, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("most,few,often", [(2048, 48, 8), (16, 4, 2)])
def test_all_pairs(docs, near, monkeypatch, most, few, often):
    for name, value in (("MOST", most), ("FEW", few), ("OFTEN", often)):
        monkeypatch.setattr(set_join, name, value)
    assert found(docs, near) == groups(near)


def test_pairs_just_above_the_limit_are_found(docs):
    """The fingerprints' sampled tables and limit of 46 bits missed about one in eight of these."""
    draw = random.Random(5)
    base = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(204)) for _ in range(150)]
    near = []
    for t in base:  # 4 words apart from each other by 5 or more: 20 of 200 runs differ, similarity 180 / 220
        w = t.split()
        for k in draw.sample(range(2, 20), 4):
            w[10 * k] = f"z{draw.getrandbits(40)}"
        near.append(" ".join(w))
    kept = simhash.drop_near_duplicates(docs([*base, *near]))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(150))


def test_clean_documents_stay(docs):
    """Fingerprints joined these: texts that share seven tenths of their runs, and texts that repeat one run."""
    draw = random.Random(6)
    texts = []
    for _ in range(60):
        w = [f"w{draw.randrange(10**6)}" for _ in range(204)]
        other = list(w)
        for k in range(1, 8):  # 35 of 200 runs differ, similarity 165 / 235
            other[25 * k] = f"z{draw.getrandbits(40)}"
        texts += [" ".join(w), " ".join(other)]
    repeated = " ".join(["same"] * 300)
    texts += [repeated + " " + " ".join(f"v{draw.randrange(10**6)}" for _ in range(100)) for _ in range(2)]
    kept = simhash.drop_near_duplicates(docs(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(texts)))
