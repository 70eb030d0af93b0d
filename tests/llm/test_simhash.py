import random

import numpy as np
import pytest
import xxhash

from arcweave.llm import simhash


def brute_print(text, words):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most):
    """Smallest index of each component by brute force."""
    name = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= most and name[j] < name[i]:
                    name[i], changed = name[j], True
    return name


def test_against_brute_force(docs, sample):
    texts = [*sample, None, "", " \n\t", "One", "one", "two words", "Ünï cödé wörds ÀB"]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs(texts).select("doc_id", "text")).collect()}
    prints = [brute_print(t, 4) for t in texts]
    assert [found[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[k]["component_id"] for k in range(len(texts))] == components(prints, 4)


@pytest.mark.parametrize("most,few", [(2048, 48), (4, 2), (8, 1)])
def test_clusters_and_large_buckets(spark, monkeypatch, most, few):
    """Dense balls and chains of fingerprints: as all pairs, also when every bucket is too large."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "FEW", few)
    draw = random.Random(most)
    prints = set()
    for _ in range(6):
        p = draw.getrandbits(64)
        for _ in range(40):
            prints.add(p)
            q = p
            for _ in range(draw.randint(1, 6)):
                q ^= 1 << draw.randrange(64)
            prints.add(q)
            if draw.random() < 0.3:
                p = q
    prints = sorted(prints)
    from arcweave.operators.components import component_labels

    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    labels = {r["id"]: r["component"] for r in component_labels(simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), 4)).collect()}
    names = components(prints, 4)
    groups = {}
    for p, name in zip(signed, names, strict=True):
        groups.setdefault(labels.get(p, p), set()).add(name)
    assert sorted(min(g) for g in groups.values()) == sorted(set(names)) and all(len(g) == 1 for g in groups.values())


def test_finer_blocks_are_exact():
    """Any two fingerprints at the limit share a bucket of every deal, however many rows there are."""
    draw = np.random.default_rng(0)
    again = tuple(tuple(range(k, 64, 5)) for k in range(5))
    for rows in (10**3, 10**7, 10**9, 10**12):
        tables = simhash.exact_tables(4, rows)
        for _ in range(200):
            a = draw.integers(0, 2**63, 1, dtype=np.uint64)
            b = a.copy()
            for bit in draw.choice(64, 4, replace=False):
                b ^= np.uint64(1 << int(bit))
            for deal in (lambda x: simhash._buckets(x, tables), lambda x: simhash._buckets(x, again), lambda x: simhash._cells(x, 4)):  # noqa: B023
                assert set(deal(a)[0].tolist()) & set(deal(b)[0].tolist())


def test_dropping(docs, spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    base = [" ".join(draw.choice(words) for _ in range(400)) for _ in range(12)]
    near = [" ".join("zz" if k in (50, 200) else w for k, w in enumerate(t.split())) for t in base]
    table = docs([*base, *near, base[0], base[0], None, ""])
    table = table.union(table.where("doc_id = 24"))
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == [*range(12), 26]
    assert simhash.drop_near_duplicates(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 1, 2, 3), (None, "a b c", 1, 2, 3), (None, "x y", 1, 2, 3)], "doc_id long, text string, _a int, print int, fingerprint int")
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(odd).collect()) == ["a b c", "x y"]
