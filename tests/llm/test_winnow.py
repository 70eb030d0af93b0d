import hashlib
import re
import struct

import pytest
import xxhash

from arcweave.llm import winnow

WORD = re.compile("[^\x20\x09-\x0d]+")


def hash_(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def turned(x, n):
    n %= 64
    return (x << n | x >> (64 - n)) & (1 << 64) - 1 if n else x


def winnowed(h, k, w):
    """Points (hash, position) from hashes of tokens: each run's hash rolls on from the one before."""
    if not h:
        return []
    if len(h) < k:
        seed = 42
        for x in h:
            seed = hash_(struct.pack("<Q", x), seed)
        grams = [seed]
    else:
        now = 0
        for x in h[:k]:
            now = turned(now, 1) ^ x
        grams = [now]
        for gone, come in zip(h, h[k:], strict=False):
            now = turned(now ^ turned(gone, k - 1), 1) ^ come
            grams.append(now)
    out = []
    for s in range(max(1, len(grams) - w + 1)):
        order = [(g >> 31) & 0xFFFFFFFF for g in grams[s : s + w]]
        p = s + max(i for i, x in enumerate(order) if x == min(order))
        if (grams[p], p) not in out:
            out.append((grams[p], p))
    return out


def brute(text, k=winnow.K, w=winnow.W):
    words = WORD.findall(text or "")
    out = winnowed([hash_(x.encode()) for x in words], k, w)
    if len(words) < winnow.FEW:
        octets = [hash_(struct.pack("<i", winnow.BYTES), hash_(bytes([b]))) for b in (text or "").encode()]
        out = out + winnowed(octets, winnow.BYTES, w)
    return out


def shown(points):
    return " ".join(f"{h:X}.{p:X}" for h, p in points)


def dice(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def check(rows, texts):
    """Against all neighbours by brute force; ``texts`` in order."""
    n = len(texts)
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % n] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(brute(t)), shown(brute(edited)))
        assert r["near_edited"] == pytest.approx(dice(brute(t), brute(edited))) and r["near_next"] == pytest.approx(dice(brute(t), brute(after)))


@pytest.mark.parametrize("run", [winnow.RUN, 8])
def test_against_brute_force(docs, sample, monkeypatch, run):
    monkeypatch.setattr(winnow, "RUN", run)
    monkeypatch.setattr(winnow, "LOOKS", 2)
    texts = [*sample[:120], None, "", "one", "a b c d e", "x " * 60, "été 😀 " * 30, "é😀", "z" * 700, " \n ", "w " * 47, "w " * 48]
    found = sorted(winnow.compare_edited(docs(texts)).collect(), key=lambda r: r["doc_id"])
    assert len(found) == len(texts)
    check(found, texts)


def test_odd_tables(spark, docs):
    assert winnow.compare_edited(docs([])).count() == 0
    check(winnow.compare_edited(docs(["a b c d e f g"])).collect(), ["a b c d e f g"])
    rows = [(None, "last"), (5, "b b"), (5, "a a"), (5, "a a"), (None, None), (-3, "first")]
    found = winnow.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 6
    # order: -3, 5 "a a", 5 "a a", 5 "b b", null "", null "last", and round
    by = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found}
    assert (-3, 5, hashlib.sha256(b"fira ").hexdigest()) in by and (None, 4, hashlib.sha256(b"lafi").hexdigest()) in by
    assert (5, 3, hashlib.sha256(b"a a").hexdigest()) in by and (5, 3, hashlib.sha256(b"b ").hexdigest()) in by


def test_rows_without_an_id_are_dealt_to_many_runs(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RUN", 50)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"{'common start ' * (k % 2)}{k * 7919 % 1009}") for k in range(3000)]
    runs = []

    def derive(placed):
        runs.append(placed.where("_late = 0").groupBy("_run").count())
        return placed

    found = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["text"], derive=derive).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1].encode())
    ordered = sorted(rows, key=key)
    assert sorted((*key(r), r["next_text"]) for r in found) == sorted((*key(r), ordered[(k + 1) % len(ordered)][1]) for k, r in enumerate(ordered))
    sizes = [r["count"] for r in runs[0].collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300


def test_guarantee():
    """Texts that share w + k - 1 words in a row share a chosen hash."""
    import random

    draw = random.Random(0)
    for _ in range(200):
        shared = [f"s{draw.randrange(9)}" for _ in range(winnow.W + winnow.K - 1)]
        a, b = ([f"{x}{draw.randrange(50)}" for _ in range(draw.randrange(30))] + shared + [f"{x}{draw.randrange(50)}" for _ in range(draw.randrange(30))] for x in "ab")
        assert {h for h, _ in brute(" ".join(a))} & {h for h, _ in brute(" ".join(b))}


def test_short_texts_are_like_their_edits(docs, sample):
    """The edit keeps half of a text; a text of 40 bytes or more shares points with it, with or without spaces."""
    texts = [t for t in sample if t and 40 <= len(t) < 400]
    texts += ["".join(chr(97 + (k * k + 3 * k * n) % 26) for k in range(60)) for n in range(1, 6)]
    found = winnow.compare_edited(docs(texts)).collect()
    assert all(r["near_edited"] > 0 for r in found) and len(texts) > 10


def test_very_long_texts(docs):
    import random

    draw = random.Random(1)
    long = " ".join(f"w{draw.randrange(10**6)}" for _ in range(150_000))
    found = {r["doc_id"]: r for r in winnow.compare_edited(docs([long, "x" * 300_000, long])).collect()}
    assert found[0]["fingerprint"] == found[2]["fingerprint"] == shown(brute_long(long)) and found[2]["near_next"] == 1.0


def brute_long(text):
    """As ``brute``, for a text of many words, with a queue."""
    h = [hash_(x.encode()) for x in text.split()]
    now, grams = 0, []
    for i, x in enumerate(h):
        now = turned(now, 1) ^ x ^ (turned(h[i - winnow.K], winnow.K) if i >= winnow.K else 0)
        if i >= winnow.K - 1:
            grams.append(now)
    order, out, last = [(g >> 31) & 0xFFFFFFFF for g in grams], [], -1
    for s in range(len(grams) - winnow.W + 1):
        p = max(range(s, s + winnow.W), key=lambda i: (-order[i], i))
        if p != last:
            out.append((grams[p], p))
            last = p
    return out
