import random
import re
from collections import Counter

from arcweave.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    """The contract's counts, plainly."""
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(k, k + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts(docs, sample):
    draw = random.Random(1)
    texts = [*sample, None, "", "\n\n", "a " * 50, "x\nx\n\nx\n y\n y", " ".join(draw.choice("abc") for _ in range(300)), "é# ü|\x0b w", "1 2 3 4 5 6 7 8 " * 3, "w" * 30_000]
    found = {r["doc_id"]: r for r in q.quality_report(docs(texts)).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(found[k][n] for n in names) for k in range(len(texts))] == [base(t) for t in texts]
    assert not any(r["kept"] and r["base_failed"] for r in found.values())


def test_estimation_finds_accuracies():
    """Votes drawn from known accuracies: EM gets near them and near the share of good documents."""
    draw = random.Random(2)
    truth, share = [0.95, 0.9, 0.8, 0.7, 0.85], 0.7
    patterns = Counter()
    for _ in range(20_000):
        good = draw.random() < share
        patterns[tuple(0 if draw.random() < 0.3 else (1 if good == (draw.random() < a) else -1) for a in truth)] += 1
    odds, weights = q.estimate(patterns)
    import math

    assert abs(1 / (1 + math.exp(-odds)) - share) < 0.03
    assert all(abs(1 / (1 + math.exp(-w)) - a) < 0.03 for w, a in zip(weights, truth, strict=True))
    assert len(q.estimate({})[1]) == len(q.RULES)


def test_verdicts(docs):
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    good = ["\n".join(f"The {letters(5)} of {letters(4)} is in {letters(6)} {letters(7)} and {letters(3)}." for _ in range(12)) for _ in range(60)]
    bad = [" ".join(f"wo{k}rd{j}###" for j in range(60)) for k in range(10)] + [" | ".join(f"tab{k}le{j}" for j in range(60)) for k in range(10)]
    found = {r["doc_id"]: r["kept"] for r in q.quality_report(docs([*good, *bad])).collect()}
    assert all(found[k] for k in range(60)) and not any(found[k] for k in range(60, 80))
    kept = q.filter_quality(docs([*good, *bad]))
    assert kept.columns == docs([]).columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_odd_tables(docs, spark):
    assert q.quality_report(docs([])).count() == 0 and q.filter_quality(docs([])).count() == 0
    text = "The cat and the dog of it was in that. " * 1 + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)) + "."
    rows = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, None, None)], "doc_id long, text string, signals int")
    assert q.filter_quality(rows).count() == 2
