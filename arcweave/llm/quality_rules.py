"""Quality rules as weak supervision.

Rules look at counts of a text and vote good (1) or bad (-1), or abstain (0).
Expectation-maximisation over the distinct vote patterns (at most 3 to the
power of the number of rules, whatever the number of documents) estimates how
often each rule is right on good and on bad documents, and a document is kept
if the posterior probability that it is good reaches ``min_quality``. No rule
alone rejects a document, but for the two hard ones behind ``base_failed``.

Everything on rows is a column expression; only pattern counts reach the driver.

Defined results: a null text counts as empty, has no words and fails the base
rules; an empty table gives an empty table; ties of the posterior at the limit
are kept; repeated rows are judged alike; other columns pass through
``filter_quality`` unchanged and are ignored by ``quality_report``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.text import has_word, let, lines, run_hashes, words
from arcweave.plans.lineage import materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = [form for w in "the of and to in is that for it with was on as are be this from at by an de la le les des et un une du que en est pour dans qui sur par au pas der die und das den von zu mit sich auf ist im dem nicht ein eine als auch el los las una por con del se no es al lo como más".split() for form in (w, w.capitalize())]
PLAIN = r"^[\p{L}'’-]+[.,;:!?]?$"
BARE = r"^[^\p{L}\p{N}]+$"


def _repeat_words(found: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""
    hashes = F.when(F.size(found) >= WINDOW, run_hashes(found, WINDOW)).otherwise(F.array().cast("array<bigint>"))

    def positions(ranked: Column) -> Column:
        same = lambda x, k: (F.get(ranked, k - 1)["h"] == x["h"]) | (F.get(ranked, k + 1)["h"] == x["h"])
        return F.transform(F.filter(ranked, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = F.sort_array(let(ranked, positions))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + (i + WINDOW - F.greatest(acc["end"], i))).alias("n"))
        return F.aggregate(at, start, step)["n"]

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def signals(text: Column) -> Column:
    """Struct of the counts that the rules look at."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of(found: Column) -> Column:
        worded = F.filter(lines(text), has_word)
        joined = F.array_join(found, "")
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(joined) - F.length(F.regexp_replace(joined, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
            let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(F.filter(x, lambda y: y.rlike(r"[.!?…:;][\"'»”)]?\s*$"))).cast("long").alias("ended"))).alias("lines"),
            _repeat_words(found).alias("n_repeat_words"),
            F.size(F.filter(found, lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
            let(F.filter(found, lambda w: ~w.rlike(PLAIN)), lambda other: F.struct((F.size(found) - F.size(other)).cast("long").alias("plain"), F.size(F.filter(other, lambda w: w.rlike(BARE))).cast("long").alias("bare"))).alias("shapes"),
            (F.length(joined) - F.length(F.regexp_replace(joined, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        )

    return let(words(text), of)


#: Name, ratio over the signals, where it votes good (None: never), where bad, and whether more is worse.
#: Rules that look for a defect abstain when they find none, as its absence says little.
RULES: list[tuple[str, Callable[[Column], Column], float | None, float, bool]] = [
    ("too_short", lambda s: s["n_words"], None, 19, False),
    ("symbols", lambda s: _per_word(s, "n_symbols"), None, 0.1, True),
    ("bare_symbols", lambda s: s["shapes"]["bare"] / F.greatest(s["n_words"], F.lit(1)), None, 0.1, True),
    ("repeated_words", lambda s: _per_word(s, "n_repeat_words"), None, 0.2, True),
    ("repeated_lines", lambda s: s["lines"]["dup"] / F.greatest(s["lines"]["n"], F.lit(1)), None, 0.3, True),
    ("word_length", lambda s: F.abs(_per_word(s, "word_chars") - 6), None, 6, True),
    ("capitals", lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)), None, 0.4, True),
    ("function_words", lambda s: _per_word(s, "n_function"), 0.08, 0.02, False),
    ("plain_words", lambda s: s["shapes"]["plain"] / F.greatest(s["n_words"], F.lit(1)), 0.85, 0.6, False),
    ("sentence_ends", lambda s: s["lines"]["ended"] / F.greatest(s["lines"]["n"], F.lit(1)), 0.5, 0.1, False),
]
NAMES = [r[0] for r in RULES]


def _per_word(found: Column, count: str) -> Column:
    return found[count] / F.greatest(found["n_words"], F.lit(1))


def votes(found: Column) -> list[Column]:
    """One column a rule, from the struct of signals: 1 good, -1 bad, 0 for no opinion."""
    out = []
    for name, ratio, good, bad, more_is_worse in RULES:
        x = ratio(found)
        vote = F.when(x >= bad if more_is_worse else x <= bad, -1)
        if good is not None:
            vote = vote.when(x <= good if more_is_worse else x >= good, 1)
        out.append(vote.otherwise(0).cast("int").alias(name))
    return out


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50, prior: float = 0.8, strength: float = 10.0) -> tuple[float, list[float]]:
    """EM over vote patterns: the log odds of good, and the log odds that each rule's vote is right.

    Accuracies and the share of good documents start at ``prior`` and are held
    there by ``strength`` pseudo-documents, so that a rule that rarely votes
    keeps a sensible estimate. A rule is taken to be better than chance.
    """
    n_rules = len(next(iter(patterns), NAMES))
    total = sum(patterns.values())
    share, right = prior, [prior] * n_rules
    for _ in range(rounds if total else 0):
        weights, odds = [math.log(a / (1 - a)) for a in right], math.log(share / (1 - share))
        good = strength * prior
        hits, seen = [strength * prior] * n_rules, [strength] * n_rules
        for row, n in patterns.items():
            p = 1 / (1 + math.exp(-(odds + sum(w * v for w, v in zip(weights, row, strict=True)))))
            good += n * p
            for j, v in enumerate(row):
                if v:
                    hits[j] += n * (p if v > 0 else 1 - p)
                    seen[j] += n
        share = min(0.99, max(0.01, good / (total + strength)))
        right = [min(0.99, max(0.55, h / s)) for h, s in zip(hits, seen, strict=True)]
    return math.log(share / (1 - share)), [math.log(a / (1 - a)) for a in right]


def fit(voted: DataFrame) -> Callable[[list[Column]], Column]:
    """Fits to all rows of the vote columns; gives the posterior probability of good as an expression over votes."""
    counts = {tuple(r[n] for n in NAMES): r["_n"] for r in voted.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("_n")).collect()}
    odds, weights = estimate(counts)
    return lambda given: 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [v * w for v, w in zip(given, weights, strict=True)], F.lit(odds))))


def base_failed(found: Column) -> Column:
    return (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])


def quality_report(docs: DataFrame, min_quality: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, posterior and verdict of every document."""
    judged = let(signals(F.col(text_col)), lambda s: F.struct(s.alias("signals"), F.struct(*votes(s)).alias("votes")))
    voted = materialize(docs.select(F.col(id_col).alias("doc_id"), judged.alias("judged")).select("doc_id", "judged.signals", "judged.votes.*"), "votes")
    quality = fit(voted)([F.col(n) for n in NAMES])
    failed = base_failed(F.col("signals"))
    return voted.select(
        "doc_id", "signals.n_words", "signals.word_chars", "signals.n_symbols", F.col("signals.lines.dup").alias("n_dup_lines"), "signals.n_repeat_words",
        failed.alias("base_failed"), (~failed & (quality >= min_quality)).alias("kept"), quality.alias("posterior"), *NAMES,
    )


def filter_quality(docs: DataFrame, min_quality: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns.

    Signals are the costly part, so documents are written once with their votes;
    the fit reads the votes alone, and the verdict needs no text and no shuffle.
    """
    judged = let(signals(F.col(f"`{text_col}`")), lambda s: F.struct(base_failed(s).alias("failed"), F.struct(*votes(s)).alias("votes")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), judged.alias("judged"))
    rows = materialize(rows.select("doc", "judged.failed", "judged.votes.*"), "judged")
    kept = rows.where(~F.col("failed") & (fit(rows)([F.col(n) for n in NAMES]) >= min_quality))
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
