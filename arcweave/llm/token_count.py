"""Token counts of a unigram tokenizer by a Viterbi pass that keeps counts alone.

An Aho-Corasick automaton reports every vocabulary piece that ends at a
character; dynamic programming carries, for each position, the best score of a
segmentation up to it and the number of its pieces, and no back pointers.

Tie rules are those of the unigram tokenizer: a path replaces another only with
a higher score and starts are tried from left to right, so among equal scores
the one with the longest last piece stays; a character without a piece of its
own costs the least piece score less 10; runs of such characters are one
unknown, or as many byte pieces as they have bytes where the vocabulary holds
all 256.

A space is U+2581 and one stands before the text. Where no piece or unknown spans the
start of such a run and all scores are whole numbers, sums are exact in any grouping,
so the pass runs word by word and counts of words are remembered (a bounded
number); otherwise it runs over the whole text.

Defined results: a null or empty text has 0 tokens; repeated rows give repeated
rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
RUN = re.compile(f"{MARK}+[^{MARK}]*")
PENALTY = 10.0
REMEMBERED = 800_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and stored scores of a sentencepiece file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of texts under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.alone = {p for p in pieces if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.by_word = all(s == int(s) for _, s in vocabulary) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and (self.bytes or MARK in self.alone)
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces on the best path through ``text``, which has its marks."""
        n = len(text)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        open_run = [False] * (n + 1)  # the best path ends with an unknown
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for at, found in self.automaton.iter(text):  # the longest first at each place
            ends[at].append(found)
        for i, char in enumerate(text):
            best = None
            for length, s in ends[i]:
                total = score[i + 1 - length] + s
                if best is None or total > best:
                    best, start, unknown = total, i + 1 - length, False
            if char not in self.alone:
                total = score[i] + self.unknown
                if best is None or total > best:
                    best, start, unknown = total, i, True
            score[i + 1], open_run[i + 1] = best, unknown
            if not unknown:
                count[i + 1] = count[start] + 1
            elif self.bytes:
                count[i + 1] = count[start] + len(char.encode("utf-8", "surrogatepass"))
            else:
                count[i + 1] = count[start] + (not open_run[start])
        return count[n]

    def word(self, word: str) -> int:
        """Pieces of a mark and a word."""
        n = self.segment(MARK + word)
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.segment(MARK + text.replace(" ", MARK))
        known, word = self.known, self.word
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            total = 0
            for w in text.split(" "):
                n = known.get(w)
                total += word(w) if n is None else n
            return total
        return sum(map(self.segment, RUN.findall(MARK + text.replace(" ", MARK))))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and n_tokens of every document under the pieces of a vocabulary file."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(read_vocabulary(vocabulary))
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            rows = [(len(t), counter.count(t)) for t in texts]
            chars, tokens = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_chars long, n_tokens long")
