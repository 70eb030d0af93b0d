import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from arcweave.llm.token_count import MARK, Counter, count_tokens, read_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def reference(vocabulary, fallback):
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, fallback))
    return lambda t: len(tokenizer.encode(MARK + t.replace(" ", MARK)).ids) if t else 0


def test_file_vocabulary(docs, sample):
    exact = reference(read_vocabulary(PATH), True)
    texts = [*sample, None, "", " ", "  ", "a", "a ", " a", "a  b", "日本 😀\n\t", f"x{MARK}y {MARK}", "<s> <0x0A> <unk>", "w" * 5000, "word " * 5000]
    found = {r["doc_id"]: r for r in count_tokens(docs(texts), PATH).collect()}
    assert [found[k]["n_tokens"] for k in range(len(texts))] == [exact(t or "") for t in texts]
    assert [found[k]["n_chars"] for k in range(len(texts))] == [len(t or "") for t in texts]
    assert count_tokens(docs([]), PATH).count() == 0


@pytest.mark.parametrize("scores", [(1,), (1, 2)])
def test_ties_and_unknowns(scores):
    draw = random.Random(len(scores))
    for _ in range(250):
        pieces = {"".join(draw.choice(f"ab{MARK}") for _ in range(draw.randint(1, 3))) for _ in range(8)}
        vocabulary = [("<unk>", 0.0), *((p, -draw.randint(1, 3) / draw.choice(scores)) for p in sorted(pieces))]
        exact, own = reference(vocabulary, False), Counter(vocabulary)
        for _ in range(20):
            text = "".join(draw.choice("abc ") for _ in range(draw.randint(0, 12)))
            assert own.count(text) == exact(text), (vocabulary, text)


def test_memory_is_bounded(monkeypatch):
    from arcweave.llm import token_count

    monkeypatch.setattr(token_count, "REMEMBERED", 10)
    own = Counter(read_vocabulary(PATH))
    text = " ".join(f"word{k}" for k in range(100))
    assert own.count(text) == own.count(text) and len(own.known) <= 10
