"""Runs of text that the packer's memo does not hold: what reaches the tokenizer, and that ids stay the tokenizer's."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as pk


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(pk.default_tokenizer())


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_known_words_are_not_encoded_again(word, monkeypatch):
    bpe, given = pk.WordBpe(pk.default_tokenizer()), []
    bpe.encode([b"zabanana straxi"])
    plain = pk.WordBpe._ids
    monkeypatch.setattr(pk.WordBpe, "_ids", lambda self, texts, *more: given.extend(texts) or plain(self, texts, *more))
    texts = ["zabanana, zabanana. Straxi###", "zabanana, straxi%%%"]
    assert bpe.encode([x.encode() for x in texts]) == [ids(word, x) for x in texts]
    assert given and not any(x in y for x in ("zabanana", "straxi") for y in given)


def test_marks_after_any_character(word):
    bpe = pk.WordBpe(pk.default_tokenizer())
    texts = [x for c in [*range(1, 0x250), 0x2BC, 0x301, 0x338, 0x2026, 0x4E2D] for x in (f"{chr(c)},", f"a{chr(c)}.", f"{chr(c)}a'", f"1{chr(c)}s'")]
    assert bpe.encode([x.encode() for x in texts]) == [ids(word, x) for x in texts]


def test_batches_and_a_full_memo(word, monkeypatch):
    monkeypatch.setattr(pk, "MEMO", 30)
    bpe, r = pk.WordBpe(pk.default_tokenizer()), random.Random(5)
    parts = ["the", "Word,", "straße.", "Été!", "it's,", "42.", "###", "<|endoftext|>", "a<|endoftext|>,", "\x1c-", "é.", "≠", "中,", " ", " ", "\n", "\x85"]
    for _ in range(6):
        texts = ["".join(r.choice([*parts, f"w{r.randrange(99)}x,", "q" * r.randrange(90) + "."]) for _ in range(r.randrange(12))) for _ in range(200)]
        assert bpe.encode([x.encode() for x in texts]) == [ids(word, x) for x in texts]
        assert len(bpe.memo) <= 30 and all(len(x) <= pk.LONGEST for x in bpe.memo)
    assert bpe.encode([]) == [] and bpe.encode([b"", b" \n"]) == [b"", b""]
    assert bpe.encode([b"\xff\xfe a"])[0].endswith(ids(word, "a"))
