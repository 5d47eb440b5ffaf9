"""Sentence marks after letters that change when a tokenizer normalises them, against the tokenizers library."""

import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tessavec.llm import tokens

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def changing():
    """Every character that NFC or lower-casing makes something else than one letter."""
    every = (chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return [c for c in every if unicodedata.normalize("NFC", c) != c or len(c.lower()) > 1 or (c.isalpha() and not c.lower().isalpha())]


@pytest.mark.parametrize("path", [WORDS, BYTES], ids=["words", "bytes"])
def test_marks_after_changing_letters(path):
    letters = changing()
    assert len(letters) > 1000 and "İ" in letters and "क़" in letters
    texts = [t for c in letters for t in (f"{c}.", f"{c},", f"a{c}, {c}b.", f"ŞİRKETİ. {c}")] + ["BELEDİYESİ, KENTİ."]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encode, count = tokens.Encoder(path).encode, tokens.WordEndCounter(WORDS).count
    assert [t for t, ids in zip(texts, want, strict=True) if np.frombuffer(encode(t), "<u2").tolist() != ids] == []
    if path == WORDS:
        assert [t for t, ids in zip(texts, want, strict=True) if count(t) != len(ids)] == []


def test_words_that_go_straight_to_the_model():
    def made(split, *added):
        t = Tokenizer(models.BPE({c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ")}, []))
        t.pre_tokenizer = split
        t.add_special_tokens(list(added))
        return t

    whole, camel = pre_tokenizers.Split(Regex("[A-Za-z]+"), "isolated"), pre_tokenizers.Split(Regex("[A-Z]?[a-z]+|[A-Z]+"), "isolated")
    assert tokens.direct_words(made(whole, "<|end|>")) == {"": ("", False)}  # a blank is a part of its own
    assert tokens.direct_words(made(camel)) == tokens.direct_words(made(whole, "PAD")) == {}
    cut = made(whole)
    cut.enable_truncation(2)
    assert tokens.direct_words(cut) == {}
    rng = random.Random(5)
    words = ["".join(rng.choices("abcxyzKLMeio", k=rng.randint(1, 40))) for _ in range(3000)] + ["Ab" * 5000]
    for path in (WORDS, BYTES):
        e = tokens.Encoder(path)
        assert set(e.direct) == {"", " "}
        for text in (" ".join(words), ". ".join(words), "\n".join(words)):
            assert np.frombuffer(e.encode(text), "<u2").tolist() == e.library.encode(text, add_special_tokens=False).ids
