"""The word cache: ids equal the tokenizer's on odd texts, and new plain words go to the model alone."""

import random

import numpy as np
import pytest

from sievework.llm import packing, tokens

NAMES = ["word_bpe_49k.json", packing.TOKENIZER]


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_tokenizer(name, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 40)
    enc, r = tokens.Encoder(tokens.public(name)), random.Random(5)
    bits = ["word", "Word", "ÉLAN", "straße", "a", "I'm", "don't", "x,", "end.", '"q"', "1234", "a1", "ª", "µm", "ﬁn", "漢字", "é", "İ", "ς", "’s", "_", "((", "!?", "A" * 60, "<|", "\x85"]
    gaps = [" ", " ", " ", "\n", "  ", "\n\n", " \n", "\t", "\xa0", "", "\r\n"]
    texts = [None, "", " ", "\n", "\n\n", " a", "a ", "a\n", "\na b", "a\n b", "a b,\nc. d", "a,\n"]
    texts += ["".join(r.choice(bits) + r.choice(gaps[: r.choice([4, len(gaps)])]) for _ in range(r.randrange(1, 30))) for _ in range(1500)]
    for text, got in zip(texts, enc.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_plain_words_need_the_model_alone(name):
    enc, text = tokens.Encoder(tokens.public(name)), "Alpha beta gammaé Delta epsilon"
    want, enc.tokenizer = enc.tokenizer.encode(text, add_special_tokens=False).ids, None
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("name", NAMES)
def test_distinct_stretches_are_looked_up_once_a_group(name, monkeypatch):
    seen, whole = [], tokens.Encoder._numbers
    monkeypatch.setattr(tokens.Encoder, "_numbers", lambda self, words: seen.append(sorted(words)) or whole(self, words))
    enc, text = tokens.Encoder(tokens.public(name)), "alpha beta, alpha beta\nalpha"
    want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert list(enc.encode_many([text] * 500)) == [want] * 500
    assert seen == [[",", "alpha", "beta"] if enc.drops_space else ["\t,", "\n", "\ralpha", "alpha", "beta"]]


@pytest.mark.parametrize("name", NAMES)
def test_groups_and_what_goes_between_them(name, monkeypatch):
    for k, v in (("GENERATION", 15), ("GROUP_CHARS", 150), ("BATCH_WORDS", 3)):
        monkeypatch.setattr(tokens, k, v)
    enc, r = tokens.Encoder(tokens.public(name)), random.Random(8)
    bits = ["".join(r.choice("abcdeéÀZ") for _ in range(r.randrange(1, 6))) for _ in range(90)] + ["x" * 60, "ab,", "é...", "a'.", "don't", "a1,", "’,", "\x01,", ",", "12", "漢,", "ÿ"]
    texts = [r.choice([" ", "\n"]).join(r.choice(bits) + r.choice(["", "", ",", "\nÀb"]) for _ in range(r.randrange(1, 25))) for _ in range(600)]
    texts[::9] = ["", " a", "a b", "a\tb", None, "a,\t b", "A​B", "a, \nb"] * 8 + [""] * (len(texts[::9]) - 64)
    for text, got in zip(texts, enc.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert len(enc.known) < 100
