"""Ids of adversarial texts against the tokenizers library, for both vocabularies."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import tokens

PIECES = [
    "a", "Be", "don't", "'S", "'re", "it'LL", "'", "''s", "é", "É", "ß", "ÿ", "×", "÷", "ª", "µ", "º", "12", "3", "²", "½", "٣", "x1y", "_", "#", "$$$", "...", "<", "<|", "<|endoftext|>", "<|start", "|>", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\r",
    "\x0b", "\x0c", "\x00", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", " ", "﻿", "́", "ſ", "İ", "日本", "한", "🙂", "🇫🇷", "‍", "ﬁ", "Ǆ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_adversarial_texts(name):
    rng = random.Random(5)
    plain = [p for p in PIECES if all(" " <= c <= "~" or c in "\t\n\r" or "À" <= c <= "ÿ" for c in p)]
    texts = ["".join(rng.choice(source) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randrange(12))) for source in [PIECES, plain] * 3000]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    small = tokens.WordEncoder(public_tokenizers.path(name), max_words=200)  # forgets again and again
    for enc in (small, tokens.encoder(public_tokenizers.path(name))):
        ids, counts = enc.encode(texts[:7])
        for at in range(7, len(texts), 500):
            more, n = enc.encode(texts[at : at + 500])
            ids, counts = np.concatenate([ids, more]), np.concatenate([counts, n])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
