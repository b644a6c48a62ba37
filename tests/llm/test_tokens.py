"""The word encoder against the tokenizer itself, on texts made of awkward characters."""

import random

import pytest

from rillstone.llm.packing import WordEncoder, vocabulary_path

PARTS = [*"aAbZé ßÉñ'’.,,..!?-_<|>/019\n\t  ́İıſKÅ中文字が한국어مرح😀👍🏽​‍﻿\x00\x01\x0b\x0c\x1c\x85 ", "<|endoftext|>", "'s", "'ll", "...", "word", "</w>"]


@pytest.mark.parametrize("seed", range(3))
def test_ids_equal_the_tokenizers(seed):
    from tokenizers import Tokenizer

    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["İ. ", "\x1c.\n", "a.. b", "a_. b", "x́, y", "中. "]
    encoder, tokenizer = WordEncoder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    wrong = [t for t, ids in zip(texts, encoder.encode_all(texts), strict=True) if ids.tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []
