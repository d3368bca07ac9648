"""Pre-tokens are encoded by the library's model alone, with the library's ids."""

import random

import numpy as np
import public_tokenizers
import pytest

from corvane.llm.token_files import LibraryEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


class _ModelOnly:
    """The library without its pre-tokenizer, batches and encodings."""

    def __init__(self, library):
        self.model = library.model


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    signs = "ab Z9'’\n\t\r \u0085　éßжあ😀\U0010ffff\x00ÿ.!_-sre"
    made = ["".join(rnd.choices(signs, k=rnd.randrange(60))) for _ in range(1500)]
    return [*made, "", " ", "word " * 500, "x" * 3000, "we'll it's 's", "ÿþ ÿ", "\U0010ffff" * 3]


def test_only_the_model_is_asked_for_plain_texts(texts):
    coder = LibraryEncoder(PATH)
    whole, coder.library = coder.library, _ModelOnly(coder.library)
    found = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)]
    assert found == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_special_and_null_texts(texts):
    coder = LibraryEncoder(PATH)
    some = [None, "a<|endoftext|>b", *texts[:50], "<|endoftext|>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(some)] == [e.ids for e in coder.library.encode_batch([t or "" for t in some], add_special_tokens=False)]
