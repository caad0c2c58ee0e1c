"""A very long text costs a worker a small multiple of its words, not fifty times its bytes."""

import tracemalloc

import numpy as np
import pytest

from hearken.llm import decontaminate, language, lmscore, simhash, toxicity
from hearken.llm.common import WordHashes, starts_of

SIZE = 12 << 20


@pytest.fixture(scope="module")
def text():
    rng = np.random.default_rng(0)
    words = [f"word{k:05}".encode() for k in rng.integers(0, 50_000, 40_000)]
    part = b" ".join(words)
    return b" ".join([part] * (SIZE // len(part) + 1))


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def machines():
    weights = np.zeros(language.BUCKETS, dtype=np.float32)
    return language.Model({"germanic": ["de", "en"], "romance": ["fr"]}, {("family:germanic", "family:romance"): (weights, 0.1), ("de", "en"): (weights, 0.2)})


def prints(text):
    flat, counts = WordHashes(lower=True)([text])
    return simhash.word_prints([flat]), simhash.shingle_sets(flat, starts_of(counts), 5)


def searched(text):
    item = (1, *(decontaminate.word_hashes()([half])[0] for half in (b"one two three four", b"five six")))
    return decontaminate.Searcher(decontaminate.Index.build([item], 32)).matches([text])


WORK = {
    "hashes": lambda text: WordHashes()([text]),
    "fingerprint": lambda text: simhash.fingerprint_of(text, 3),
    "near copies": prints,
    "language": lambda text: machines().predict([text]),
    "toxicity": toxicity.distinct_words,
    "decontamination": searched,
    "language model": lambda text: lmscore.pair_hashes(*lmscore.token_hashes([text], WordHashes(lower=True))),
}


@pytest.mark.parametrize("name", WORK)
def test_memory_of_a_long_text(text, name):
    assert peak(lambda: WORK[name](text)) < 12 * len(text) + (64 << 20)


def test_one_endless_word():
    word = b"x" * (5 << 20)
    assert len(WordHashes()([word])[0]) == 1 and simhash.fingerprint_of(word, 3) == simhash.fingerprint_of(b" " + word + b"\n", 3)
    assert peak(lambda: WordHashes()([word + b" y"])) < 4 * len(word) + (32 << 20)  # tables of a fixed size beside it
