"""WordPiece tokens: the longest pieces of a vocabulary, from the left of each word, found by a walk down a trie."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hearken.session import sent_to_workers

#: Marks a piece that goes on with a word.
MARK = "##"
# Special tokens, none of which is decoded, and spaces that decoding takes out again.
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
CLEANED = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
#: Words whose tokens a task remembers.
REMEMBERED = 200_000
END = ""


def stands_alone(c: str) -> bool:
    """Punctuation, marks of ASCII, and ideographs are words by themselves."""
    if c.isascii():
        return not c.isalnum() and c.isprintable() and c != " "
    return unicodedata.category(c)[0] == "P" or 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF


def basic_words(text: str) -> Iterator[str]:
    for word in text.split():
        start = 0
        for k, c in enumerate(word):
            if stands_alone(c):
                if start < k:
                    yield word[start:k]
                yield c
                start = k + 1
        if start < len(word):
            yield word[start:]


def trie_of(pieces: Iterable[tuple[str, int]]) -> dict:
    """Nested by character; the id of a piece that ends stands under the empty string."""
    root: dict = {}
    for piece, number in pieces:
        at = root
        for c in piece:
            at = at.setdefault(c, {})
        at[END] = number
    return root


@dataclass
class WordPiece:
    """A tokenizer over a vocabulary in the order of its ids.

    A word of more than ``longest`` characters, or one that no pieces make up, is the unknown token.  ``lower`` lower-cases
    first; ``clean`` takes out the spaces before punctuation when decoding.
    """

    vocabulary: list[str]
    lower: bool = False
    clean: bool = True
    longest: int = 100
    unknown: str = "[UNK]"
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if len(set(self.vocabulary)) < len(self.vocabulary):
            raise ValueError("a vocabulary must not hold a piece twice")
        if self.unknown not in self.vocabulary:
            raise ValueError(f"a vocabulary needs {self.unknown}")
        special = {*SPECIAL, self.unknown}
        plain = [(p, k) for k, p in enumerate(self.vocabulary) if p not in special]
        self.first = trie_of((p, k) for p, k in plain if not p.startswith(MARK) or p == MARK)
        self.later = trie_of((p[len(MARK) :], k) for p, k in plain if p.startswith(MARK) and p != MARK)
        self.none = self.vocabulary.index(self.unknown)
        self.silent = {k for k, p in enumerate(self.vocabulary) if p in special}

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **options) -> WordPiece:
        """A vocabulary with a piece per line, from any place that Spark reads."""
        (text,) = spark.read.text(path, wholetext=True).first()
        return cls(text.rstrip("\n").split("\n"), **options)

    def of_word(self, word: str) -> tuple[int, ...]:
        if len(word) > self.longest:
            return (self.none,)
        found, at, trie = [], 0, self.first
        while at < len(word):
            node, best, end, k = trie, None, at, at
            while k < len(word) and (node := node.get(word[k])) is not None:
                k += 1
                if END in node:
                    best, end = node[END], k
            if best is None:
                return (self.none,)
            found.append(best)
            at, trie = end, self.later
        return tuple(found)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for word in basic_words(text.lower() if self.lower else text):
            if word not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = self.of_word(word)
            out += self.known[word]
        return out

    def text(self, ids: Iterable[int]) -> str:
        """Pieces joined again; special tokens and ids that the vocabulary lacks are left out."""
        said = " ".join([self.vocabulary[k] for k in ids if k not in self.silent and 0 <= k < len(self.vocabulary)]).replace(f" {MARK}", "")
        if self.clean:
            for spaced, closed in CLEANED:
                said = said.replace(spaced, closed)
        return said

    def tile_texts(self, text: str, size: int) -> list[str]:
        """The text itself if it has no more than ``size`` tokens; else what each so many tokens say, blank ones left out."""
        ids = self.ids(text)
        if len(ids) <= size:
            return [text]
        return [said for at in range(0, len(ids), size) if (said := self.text(ids[at : at + size])).strip()]

    def as_step(self, kind: str, made, arrow: pa.DataType):
        """An Arrow function of one column; the tokenizer is broadcast once."""
        blank = WordPiece(self.vocabulary, self.lower, self.clean, self.longest, self.unknown)
        sent = sent_to_workers(SparkSession.active(), blank)

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = sent()
            for column in columns:
                yield pa.array([None if x is None else made(own, x) for x in column.to_pylist()], arrow)

        return F.arrow_udf(run, kind)

    def encode(self, text: Column) -> Column:
        """array<int> of a text's tokens, without marks around them."""
        return self.as_step("array<int>", lambda own, x: own.ids(x), pa.list_(pa.int32()))(text)

    def decode(self, ids: Column) -> Column:
        return self.as_step("string", lambda own, x: own.text(x), pa.string())(ids)

    def tiles(self, text: Column, max_length: int = 128) -> Column:
        """Texts of at most max_length - 2 tokens each, as ``token_tiles`` with words for tokens; a step of its own in the plan."""
        size = max_length - 2
        if size <= 0:
            raise ValueError("max_length must be greater than 2")
        return self.as_step("array<string>", lambda own, x: own.tile_texts(x, size), pa.list_(pa.string()))(text)
