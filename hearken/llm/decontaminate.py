"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND, then verified.

The items are the indexed documents, those of like length in one index; each passage of a training text is a query.  For every
term the index keeps its largest impact, and its largest impact in each block of items.  Passages whose blocks all stay below the
threshold are set aside for a whole batch at once; in the others WAND moves a cursor through each term's postings, picks the
first item that the terms' bounds allow, and skips the block if its own bounds do not.  Impacts are divided by the item's
score against itself, so one threshold fits all items: 1 means that every term of the item occurs in the passage.  A hit counts
once enough word pairs of both the question and the answer stand in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.llm.common import WordHashes, as_bytes, in_slices, mix, named, numbered, pieces, sent_to_workers, starts_of

#: Parameters of BM25; share of an item's own score that retrieves it; share of word pairs that verifies a part.
K1, B, RETRIEVE, VERIFY = 1.2, 0.75, 0.6, 0.5
#: What rounding may take from a bound.
SLACK = 1e-3
#: Text bytes per index; a larger benchmark is searched in several.  Blocks per index.  Words that a passage advances at least.
INDEX_BYTES, BLOCKS, STRIDE = 8 << 20, 64, 32
MATCH = "array<struct<item_id:bigint,start:bigint,bm25:double,question_overlap:double,answer_overlap:double>>"


#: Bytes of a word that do not count: ASCII characters other than letters and digits.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def lowered(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in as_bytes(pc.utf8_lower(column))]


def word_hashes() -> WordHashes:
    """Hashes of words in lower case without marks; 0 for bare marks."""
    return WordHashes(skip=MARKS)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence or line; where there is one only, the last third of the words."""
    ends = [m.end() for m in re.finditer(r"(?:[.?!:]\s+|\n)", text.strip())]
    if ends:
        return text.strip()[: ends[-1]], text.strip()[ends[-1] :]
    found = text.split()
    cut = len(found) - len(found) // 3
    return " ".join(found[:cut]), " ".join(found[cut:])


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of neighbouring words; of a single word, that of the word with itself."""
    left, right = (words[:-1], words[1:]) if len(words) > 1 else (words, words)
    with np.errstate(over="ignore"):
        return np.unique(mix(left * np.uint64(0x9FB21C651E98DF25) + right))


@dataclass
class Index:
    """Postings by term (items in block order), largest impacts by term and block, and each item's word pairs.

    The largest impacts are kept for the blocks that a term occurs in; all arrays are as long as the items' words at most.
    """

    ids: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_size: int
    block_offsets: np.ndarray
    block_at: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    pairs: list[tuple[np.ndarray, np.ndarray]]
    stride: int

    @classmethod
    def build(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], stride: int) -> "Index":
        """From (item, hashes of the question's words, hashes of the answer's); ``stride`` is no shorter than any item."""
        rows = sorted(rows, key=lambda r: (len(r[1]) + len(r[2]), r[0]))
        n, lengths = len(rows), np.array([len(q) + len(a) for _, q, a in rows], dtype=float)
        words, owner = np.concatenate([h for _, q, a in rows for h in (q, a)]), np.repeat(np.arange(n), lengths.astype(int))
        hashes, term = np.unique(words, return_inverse=True)
        key, tf = np.unique(term * n + owner, return_counts=True)
        term, owner = key // n, key % n
        df = np.bincount(term, minlength=len(hashes))
        impact = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / lengths.mean()))
        impact /= np.bincount(owner, weights=impact, minlength=n)[owner]
        size = max(1, -(-n // BLOCKS))
        block, first = np.unique(term * (BLOCKS + 1) + owner // size, return_index=True)
        block_max = np.nextafter(np.maximum.reduceat(impact, first).astype(np.float32), np.float32(np.inf))
        starts = np.searchsorted(block // (BLOCKS + 1), np.arange(len(hashes) + 1))
        return cls(
            np.array([i for i, _, _ in rows], dtype=np.int64), hashes, np.searchsorted(term, np.arange(len(hashes) + 1)), owner, impact, size, starts, block % (BLOCKS + 1), block_max,
            np.maximum.reduceat(block_max, starts[:-1]), [(pair_hashes(q), pair_hashes(a)) for _, q, a in rows], stride,
        )

    def block_bounds(self, terms: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(n, BLOCKS): the sums of the largest impacts in each block over the terms of each owner."""
        size = self.block_offsets[terms + 1] - self.block_offsets[terms]
        at = np.repeat(self.block_offsets[terms] - starts_of(size)[:-1], size) + np.arange(int(size.sum()))
        return np.bincount(np.repeat(owner, size) * BLOCKS + self.block_at[at], weights=self.block_max[at], minlength=n * BLOCKS).reshape(n, BLOCKS)

    def retrieved(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of all items at the threshold or above for one passage of distinct terms, by block-max WAND."""
        bound = self.block_bounds(terms, np.zeros(len(terms), dtype=np.int64), 1)[0]
        postings = [(self.items[a:b], self.impacts[a:b]) for a, b in zip(self.offsets[terms].tolist(), self.offsets[terms + 1].tolist())]
        most, at = self.term_max[terms].astype(np.float64), np.zeros(len(terms), dtype=np.int64)
        now, end, found = np.array([p[0] for p, _ in postings]), len(self.ids), []
        while True:
            order = np.argsort(now, kind="stable")
            reached = np.cumsum(most[order]) >= RETRIEVE - SLACK
            pivot = int(now[order[int(reached.argmax())]]) if reached.any() else end
            if pivot >= end:
                return found
            block = pivot // self.block_size
            if bound[block] < RETRIEVE - SLACK:
                target = min(end, (block + 1) * self.block_size)  # no item of this block can pass
            elif now[order[0]] == pivot:
                here = np.flatnonzero(now == pivot)
                score = float(sum(postings[t][1][at[t]] for t in here))
                if score >= RETRIEVE - 1e-9:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for t in np.flatnonzero(now < target).tolist():
                at[t] += np.searchsorted(postings[t][0][at[t] :], target)
                now[t] = postings[t][0][at[t]] if at[t] < len(postings[t][0]) else end


class Searcher:
    """Finds the items in texts."""

    def __init__(self, index: Index):
        self.index, self.hashes = index, word_hashes()

    def passages(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words but bare marks with the texts' bounds; bounds of each text's stretches of ``stride`` words;
        their distinct terms with bounds."""
        stride, known = self.index.stride, self.index.hashes
        flat, counts = self.hashes(texts)
        real = flat != 0
        bounds = np.concatenate(([0], np.cumsum(real)))[starts_of(counts)]
        flat = flat[real]
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        sizes = np.diff(bounds)
        first = starts_of(-(-sizes // stride))
        hit = np.flatnonzero(known[at] == flat)
        owner = np.repeat(np.arange(len(texts)), sizes)[hit]
        stretch = first[owner] + (hit - bounds[owner]) // stride
        key = np.unique(stretch * len(known) + at[hit])
        return flat, bounds, first, key % len(known), np.searchsorted(key, np.arange(int(first[-1]) + 1) * len(known))

    def matches(self, texts: list[bytes]) -> list[list[tuple]]:
        index = self.index
        found: list[dict[int, tuple]] = [{} for _ in texts]
        words, begins, first, terms, bounds = self.passages(texts)
        best = np.concatenate(([0.0], np.cumsum(index.term_max[terms], dtype=np.float64)))[bounds]
        alone = np.append(np.diff(best), 0.0)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        follows = np.concatenate((owner[1:] == owner[:-1], [False])) if len(owner) else np.zeros(0, bool)
        # A passage is a stretch and the next one of the same text.  Bounds over both may count a term twice, which only raises
        # them; the few passages that pass are searched with their distinct terms.
        likely = np.flatnonzero(alone[:-1] + np.where(follows, alone[1:], 0) >= RETRIEVE - SLACK)
        for p in likely[self.open_blocks(likely, follows, terms, bounds)].tolist():
            own = terms[bounds[p] : bounds[p + 1]]
            if follows[p]:
                own = np.union1d(own, terms[bounds[p + 1] : bounds[p + 2]])
            start = int(p - first[owner[p]]) * index.stride
            passage = words[begins[owner[p]] + start : min(begins[owner[p]] + start + 2 * index.stride, begins[owner[p] + 1])]
            seen = None
            for item, score in index.retrieved(own):
                if seen is None:
                    with np.errstate(over="ignore"):
                        seen = np.union1d(pair_hashes(passage), mix(passage * np.uint64(0x9FB21C651E98DF25) + passage))
                question, answer = (len(np.intersect1d(part, seen, assume_unique=True)) / len(part) if len(part) else 1.0 for part in index.pairs[item])
                if question >= VERIFY and answer >= VERIFY and score > found[owner[p]].get(item, (0, -1.0))[1]:
                    found[owner[p]][item] = (start, score, question, answer)
        return [sorted((int(index.ids[i]), *m) for i, m in f.items()) for f in found]

    def open_blocks(self, likely: np.ndarray, follows: np.ndarray, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which of the likely passages have a block that their largest impacts there can bring over the threshold."""
        out = np.zeros(len(likely), dtype=bool)
        for at in range(0, len(likely), 1024):
            part = likely[at : at + 1024]
            wanted = np.unique(np.concatenate((part, part[follows[part]] + 1)))
            size = bounds[wanted + 1] - bounds[wanted]
            own = terms[np.repeat(bounds[wanted] - starts_of(size)[:-1], size) + np.arange(int(size.sum()))]
            sums = self.index.block_bounds(own, np.repeat(np.arange(len(wanted)), size), len(wanted))
            total = sums[np.searchsorted(wanted, part)] + np.where(follows[part][:, None], sums[np.minimum(np.searchsorted(wanted, part + 1), len(wanted) - 1)], 0)
            out[at : at + 1024] = total.max(axis=1) >= RETRIEVE - SLACK
        return out


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of the items, one after the other: by length, so that passages suit their items, and of about ``INDEX_BYTES`` at most.

    Lengths go by powers of two, from ``STRIDE`` words on.  Items with null id or without words are left out.  The driver holds
    one index at a time.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    n_words = F.size(F.split(F.trim("text"), r"\s+"))
    sized = rows.withColumn("class", F.when(n_words <= STRIDE, 0).otherwise(F.ceil(F.log2(n_words / STRIDE) - 1e-9)).cast("int"))
    held = sized.groupBy("class").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("class").collect()  # a row per power of two
    for of in held:
        parts = max(1, -(-of["bytes"] // INDEX_BYTES))
        for k in range(parts):
            own = sized.where((F.col("class") == of["class"]) & (F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)).select("item_id", "text").collect()
            halves = [half for r in own for half in question_and_answer(r.text)]
            flat, counts = word_hashes()(lowered(pa.array(halves, pa.string())))
            cuts = starts_of(counts)
            split = [flat[a:b][flat[a:b] != 0] for a, b in zip(cuts[:-1], cuts[1:])]
            parsed = [(r.item_id, split[2 * i], split[2 * i + 1]) for i, r in enumerate(own) if len(split[2 * i]) or len(split[2 * i + 1])]
            if parsed:
                yield Index.build(parsed, max(STRIDE << of["class"], max(len(q) + len(a) for _, q, a in parsed)))


def matched(docs: DataFrame, of: Iterable[Index], text_at: str) -> DataFrame:
    """``docs`` with the column ``matches``: those of all indexes, which one worker searches in turn."""
    sent = [sent_to_workers(docs.sparkSession, index) for index in of]  # INDEX_BYTES of items each, but for a single longer one
    at = docs.columns.index(text_at)
    names = ["item_id", "start", "bm25", "question_overlap", "answer_overlap"]
    kind = pa.list_(pa.struct(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [Searcher(index()) for index in sent]
        for batch in in_slices(batches):
            texts = lowered(batch.column(at).cast(pa.string()))
            rows = [chain(*r) for part in pieces(texts) for r in zip(*(s.matches(texts[part]) for s in searchers))] if searchers else [()] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[dict(zip(names, m)) for m in r] for r in rows], kind)], [*batch.schema.names, "matches"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("matches", T._parse_datatype_string(MATCH))]))


def search(docs: DataFrame, index: Index, text_col: str = "text", out: str = "matches") -> DataFrame:
    """``docs`` with one more column ``out``, in place of one of that name: the verified items of each text, best passage each.

    ``start`` counts words that are not bare marks.  Null and empty texts match nothing.  Items with equal texts all match; of
    passages that score the same the first counts.  All other columns pass through, whatever their names, repeated rows too.
    """
    return named(matched(numbered(docs), [index], f"_{docs.columns.index(text_col)}"), docs, {"matches": out})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and verified item: doc_id, item_id, start, bm25, question_overlap, answer_overlap.

    Null and empty texts and items match nothing; a document with a null id is reported with it.  Repeated rows are each
    reported, and so are items with equal texts.  Other columns are not read.  Empty tables give an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, bm25 double, question_overlap double, answer_overlap double")
    for index in indexes(benchmark):
        found = found.unionByName(matched(narrow, [index], "text").select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*"))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged; no shuffle.

    Rows with null or empty texts stay, repeated rows each, and all rows where the benchmark is empty.  Columns pass through,
    whatever their names.
    """
    flat, at = numbered(docs), f"_{docs.columns.index(text_col)}"
    return named(matched(flat, indexes(benchmark), at).where(F.size("matches") == 0).drop("matches"), docs)
