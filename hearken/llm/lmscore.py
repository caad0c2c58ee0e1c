"""Language-model scoring with a log-frequency Bloom filter.

Training counts of single tokens and token pairs are summed per segment of the hash space.  Each segment's reducer keeps its exact
token counts and writes its own stretch of the filter, in which a gram with quantised count q is present at levels 1 to q.  A
stretch has as many bits as its entries need for one stated error, whatever the input.  The filter grows with the input and
stays in its segments: pieces of text send their distinct grams to the segments and get levels back; a count is read by
probing level after level until one is missing or the segment's largest is reached.

The ``HEAD`` most frequent tokens travel in a table of that size; the exact counts of other tokens come back with the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import WordHashes, as_bytes, dropped, mix, pieces, released, starts_of, stored, sum_rows

#: Tokens in the broadcast table of exact counts, probes per level, error per level, levels per doubling of a count.
HEAD, PROBES, ERROR, PER_DOUBLING = 65_536, 4, 0.02, 2
#: Weight of the pair estimate against the single-token estimate.
PAIR_WEIGHT = 0.6
#: Distinct grams that a task gathers before it hands them on, text bytes per segment, and text bytes per piece.
GATHER, SEGMENT_BYTES, PIECE_BYTES = 2_000_000, 8 << 20, 8 << 20
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(blobs: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end) and the bounds of the texts."""
    found, counts = hashes(blobs)
    bounds = starts_of(counts + 1)
    flat = np.full(int(bounds[-1]), END)
    flat[np.arange(len(found)) + np.repeat(np.arange(len(blobs)), counts)] = found
    return flat, bounds


def pair_hashes(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token with its predecessor, and the predecessors."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9FB21C651E98DF25) + tokens), before


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with their counts added up."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts, first)


def planes(values: np.ndarray) -> bytes:
    """The bytes of all values by their significance: those that are mostly alike lie together and compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps(ordered: np.ndarray) -> bytes:
    return planes(np.diff(ordered, prepend=ordered.dtype.type(0)))


def from_steps(blob: bytes, kind: type) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(from_planes(blob, kind), dtype=kind)


class Segments:
    """A power of two of segments of the hash space; inside one, a gram goes by its next 32 bits.

    A segment's some million grams share them by chance in less than one case of a thousand, far below the filter's error.
    """

    def __init__(self, text_bytes: int):
        self.log2 = max(4, min(30, (text_bytes // SEGMENT_BYTES).bit_length()))

    def of(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.log2)).astype(np.int64)

    def inner(self, grams: np.ndarray) -> np.ndarray:
        return ((grams >> np.uint64(32 - self.log2)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def cuts(self, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments that occur in ordered grams, and where each begins, with the end."""
        held, first = np.unique(self.of(ordered), return_index=True)
        return held, np.append(first, len(ordered))


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(PER_DOUBLING * np.log2(np.maximum(1, counts.astype(np.float64))) + 1e-9).astype(np.int64)


def place(grams: np.ndarray, level: int, probe: int, n_bits: int) -> np.ndarray:
    """The bit that each gram has at a level, for one of its probes."""
    with np.errstate(over="ignore"):
        seed = np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return mix(grams.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + seed) % np.uint64(n_bits)


def filled(grams: np.ndarray, q: np.ndarray) -> bytes:
    """A segment's bits for grams of quantised counts ``q``: as many as keep the error per level at ``ERROR``."""
    per_entry = -PROBES / np.log(1 - ERROR ** (1 / PROBES))
    bits = np.zeros(8 * max(8, int(np.ceil(per_entry * q.sum() / 8))), dtype=np.uint8)
    level = 1
    while len(grams):
        for probe in range(PROBES):
            bits[place(grams, level, probe, len(bits))] = 1
        keep = q > level
        grams, q, level = grams[keep], q[keep], level + 1
    return np.packbits(bits, bitorder="little").tobytes()


def levels(bits: np.ndarray, grams: np.ndarray, top: int) -> np.ndarray:
    """Quantised counts by probing, 0 for what is absent; no level above ``top`` is stored."""
    out, alive, level = np.zeros(len(grams), dtype=np.uint8), np.arange(len(grams)), 1
    while len(alive) and level <= top:
        for probe in range(PROBES):
            at = place(grams[alive], level, probe, 8 * len(bits))
            alive = alive[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        out[alive] = level
        level += 1
    return out


def log10(level: dict[str, np.ndarray], total: int, distinct: int) -> np.ndarray:
    """log10 of each token's smoothed probability, from the levels of the tokens, their predecessors and the pairs.

    A quantised count stands for the smallest count of its class in a numerator and for the largest in a denominator, so
    the probabilities after a context do not add up to more than one but for false positives.
    """
    low = lambda q: np.where(q > 0, 2.0 ** ((q.astype(np.float64) - 1) / PER_DOUBLING), 0.0)
    alone = (low(level["token"]) + 1) / (total + distinct + 1)
    after = np.minimum(1.0, low(level["pair"]) / 2.0 ** (level["before"].astype(np.float64) / PER_DOUBLING))
    return np.log10(PAIR_WEIGHT * after + (1 - PAIR_WEIGHT) * alone)


def learn(docs: DataFrame, text_col: str, segments: Segments) -> DataFrame:
    """(segment, bits, top, tokens, counts, total, distinct): each segment's part of the filter, its largest level, its exact
    token counts and their sums; one pass and one shuffle."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(lower=True), [[], []], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows: dict[int, list] = {}
            for kind, part in enumerate(held):
                grams, counts = summed(np.concatenate([h for h, _ in part]), np.concatenate([c for _, c in part]))
                found, cuts = segments.cuts(grams)
                for s, a, b in zip(found.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    row = rows.setdefault(s, [s, b"", b"", b"", b""])
                    row[1 + 2 * kind : 3 + 2 * kind] = steps(grams[a:b] if kind == 0 else segments.inner(grams[a:b])), planes(counts[a:b].astype(np.uint32))
            columns = list(zip(*rows.values()))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["segment", "singles", "single_counts", "pairs", "pair_counts"])

        for batch in batches:
            texts = [b or b"" for b in as_bytes(batch.column(0))]
            for part in pieces(texts):
                tokens, bounds = token_hashes(texts[part], hashes)
                starts = np.full(part.stop - part.start, START)
                for kind, found in enumerate((np.concatenate((tokens, starts)), pair_hashes(tokens, bounds)[0])):
                    held[kind].append(summed(found, np.ones(len(found), dtype=np.uint64)))
                    size += len(held[kind][-1][0])
                if size > GATHER:
                    yield from out()
                    held, size = [[], []], 0
        if size:
            yield from out()

    def build(group: pa.Table) -> pa.Table:
        def of(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            grams = [from_steps(b, kind) for b in group.column(name).to_pylist() if b]
            counts = [from_planes(b, np.uint32).astype(np.uint64) for b in group.column(f"{name[:-1]}_counts").to_pylist() if b]
            return summed(np.concatenate([np.zeros(0, kind), *grams]), np.concatenate([np.zeros(0, np.uint64), *counts]))

        (singles, counts), (pairs, pair_counts) = of("singles", np.uint64), of("pairs", np.uint32)
        q = np.concatenate((quantised(counts), quantised(pair_counts)))
        bits = filled(np.concatenate((segments.inner(singles), pairs)), q)
        real = singles != START
        return pa.table({"segment": [group.column("segment")[0].as_py()], "bits": pa.array([bits], pa.binary()), "top": [int(q.max(initial=0))], "tokens": pa.array([steps(singles[real])], pa.binary()), "counts": pa.array([planes(counts[real])], pa.binary()), "total": [int(counts[real].sum())], "distinct": [int(real.sum())]})

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    made = texts.mapInArrow(gather, "segment long, singles binary, single_counts binary, pairs binary, pair_counts binary")
    return made.groupBy("segment").applyInArrow(build, "segment long, bits binary, top long, tokens binary, counts binary, total long, distinct long")


def head_of(learned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens in order, with their counts: ``HEAD`` of them at most."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, counts = from_steps(tokens, np.uint64), from_planes(counts, np.uint64).astype(np.int64)
                keep = np.argsort(-counts, kind="stable")[:HEAD]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], ["token", "count"])

    head = learned.select("tokens", "counts").mapInArrow(most, "token long, count long").orderBy(F.desc("count"), "token").limit(HEAD).toArrow()
    tokens = head.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], head.column("count").to_numpy()[order]


def place_of(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in an ordered array, and whether it does."""
    if not len(ordered):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row; ``train`` marks the rows to learn from.

    A null text is empty: it has the end token only.  Without training rows every token is unknown, base_score is 0 (a table
    without entries gives each token the chance 1 of 1) and score follows the smoothing alone.  Repeated rows each count and
    are each scored.  Other columns are not read.  An empty table gives an empty result.
    """
    import zstandard

    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    segments = Segments(text_bytes)
    learned = stored(learn(docs.where(train), text_col, segments))
    released(spark)
    total, distinct = map(int, learned.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first())
    sent = spark.sparkContext.broadcast(head_of(learned))  # HEAD tokens at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [b or b"" for b in as_bytes(batch.column(2))]
            for part in pieces(texts, PIECE_BYTES):
                rows = batch.column(0)[part.start : part.stop].to_pylist()
                sizes = np.array([len(t) for t in texts[part]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:1], pa.int64()), pa.array([batch.column(1)[part.start : part.stop].to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([press.compress(b"".join(texts[part]))], pa.binary())], ["piece", "ids", "sizes", "zipped"])

    def read(sizes: np.ndarray, zipped: bytes) -> tuple[np.ndarray, np.ndarray]:
        ends = starts_of(sizes).tolist()
        whole = zstandard.ZstdDecompressor().decompress(zipped, max_output_size=max(1, ends[-1]))
        return token_hashes([whole[a:b] for a, b in zip(ends[:-1], ends[1:])], WordHashes(lower=True))

    def wanted(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct singles outside the head and the distinct pairs of a piece, in order."""
        singles = np.unique(np.concatenate((tokens, [START])))
        return singles[~place_of(singles, sent.value[0])[1]], np.unique(pair_hashes(tokens, bounds)[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sizes, zipped in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rows: dict[int, list] = {}
                for kind, grams in enumerate(wanted(*read(sizes.values.to_numpy(), zipped.as_py()))):
                    found, cuts = segments.cuts(grams)
                    for s, a, b in zip(found.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                        rows.setdefault(s, [s, piece, b"", b""])[2 + kind] = steps(grams[a:b] if kind == 0 else segments.inner(grams[a:b]))
                columns = list(zip(*rows.values()))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["segment", "piece", "singles", "pairs"])

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        singles = [from_steps(b, np.uint64) for b in asked.column("singles").to_pylist()]
        pairs = [from_steps(b, np.uint32) for b in asked.column("pairs").to_pylist()]
        flat = np.concatenate([np.zeros(0, np.uint64), *singles])
        level, counts = np.zeros(len(flat) + sum(map(len, pairs)), dtype=np.uint8), np.zeros(len(flat), dtype=np.uint64)
        if part.num_rows:
            bits = np.frombuffer(part.column("bits")[0].as_buffer(), dtype=np.uint8)
            level = levels(bits, np.concatenate([segments.inner(flat), *pairs]), part.column("top")[0].as_py())
            at, known = place_of(flat, from_steps(part.column("tokens")[0].as_py(), np.uint64))
            held = from_planes(part.column("counts")[0].as_py(), np.uint64)
            counts = np.where(known, held[at], 0).astype(np.uint64) if len(held) else counts
        ends, pair_ends = starts_of(np.array([len(s) for s in singles])).tolist(), (len(flat) + starts_of(np.array([len(p) for p in pairs]))).tolist()
        out = [(level[a:b].tobytes(), planes(counts[a:b]), level[c:d].tobytes()) for a, b, c, d in zip(ends[:-1], ends[1:], pair_ends[:-1], pair_ends[1:])]
        return pa.table({"piece": asked.column("piece"), "segment": asked.column("segment"), **{name: pa.array([r[k] for r in out], pa.binary()) for k, name in enumerate(("single_levels", "single_counts", "pair_levels"))}})

    def finish(held: pa.Table, answers: pa.Table) -> pa.Table:
        head, head_counts = sent.value
        tokens, bounds = read(held.column("sizes")[0].values.to_numpy(), held.column("zipped")[0].as_py())
        pairs, before = pair_hashes(tokens, bounds)
        singles, distinct_pairs = wanted(tokens, bounds)
        answers = answers.sort_by("segment")
        told = {name: b"".join(answers.column(name).to_pylist()) for name in ("single_levels", "pair_levels")}
        single_levels = np.frombuffer(told["single_levels"], dtype=np.uint8)
        single_counts = np.concatenate([np.zeros(0, np.uint64), *(from_planes(b, np.uint64) for b in answers.column("single_counts").to_pylist())])
        # One table of all singles of the piece: the head's and those asked for.
        known, order = np.concatenate((head, singles)), np.argsort(np.concatenate((head, singles)), kind="stable")
        known, level_of = known[order], np.concatenate((quantised(head_counts), single_levels))[order]
        count_of = np.concatenate((head_counts.astype(np.float64), single_counts.astype(np.float64)))[order]
        at = np.searchsorted(known, tokens)
        level = {"token": level_of[at], "before": level_of[np.searchsorted(known, before)], "pair": np.frombuffer(told["pair_levels"], dtype=np.uint8)[np.searchsorted(distinct_pairs, pairs)]}
        count = count_of[at]
        return pa.table({
            "doc_id": pa.array(held.column("ids")[0].as_py(), pa.int64()), "n_tokens": np.diff(bounds).astype(np.int64), "n_known": sum_rows((count > 0).astype(np.float64), bounds).astype(np.int64),
            "base": sum_rows(np.log10(count + 1), bounds), "score": sum_rows(log10(level, total, distinct), bounds),
        })

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = stored(given.mapInArrow(cut, "piece long, ids array<long>, sizes array<long>, zipped binary"))
    asked = held.select("piece", "sizes", "zipped").mapInArrow(ask, "segment long, piece long, singles binary, pairs binary")
    parts = learned.select("segment", "bits", "top", "tokens", "counts")
    answers = stored(asked.groupBy("segment").cogroup(parts.groupBy("segment")).applyInArrow(answer, "piece long, segment long, single_levels binary, single_counts binary, pair_levels binary"))
    dropped(learned)
    released(spark)
    done = held.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return done.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
