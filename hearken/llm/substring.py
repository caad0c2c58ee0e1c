"""Substring deduplication by recompression: words inside a window of 13 that an earlier document also has are removed.

1. Texts are written once, compressed, with a row number.
2. Every window is keyed by the highest recompressed symbol that rests inside it (see ``recompress``).  Neighbouring windows
   share keys, so a stretch of windows costs one entry.  Keys that two rows share reveal where repeats can be.
3. Only windows on shared keys are compared, by a 96-bit digest of the words themselves: each learns the smallest document
   with its words.  That any two different windows of 1e13 share a digest has a chance below one in a thousand.
4. The flagged windows return to their texts, and the words that they cover are removed.

Entries travel in packed, sorted columns per bucket of the hash space.  A task first settles what it can see itself: of all
windows with one hash in its batch only those of the smallest document are sent on, so a passage in a third of all
documents sends one entry per batch and no bucket gathers a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import WordHashes, as_bytes, dropped, pieces, released, starts_of, stored
from hearken.llm.recompress import windows

#: Words per window, entries that a task gathers before it hands them on, text bytes per bucket, words per piece of a text.
WIDTH, GATHER, BUCKET_BYTES, PIECE = 13, 1_500_000, 8 << 20, 1 << 18
#: Stands for a null id: larger than all others, so such rows yield to every row with an id.
NO_ID = (1 << 63) - 1


def planes(column: np.ndarray) -> bytes:
    return column.view(np.uint8).reshape(-1, column.itemsize).T.tobytes()


def from_planes(blob: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob[: n * size], dtype=np.uint8).reshape(size, n).T).view(kind).ravel()


def packed(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(map(planes, columns))


def unpacked(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, view, out = int.from_bytes(blob[:8], "little"), memoryview(blob)[8:], []
    for kind in kinds:
        out.append(from_planes(view, kind, n))
        view = view[n * np.dtype(kind).itemsize :]
    return out


def windows_of(texts: list[bytes], hashes: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, key) of all windows of the texts.

    Long texts are cut into pieces that overlap by width - 1 words; keys depend on a window's words alone, so the cuts leave no
    trace.
    """
    flat, counts = hashes(texts)
    bounds, out = starts_of(counts), []
    # Pieces: (text, first word, last word), those of one group next to each other.
    pieces_of, size = [], 0
    for i in range(len(texts)):
        for at in range(0, max(0, int(counts[i]) - width + 1), PIECE - width + 1):
            pieces_of.append((i, at, min(int(counts[i]), at + PIECE)))
    groups: list[list[tuple[int, int, int]]] = [[]]
    for piece in pieces_of:
        if size + piece[2] - piece[1] > PIECE and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(piece)
        size += piece[2] - piece[1]
    for group in filter(None, groups):
        text, first, last = (np.array(c) for c in zip(*group))
        sizes = last - first
        offset = starts_of(sizes)
        piece = np.repeat(np.arange(len(group)), sizes)
        words = flat[np.arange(int(offset[-1])) - offset[piece] + (bounds[text] + first)[piece]]
        starts, key = windows(words, piece, width)
        which = piece[starts]
        out.append((text[which], starts - offset[which] + first[which], key))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def groups_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal keys, and the run of each entry."""
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(sorted_keys)]))))


def equal_groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``groups_of`` for rows sorted by several columns."""
    change = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    first = np.flatnonzero(np.concatenate(([True], change)))
    return first, np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(columns[0])]))))


def by_bucket(keys: np.ndarray, columns: list[np.ndarray], log2: int) -> Iterator[tuple[int, bytes]]:
    """Packed columns of each bucket that occurs; ``keys`` are sorted and come first in the columns."""
    held, first = np.unique((keys >> np.uint64(64 - log2)).astype(np.int64), return_index=True)
    for b, at, end in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield b, packed([np.ascontiguousarray(c[at:end]) for c in columns])


def by_row(rows: np.ndarray, columns: list[np.ndarray], shift: int) -> Iterator[tuple[int, bytes]]:
    """Packed columns, row numbers first, of each row number or group of 2**shift neighbouring ones."""
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], [c[order] for c in columns]
    if len(rows):
        first, _ = groups_of(rows >> shift)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
            yield int(rows[a] >> shift), packed([np.ascontiguousarray(c[a:b]) for c in (rows, *columns)])


#: Findings travel for 2**GROUP neighbouring rows together, then part.
GROUP = 8
EVIDENCE = "bucket long, sent binary, part long, found binary"


def per_row(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(row, found) from findings (part, found) of groups of rows: one packed value per row."""

    def parted(group: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(unpacked(b, ("<i8", *kinds)) for b in group.column("found").to_pylist()))]
        lines = list(by_row(columns[0], columns[1:], 0))
        return pa.table({"row": pa.array([r for r, _ in lines], pa.int64()), "found": pa.array([f for _, f in lines], pa.binary())})

    return found.groupBy("part").applyInArrow(parted, "row long, found binary")


def batch_of(sent: list[tuple[int, bytes]], found: list[tuple[int, bytes]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries for buckets, and findings, which pass through a bucket that their rows choose."""
    names = ["bucket", "sent", "part", "found"]
    lines = [(b, blob, None, None) for b, blob in sent] + [(part % n_buckets, None, part, blob) for part, blob in found]
    for at in range(0, len(lines), 4096):
        part = list(zip(*lines[at : at + 4096]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary())], names)


def revealed(packed_docs: DataFrame, width: int, log2: int) -> DataFrame:
    """(row, found): stretches of windows (row, start, length) whose symbol two rows share."""
    import zstandard

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip, held, size = WordHashes(), zstandard.ZstdDecompressor(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, row, start, length = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(key, kind="stable")
            key, row, start, length = key[order], row[order], start[order], length[order]
            first, group = groups_of(key)
            shared = (np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first))[group]
            # A key shared inside the batch is settled here; one entry (length 0) tells the others about it.
            send = ~shared
            send[first] = True
            flag = np.where(shared, 0, length).astype(np.uint16)
            yield from batch_of(
                list(by_bucket(key[send], [key[send], row[send], start[send], flag[send]], log2)),
                list(by_row(row[shared], [start[shared], length[shared]], GROUP)), 1 << log2,
            )

        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = [unzip.decompress(b) for b in batch.column(1).to_pylist()]
            for part in pieces(texts):
                text, start, key = windows_of(texts[part], hashes, width)
                if not len(text):
                    continue
                change = np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (start[1:] - start[:-1] != 1)))
                at = np.flatnonzero(change)
                at = np.unique(np.concatenate((at, np.arange(0, len(text), 60_000))))  # lengths fit two bytes
                length = np.diff(np.concatenate((at, [len(text)])))
                held.append((key[at], rows[part][text[at]], start[at].astype(np.uint32), length.astype(np.uint16)))
                size += len(at)
                if size > GATHER:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def settle(group: pa.Table) -> pa.Table:
        lines = [(r, f) for r, f in zip(group.column("part").to_pylist(), group.column("found").to_pylist()) if r is not None]
        blobs = [b for b in group.column("sent").to_pylist() if b is not None]
        if blobs:
            key, row, start, length = (np.concatenate(c) for c in zip(*(unpacked(b, ("<u8", "<i8", "<u4", "<u2")) for b in blobs)))
            order = np.argsort(key, kind="stable")
            key, row, start, length = key[order], row[order], start[order], length[order]
            first, group_of = groups_of(key)
            shared = (np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first))[group_of] & (length > 0)
            lines += by_row(row[shared], [start[shared], length[shared]], GROUP)
        return pa.table({"part": pa.array([r for r, _ in lines], pa.int64()), "found": pa.array([f for _, f in lines], pa.binary())})

    found = packed_docs.select("row", "zipped").mapInArrow(gather, EVIDENCE).groupBy("bucket").applyInArrow(settle, "part long, found binary")
    return per_row(found, ("<u4", "<u2"))


def digests(text: bytes, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests of the windows of words that begin at ``starts``, in two parts."""
    import xxhash

    words = text.split()
    made = b"".join([xxhash.xxh3_128_digest(b" ".join(words[s : s + width])) for s in starts.tolist()])
    return np.frombuffer(made, dtype="<u8")[::2].copy(), np.frombuffer(made, dtype="<u4")[2::4].copy()


def verified(candidates: DataFrame, width: int, log2: int) -> DataFrame:
    """(row, found): starts of windows whose words also start in a document with a smaller id.

    ``candidates``: row, id, zipped and ``found``, the packed findings of ``revealed`` for the row.
    """
    import zstandard

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, held, size = zstandard.ZstdDecompressor(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            own, more, doc, row, start, later = judged([np.concatenate(c) for c in zip(*held)])
            send = ~later
            # One entry per window, document and row goes on, and each place in the row has its own.
            yield from batch_of(
                list(by_bucket(own[send], [own[send], more[send], doc[send], row[send], start[send]], log2)),
                list(by_row(row[later], [start[later]], GROUP)), 1 << log2,
            )

        for batch in batches:
            rows, ids, stretches = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for i, packed_stretches in enumerate(stretches):
                if not packed_stretches:
                    continue
                _, at, length = unpacked(packed_stretches, ("<i8", "<u4", "<u2"))
                begin, end = at.astype(np.int64), at.astype(np.int64) + length
                marks = np.bincount(begin, minlength=int(end.max()) + 1) - np.bincount(end, minlength=int(end.max()) + 1)
                chosen = np.flatnonzero(np.cumsum(marks) > 0)
                own, more = digests(unzip.decompress(batch.column(2)[i].as_py()), chosen, width)
                held.append((own, more, np.full(len(chosen), ids[i]), np.full(len(chosen), rows[i]), chosen.astype(np.uint32)))
                size += len(chosen)
                if size > GATHER:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def judged(columns: list[np.ndarray]) -> list[np.ndarray]:
        """The columns in the order of the digests, and which windows stand in a smaller document too."""
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        first, group = equal_groups(*columns[:2])
        return [*columns, columns[2] > np.minimum.reduceat(columns[2], first)[group]]

    def settle(group: pa.Table) -> pa.Table:
        lines = [(r, f) for r, f in zip(group.column("part").to_pylist(), group.column("found").to_pylist()) if r is not None]
        blobs = [b for b in group.column("sent").to_pylist() if b is not None]
        if blobs:
            _, _, _, row, start, later = judged([np.concatenate(c) for c in zip(*(unpacked(b, ("<u8", "<u4", "<i8", "<i8", "<u4")) for b in blobs))])
            lines += by_row(row[later], [start[later]], GROUP)
        return pa.table({"part": pa.array([r for r, _ in lines], pa.int64()), "found": pa.array([f for _, f in lines], pa.binary())})

    found = candidates.mapInArrow(gather, EVIDENCE).groupBy("bucket").applyInArrow(settle, "part long, found binary")
    return per_row(found, ("<u4",))


def removed_mask(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + width, n), -1)
    return np.cumsum(marks[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text (words joined by one space).

    Windows are judged on the input.  A row with a null id yields to rows with ids and to none without.  Rows with equal ids
    do not remove each other's words.  Texts shorter than a window, empty and null ones lose nothing.  Other columns are not
    read.  An empty table gives an empty result.
    """
    import zstandard

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(b or b"") for b in as_bytes(batch.column(2))], pa.binary())], ["row", "id", "zipped"])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    log2 = max(4, min(40, (total // BUCKET_BYTES).bit_length()))
    whole = stored(given.mapInArrow(zipped, "row long, id long, zipped binary"))

    def with_findings(found: DataFrame) -> DataFrame:
        gathered = found.withColumnRenamed("row", "of_row")
        return whole.join(gathered, whole["row"] == gathered["of_row"], "left").drop("of_row")

    # Each step's findings are written, so that its shuffles can go before the next one's come.
    candidates = stored(revealed(whole, width, log2))
    released(docs.sparkSession)
    flagged = stored(verified(with_findings(candidates), width, log2))
    dropped(candidates)
    released(docs.sparkSession)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, digests, kept_texts = [], [], [], []
            for blob, found in zip(batch.column(2), batch.column(3).to_pylist()):
                words = unzip.decompress(blob.as_py()).split()
                gone = 0
                if found:
                    mask = removed_mask(len(words), unpacked(found, ("<i8", "<u4"))[1].astype(np.int64), width)
                    gone = int(mask.sum())
                    kept = b" ".join([w for w, m in zip(words, mask.tolist()) if not m])
                else:
                    kept = b" ".join(words)
                counts.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = with_findings(flagged).mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    columns = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]
    return done.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), *columns)
