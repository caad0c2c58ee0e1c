"""SimHash near-duplicates: 64-bit fingerprints, linked through vantage-point trees over Hamming distance (see ``vptree``).

``near_duplicates`` links texts by one fingerprint of word shingles alone.  ``near_copies`` finds the texts whose sets of word
shingles are similar enough:

1. Each text becomes a few independent fingerprints over its distinct words.  An edit that leaves four fifths of the five-word
   shingles changes few words, so these fingerprints move few bits, while those of shingles would move too many for a tree.
2. Texts with equal sets of shingles collapse to one node, so groups of exact copies of any size cost one row.
3. For each fingerprint a tree finds the nodes within reach; each leaf returns a minimum spanning forest of its links.
4. Each link is checked on the sets of shingles themselves.
5. Links become components through rounds of large and small stars on DataFrames, each written to the shared folder.
6. What the fingerprints miss is found exactly (``missed``): of texts that are similar enough, the first shingles of both, in one
   order of all, share one.  Only shingles that lie in several components are paired; the pairs are checked as in 4.  First
   each text meets one hub for each of its shingles, so that a dense group is one component before the rest meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm import vptree
from hearken.llm.common import WordHashes, as_bytes, at_place, between_words, dropped, in_slices, mix, named, numbered, pieces, released, sent_to_workers, starts_of, stored

#: Fingerprints per text of ``near_copies`` and the bits in which one of them may differ: more fingerprints and a short reach, as
#: the leaves that a fingerprint visits grow with the power 0.44 of their number at 2 bits and 0.63 at 3.
TABLES, REACH = 12, 2
#: One in so many texts shows which shingles are frequent: those in so many of the drawn ones.  Up to so many come last in the order
#: of shingles, which decides how many pairs are tried, not which are found.
DRAWN, OFTEN, LATE = 32, 4, 65_536
#: Allowed for rounding where a number of shingles meets a bound.
_ROUND = 1e-6
#: A byte's bits, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: An odd number for each place in a shingle.
_TIMES = mix(np.arange(101, 165, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fingerprint_of(text: bytes | None, width: int) -> int:
    """Bits set in more than half of the shingles' hashes, as a signed number; 0 for a text without words."""
    import xxhash

    votes, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for piece in between_words((text or b"").lower()):
        found = tail + piece.split()
        joined = list(map(b" ".join, zip(*(found[k:] for k in range(width)))))
        for at in range(0, len(joined), 1 << 16):
            part = joined[at : at + (1 << 16)]
            votes += bits_of(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), dtype="<u8", count=len(part))).sum(axis=0, dtype=np.int64)
        n, tail = n + len(joined), found[max(0, len(found) - width + 1) :]
    if not n and tail:
        votes, n = bits_of(np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], dtype="<u8"))[0], 1
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; a null text counts as empty, with fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint_of(x, width) for x in as_bytes(batch.column(1))], pa.int64())], ["doc_id", "fp"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest id reachable through links, its own included).

    Null and empty texts share fingerprint 0 and are linked like others.  Repeated rows stay, in the same component.  A row
    with a null id keeps its row and takes the component of the rows with ids that share its fingerprint, null if there are
    none; fingerprints of null ids alone form no link.  Other columns of the input, whatever their names, are not read.
    An empty table gives an empty result.
    """
    marked = stored(fingerprints(docs, id_col, text_col, width))
    named = stored(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    points = named.select(F.lit(0).cast("long").alias("tab"), "fp", F.lit(0).cast("long").alias("then"), F.col("rep").alias("name"), F.lit(0).cast("long").alias("size"))
    found = components(vptree.links(points, 1, reach))
    label = named.join(found, named["rep"] == found["node"], "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "rep").alias("component_id"))
    joined = marked.join(label, marked["fp"] == label["of_fp"], "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of all runs of ``width`` words of each text; of a shorter text, that of the whole text."""

    def summed(part: np.ndarray, n: int) -> np.ndarray:
        total = np.full(max(0, len(part) - n + 1), n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                total += part[k : len(part) - n + 1 + k] * _TIMES[k % len(_TIMES)]
        return mix(total)

    whole = summed(words, width)
    return [np.unique(whole[a : b - width + 1]) if b - a >= width else summed(words[a:b], int(b - a))[: b - a] for a, b in zip(bounds[:-1], bounds[1:])]


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bit is set in each run of at most 255 hashes that starts at ``first``; a byte of a lane counts one bit."""
    return np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], first, axis=0).view(np.uint8).reshape(len(first), 64)


def word_prints(words: list[np.ndarray]) -> np.ndarray:
    """A row of ``TABLES`` fingerprints per text: bits set in more than half of the scrambled hashes of its distinct words."""
    found = [np.unique(w) for w in words]
    sizes = np.array([len(w) for w in found], dtype=np.int64)
    flat = np.concatenate([*found, np.zeros(0, np.uint64)])
    runs = -(-sizes // 255)
    owner = np.repeat(np.arange(len(words)), runs)
    begin = starts_of(sizes)[owner] + 255 * (np.arange(len(owner)) - starts_of(runs)[owner])
    votes = np.zeros((TABLES, len(words), 64), dtype=np.int64)
    for at in range(0, len(owner), 256):
        own, first = owner[at : at + 256], begin[at : at + 256]
        part = flat[first[0] : begin[at + 256] if at + 256 < len(owner) else len(flat)]
        text = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for k in range(TABLES):
            votes[k, own[text]] += np.add.reduceat(bit_counts(mix(part ^ _SEEDS[k]), first - first[0]), text, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > sizes[None, :, None], axis=2, bitorder="little").view("<i8")[:, :, 0].T


def set_names(found: list[np.ndarray]) -> np.ndarray:
    """Equal sets have equal names; 0 is that of the empty one."""
    with np.errstate(over="ignore"):
        return np.array([mix(mix(s).sum(dtype=np.uint64) + np.uint64(len(s)))[()] if len(s) else 0 for s in found], dtype=np.uint64).view(np.int64)


def sets(docs: DataFrame, width: int, of_set) -> DataFrame:
    """(doc_id, node, size, told) of (doc_id, text): one row per input row; texts without words share node 0 and size 0.

    ``of_set`` makes a list of numbers for each of some texts from their sets and words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(lower=True)
        for batch in in_slices(batches):
            texts = [b or b"" for b in as_bytes(batch.column(1))]
            for part in pieces(texts):
                flat, counts = hashes(texts[part])
                bounds = starts_of(counts)
                found = shingle_sets(flat, bounds, width)
                told = of_set(found, [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(set_names(found)), pa.array([len(s) for s in found], pa.int64()), pa.array(told, pa.list_(pa.int64()))], ["doc_id", "node", "size", "told"])

    return docs.mapInArrow(run, "doc_id long, node long, size long, told array<long>")


def whole_sets(found: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    return [s.view(np.int64) for s in found]


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by comparing the sets; only texts in a pair are read for them."""
    asked = stored(nodes.select("node", "rep").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    texts = docs.join(asked.select("rep").hint("shuffle_hash"), F.col("doc_id") == F.col("rep"), "left_semi")
    held = stored(sets(texts, width, whole_sets).select("node", "told").join(asked, "node", "left_semi").groupBy("node").agg(F.first("told").alias("hashes")))
    one = pairs.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")
    both = one.join(held.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    true = stored(both.where(shared * (1 + least) >= least * (F.size("of_a") + F.size("of_b")) - _ROUND).select("a", "b"))
    dropped(asked, held)
    return true


def late_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that are frequent among texts drawn by their ids, the most frequent last."""
    drawn = sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWN)) == 0), width, whole_sets)
    counts = drawn.select(F.explode("told").alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    most = counts.orderBy(F.desc("count"), "h").limit(LATE).collect()  # LATE rows at most
    return np.array([r.h for r in reversed(most)], dtype=np.int64)


def first_shingles(docs: DataFrame, nodes: DataFrame, found: DataFrame, width: int, least: float) -> DataFrame:
    """(h, at, node, size, root): the first shingles of each set, at their places, that lie in several components ``found``.

    A set needs ``least`` of its size in common with a similar one, so it shares one of its first shingles if as many others
    as are fewer than that come after them.
    """
    late = late_shingles(docs, width)
    sent = sent_to_workers(docs.sparkSession, (np.sort(late), np.argsort(late)))  # LATE numbers at most

    def first(found: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
        known, place = sent()
        out = []
        for s in found:
            s = s.view(np.int64)
            at = np.searchsorted(known, s)
            is_late = known[np.minimum(at, len(known) - 1)] == s if len(known) else np.zeros(len(s), dtype=bool)
            s = np.concatenate((s[~is_late], s[is_late][np.argsort(place[at[is_late]])]))
            out.append(s[: len(s) - int(np.ceil(least * len(s) - _ROUND)) + 1])
        return out

    rooted = nodes.where("size > 0").select(F.col("node").alias("of"), "rep").join(found.select(F.col("node").alias("of"), "component"), "of", "left").select("of", "rep", F.coalesce("component", "of").alias("root"))
    own = sets(docs, width, first).join(rooted.hint("shuffle_hash"), (F.col("node") == F.col("of")) & (F.col("doc_id") == F.col("rep")))
    return apart(own.select(F.posexplode("told").alias("at", "h"), "node", "size", "root").select("h", "at", "node", "size", "root"))


def apart(firsts: DataFrame) -> DataFrame:
    """The rows whose shingle lies in several components."""
    on_h = Window.partitionBy("h")
    return stored(firsts.withColumns({"low": F.min("root").over(on_h), "high": F.max("root").over(on_h)}).where("low <> high").drop("low", "high"))


def rooted_again(met: DataFrame, found: DataFrame) -> DataFrame:
    """``met`` by the components ``found``, which are larger."""
    grown = found.select(F.col("node").alias("of"), "component")
    return apart(met.join(grown, F.col("root") == F.col("of"), "left").select("h", "at", "node", "size", F.coalesce("component", "root").alias("root")))


def missed(met: DataFrame, least: float, hubs: bool) -> DataFrame:
    """(a, b): all pairs of nodes of unlike components that can be similar enough, and others; to be checked.

    The least number of shingles in common follows from both sizes.  With as many others as are fewer than that left out at the
    end of each set, one is still shared; so two sets meet in a shingle only where both have it at such a place, and a shingle
    that all sets of a dense group have in their tails pairs none of them.  The shared ones among all first shingles of both,
    and all that come after, must be enough.

    With ``hubs`` each set meets, in place of all others, the one of about its size that has the shingle first: of a dense
    group that is the one with the fewest shingles of its own.  These pairs are two for each first shingle at most.
    """
    own, other = met, met
    if hubs:
        step = -math.log(min(max(least, 0.5), 0.99))  # similar sets are at most one step apart in size
        own = met.withColumn("step", F.floor(F.log("size") / step))
        other = own.groupBy("h", "step").agg(F.min(F.struct("at", "node", "size", "root")).alias("hub")).select("h", "step", "hub.*")
        own = own.withColumn("step", F.explode(F.array("step", F.col("step") - 1)))
    other = other.select(*[F.col(k).alias(f"of_{k}") for k in other.columns])
    enough = F.ceil((least * (F.col("size") + F.col("of_size")) - _ROUND) / (1 + least))
    meet = (F.col("root") != F.col("of_root")) & (F.col("at") <= F.col("size") - enough) & (F.col("of_at") <= F.col("of_size") - enough)
    meet &= (F.col("step") == F.col("of_step")) if hubs else (F.col("node") < F.col("of_node"))
    both = own.join(other, F.col("h") == F.col("of_h")).where(meet)
    pairs = both.select(F.col("node").alias("a"), F.col("of_node").alias("b"), F.col("size").alias("x"), F.col("of_size").alias("y")).distinct()
    held = met.groupBy("node").agg(F.collect_list("h").alias("hashes"))
    pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(held.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    most = F.size(F.array_intersect("of_a", "of_b")) + F.ceil(least * F.greatest("x", "y") - _ROUND) - 1
    return stored(pairs.where(most * (1 + least) >= least * (F.col("x") + F.col("y")) - _ROUND).select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) per input row: the smallest id reachable through links of similarity ``least`` or more.

    Similarity is that of Jaccard between sets of ``width``-word shingles, A-Z lower-cased.  Null texts and those without words
    are equal.  Repeated rows stay, in one component.  A row with a null id takes the component of the rows with ids whose
    sets equal its own, null if there are none, and forms no link.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = stored(sets(docs, width, lambda found, words: list(word_prints(words))).withColumnRenamed("told", "prints"))
    nodes = stored(marked.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("prints").alias("prints")))
    following = F.get("prints", F.pmod(F.col("tab") + 1, F.lit(TABLES)).cast("int")).alias("then")
    at = nodes.where("size > 0").select(F.posexplode("prints").alias("tab", "fp"), "node", "size", "prints").select("tab", "fp", following, "node", "size")
    # Nodes that share two fingerprints meet a tree's leaf as one of them, another in each table, and link to it.
    hub = F.min_by(F.struct(F.col("node").alias("name"), "size"), F.xxhash64("node", "tab"))
    points = stored(at.groupBy(F.col("tab").cast("long").alias("tab"), "fp", "then").agg(hub.alias("hub"), F.count("*").alias("n")).select("tab", "fp", "then", "hub.*", "n"))
    shared = points.where("n > 1").select(*[F.col(k).alias(f"of_{k}") for k in ("tab", "fp", "then", "size")], F.col("name").alias("b"))
    same = [F.col(k) == F.col(f"of_{k}") for k in ("tab", "fp", "then")]
    met = at.join(shared, same).where(F.col("node") != F.col("b")).where(F.least("size", "of_size") >= least * F.greatest("size", "of_size") - 1e-9)
    found = vptree.links(points, TABLES, REACH, least).unionByName(met.select(F.col("node").alias("a"), "b"))
    pairs = stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    true = similar(pairs, nodes, docs, width, least)
    known = stored(components(true))
    dropped(points, pairs, true)
    released(docs.sparkSession)
    met = first_shingles(docs, nodes, known, width, least)
    for hubs in (True, False):  # what the hubs link need not be paired
        rest = missed(met, least, hubs)
        more = similar(rest, nodes, docs, width, least)
        whole = stored(components(more.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))))
        dropped(known, rest, more)
        known = whole
        if hubs:
            before, met = met, rooted_again(met, known)
            dropped(before)
    rooted = nodes.select("node", "rep").join(known.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = stored(rooted.join(firsts, "root").select(F.col("node").alias("of_node"), "component_id"))
    dropped(met, known)
    return marked.select("doc_id", "node").join(label, F.col("node") == F.col("of_node"), "left").select("doc_id", "component_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach, by rounds of large and small stars.

    Every group is reduced by a minimum, which combines before the shuffle; no neighbourhood is collected.  The rounds, whose
    number grows with the logarithm of the longest path, end when nothing changes.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
        hung = both.join(low, both["a"] == low["hub"]).where(F.col("b") > F.col("a") if large else F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            hung = hung.unionByName(low.where("hub <> low").select(F.col("hub").alias("a"), F.col("low").alias("b")))
        return hung.where("a <> b").distinct()

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was, is_now = None, state(now)
    while is_now[0] and is_now != was:
        after = stored(star(star(now, True), False))
        dropped(now)
        now, was, is_now = after, is_now, state(after)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id.

    Of rows that share that id one stays; rows with a null id belong to no group and all stay.  Columns pass through.
    """
    found = near_copies(docs, id_col, text_col, width, least)
    # Few rows go, so their ids are what the texts meet, hashed on the ids' side so that the texts are not sorted.
    seen = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    odd = stored(seen.where("doc_id <> component_id or rows > 1").withColumnRenamed("doc_id", "id"))
    flat, id_at = numbered(docs), at_place(docs, id_col)
    on_id = F.col(id_at).cast("long") == F.col("id")
    out = flat.join(odd.select("id").hint("shuffle_hash"), on_id, "left_anti")
    often = odd.where("id = component_id and rows > 1").select("id")
    if often.take(1):
        out = out.unionByName(flat.join(often.hint("shuffle_hash"), on_id, "left_semi").dropDuplicates([id_at]))
    return named(out, docs)
