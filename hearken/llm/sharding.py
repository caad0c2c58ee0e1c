"""Sharding by sampled splitters: near-equal bytes per shard, gapless slots, equal texts side by side.

Built-in functions only.  Rows are ordered by (hash of the text, hash of the id, hash of a row number), so equal texts are
neighbours and yet a group of any size can be divided.  A size-weighted sample gives quantile boundaries of many more ranges
than shards; ranges that turn out overfull are sampled again and subdivided; consecutive ranges then fill the shards.  Only
hashes, sizes and ids are shuffled, never a text, and no task orders more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.common import stored

#: Bytes that a record costs beside its text.
OVERHEAD = 16
#: Ranges per shard, samples per range, range size in means above which a range is divided, and rounds of dividing.
RANGES, SAMPLES, OVERFULL, ROUNDS = 64, 6, 2.0, 6
KEY = ("k1", "k2", "k3")
#: Ranges are looked up by the leading bits of k1.
CELL_BITS = 12


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The narrow rows that all later steps read, written once."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col)).alias("k2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
    )
    return stored(narrow)


def key(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + k).alias(k) for k in KEY))


def cell(k1: Column) -> Column:
    return F.shiftright(k1, 64 - CELL_BITS)


def sampled_starts(rows: DataFrame, target: float, seed: int, within: list[str]) -> DataFrame:
    """First keys of consecutive stretches of about ``target`` bytes, judged by a size-weighted sample of the rows."""
    chance = F.least(F.lit(1.0), F.col("size") * SAMPLES / F.lit(target))
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < chance).select(*within, *KEY, (F.col("size") / chance).alias("weight"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    # By the middle of its weight a row larger than a stretch opens one of its own, even after a small one.
    part = F.floor((F.coalesce(F.sum("weight").over(before), F.lit(0.0)) + F.col("weight") / 2) / F.lit(target))
    first = drawn.withColumn("part", part).groupBy(*within, "part").agg(F.min(key()).alias("first"))
    return first.select("first.*")


def ranges_of(starts: DataFrame) -> DataFrame:
    """(range_id, lo, hi) covering all keys; a row per cell that a range touches, in ``cell``.  As many rows as ranges and cells."""
    lowest = starts.sparkSession.range(1).select(*(F.lit(-(2**63)).cast("long").alias(k) for k in KEY))
    ordered = Window.partitionBy(F.lit(0)).orderBy(*KEY)
    spans = starts.unionByName(lowest).distinct().select(F.row_number().over(ordered).alias("range_id"), key().alias("lo"), F.lead(key()).over(ordered).alias("hi"))
    last = F.coalesce(cell(F.col("hi.k1")), F.lit((1 << (CELL_BITS - 1)) - 1).cast("long"))
    return spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo.k1")), last)))


def placed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with its range: an equi-join on the cell with the small table of ranges, then the bounds."""
    near = ranges.withColumnRenamed("cell", "range_cell")
    inside = (key() >= F.col("lo")) & (F.col("hi").isNull() | (key() < F.col("hi")))
    return rows.join(F.broadcast(near), (cell(F.col("k1")) == F.col("range_cell")) & inside).drop("range_cell", "lo", "hi")


def shard_by_size(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard).

    A null text counts as empty, with crc32 0.  Rows with null ids and repeated rows are placed like others; which of several
    identical rows gets which slot is immaterial.  Other columns of the input are not read.  An empty table gives an empty
    result; with fewer rows than shards some shards stay empty.
    """
    rows = keyed(docs, id_col, text_col)
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_ranges = shards * RANGES
    target = max(1.0, total / n_ranges)
    starts = stored(sampled_starts(rows, target, seed, []))
    for k in range(ROUNDS):
        held = placed(rows, ranges_of(starts))
        sums = held.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        overfull = sums.where((F.col("bytes") > OVERFULL * target) & (F.col("n") > 1)).select("range_id")
        if not overfull.take(1):
            break
        crowded = held.join(F.broadcast(overfull), "range_id", "left_semi")  # ranges are few by construction
        starts = stored(starts.unionByName(sampled_starts(crowded, target / 2, seed + k + 1, ["range_id"])).distinct())
    ranges = ranges_of(starts)
    held = placed(rows, ranges)
    sums = held.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    in_shard = sums.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_shard.select(F.col("range_id").alias("of_range"), "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    slot = F.col("base") + F.row_number().over(Window.partitionBy("range_id").orderBy(*KEY)) - 1
    return held.join(F.broadcast(offsets), F.col("range_id") == F.col("of_range")).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
