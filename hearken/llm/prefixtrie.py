"""The prefix trie of conversations, merged family by family.

A family is the conversations of one base.  Turns are narrowed to digests and dealt out by base once: that cogroup of a family's
own turns with the first turns of its base serves the numbering, the rebuilding and the family's trie, all by built-in functions
whose windows spill, so that a conversation of any length needs no memory of its own.  What is shuffled by node afterwards are
the families' nodes, not the turns.  Sums over subtrees need no walk up the trie: each node is owned by its smallest member,
and a node's sum is that of its members over what they own from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.common import dropped, stored, words

#: Conversations that share a base, and the most first turns that one takes from it.
FAMILY, SHARED = 20, 3
#: Members that end at a node are listed by blocks of 2 to the power of this many ids.
BLOCK_BITS = 12
NODE = ["depth", "x1", "x2"]


def narrow(turns: DataFrame) -> DataFrame:
    """(base, conv, turn, digest, tokens): the content of a turn as sixteen bytes, and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    return turns.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text))).alias("digest"), F.size(words(text)).cast("long").alias("tokens"),
    )


def first_turns(conv: Column) -> Column:
    """How many turns a conversation takes from its base: 0 to ``SHARED``."""
    return F.crc32(conv.cast("string")) % (SHARED + 1)


def rebuilt(turns: DataFrame) -> DataFrame:
    """(base, conv, depth, tokens, t1, t2, x1, x2, last): the turns of rebuilt conversations, each with depth 0 before them.

    t1 and t2 are hashes of a turn at its depth, x1 and x2 those of the whole prefix, which joins its turns' hashes bit by bit.
    """
    own = Window.partitionBy("base", "conv")
    numbered = narrow(turns).repartition("base").withColumn("k", F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "digest")))
    piece = F.struct("k", "digest", "tokens")
    is_first = (F.col("conv") == F.col("base")) & (F.col("k") <= SHARED)
    met = numbered.withColumn("first", F.sort_array(F.collect_list(F.when(is_first, piece)).over(Window.partitionBy("base"))))  # three at most
    h = first_turns(F.col("conv")).cast("int")
    part = lambda n, x: F.struct(F.lit(n).alias("part"), x["k"].alias("k"), x["digest"].alias("digest"), x["tokens"].alias("tokens"))
    root = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("k"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("tokens")))
    none = F.slice(root, 1, 0)
    given = F.when(F.col("k") == 1, F.concat(root, F.transform(F.slice("first", 1, h), lambda x: part(1, x)))).otherwise(none)
    kept = F.when(F.col("k") > h, F.array(part(2, piece))).otherwise(none)
    rows = met.select("base", "conv", F.explode(F.concat(given, kept)).alias("r"))
    path = own.orderBy("r.part", "r.k")
    placed = rows.withColumn("depth", (F.row_number().over(path) - 1).cast("long"))
    salted = lambda seed: F.when(F.col("r.digest").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "r.digest"))
    hashed = placed.select("base", "conv", "depth", "r.part", "r.k", "r.tokens", salted(1).alias("t1"), salted(2).alias("t2"))
    along = own.orderBy("part", "k")
    joined = {f"x{n}": F.bit_xor(f"t{n}").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in (1, 2)}
    return hashed.select("base", "conv", "depth", "tokens", "t1", "t2", *[x.alias(name) for name, x in joined.items()], F.lead("depth").over(along).isNull().alias("last"))


def families(path: DataFrame) -> DataFrame:
    """The nodes of each family's trie, with its members (twenty at most); grouped where the turns already are."""
    return path.groupBy("base", *NODE).agg(
        F.first("tokens").alias("tokens"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.min("conv").alias("least"), F.count("*").alias("n"),
        F.collect_list(F.struct("conv", "last")).alias("members"),
    )


def merged(nodes: DataFrame) -> DataFrame:
    """All families' nodes as one trie: (depth, x1, x2, up1, up2, tokens, conv_id, n_convs)."""
    alike = nodes.groupBy(*NODE).agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("tokens").alias("tokens"), F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    return alike.select(*NODE, F.col("x1").bitwiseXOR(F.col("t1")).alias("up1"), F.col("x2").bitwiseXOR(F.col("t2")).alias("up2"), "tokens", "conv_id", "n_convs")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id and n_children."""
    above = nodes.select((F.col("depth") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.groupBy((F.col("depth") - 1).alias("d"), F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(F.count("*").alias("n_children"))
    met = nodes.join(above, (F.col("depth") == F.col("d")) & (F.col("up1") == F.col("p1")) & (F.col("up2") == F.col("p2")), "left").drop("d", "p1", "p2")
    met = met.join(below, (F.col("depth") == F.col("d")) & (F.col("x1") == F.col("p1")) & (F.col("x2") == F.col("p2")), "left").drop("d", "p1", "p2")
    return met.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def subtree_sums(family: DataFrame, trie: DataFrame) -> DataFrame:
    """(depth, x1, x2, n_leaves, saved_tokens), each node counted once, by the member that owns it.

    Every family node learns who owns it, and goes back to its family; a member sums what it owns from its end upwards; the family
    adds its members' sums at each node; and only these are added over families.
    """
    worth = trie.select(*NODE, "conv_id", ((F.col("n_convs") - 1) * F.col("tokens")).alias("worth"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = family.select("base", *NODE, "members").join(worth, NODE)
    conv = F.explode("members")
    steps = owned.repartition("base").select("base", *NODE, "conv_id", "worth", "leaf", conv.alias("m"))
    mine = F.col("m.conv") == F.col("conv_id")
    from_here = Window.partitionBy("base", "m.conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.select("base", *NODE, F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(from_here).alias("leaves"), F.sum(F.when(mine, F.col("worth")).otherwise(0)).over(from_here).alias("saved"))
    by_family = summed.groupBy("base", *NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return by_family.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(family: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of nodes at which members end: the digest of their ids in order.

    Ids are listed by blocks, and a node's blocks stream through its digest in order, so a node where most conversations end is
    never held whole.
    """
    ends = family.select(*NODE, F.explode(F.filter("members", lambda m: m["last"])).alias("m")).select(*NODE, F.col("m.conv").alias("conv"))
    block = F.shiftright("conv", BLOCK_BITS)
    listed = ends.groupBy(*NODE, block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        names = [*NODE, "ends_sha256"]
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(name).to_pylist() for name in [*NODE, "ids"]]):
                if key != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=shape)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, sha.hexdigest())))], schema=shape)

    shape = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
    ordered = listed.select(*NODE, "block", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return ordered.mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    ``turns`` has conv_id, turn, role and text.  Turns go by ``turn``, null first; equal ones by the digest of their content.  Null
    roles and texts are empty.  Rows without a conv_id belong to no conversation and are left out.  Repeated rows are turns of
    their own.  A conversation takes its first turns, 0 to 3 by crc32 of its id, from the base of its family (id - id % 20) and
    then goes on with its own; where the base is missing it keeps what comes after them.  Texts may be of any length, since only
    digests travel; so may conversations.  Prefixes are told apart by 128 bits.  Other columns are not read.  An empty table gives
    an empty result.
    """
    family = stored(families(rebuilt(turns)))
    alike = stored(merged(family))
    nodes = stored(with_parents(alike))
    sums, ends = subtree_sums(family, nodes), end_digests(family)
    done = nodes.join(sums, NODE, "left").join(ends, NODE, "left")
    result = done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    dropped(alike)
    return result
