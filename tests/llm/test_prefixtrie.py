"""The trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from hearken.llm import prefixtrie, queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(r)} {r}{x}".encode()).digest(), r, x))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + said[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    for prefix in members:
        if prefix:
            below[prefix[:-1]].append(prefix)
    out, sums = [], {}
    for prefix in sorted(members, key=len, reverse=True):
        here, kids = members[prefix], below[prefix]
        tokens = len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        sums[prefix] = (sum(sums[k][0] for k in kids) or 1, (len(here) - 1) * tokens + sum(sums[k][1] for k in kids))
        ends = ",".join(str(c) for c in sorted(here) if len(rebuilt[c]) == len(prefix))
        out.append((min(here), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(here), len(kids), *sums[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def some(n_convs, seed=0, most=6):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n_convs), 400, 403, 1010, 1011]:
        rows += [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a b", "hi", "c  d\te", ""])) for t in range(rng.randint(1, most))]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_brute_force(spark):
    rows = some(90)
    assert got(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 5, "x 1", "b"), (0, 5, "x", " 1b"), (3, None, "", ""), (7, 1, "user", None), (None, 1, "user", "lost"),
        (21, 1, "user", "base is missing"), (22, 1, "u", "q"), (22, 2, "u", "q"), (22, 3, "u", "q"), (22, 4, "u", "long " * 50_000), (45, 0, "u", "t"), (60, 0, "u", "t"), (61, 0, "u", "  　x"),
    ]
    df = spark.createDataFrame([(*r, k, "c") for k, r in enumerate(rows)], SCHEMA + ", depth int, base string")
    assert got(prefixtrie.trie(df)) == nodes(rows)


def test_blocks_of_ends_stream_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK_BITS", 3)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)]
    assert got(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(rows)


def test_a_long_conversation(spark):
    rows = [(20, t, "user", f"w{t} x") for t in range(3000)] + [(c, t, "user", f"w{t} x") for c in (21, 22, 23, 24) for t in range(500)]
    assert got(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(rows)


def test_empty_table(spark):
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_are_shuffled_by_family_only(spark):
    """The families' nodes come out of one shuffle, on the base id."""
    plan = prefixtrie.families(prefixtrie.rebuilt(spark.createDataFrame(some(5), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(base") == 1 and plan.count("Exchange") == 1


def test_registered_query(spark, tmp_path):
    rows = some(30, seed=3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == nodes(rows)
