"""Mixing sources to target weights: budgets down a domain-language-source tree, then a token prefix of each leaf.

Weights divide the budget from the root down.  A child that cannot use its share, even after all its epochs, leaves the rest to
its siblings; only what a whole subtree cannot use moves on to its parent's siblings.  A leaf takes whole epochs and then the
prefix of one more, in an order seeded by the epoch.  Only token counts are gathered: the prefix of a leaf is found as the key
of its last document, over narrow rows, and the texts are filtered where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.common import at_place, named, numbered, stored, words

#: The tree's levels, leaves up to which their rows are broadcast, and rows per stretch of a leaf's order.
LEVELS = ("domain", "language", "source_name")
BROADCAST_LEAVES, STRETCH = 20_000, 50_000
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Plan:
    """Targets of a mix.

    domains: domain of each source; others belong to ``other``.  weights: weight of a path, such as ("web",) or ("web", "en");
    a path not listed weighs 1.  share: budget as a share of the corpus' tokens.  epochs: most passes over a leaf.
    """

    domains: dict[str, str] = field(default_factory=dict)
    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    share: float = 0.6
    epochs: int = 4
    seed: int = 17


def divided(budget: int, room: dict, weight: dict) -> dict:
    """Shares of a budget by weight, none above its room; what some cannot take goes to the others, by weight again."""
    budget = min(budget, sum(room.values()))
    exact, open_, left = {}, {k for k in room if weight[k] > 0}, Fraction(budget)
    if not open_:
        return {k: 0 for k in room}
    while open_:
        total = sum(Fraction(weight[k]) for k in open_)
        full = [k for k in open_ if left * Fraction(weight[k]) / total >= room[k]]
        if not full:
            exact.update({k: left * Fraction(weight[k]) / total for k in open_})
            break
        exact.update({k: Fraction(room[k]) for k in full})
        left -= sum(room[k] for k in full)
        open_ -= set(full)
    shares = {k: int(exact.get(k, 0)) for k in room}
    spare = int(sum(exact.values())) - sum(shares.values())
    for k in sorted(exact, key=lambda k: (-(exact[k] - shares[k]), k))[:spare]:
        shares[k] += 1
    return shares


def budgets(leaves: dict[tuple[str, ...], int], plan: Plan) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf, given the tokens that each leaf has."""
    room = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            room[path[:depth]] = room.get(path[:depth], 0) + tokens * plan.epochs

    def weight_of(path: tuple[str, ...]) -> float:
        return plan.weights.get(path, 1.0)

    def usable(path: tuple[str, ...]) -> int:
        """Room below a path, without what a weight of 0 shuts."""
        children = below.get(path)
        return room[path] if not children else sum(usable(c) for c in children if weight_of(c) > 0)

    below: dict[tuple, list] = {}
    for path in room:
        if path:
            below.setdefault(path[:-1], []).append(path)
    out, todo = {}, [((), min(int(plan.share * sum(leaves.values())), usable(())))] if leaves else []
    while todo:
        path, budget = todo.pop()
        children = sorted(below.get(path, []))
        if not children:
            out[path] = budget
            continue
        shares = divided(budget, {c: usable(c) for c in children}, {c: weight_of(c) for c in children})
        todo += shares.items()
    return out


def leaf_columns(docs: DataFrame, plan: Plan, lang_col: str, source_col: str) -> list[Column]:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN))
    domain = F.lit("other")
    if plan.domains:
        domain = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(plan.domains.items()) for x in pair])[source], domain)
    return [domain.alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("language"), source.alias("source_name")]


def order_key(epoch: Column, seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, doc_id, text)


def ends_of(narrow: DataFrame, plan: Plan) -> tuple[DataFrame, int]:
    """(of_domain, of_language, of_source_name, whole, rest, last_key, last_start) of every leaf, and the number of leaves.

    A leaf takes ``whole`` epochs, then the documents of one more up to ``last_key``, which starts at token ``last_start`` of
    ``rest``.  The driver holds a row per leaf, as the plan does.
    """
    sums = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()
    leaves = {tuple(r[k] for k in LEVELS): r.tokens for r in sums}
    rows = []
    for path, budget in budgets(leaves, plan).items():
        whole = budget // leaves[path] if leaves[path] else 0
        rows.append((*path, whole, budget - whole * leaves[path]))
    planned = narrow.sparkSession.createDataFrame(rows, ", ".join(f"of_{k} string" for k in LEVELS) + ", whole long, rest long")

    # The last document of each prefix.  A leaf's order is cut into stretches by the leading bits of the keys, so that no task
    # orders more than a stretch of a leaf.
    stretches = max(0, (max([r.rows for r in sums], default=0) // STRETCH).bit_length())
    partial = on_leaf(narrow, planned.where("rest > 0"), len(rows)).select(*LEVELS, "tokens", "rest", order_key(F.col("whole"), plan.seed, F.col("id"), F.col("hash")).alias("key"))
    cut = F.shiftright("key", 64 - stretches) if stretches else F.lit(0)
    placed = partial.withColumn("stretch", cut.cast("long"))
    totals = placed.groupBy(*LEVELS, "stretch").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy(*LEVELS).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.select(*[F.col(k).alias(f"in_{k}") for k in LEVELS], F.col("stretch").alias("in_stretch"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begun"), "held")
    open_ = placed.join(begun, [placed[k] == F.col(f"in_{k}") for k in LEVELS] + [placed["stretch"] == F.col("in_stretch")]).where("begun < rest")
    crossing = open_.where("begun + held >= rest")
    earlier = Window.partitionBy(*LEVELS, "stretch").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    last = (
        crossing.withColumn("start", F.col("begun") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).where("start < rest")
        .groupBy(*LEVELS).agg(F.max(F.struct("key", "start")).alias("last"))
    )
    ends = planned.join(last, [F.col(f"of_{k}") == F.col(k) for k in LEVELS], "left")
    return stored(ends.select(*[f"of_{k}" for k in LEVELS], "whole", "rest", F.col("last.key").alias("last_key"), F.col("last.start").alias("last_start"))), len(rows)


def on_leaf(docs: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    """Rows with LEVELS joined with a row per leaf, which is broadcast as long as there are few."""
    return docs.join(F.broadcast(leaves) if n <= BROADCAST_LEAVES else leaves, [docs[k] == F.col(f"of_{k}") for k in LEVELS])


def select(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", columns: bool = True) -> DataFrame:
    """``docs`` with __domain, __language, __source, __epoch, __tokens and __taken, a row per document and epoch that takes it.

    __taken is the document's tokens but for the last document of a prefix, which is cut to the budget.  Null languages and
    sources are ``unknown``; a null text has no tokens and goes with its place in the order.  Rows equal in id and text
    share one place in the order and go together.  Columns pass through, whatever their names; those that have one of the names
    above are replaced, unless ``columns`` is False: then none is added.  An empty table gives an empty result.
    """
    flat = numbered(docs)
    id_at, text_at, lang_at, source_at = (at_place(docs, c) for c in (id_col, text_col, lang_col, source_col))
    text = F.col(text_at).cast("string")
    leaf = leaf_columns(flat, plan, lang_at, source_at)
    narrow = stored(flat.select(*leaf, F.col(id_at).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.size(words(text)).cast("long").alias("tokens")))
    ends, n = ends_of(narrow, plan)
    met = on_leaf(flat.select("*", *leaf, F.size(words(text)).cast("long").alias("tokens")), ends, n)
    key = order_key(F.col("whole"), plan.seed, F.col(id_at).cast("long"), F.xxhash64(text))
    in_prefix = (F.col("rest") > 0) & (key <= F.col("last_key"))
    passes = F.coalesce(F.col("whole") + in_prefix.cast("long"), F.col("whole"))
    cut = (F.col("epoch") == F.col("whole")) & (key == F.col("last_key"))
    out = met.withColumn("passes", passes).where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    out = out.withColumn("taken", F.when(cut, F.least(F.col("tokens"), F.col("rest") - F.col("last_start"))).otherwise(F.col("tokens")))
    return named(out, docs, {"domain": "__domain", "language": "__language", "source_name": "__source", "epoch": "__epoch", "tokens": "__tokens", "taken": "__taken"} if columns else None)
