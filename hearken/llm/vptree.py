"""Vantage-point trees over Hamming distance, grown on Spark until no leaf is overfull, and spanning links of near fingerprints.

A node sends fingerprints within its radius of the vantage point inside and the others outside.  Every fingerprint has one home
leaf; it also visits, as a guest, the leaves across a boundary that the triangle bound leaves open.  So any two fingerprints
within reach meet in the home leaf of one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints that a leaf should hold, those at which it goes on with the tree in memory, fingerprints drawn to divide an
#: overfull leaf, and the fewest that are divided.
LEAF, INNER, SAMPLE, LEAST = 16_384, 2048, 4096, 32
#: Pairs held at a time before they are reduced to a spanning forest.
PAIRS = 1 << 19
Split = tuple[np.uint64, int]


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def split_of(points: np.ndarray, reach: int = 2) -> Split | None:
    """The vantage point and radius that divide the points best, of a few tried; None where none divides them."""
    best = None
    for k in range(8):
        vantage = points[(k * 7919 + 13) % len(points)]
        d = distance(points, vantage)
        radius = int(np.median(d))
        for r in {radius, max(radius - 1, 0)}:
            inside = int((d <= r).sum())
            near = int(((d > r) & (d <= r + reach)).sum())
            if 0 < inside < len(points):
                score = max(inside, len(points) - inside) + near
                if best is None or score < best[0]:
                    best = (score, vantage, r)
    return best and best[1:]


@dataclass
class Tree:
    """Nodes as arrays; a child that is negative is the leaf ~child."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    leaves: int = 1

    @classmethod
    def of(cls, nodes: list[list], leaves: int) -> "Tree":
        columns = list(zip(*nodes)) if nodes else [[]] * 4
        return cls(*(np.array(c, dtype=t) for c, t in zip(columns, (np.uint64, np.int16, np.int64, np.int64))), leaves)

    @classmethod
    def layout(cls, points: np.ndarray, per_point: float, leaf: int, reach: int = 2) -> "Tree":
        """A tree over a sample in which each point stands for ``per_point``; one leaf where it cannot be divided."""
        nodes, todo, leaves = [], [(points, None)], 0
        while todo:
            part, hook = todo.pop()
            split = None if len(part) * per_point <= leaf or len(part) < LEAST else split_of(part, reach)
            if split is None:
                child, leaves = ~leaves, leaves + 1
            else:
                child = len(nodes)
                nodes.append([split[0], split[1], None, None])
                near = distance(part, split[0]) <= split[1]
                todo += [(part[~near], (child, 3)), (part[near], (child, 2))]
            if hook:
                nodes[hook[0]][hook[1]] = child
        return cls.of(nodes, leaves)

    def grafted(self, grown: dict[int, "Tree"]) -> "Tree":
        """This tree with leaves replaced by trees; the first leaf of each keeps the number."""
        nodes = [list(n) for n in zip(self.vantage, self.radius, self.inside, self.outside)]
        leaves, at = self.leaves, {}
        for leaf, sub in grown.items():
            first, name = len(nodes), [leaf, *range(leaves, leaves + sub.leaves - 1)]
            leaves += sub.leaves - 1
            child = lambda c: first + int(c) if c >= 0 else ~name[~int(c)]  # noqa: E731,B023
            nodes += [[v, r, child(i), child(o)] for v, r, i, o in zip(sub.vantage, sub.radius, sub.inside, sub.outside)]
            at[~leaf] = child(0) if len(sub.vantage) else ~leaf
        for node in nodes[: len(self.vantage)]:
            node[2], node[3] = at.get(node[2], node[2]), at.get(node[3], node[3])
        return Tree.of(nodes, leaves)

    def routed(self, points: np.ndarray, reach: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indexes of points at home, indexes of guests) of the leaves that are visited; no guests without a reach.

        Points at home go to one side.  Those outside also visit the inside when within reach of the boundary; a guest visits
        each side that the triangle bound leaves open.  Guests from inside are not needed outside, as the pair is met from
        the other end.
        """
        todo = [(0 if len(self.vantage) else ~0, np.arange(len(points)), np.arange(0))]
        while todo:
            node, home, guest = todo.pop()
            if not len(home) and not len(guest):
                continue
            if node < 0:
                yield ~node, home, guest
                continue
            vantage, radius = self.vantage[node], int(self.radius[node])
            h, g = distance(points[home], vantage), distance(points[guest], vantage)
            near = h <= radius
            over = home[~near & (h <= radius + reach)] if reach is not None else guest
            todo.append((int(self.inside[node]), home[near], np.concatenate((over, guest[g <= radius + (reach or 0)]))))
            todo.append((int(self.outside[node]), home[~near], guest[g > radius - (reach or 0)]))

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        for leaf, rows, _ in self.routed(points, None):
            out[rows] = leaf
        return out


def grown(points: DataFrame, tables: int, reach: int, leaf: int = LEAF, sample: int = SAMPLE) -> list[Tree]:
    """A tree for each table of ``points`` (tab, fp); equal fingerprints share a leaf.

    All leaves that hold more than twice ``leaf`` points are divided by points drawn from them, round after round; tasks draw and
    divide, and the driver receives the nodes alone.  A leaf stays overfull only where no vantage point divides its points.
    """
    trees, final = [Tree.of([], 1) for _ in range(tables)], set()

    def overfull() -> dict[tuple[int, int], int]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tab, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                for t in np.unique(tab).tolist():
                    at, n = np.unique(trees[t].home(fp[tab == t]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(at), pa.array(n)], ["tab", "leaf", "n"])

        held = points.select("tab", "fp").mapInArrow(count, "tab long, leaf long, n long").groupBy("tab", "leaf").agg(F.sum("n").alias("n"))
        return {(r.tab, r.leaf): r.n for r in held.where(F.col("n") > 2 * leaf).collect() if (r.tab, r.leaf) not in final}

    heavy = overfull()
    while heavy:
        rate = min(1.0, sample * len(heavy) / sum(heavy.values()))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tab, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for t in np.unique(tab).tolist():
                    own = fp[tab == t]
                    at = trees[t].home(own.view(np.uint64))
                    keep = np.isin(at, [x for y, x in heavy if y == t])  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), t)), pa.array(at[keep]), pa.array(own[keep])], ["tab", "leaf", "fp"])

        def divide(group: pa.Table) -> pa.Table:
            t, at, drawn = group.column("tab")[0].as_py(), group.column("leaf")[0].as_py(), np.sort(group.column("fp").to_numpy()).view(np.uint64)
            drawn = drawn[np.argsort(drawn * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
            sub = Tree.layout(drawn, heavy[t, at] / len(drawn), leaf, reach)  # noqa: B023
            return pa.table({"tab": [t], "leaf": [at], "vantage": [sub.vantage.view(np.int64)], "radius": [sub.radius], "inside": [sub.inside], "outside": [sub.outside], "leaves": [sub.leaves]}, schema=pa.schema([("tab", pa.int64()), ("leaf", pa.int64()), ("vantage", pa.list_(pa.int64())), ("radius", pa.list_(pa.int16())), ("inside", pa.list_(pa.int64())), ("outside", pa.list_(pa.int64())), ("leaves", pa.int64())]))

        part = points.select("tab", "fp").where(F.pmod(F.xxhash64("fp", F.lit(len(final))), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)
        made = part.mapInArrow(draw, "tab long, leaf long, fp long").groupBy("tab", "leaf").applyInArrow(divide, "tab long, leaf long, vantage array<long>, radius array<short>, inside array<long>, outside array<long>, leaves long").collect()
        subs: list[dict[int, Tree]] = [{} for _ in trees]
        for r in made:
            subs[r.tab][r.leaf] = Tree(np.array(r.vantage, dtype=np.int64).view(np.uint64), np.array(r.radius, np.int16), np.array(r.inside, np.int64), np.array(r.outside, np.int64), r.leaves)
        final |= {key for key in heavy if key[1] not in subs[key[0]] or subs[key[0]][key[1]].leaves == 1}
        trees = [tree.grafted(sub) for tree, sub in zip(trees, subs)]
        heavy = overfull()
    return trees


def near_pairs(home: np.ndarray, guest: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in home, j in home + guest) within reach, each once; guests count from len(home).  Memory stays bounded."""
    points = np.concatenate((home, guest))

    def compared(h: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        vantage, q = points[h[0]], np.concatenate((h, g))
        dh, dq = distance(points[h], vantage), distance(points[q], vantage)
        order = np.argsort(dq, kind="stable")
        h, q, once = h[np.argsort(dh, kind="stable")], q[order], (np.arange(len(q)) < len(h))[order]
        edge_h, edge_q = np.searchsorted(np.sort(dh), np.arange(70)), np.searchsorted(np.sort(dq), np.arange(70))
        for d in range(65):
            rows, near = q[edge_q[d] : edge_q[d + 1]], h[edge_h[max(0, d - reach)] : edge_h[d + reach + 1]]
            step = max(1, (1 << 20) // max(1, len(near)))
            for at in range(0, len(rows) if len(near) else 0, step):
                part = rows[at : at + step]
                j, i = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[near][None, :]) <= reach)
                # Two points at home meet twice; a guest meets a point at home here only.
                keep = (near[i] < part[j]) | ~once[edge_q[d] + at :][j]
                yield near[i][keep], part[j][keep]

    todo = [(np.arange(len(home)), np.arange(len(home), len(points)), 0)]
    while todo:
        h, g, depth = todo.pop()
        if not len(h):
            continue
        split = split_of(points[h], reach) if len(h) > INNER and depth < 40 else None
        if split is None:
            yield from compared(h, g)
            continue
        dh, dg = distance(points[h], split[0]), distance(points[g], split[0])
        todo.append((h[dh <= split[1]], np.concatenate((h[(dh > split[1]) & (dh <= split[1] + reach)], g[dg <= split[1] + reach])), depth + 1))
        todo.append((h[dh > split[1]], g[dg > split[1] - reach], depth + 1))


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a minimum spanning forest over n points; it keeps the components of every bound on the weight."""
    order = np.argsort(weight, kind="stable")
    label, chosen, alive = np.arange(n), [], np.arange(len(order))
    a, b = a[order], b[order]
    while True:
        x, y = label[a[alive]], label[b[alive]]
        cross = x != y
        alive, x, y = alive[cross], x[cross], y[cross]
        if not len(alive):
            return order[np.unique(np.concatenate(chosen))] if chosen else order[:0]
        best = np.full(n, len(a))
        np.minimum.at(best, x, alive)
        np.minimum.at(best, y, alive)
        roots = np.flatnonzero(best < len(a))
        edge = best[roots]
        chosen.append(edge)
        parent, other = np.arange(n), label[a[edge]] + label[b[edge]] - roots
        parent[roots] = other
        mutual = roots[(parent[other] == roots) & (roots < other)]
        parent[mutual] = mutual
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], weigh) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of a stream of pairs, reduced as it comes; ``weigh`` gives weights, negative for no link."""
    held, size = [(np.zeros(0, np.int64),) * 3], 0

    def reduced() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b, w = (np.concatenate(c) for c in zip(*held))
        keep = forest(n, a, b, w)
        return [(a[keep], b[keep], w[keep])]

    for a, b in pairs:
        w = weigh(a, b)
        ok = w >= 0
        held.append((a[ok], b[ok], w[ok].astype(np.int64)))
        size += len(held[-1][0])
        if size > PAIRS:
            held, size = reduced(), 0
    return reduced()[0][:2]


def links(points: DataFrame, tables: int, reach: int, least: float = 0.0, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(a, b) of names: links that connect all fingerprints of a table within reach of each other.

    ``points`` has rows (tab, fp, then, name, size); few share a fingerprint of one table.  Of the links inside a leaf those of a
    minimum spanning forest are returned, by distance over both ``fp`` and ``then``, a second fingerprint; pairs whose sizes
    differ by more than the factor ``least`` do not link.
    """
    trees = grown(points, tables, reach, leaf, sample)
    names = ["tab", "leaf", "fp", "then", "name", "size", "home"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tab, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for t in np.unique(tab).tolist():
                own = np.flatnonzero(tab == t)
                for at, home, guest in trees[t].routed(fp[own], reach):
                    rows = own[np.concatenate((home, guest))]
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(np.full(len(rows), at)), *taken.columns[1:], pa.array(np.arange(len(rows)) < len(home))], names)

    def joined(group: pa.Table) -> pa.Table:
        home, name = (group.column(k).to_numpy() for k in ("home", "name"))
        order = np.lexsort((name, ~home))
        fp, then, name, size = (group.column(k).to_numpy()[order] for k in ("fp", "then", "name", "size"))
        fp, then = fp.view(np.uint64), then.view(np.uint64)

        def weigh(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            far = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) + np.bitwise_count(then[a] ^ then[b])
            return np.where(np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9, far, -1)

        n = int(home.sum())
        a, b = spanning(len(fp), near_pairs(fp[:n], fp[n:], reach), weigh)
        return pa.table({"a": name[a], "b": name[b]})

    kinds = "tab long, leaf long, fp long, then long, name long, size long, home boolean"
    return points.select("tab", "fp", "then", "name", "size").mapInArrow(route, kinds).groupBy("tab", "leaf").applyInArrow(joined, "a long, b long")
