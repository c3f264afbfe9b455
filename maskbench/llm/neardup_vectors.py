"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import components, parts_for, staged

THRESHOLD = 0.9
RADII = (1.0, 0.5, 0.25, 0.125)   # of the levels below the root, each half of the one above
BLOCK = 4096                      # vectors of one tree
CELLS = 1024                      # children of the root, at most
ROWS = 512                        # rows of a distance matrix that are held at once
SLACK = 1e-6                      # bounds are only trusted beyond this; the rest is compared exactly


def valid(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)              # keeps squares of very large or small numbers finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, all pairs."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover_tree(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector the node that holds it at each level, and that node's covering radius.

    A node is named by its centre, the first vector that no earlier centre of its parent covers; a parent's
    centre is the first centre among its children, so levels are nested. The radius kept is the largest
    distance from the centre to a vector of the node, at most the level's.
    """
    n = len(u)
    node, radius = np.zeros((n, len(RADII)), np.int32), np.zeros((n, len(RADII)))
    parents = [np.arange(n)]
    for level, reach in enumerate(RADII):
        children = []
        for members in parents:
            left = members
            while len(left):
                d = _gap(u[left], u[left[:1]])[:, 0]
                d[0] = 0.0
                own = left[d <= reach]
                node[own, level], radius[own, level] = left[0], d[d <= reach].max()
                children.append(own)
                left = left[d > reach]
        parents = children
    return node, radius


class Tree:
    """One side of a traversal: nodes by level, their children, the vectors below them and their weights."""

    def __init__(self, x: np.ndarray, node: np.ndarray, radius: np.ndarray, weight: np.ndarray | None = None):
        self.u, n = _units(x), len(x)
        path = np.column_stack([node, np.arange(n)])          # the last level: the vectors themselves
        order = np.lexsort(path.T[::-1])
        self.order, path = order, path[order]
        self.weight = (np.ones(n, np.int64) if weight is None else weight)[order]
        self.mass = np.r_[0, np.cumsum(self.weight)]
        rad = np.column_stack([radius[order], np.zeros(n)])
        self.first, self.last, self.centre, self.radius, self.kids = [], [], [], [], []
        for level in range(path.shape[1]):
            start = np.flatnonzero(np.r_[True, (path[1:, :level + 1] != path[:-1, :level + 1]).any(axis=1)]) if n else np.empty(0, int)
            self.first.append(start)
            self.last.append(np.r_[start[1:], n])
            self.centre.append(path[start, level])
            self.radius.append(rad[start, level])
        for level in range(path.shape[1] - 1):
            self.kids.append((np.searchsorted(self.first[level + 1], self.first[level]), np.searchsorted(self.first[level + 1], self.last[level])))


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, its members) for all ranges."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def traverse(a: Tree, b: Tree, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Weight of what each vector of ``a`` and of ``b`` links with, itself left out, and pairs that connect what is linked.

    Two nodes further apart than their radii and the threshold's distance have no link and are dropped;
    two nodes that lie wholly within it link in all their pairs and are counted at once; the others' children
    are compared, and vectors at last exactly. With ``same`` the trees are one, and each pair is seen once.
    """
    reach = math.sqrt(2.0 - 2.0 * threshold)
    links = [np.zeros(len(a.u) + 1, np.int64), np.zeros(len(b.u) + 1, np.int64)]   # differences over each order
    itself = np.zeros(len(a.u) + 1, np.int64)                                      # vectors counted with their own node
    edges: list[np.ndarray] = []
    depth = len(RADII)

    def all_pairs(level: int, p: np.ndarray, q: np.ndarray) -> None:
        for side, t, x, other, y in ((0, a, p, b, q), (1, b, q, a, p)):
            size = other.mass[other.last[level][y]] - other.mass[other.first[level][y]]
            if same:
                inside = p == q
                if side == 0:
                    np.add.at(itself, t.first[level][x[inside]], 1)
                    np.add.at(itself, t.last[level][x[inside]], -1)
                else:
                    size = np.where(inside, 0, size)
            np.add.at(links[side], t.first[level][x], size)
            np.add.at(links[side], t.last[level][x], -size)
            owner, at = _expand(t.first[level][x], t.last[level][x])
            mate = other.centre[level][y][owner]
            edges.append(np.column_stack([t.order[at], mate] if side == 0 else [mate, t.order[at]]))

    def sift(level: int, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level == depth:
            hit = np.zeros(len(p), bool)
            near = np.flatnonzero(d <= reach + 1e-6)
            x, y = a.u[a.order[p[near]]], b.u[b.order[q[near]]]
            hit[near] = np.einsum("ij,ij->i", x, y) >= threshold
            if same:
                hit &= p != q
            all_pairs(level, p[hit], q[hit])
            return p[:0], q[:0]
        r = a.radius[level][p] + b.radius[level][q]
        full = d + r <= reach - SLACK
        if same:
            full &= (p != q) | (2 * a.radius[level][p] <= reach - SLACK)
        all_pairs(level, p[full], q[full])
        go = ~full & (d <= r + reach + SLACK)
        return p[go], q[go]

    pairs = []
    top_a, top_b = a.u[a.centre[0]], b.u[b.centre[0]]
    for lo in range(0, len(top_a), ROWS):
        d = _gap(top_a[lo:lo + ROWS], top_b)
        near = d <= a.radius[0][lo:lo + ROWS, None] + b.radius[0][None, :] + reach + SLACK
        p, q = np.nonzero(near)
        d = d[p, q]
        p = p + lo
        if same:
            keep = p <= q
            p, q, d = p[keep], q[keep], np.where(p == q, 0.0, d)[keep]
        pairs.append(sift(0, p, q, d))
    for level in range(depth):
        p, q = (np.concatenate([x[i] for x in pairs]) if pairs else np.empty(0, int) for i in (0, 1))
        pairs = []
        step = 4096
        for lo in range(0, len(p), step):
            u, v = p[lo:lo + step], q[lo:lo + step]
            owner, x = _expand(a.kids[level][0][u], a.kids[level][1][u])
            owner, y = _expand(b.kids[level][0][v[owner]], b.kids[level][1][v[owner]]), x
            x, y = y[owner[0]], owner[1]
            if same:
                keep = (x <= y)
                x, y = x[keep], y[keep]
            for at in range(0, len(x), 1 << 17):
                i, j = x[at:at + (1 << 17)], y[at:at + (1 << 17)]
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", a.u[a.centre[level + 1][i]], b.u[b.centre[level + 1][j]])))
                if same:
                    d[i == j] = 0.0
                pairs.append(sift(level + 1, i, j, d))
    out = []
    for side, t in ((0, a), (1, b)):
        n = np.zeros(len(t.u), np.int64)
        n[t.order] = np.cumsum(links[side])[:-1] - (np.cumsum(itself)[:-1] * t.weight if same and side == 0 else 0)
        out.append(n)
    return out[0], out[1], edges


def _spanning(n: int, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge for each vector, with the same reach as all edges."""
    label = np.arange(n)
    e = np.unique(np.concatenate(edges), axis=0) if edges else np.empty((0, 2), int)
    while True:
        low = np.minimum(label[e[:, 0]], label[e[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[e[:, 0]], low)
        np.minimum.at(new, label[e[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    Two vectors link when they have one length and their cosine, in double precision, is at least ``threshold``.
    Equal vectors are merged first and weigh as many as they are. Vectors of each length have a forest of their
    own: the root's children are up to CELLS vectors, those with the smallest hash; every vector goes to the
    nearest one. A cell's vectors form trees of about ``block`` vectors, a full cell many. Pairs of cells, then
    of trees, are dropped by their radii; each pair of trees that is left is one task's group, a bounded one.
    In many dimensions, where most vectors lie far apart and yet within the bound, few pairs of trees can be
    dropped: comparisons then grow with the square of the number of distinct clusters, though they stay exact.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Equal vectors and
    repeated rows are others to each other. ``label`` and other columns are not read. A null vec_id is kept,
    and never is the smallest of its group. An empty table gives an empty result.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("ok", valid(F.col("x")))
    equal = staged(v.where("ok").groupBy("x").agg(F.count("*").alias("w"), F.min("vec_id").alias("least")).withColumn("dim", F.size("x")))
    # only lengths of more than one tree need centres; there are at most 1 / block as many as vectors
    full = {r["dim"]: r["n"] for r in equal.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()}
    is_full = F.col("dim").isin(list(full)) if full else F.lit(False)
    by_hash = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("x"), "x"))
    first: dict[int, list] = {}
    for r in equal.where(is_full).select("dim", "x", by_hash.alias("place")).where(F.col("place") <= CELLS).collect() if full else []:
        if r["place"] <= parts_for(full[r["dim"]], block):
            first.setdefault(r["dim"], []).append(r["x"])
    centres = spark.sparkContext.broadcast({dim: _units(np.array(x)) for dim, x in first.items()})

    def place(batches):
        for b in batches:
            x, dims = b.column("x"), b.column("dim").to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if int(dim) in centres.value:
                    at = np.flatnonzero(dims == dim)
                    d = _gap(_units(_matrix(x.take(pa.array(at)))), centres.value[int(dim)])
                    cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    placed = staged(equal.mapInArrow(place, f"x array<double>, w long, least {kind}, dim int, cell int, far double")
                    .withColumn("row", F.monotonically_increasing_id()))
    cells = placed.where(is_full).groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect() if full else []
    reach, near = math.sqrt(2.0 - 2.0 * threshold), []
    for dim, c in centres.value.items():                       # at most CELLS * CELLS / 2 pairs of one length
        own = sorted((r["cell"], r["far"]) for r in cells if r["dim"] == dim)
        at, far = np.array([k for k, _ in own]), np.array([f for _, f in own])
        for i, j in zip(*np.nonzero(np.triu(_gap(c[at], c[at]) <= far[:, None] + far[None, :] + reach + SLACK))):
            near.append((dim, int(at[i]), int(at[j])))
    cut = spark.createDataFrame([(r["dim"], r["cell"], parts_for(r["n"], block)) for r in cells], "dim int, cell int, cuts int")
    blocks = cut.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
    single = placed.where(~is_full).select("dim", *[F.lit(0).alias(k) for k in ("a_cell", "b_cell", "a_part", "b_part")]).distinct()
    pairs = (spark.createDataFrame(near, "dim int, a_cell int, b_cell int")
             .join(blocks.select("dim", F.col("cell").alias("a_cell"), F.col("part").alias("a_part")), ["dim", "a_cell"])
             .join(blocks.select("dim", F.col("cell").alias("b_cell"), F.col("part").alias("b_part")), ["dim", "b_cell"])
             .where("a_cell < b_cell or a_part <= b_part").unionByName(single))
    part = F.pmod(F.xxhash64("row"), F.coalesce("cuts", F.lit(1))).cast("int")
    dealt = placed.join(F.broadcast(cut), ["dim", "cell"], "left").select("dim", "cell", part.alias("part"), "row", "w", "x")

    def grow(t: pa.Table) -> pa.Table:
        node, radius = cover_tree(_units(_matrix(t.column("x"))))
        at = pa.array(range(t.num_rows), pa.int32())
        return t.append_column("at", at).append_column("node", pa.array(node.tolist(), pa.list_(pa.int32()))).append_column(
            "radius", pa.array(radius.tolist(), pa.list_(pa.float64())))

    shape = "dim int, cell int, part int, row long, w long, x array<double>, at int, node array<int>, radius array<double>"
    grown = staged(dealt.groupBy("dim", "cell", "part").applyInArrow(grow, shape)).withColumnRenamed("dim", "own_dim")
    keys = ["dim", "a_cell", "a_part", "b_cell", "b_part"]
    sides = []
    for side, (k, p) in enumerate((("a_cell", "a_part"), ("b_cell", "b_part"))):
        own = pairs if side == 0 else pairs.where("a_cell <> b_cell or a_part <> b_part")
        sides.append(own.join(grown, (F.col("dim") == F.col("own_dim")) & (F.col(k) == F.col("cell")) & (F.col(p) == F.col("part")))
                     .select(*keys, F.lit(side).alias("side"), "row", "w", "x", "at", "node", "radius"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("at", "ascending")])
        side, row, w = (t.column(k).to_numpy() for k in ("side", "row", "w"))
        x, node, radius = _matrix(t.column("x")), _matrix(t.column("node")).astype(np.int32), _matrix(t.column("radius"))
        forest = [Tree(x[side == i], node[side == i], radius[side == i], w[side == i]) for i in (0, 1) if (side == i).any()]
        same = len(forest) == 1
        n, m, edges = traverse(forest[0], forest[-1], same, threshold)
        k = len(n)
        u, v = _spanning(len(row), [e + [0, 0 if same else k] for e in edges])
        total = n + m if same else np.concatenate([n, m])
        some = np.flatnonzero(total)
        return pa.table({"row": pa.array(np.concatenate([row[some], row[u]])), "n": pa.array(np.concatenate([total[some], np.zeros(len(u), np.int64)])),
                         "to": pa.array(np.concatenate([row[some], row[v]]))})

    found = staged(sides[0].union(sides[1]).groupBy(*keys).applyInArrow(compare, "row long, n long, to long"))
    links = found.where("n > 0").groupBy("row").agg(F.sum("n").alias("n"))
    group = components(found.where("row <> to").select(F.col("row").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "row")
    merged = placed.select("x", "w", "least", "row").join(links, "row", "left").join(group, "row", "left").withColumn("group", F.coalesce("component", "row"))
    least = merged.groupBy("group").agg(F.min("least").alias("component_id"))
    known = merged.join(least, "group").select("x", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    good = v.where("ok").join(known, "x").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = v.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
