"""Jaccard join of documents on word shingles: size-banded tiles, bitmap signatures, exact intersection."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .base import components, mapped, parts_for, shingles, split_by_ids, staged

NEEDED = (75, 100)                # intersection : union
COUNTERS = 1 << 18
SEGMENT = 1 << 12
TILE = 2048
COLUMNS, CODES = 1 << 12, 1 << 20
ROUNDS = 2                        # of the most alike sets, before all that is left


def _signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def set_code(s: np.ndarray) -> int | None:
    """The code of a whole set; documents with one set are one node of the join."""
    return _signed(xxhash.xxh64_intdigest(s.tobytes())) if len(s) else None


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed signature of two to four bits per element, a power of two of 64-bit words."""
    words = 1 << max(0, math.ceil(math.log2(max(1, len(s)) / 32)))
    bits = np.zeros(words * 64, np.uint8)
    bits[(s & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """A wider signature as the one of fewer words; the elements' bits are kept modulo the width."""
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0)


def overlap_bound(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """No intersection is larger than this.

    A bit that only one side has stands for an element that only it has; and shared elements have common
    bits, but for those that share a bit with another one.
    """
    count = lambda x: np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
    return np.minimum((n + m - count(a ^ b)) // 2, count(a & b) + np.minimum(n - count(a), m - int(np.bitwise_count(b).sum())))


def enough(common, n, m):
    """100 * intersection >= 75 * union."""
    return NEEDED[1] * common >= NEEDED[0] * (n + m - common)


def band(n: Column) -> Column:
    """Sizes whose ratio is at least 0.75 lie in one band or in two that follow each other."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(4 / 3)) + F.lit(1e-9)).cast("int")


def text_hash() -> Column:
    """Tells texts of one id apart, and orders rows of equal or null ids; null text has a code of its own."""
    return F.xxhash64(F.col("text").cast("string"))


def _sets(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, hash, n, node), and each task's counts of hashed shingles in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["doc_id", "hash", "n", "node", "segment", "salt", "counts"]
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n, node = [], []
            for t in b.column(1):
                s = shingles(t.as_py() or "")
                n.append(len(s))
                node.append(set_code(s))
                if len(s):
                    np.add.at(counts, (s >> np.uint64(46)).astype(np.int64), 1)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(k, pa.int32()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        k = COUNTERS // SEGMENT
        if counts.any():
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(k, pa.int64())] * 4, pa.array(range(k), pa.int32()),
                pa.array([TaskContext.get().partitionId() // 256] * k, pa.int32()),
                pa.array([x.tobytes() for x in counts.reshape(k, -1)], pa.binary())], names)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("hash")),
                  run, "doc_id long, hash long, n long, node long, segment int, salt int, counts binary")


def _added(key: tuple, t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in t.column("counts")], axis=0)
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How often shingles of each hash class occur in all documents: COUNTERS numbers, whatever the input."""
    parts = rows.where("segment is not null").select("segment", "salt", "counts")
    half = parts.groupBy("segment", "salt").applyInArrow(_added, "segment int, counts binary")
    got = half.groupBy("segment").applyInArrow(_added, "segment int, counts binary").toArrow()
    total = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.int64)
    for s, c in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        total[s] = np.frombuffer(c, np.int64)
    return total.ravel()


def _prefixes(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(shingle, node, n, pos) for the rarest shingles of each set; ``pos`` is the place in their order, from 0.

    Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of the larger and the first
    n - ceil(6/7 n) + 1 of the smaller, in any order that is the same for all sets; here the
    rarest class first. A set that a task has seen already is not written again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for b in batches:
            out, node, size, pos = [], [], [], []
            for t in b.column(0):
                s = shingles(t.as_py() or "")
                k, n = set_code(s), len(s)
                if k is None or k in seen:
                    continue
                seen.add(k)
                first = n - (3 * n + 3) // 4 + 1
                of = often[(s >> np.uint64(46)).astype(np.int64)]
                if first < n:
                    near = np.argpartition(of, first - 1)[:first]
                    edge = of[near].max()                    # ties at the edge go by code, as everywhere
                    near = np.flatnonzero(of <= edge)
                else:
                    near = np.arange(n)
                near = near[np.lexsort((s[near], of[near]))][:first]
                out.append(s[near].view(np.int64))
                node.append(np.full(len(near), k, np.int64))
                size.append(np.full(len(near), n, np.int32))
                pos.append(np.arange(len(near), dtype=np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out, node, size, pos)],
                                                 ["shingle", "node", "n", "pos"])

    return mapped(docs.select(F.col("text").cast("string")), run, "shingle long, node long, n int, pos int")


def _tiles(prefixes: DataFrame, parts: int) -> DataFrame:
    """Rows of shingles that several sets share, each with two partners that are likely to link.

    Rows stream in the order of (shingle, size, node), so a group is never held: ``leader`` is the first
    set of the shingle and size band, ``prior`` the one just before.
    """
    names = ["shingle", "node", "n", "pos", "band", "leader", "prior"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                           # the last row, not yet known to have company
        lead: tuple | None = None                             # (shingle, band, node) of the current leader
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held[:5], cols)]
            s, node, n, pos, bd = cols
            same = (s[1:] == s[:-1]) & (node[1:] == node[:-1])
            keep = np.r_[True, ~same]
            s, node, n, pos, bd = (c[keep] for c in (s, node, n, pos, bd))
            linked = np.r_[held is not None and held[5], s[1:] == s[:-1]]  # has the one before it in its group
            start = np.r_[True, (s[1:] != s[:-1]) | (bd[1:] != bd[:-1])]
            first = node[np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))]
            if lead is not None and lead[:2] == (s[0], bd[0]):
                head = np.cumprod(np.r_[True, ~start[1:]]).astype(bool)
                first = np.where(head, lead[2], first)
            prior = np.r_[node[0], node[:-1]]
            prior = np.where(np.r_[False, s[1:] == s[:-1]], prior, node)
            if held is not None and len(s):
                prior[0] = held[6]
            company = linked | np.r_[s[1:] == s[:-1], False]
            send = company.copy()
            send[-1] = False                                  # decided with the next batch
            held = ([s[-1:], node[-1:], n[-1:], pos[-1:], bd[-1:]] + [bool(linked[-1]), prior[-1]])
            lead = (s[-1], bd[-1], first[-1])
            if send.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[send]) for x in (s, node, n, pos, bd, first, prior)], names)
        if held is not None and held[5]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held[:5], np.array([lead[2]]), np.array([held[6]]))], names)

    rows = prefixes.withColumn("band", band(F.col("n"))).repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "node")
    return mapped(rows, run, "shingle long, node long, n int, pos int, band int, leader long, prior long")


def _fetch(docs: DataFrame, nodes: DataFrame, members: DataFrame, what: str) -> DataFrame:
    """Of one document of each of the nodes: (node, n, kept), which is the set's bits, its codes or the text.

    A filter of fixed size over the ids of those documents spares the others' texts; the join that follows
    is exact.
    """
    nodes = staged(nodes)
    ids = members.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            node, size, kept = [], [], []
            for t in b.column(0):
                s = shingles(t.as_py() or "")
                k = set_code(s)
                if k is not None and k not in seen:
                    seen.add(k)
                    node.append(k)
                    size.append(len(s))
                    kept.append(t.as_py() if what == "text" else (bitmap(s) if what == "bits" else s).tobytes())
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(kept, pa.string() if what == "text" else pa.binary())],
                                                 ["node", "n", "kept"])

    few = split_by_ids(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ids).where("possible")
    found = mapped(few.select("text"), run, f"node long, n int, kept {'string' if what == 'text' else 'binary'}")
    return staged(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def side(k: str) -> DataFrame:
        return sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("kept").alias(f"kept_{k}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "kept_a", "kept_b")


def _within_bound(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5))):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                w = min(len(u), len(v))
                ok.append(bool(enough(overlap_bound(folded(u, w), n[i], folded(v, w), m[i]), n[i], m[i])))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return mapped(_both(pairs, bits), run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the intersection of their sorted codes; pairs must have passed the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, np.ndarray] = {}
            ok = []
            for i in range(b.num_rows):
                xy = []
                for k in (0, 1):
                    node = b.column(k)[i].as_py()
                    if node not in held:
                        if len(held) > 1000:
                            held.clear()
                        held[node] = shingles(b.column(4 + k)[i].as_py())
                    xy.append(held[node])
                x, y = xy
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(enough(common, len(x), len(y))))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    pairs = staged(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return staged(mapped(_both(pairs, _fetch(docs, nodes, members, "text")), run, "a long, b long"))


def _banded_pairs(rows: DataFrame, sets: DataFrame, parts: int, best: bool = False) -> DataFrame:
    """Candidates (a, b, like) between sets of different labels that share a shingle, by tiles of a shingle and a size band.

    A tile pairs the sets of its band with those of its band and of the next; larger ones are cut into
    squares of TILE by TILE sets. Inside, sizes, labels, the places of the shingle and the bitmaps' bound decide: two
    sets that link share no more than what follows the first shingle they share, so a pair is left to the tile where
    enough follows in both. ``like`` is the similarity that the bound leaves possible. With ``best`` a square gives only the most alike partner of each of its
    sets, no more pairs than it has sets, and only the rarest shingles and sets of one band count: not all candidates.
    """
    core = F.col("pos") < F.col("n") - F.floor((6 * F.col("n") + 6) / 7) + 1
    if best:
        r = rows.where(core).select("shingle", F.col("band").alias("tile"), "node", "n", "pos", "label", F.lit(True).alias("small"))
    else:
        both = F.explode(F.array(F.struct(core.alias("small"), F.col("band").alias("tile")),
                                 F.struct(F.lit(False).alias("small"), (F.col("band") - 1).alias("tile"))))
        r = rows.select("shingle", "node", "n", "pos", "label", both.alias("x")).select("shingle", "x.tile", "node", "n", "pos", "label", "x.small")
    heavy = (r.groupBy("shingle", "tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("cuts"), F.max("small").alias("has"),
                                              (F.min("label") != F.max("label")).alias("differ")).where("has and differ"))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    keys = ["shingle", "tile", "i", "j"]
    # in square (i, j) the sets dealt to i are the smaller, those dealt to j the larger of a pair
    places = F.array_union(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.col("own").alias("i"), x.alias("j"))),
                           F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(x.alias("i"), F.col("own").alias("j"))))
    cut = (r.join(heavy, ["shingle", "tile"]).withColumn("own", own).withColumn("p", F.explode(places))
           .where("small or p.j = own").select("shingle", "tile", "p.i", "p.j", "node", "n", "pos", "label",
                                               (F.col("small") & (F.col("p.i") == F.col("own"))).alias("small"),
                                               (F.col("p.j") == F.col("own")).alias("large")))
    full = cut.join(sets.select("node", F.col("kept").alias("bits")), "node").select(*keys, "node", "n", "pos", "label", "small", "large", "bits")

    def square(rows: list[tuple]) -> list[tuple[int, int, float]]:
        """Pairs of one square that nothing rules out: (node, n, pos, label, small, large, bits) rows."""
        width = min(len(r[6]) for r in rows)
        if len(rows) <= 24:                                   # whole numbers as bitmaps beat arrays on few rows
            found = _few_pairs(rows, width)
            return _best_of(found) if best else found
        node, n, pos, label, small, large = (np.array([r[k] for r in rows]) for k in range(6))
        bits = np.stack([folded(np.frombuffer(r[6], np.uint64), width // 8) for r in rows])
        after = n - pos
        big, out = np.flatnonzero(large), []
        top, by = np.zeros(len(rows)), np.zeros(len(rows), np.int64)  # of each larger set, its best partner so far
        for i in np.flatnonzero(small):
            j = big[(label[big] != label[i]) & ((n[big] > n[i]) | ((n[big] == n[i]) & (node[big] > node[i]))) & (3 * n[big] <= 4 * n[i])]
            if len(j):
                common = np.minimum(overlap_bound(bits[j], n[j], bits[i], int(n[i])), np.minimum(after[j], after[i]))
                ok = enough(common, n[j], int(n[i]))
                j, like = j[ok], (common / (n[j] + int(n[i]) - common))[ok]
                if best and len(j):
                    more = like > top[j]
                    top[j[more]], by[j[more]] = like[more], i
                    j, like = j[[like.argmax()]], [like.max()]
                out += zip([int(node[i])] * len(j), node[j].tolist(), like)
        if best:
            at = np.flatnonzero(top)
            out = list({*out, *zip(node[by[at]].tolist(), node[at].tolist(), top[at])})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen = None, [], set()

        def batch(pairs: list[tuple[int, int, float]]) -> pa.RecordBatch:
            """A pair that the task has given lately, for another shingle, is left out."""
            new = {(a, b): x for a, b, x in pairs if (a, b) not in seen}
            if len(seen) > 1 << 19:
                seen.clear()
            seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in new], pa.int64()), pa.array([k[1] for k in new], pa.int64()),
                                               pa.array(list(new.values()), pa.float64())], ["a", "b", "like"])

        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:4] != at:
                    if len(held) > 1:
                        out += square(held)
                    at, held = row[:4], []
                held.append(row[4:])
            if out:
                yield batch(out)
        if len(held) > 1:
            yield batch(square(held))

    dealt = full.repartition(parts, *keys).sortWithinPartitions(*keys)
    return mapped(dealt, run, "a long, b long, like double").groupBy("a", "b").agg(F.max("like").alias("like"))


def _best_of(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """For each set the most alike of its partners."""
    top: dict[int, tuple[int, int, float]] = {}
    for p in pairs:
        for node in p[:2]:
            if node not in top or p[2] > top[node][2]:
                top[node] = p
    return list(set(top.values()))


def _few_pairs(rows: list[tuple], width: int) -> list[tuple[int, int, float]]:
    whole, mask = [], (1 << 8 * width) - 1
    for _, n, _, _, _, _, raw in rows:
        x, y = int.from_bytes(raw, "little"), 0
        while x:
            x, y = x >> 8 * width, y | x & mask
        whole.append((y, n - y.bit_count()))
    out = []
    for (node, n, pos, label, small, _, _), (u, spare) in zip(rows, whole):
        if small:
            for (other, m, at, other_label, _, large, _), (v, more) in zip(rows, whole):
                if large and label != other_label and (m, other) > (n, node) and 3 * m <= 4 * n:
                    common = min((n + m - (u ^ v).bit_count()) // 2, (u & v).bit_count() + min(spare, more), n - pos, m - at)
                    if enough(common, n, m):
                        out.append((node, other, common / (n + m - common)))
    return out


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows of documents, tile rows, the bitmaps of the tiles' sets, and into how many parts tiles are dealt."""
    rows = staged(_sets(docs))
    members = rows.where("segment is null").select("doc_id", "hash", "n", "node")
    load = members.agg(F.sum(F.col("n") / 4 + 1)).first()[0]
    frequencies = _frequencies(rows)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(int(load or 0), 1_000_000))
    tiles = staged(_tiles(_prefixes(docs, frequencies), parts))
    sets = _fetch(docs, tiles.select("node").distinct(), members.where("node is not null"), "bits")
    return members, tiles, sets, parts


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the sets on the left link with which on the right, by their whole sorted codes.

    The shared codes are the columns of two 0/1 matrices, COLUMNS at a time, whose product counts the intersections.
    """
    n, m = (np.array([len(s) for s in side]) for side in (left, right))
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(shared), COLUMNS):
        part = shared[k:k + COLUMNS]
        a, b = (np.zeros((len(side), len(part)), np.float32) for side in (left, right))
        for x, side in ((a, left), (b, right)):
            for row, s in zip(x, side):
                row[np.flatnonzero(np.isin(part, s, assume_unique=True))] = 1
        common += (a @ b.T).astype(np.int64)
    return enough(common, n[:, None], m[None, :])


def _link_counts(docs: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, others): with how many rows of other sets the sets of a component of three or more link.

    Links stay inside a component, so its sets meet there, cut into squares of at most TILE / 4 sets and about CODES
    codes a side. A square adds up its links by set and gives one row per set, however many links it has.
    """
    cuts = F.ceil(F.greatest(F.col("sets") / (TILE // 4), F.col("codes") / CODES)).cast("int")
    groups = nodes.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("codes")).where("sets > 2").select("component", cuts.alias("cuts"))
    dealt = staged(nodes.join(groups, "component").select("node", "component", "copies", "cuts", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("own")))
    whole = _fetch(docs, dealt.select("node"), known, "codes").select("node", "kept")
    places = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    keys = ["component", "i", "j"]
    rows = dealt.withColumn("p", F.explode(places)).join(whole, "node").select("component", "p.i", "p.j", "node", "copies", "own", "kept")

    def square(i: int, j: int, rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[2] == k] for k in ((i,) if i == j else (i, j))]
        if not all(sides):
            return []
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
        links = _linked(sets[0], sets[-1])
        if i == j:
            np.fill_diagonal(links, False)
        copies = [np.array([r[1] for r in side], np.int64) for side in sides]
        out = list(zip([r[0] for r in sides[0]], (links @ copies[-1]).tolist()))
        return out if i == j else out + list(zip([r[0] for r in sides[1]], (copies[0] @ links).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["node", "others"])

        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:3] != at:
                    if held:
                        out += square(*at[1:], held)
                    at, held = row[:3], []
                held.append(row[3:])
            yield batch(out)
        if held:
            yield batch(square(*at[1:], held))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = mapped(rows.repartition(parts, *keys).sortWithinPartitions(*keys), run, "node long, others long")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def near_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every document row.

    ``n_links`` is the number of other rows that the row links with, those of equal sets included. The components
    are those of :func:`near_groups`; all sets of one are then compared exactly with each other, so no link is left
    out. That work grows with the square of a component's distinct sets, but is dealt in squares, and what they give
    is a number a set. Documents without shingles have no links.
    """
    members, joined = _joined(docs)
    known = members.where("node is not null")
    nodes = staged(known.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
                   .join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"), F.sum("copies").alias("all"))
    others = F.when(F.col("sets") == 2, F.col("all") - F.col("copies")).otherwise(F.coalesce("others", F.lit(0)))  # two sets of one component link
    final = staged(nodes.join(names, "component").join(_link_counts(docs, known, nodes), "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + others).alias("n_links")))
    return members.join(final, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document row; see :func:`grouped`."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc_id, hash, n, node), and (node, component) of the nodes that links join under another one."""
    members, tiles, sets, parts = _prepared(docs)
    known = members.where("node is not null")

    def likely(rows: DataFrame) -> DataFrame:
        """Of the partners (node, to), for each node the one named most often, and the smallest."""
        votes = rows.where("node <> to").groupBy("node", "to").agg(F.count("*").alias("n")).groupBy("node").agg(
            F.max(F.struct("n", "to"))["to"].alias("most"), F.min("to").alias("least"))
        two = votes.select("node", F.explode(F.array_distinct(F.array("most", "least"))).alias("to"))
        return two.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()

    def open_tiles(links: DataFrame) -> DataFrame:
        """Tile rows, with their labels, of the shingles whose sets are not all in one group yet."""
        marked = tiles.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node"))
        ends = marked.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
        return staged(marked.join(ends, "shingle", "left_semi").select("shingle", "node", "n", "pos", "band", "label"))

    first = likely(tiles.select("node", F.explode(F.array_distinct(F.array("leader", "prior"))).alias("to")))
    links = _verified(_within_bound(first, sets), docs, known)
    # then across the groups so far, each set with the most alike one of another group that any of its tiles has:
    # sets of one group are never compared again, so a large group costs rounds, not pairs
    for _ in range(ROUNDS):
        near = staged(_banded_pairs(open_tiles(links), sets, parts, best=True))
        ways = near.select("a", "b", F.col("a").alias("node"), F.col("b").alias("to"), "like").union(near.select("a", "b", "b", "a", "like"))
        most = staged(ways.groupBy("node").agg(F.max(F.struct("like", "to", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
        found = _verified(most, docs, known)
        links = staged(links.union(found))
        if 4 * found.count() < most.count():
            break
    more = _verified(_banded_pairs(open_tiles(links), sets, parts).select("a", "b"), docs, known)
    return members, components(links.union(more))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n_shingles, component_id, kept) for every document row.

    ``kept`` is (unnamed, doc_id, hash) of the component's first row by id, null ids last, then by the hash of
    its text; it is null for a document without shingles.

    Two documents link when the Jaccard similarity of their sets of 5-word shingles is 0.75 or more; a
    component is what links reach, named by its smallest doc_id. Equal sets are one node. Only a shingle
    among a set's rarest can bring it a partner. First each node is compared with two likely partners,
    which joins most groups, then in rounds with the most alike one of another group in its tiles, as long as
    that joins many. For shingles whose sets are not all in one group yet, the tiles of :func:`_banded_pairs`
    then find every other candidate. All are compared exactly.

    Null and empty texts have no shingles and link with nothing; a null id is kept, has a null component
    when alone, and takes its group's otherwise; repeated rows are equal sets; other columns are left out;
    an empty table gives an empty result.
    """
    members, joined = _joined(docs)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    least = (members.where("node is not null").groupBy("node").agg(F.min(row).alias("least"))
             .join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = least.groupBy("component").agg(F.min("least").alias("kept"))
    final = staged(least.join(names, "component").select("node", "kept"))
    return members.join(final, "node", "left").select(
        "doc_id", "hash", F.col("n").alias("n_shingles"), F.coalesce("kept.doc_id", "doc_id").alias("component_id"), "kept")
