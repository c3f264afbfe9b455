"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import array
import bisect
import functools
import json
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .base import mapped, parts_for, staged

CAPACITY = 1024
END_ID = 2
PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


class ByteTokens:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    A text is cut at its spaces; each run between spaces, with the space before it, is encoded once and
    remembered up to a bound. The pre-tokenizer keeps a space with what follows it, so this cut never
    changes an id as long as no other white space touches the space; such texts, and texts that hold a
    special token, take the whole-text path.
    """

    LIMIT = 100_000

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # the file writes each byte as one printable character: printable ones as they are, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", mergeable_ranks=ranks, special_tokens={},
                                      pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
        self.known: dict[str, bytes | None] = {}

    @functools.cached_property
    def whole(self):
        """The tokenizer as such, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bytes:
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()

    def _run(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise LookupError
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        got = self.known[run] = self._plain(" " + run)
        return got

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        if first and first[-1].isspace() or not first and text:
            return self._plain(text)
        known = self.known
        try:
            return self._plain(first) + b"".join([known.get(r) or self._run(r) for r in rest])
        except LookupError:
            return self._plain(text)


_LOADED: dict[str, ByteTokens] = {}


def tokens_from(path: str) -> ByteTokens:
    """One tokenizer per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenised documents, cut where longer than the capacity; the first piece takes what is left over.

    ``ids`` holds the ids of a piece as bytes when asked for, else null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens_from(tokenizer), array.array("I", [end_id]).tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * lo:4 * hi]
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(part), part if keep_ids else None))
            if rows:
                names = PIECE.fieldNames()
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECE)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best-fit over ranges: rows (length, lo, hi, sequence, each, offset).

    Documents of one length are a range of ranks, sequences with one gap are ranges of numbers. A round
    takes the longest lengths left, finds for them the successor among the gaps, gives lower ranks the
    tighter gaps, fills a gap as often as the length goes into it, and updates the gaps. What no gap can
    take opens new sequences. Ranks lo to hi of a length go, ``each`` to a sequence, from ``offset`` on.
    A filled gap is less than half of what it was, so there are at most 3 * log2(capacity) * capacity rows,
    however many documents there are.
    """
    gaps: list[int] = []                                    # sorted sizes
    free: dict[int, list[tuple[int, int]]] = {}             # size -> ranges of sequences
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in free:
                bisect.insort(gaps, gap)
                free[gap] = []
            free[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, at, cut = counts[length], 0, []
        while left:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, n = free[gap].pop()
                if not free[gap]:
                    del free[gap]
                    gaps.pop(i)
            else:
                gap = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                out.append((length, at, at + full * each, first, each, capacity - gap))
                cut.append((gap - each * length, first, full))
                at, left = at + full * each, left - full * each
            if full < n and left:                           # the last sequence takes fewer
                out.append((length, at, at + left, first + full, left, capacity - gap))
                cut.append((gap - left * length, first + full, 1))
                full, at, left = full + 1, at + left, 0
            if full < n:
                cut.append((gap, first + full, n - full))
        for c in cut:                                       # the gaps change at the end of the round
            add(*c)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Bulk-synchronous best-fit. Spark tokenises, counts the lengths and ranks the pieces of each length, in
    chunks, so that a length with most of the pieces is spread; the rounds of :func:`best_fit` sweep over
    ranges of ranks, of which there are few by the capacity; a join on length and rank places each piece.

    Null text is empty (one token, the end id); a null id is kept; repeated rows are packed each; other
    columns are left out; an empty table gives an empty result. Returns doc_id, piece, start, length,
    ids_crc32, ids, sequence_id, offset.
    """
    spark = docs.sparkSession
    p = staged(pieces(docs, tokenizer, capacity, end_id, keep_ids))
    chunks = parts_for(p.count(), 20_000, 16)
    p = p.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    sizes = staged(p.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(counts, capacity)
    plan = spark.createDataFrame(runs, "length long, lo long, hi long, sequence long, each long, base long")
    if len(runs) <= 65_536:
        plan = F.broadcast(plan)
    before = sizes.select("length", "chunk", (F.sum("n").over(
        Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = (p.withColumn("inside", inside).join(before, ["length", "chunk"])
              .withColumn("rank", F.col("before") + F.col("inside")))
    step = F.col("rank") - F.col("lo")
    return (ranked.join(plan, "length").where("rank >= lo and rank < hi")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "ids",
                    (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("base") + step % F.col("each") * F.col("length")).cast("long").alias("offset")))
