"""What the operators share: staged tables, word codes and shingle sets."""

from __future__ import annotations

import ctypes
import math
import uuid
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import shared_dir

#: One word: everything between the white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, *by: str) -> DataFrame:
    """Write an intermediate table to the folder in ``spark.checkpoint.dir`` and read it back, in folders by ``by`` if given.

    Executors that are lost later then cost no recomputation of what lies before.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end: a worker stays for later tasks, and what it held
    counts against its executor until then."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return df.mapInArrow(freed, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | F.Column, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def parts_for(rows: int | None, each: int, least: int = 1) -> int:
    """Partitions or chunks that hold about ``each`` units."""
    return max(least, math.ceil((rows or 0) / each))


def text_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes over all bits (multiply and shift, wrapping)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Odd multipliers that tell the words of a shingle apart by their place.
PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit codes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct codes of the shingles of five words; fewer words make one shingle, none an empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_codes(words)
    width = len(PLACES)
    n = max(1, len(h) - width + 1)
    out = h[:n] * PLACES[0]
    for i in range(1, min(width, len(h))):
        out += h[i:i + n] * PLACES[i]
    out = mixed(out + np.uint64(min(width, len(h))))
    out.sort()
    return out[np.flatnonzero(np.concatenate(([True], out[1:] != out[:-1])))]


#: Bits of the filter of ids; it is as large for any input.
FILTER_BITS = 1 << 24


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``possible``: false only where a row's key is certainly not among ``ids`` (column of the same name).

    A Bloom filter of FILTER_BITS bits, at most FILTER_BITS / 64 rows of two longs, is broadcast. It spares
    most texts the shuffle of the exact join that follows on the possible rows.
    """
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    words = (ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("_bits")))
    marked = docs.withColumn("_at", at).join(F.broadcast(words), F.floor(F.col("_at") / 64) == F.col("_word"), "left")
    bit = F.expr("shiftrightunsigned(_bits, cast(_at % 64 as int)) & 1L")
    return marked.withColumn("possible", F.coalesce(bit, F.lit(0)) == 1).drop("_at", "_word", "_bits")


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that links reach, for all nodes but that one itself.

    Every round hangs all neighbours of a node and the node itself under the smallest of them,
    first seen from the larger, then from the smaller ends, until nothing moves. A node's list is
    never gathered: its minimum is a partial aggregate that is joined back to the links.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(limit):
        # large star: neighbours above a node go under its smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: neighbours below a node, and the node, go under the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        e = staged(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def term_table(digits: bool) -> bytes:
    """Byte table for ``bytes.translate``: only A-Z lower-cased; letters, bytes above 127 and, if asked, digits stay; the rest is a space.

    What ``translate(table).split()`` gives are then the maximal runs of such characters in UTF-8 text.
    """
    keep = lambda b: b >= 128 or chr(b).isalpha() or (digits and chr(b).isdigit())
    return bytes((b | 32 if b < 128 and chr(b).isalpha() else b) if keep(b) else 32 for b in range(256))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
