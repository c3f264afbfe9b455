"""Decoded frames, split lists and video shards."""

from __future__ import annotations

import hashlib
from typing import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from ..functions.ordered import ordinal
from ..functions.text import text_chunk

# Where the frame folders of the known layouts lie below a dataset root.
LAYOUTS = {
    "davis": ("JPEGImages/480p", "JPEGImages"),
    "mose": ("{split}/JPEGImages", "JPEGImages"),
    "ytvos": ("{split}/JPEGImages", "JPEGImages"),
}
LABEL_DIRS = {"JPEGImages/480p": "Annotations/480p", "JPEGImages": "Annotations"}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).schema
        return True
    except AnalysisException:
        return False


def dataset_dirs(spark: SparkSession, kind: str, roots: str | Sequence[str], split: str = "val"
                 ) -> tuple[str, str]:
    """Frame and annotation folders of the first candidate root that has the layout."""
    if kind not in LAYOUTS:
        raise KeyError(f"unknown dataset kind {kind!r}; known: {sorted(LAYOUTS)}")
    for root in [roots] if isinstance(roots, str) else roots:
        for rel in LAYOUTS[kind]:
            frames = f"{root.rstrip('/')}/{rel.format(split=split)}"
            if _exists(spark, frames):
                return frames, frames.replace("JPEGImages", "Annotations")
    raise FileNotFoundError(f"no {kind} frame folder below {roots}")


def _named(df: DataFrame, path: str) -> DataFrame:
    """Clip and file name from ``.../<seq>/<name>.<ext>``."""
    return df.withColumn("seq", F.element_at(F.split(path, "/"), -2)).withColumn(
        "name", F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1))


def frame_index(df: DataFrame) -> DataFrame:
    """``frame`` is the position of a file in its clip's name order, not the number in the name."""
    return ordinal(df, ["seq"], ["name"], text_chunk("name"), "frame")


def list_frames(spark: SparkSession, frames_dir: str, pattern: str = "*.{jpg,jpeg,png}"
                ) -> DataFrame:
    """(seq, frame, name, path, length) of a frame tree without reading the pixels."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True).load(frames_dir)
    return frame_index(_named(raw.select("path", "length"), "path"))


@F.pandas_udf(BinaryType())
def _rgb(data: pd.Series, h: pd.Series, w: pd.Series, ch: pd.Series) -> pd.Series:
    out = []
    for px, a, b, k in zip(data, h, w, ch):
        img = np.frombuffer(bytes(px), np.uint8).reshape(a, b, k)
        img = np.repeat(img, 3, axis=2) if k == 1 else img[..., 2::-1]
        out.append(np.ascontiguousarray(img).tobytes())
    return pd.Series(out, dtype=object)


def read_frames(spark: SparkSession, frames_dir: str, pattern: str = "*.{jpg,jpeg,png}"
                ) -> DataFrame:
    """Decoded RGB frames. The JVM image source decodes; its BGR order is turned round."""
    raw = spark.read.format("image").option("dropInvalid", False).option(
        "pathGlobFilter", pattern).option("recursiveFileLookup", True).load(frames_dir)
    d = _named(raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"),
                          F.col("image.width").alias("w"), F.col("image.nChannels").alias("_c"),
                          F.col("image.data").alias("_d")), "path")
    index = frame_index(_named(raw.select(F.col("image.origin").alias("path")), "path")).select(
        "seq", "name", "frame")
    return d.join(index, ["seq", "name"]).select(
        "seq", "frame", "h", "w", _rgb("_d", "h", "w", "_c").alias("rgb"))


def filter_split(df: DataFrame, spark: SparkSession, split_file: str,
                 allow_missing_split: bool = False) -> DataFrame:
    """Rows of the clips named in a split list.

    A missing list or one that names no clip fails, unless all clips are asked for explicitly.
    """
    try:
        names = spark.read.text(split_file).select(F.trim("value").alias("seq")).where(
            F.col("seq") != "").distinct()
        names.schema
    except AnalysisException:
        if allow_missing_split:
            return df
        raise FileNotFoundError(f"split list {split_file} does not exist") from None
    kept = df.join(names, "seq", "left_semi")
    if kept.limit(1).count() == 0:
        if allow_missing_split:
            return df
        raise ValueError(f"split list {split_file} names no clip of the dataset")
    return kept


def shard_inventory(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Frame ids per video of Parquet shards; the image columns are never read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select("video_id", "frame_id")


def shard_images(spark: SparkSession, path: str | Sequence[str], videos: DataFrame) -> DataFrame:
    """Images and annotations of the selected videos only."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.join(videos.select("video_id"), "video_id", "left_semi").select(
        "video_id", "frame_id", F.col("image.bytes").alias("image"),
        F.col("annotation.bytes").alias("annotation"))


HASH_WHOLE = 64 << 20  # bytes up to which a file is hashed as one value
# names from which the text source infers that it has to decompress
CODED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")
MARK = b"\xef\xbb\xbf"


class _Digest:
    """SHA-256 of a file from its pieces between line feeds. The text source drops a leading byte-order mark and does not
    tell of a last line feed; the length of the file tells both."""

    def __init__(self, length: int) -> None:
        self.length, self.n = length, 0
        self.hashes = hashlib.sha256(), hashlib.sha256(MARK)

    def add(self, pieces: list[bytes], first: bool) -> None:
        self._update(b"\n".join(pieces if first else [b"", *pieces]))

    def _update(self, data: bytes) -> None:
        self.n += len(data)
        for h in self.hashes:
            h.update(data)

    def result(self) -> str:
        marked, feed = divmod(self.length - self.n, len(MARK))
        if marked not in (0, 1) or feed not in (0, 1):
            raise ValueError(f"{self.n} of {self.length} bytes came")
        if feed:
            self._update(b"\n")
        return self.hashes[marked].hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file of a partition, which holds its files one after the other and whole."""
    path, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [unquote(path)], "length": pa.array([digest.length], pa.int64()),
                                           "sha256": [digest.result()]})

    for batch in batches:
        for p in batch.column(0).unique().to_pylist():
            rows = batch.filter(pc.equal(batch.column(0), p))
            if p != path:
                if path is not None:
                    yield done()
                path, digest = p, _Digest(rows.column(1)[0].as_py())
                digest.add(rows.column(2).to_pylist(), True)
            else:
                digest.add(rows.column(2).to_pylist(), False)
    if path is not None:
        yield done()


def _whole_files(spark: SparkSession) -> SparkSession:
    """A session whose scans give every file a task of its own and never split one."""
    s = spark.newSession()
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        s.conf.set(k, 1 << 40)
    return s


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 and size of every file below a folder; empty files, which no source of Spark lists, are not among them.

    SHA-256 is a chain, so one task reads a whole file; a file larger than ``HASH_WHOLE`` or than the binary source takes passes
    through it in pieces, cut at line feeds, and is never held as one value.
    """
    def below(s: SparkSession, kind: str, **options: str) -> DataFrame:
        return s.read.format(kind).options(pathGlobFilter=pattern, recursiveFileLookup=True, **options).load(path)

    raw = below(spark, "binaryFile")
    most = min(HASH_WHOLE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    hashes = raw.where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"))
    coded = F.regexp_extract("path", rf"\.({'|'.join(CODED)})$", 1)
    for (code,) in raw.where(F.col("length") > most).select(coded).distinct().collect():
        # the bytes as they are; Hadoop's shaded client looks for the second key under its own name
        options = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", **dict.fromkeys(
            ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension"), f".{code}")} if code else {}
        lines = below(_whole_files(spark), "text", lineSep="\n", **options).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary"))
        lines = lines.where((F.col("length") > most) & (coded == code))
        hashes = hashes.unionByName(lines.mapInArrow(_digests, "path string, length bigint, sha256 string"))
    return hashes
