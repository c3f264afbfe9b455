"""Frame and label trees as a Spark data source: one folder per clip, one file per frame.

The planner lists clip folders only; tasks list and read the files of the clips dealt to them. Clips and frames
are chosen by options, so that other clips are not listed and other files not opened. They are not taken from
pushed filters: Spark 4.1 keeps a Python source's pushed filters for every later use of the same DataFrame.
"""

from __future__ import annotations

import re
import uuid
from typing import Iterator, NamedTuple, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Folders to try below a root, then frames, labels and split list below the one that has the layout.
LAYOUTS = {
    "davis": (("", "DAVIS", "davis"), "JPEGImages/{resolution}", ("Annotations/{resolution}",), "ImageSets/{year}/{split}.txt"),
    "mose": (("", "{split}", "val"), "JPEGImages", ("Annotations", "../Annotations"), None),
    "ytvos": (("{split}", ""), "JPEGImages", ("Annotations",), None),
}
IMAGES = (".jpg", ".jpeg", ".png")
BATCH_FILES, BATCH_BYTES = 64, 16 << 20       # of one Arrow batch; a single larger file is a batch of its own
SHAPE = "seq string, frame long, number long, name string, path string, length long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and its own form of a path or URI."""
    if re.match(r"file:/", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _is_dir(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.Directory


class Tree(NamedTuple):
    frames: str
    labels: str | None
    split_list: str | None


def locate(kind: str, roots: Sequence[str], split: str, resolution: str = "480p", year: str = "2017") -> Tree:
    """The first folder below one of the roots that has the layout."""
    if kind not in LAYOUTS:
        raise KeyError(f"unknown dataset kind {kind!r}; known: {sorted(LAYOUTS)}")
    bases, frames, labels, listed = LAYOUTS[kind]
    names = {"split": split, "resolution": resolution, "year": year}
    for root in roots:
        fs, top = file_system(root)
        for base in bases:
            at = "/".join(x for x in (top.rstrip("/"), base.format(**names)) if x)
            if _is_dir(fs, f"{at}/{frames.format(**names)}"):
                found = [p for p in (f"{at}/{x.format(**names)}" for x in labels) if _is_dir(fs, p)]
                return Tree(f"{at}/{frames.format(**names)}", found[0] if found else None, f"{at}/{listed.format(**names)}" if listed else None)
    raise FileNotFoundError(f"no {kind} frame folder below {list(roots)}")


class Clips(InputPartition):
    def __init__(self, folder: str, seqs: list[str]):
        self.folder, self.seqs = folder, seqs


class Written(WriterCommitMessage):
    pass


class FrameTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.seqs = set(options["clips"].split("\n")) if "clips" in options else None
        self.first, self.past = int(options.get("first_frame", "0")), int(options.get("past_frame", str(1 << 62)))

    def partitions(self) -> list[Clips]:
        o = self.o
        tree = locate(o["kind"], o["path"].split("\n"), o.get("split", "val"), o.get("resolution", "480p"), o.get("year", "2017"))
        fs, _ = file_system(o["path"].split("\n")[0])
        if o.get("what", "frames") == "labels" and tree.labels is None:
            raise FileNotFoundError(f"no annotation folder beside {tree.frames}")
        folder = tree.labels if o.get("what", "frames") == "labels" else tree.frames
        named = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.Directory]
        if tree.split_list and o.get("split_list", "true") == "true":
            named = listed_clips(fs, tree.split_list, named, o.get("allow_missing_split", "false") == "true")
        named = sorted(s for s in named if self.seqs is None or s in self.seqs)
        n = max(1, min(len(named), int(o.get("partitions", "200"))))
        return [Clips(folder, named[i::n]) for i in range(n)]

    def read(self, partition: Clips) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.o["path"].split("\n")[0])
        with_content = self.o.get("content", "true") == "true"
        names = ["seq", "frame", "number", "name", "path", "length"] + (["content"] if with_content else [])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + ([pa.binary()] if with_content else [])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for seq in partition.seqs:
            files = [i for i in fs.get_file_info(pafs.FileSelector(f"{partition.folder}/{seq}"))
                     if i.type == pafs.FileType.File and i.base_name.lower().endswith(IMAGES)]
            for frame, info in enumerate(sorted(files, key=lambda i: i.base_name)):
                if not self.first <= frame < self.past:
                    continue
                name = info.base_name.rsplit(".", 1)[0]
                row = [seq, frame, int(name) if re.fullmatch(r"[0-9]{1,18}", name) else None, name, info.path, info.size]
                if with_content:
                    if rows and size + info.size > BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
                    with fs.open_input_stream(info.path) as f:
                        row.append(f.read())
                    size += info.size
                rows.append(row)
                if len(rows) >= BATCH_FILES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class FrameTreeWriter(DataSourceArrowWriter):
    """Writes (file, content) rows below a root. A file appears under its name when it is whole, so tasks may be run again."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.root)
        made: set[str] = set()
        for b in iterator:
            for file, content in zip(b.column("file").to_pylist(), b.column("content")):
                path = f"{root.rstrip('/')}/{file}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                fs.move(part, path)
        return Written()


class FrameTree(DataSource):
    """``spark.read.format("frame_tree")``; options: path, kind, split, resolution, year, what, content,
    allow_missing_split, clips (one a line), first_frame, past_frame, partitions."""

    @classmethod
    def name(cls) -> str:
        return "frame_tree"

    def schema(self) -> str:
        return SHAPE + (", content binary" if self.options.get("content", "true") == "true" else "")

    def reader(self, schema) -> FrameTreeReader:
        return FrameTreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FrameTreeWriter:
        return FrameTreeWriter(dict(self.options))


def listed_clips(fs: pafs.FileSystem, path: str, clips: Sequence[str], allow_missing: bool) -> list[str]:
    """The clips that a split list, a file or a folder of text files, names.

    A list that is absent or names no clip fails, or stands for all clips if that is allowed.
    """
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.NotFound:
        if allow_missing:
            return list(clips)
        raise FileNotFoundError(f"split list {path} does not exist")
    parts = [path] if kind == pafs.FileType.File else [
        i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File and i.base_name[0] not in "._"]
    named: set[str] = set()
    for part in parts:
        with fs.open_input_stream(part) as f:
            named |= {line.strip() for line in f.read().decode("utf-8").splitlines()}
    kept = [s for s in clips if s in named]
    if not kept and not allow_missing:
        raise ValueError(f"split list {path} names no clip of the dataset")
    return kept or list(clips)


def use_frame_trees(spark: SparkSession) -> None:
    spark.dataSource.register(FrameTree)


def read_tree(spark: SparkSession, kind: str, roots: str | Sequence[str], split: str = "val", what: str = "frames", content: bool = True,
              allow_missing_split: bool = False, clips: Sequence[str] | None = None, frames: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """(seq, frame, number, name, path, length[, content]) of the first root with the layout.

    ``frame`` is the position in the clip's name order, ``number`` the number in the file's name (NULL without one).
    ``what`` is ``frames`` or ``labels``. Only the named ``clips`` are listed, and of ``frames`` (first, past the last)
    only those places are opened. Roots are on one file system.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    if what not in ("frames", "labels"):
        raise ValueError(f"what is 'frames' or 'labels', not {what!r}")
    locate(kind, roots, split, options.get("resolution", "480p"), options.get("year", "2017"))
    use_frame_trees(spark)
    o = {"kind": kind, "path": "\n".join(roots), "split": split, "what": what, "content": str(content).lower(),
         "allow_missing_split": str(allow_missing_split).lower(), "partitions": spark.conf.get("spark.sql.shuffle.partitions"), **options}
    if clips is not None:
        o["clips"] = "\n".join(clips)
    if frames is not None:
        o["first_frame"], o["past_frame"] = (str(i) for i in frames)
    return spark.read.format("frame_tree").options(**o).load()


def write_tree(df: DataFrame, root: str) -> None:
    """Write (file, content) rows as files below ``root``; ``file`` is the path relative to it."""
    use_frame_trees(df.sparkSession)
    df.select("file", "content").write.format("frame_tree").mode("append").option("path", root).save()
