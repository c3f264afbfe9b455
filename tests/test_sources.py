"""File sources on small trees, and streams against their batch twins."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskbench.kernels.png import read_png, write_png
from maskbench.sources import files, frame_tree as ft, labels, results


def png(a: np.ndarray, colour: int, depth: int = 8, palette: bool = False, kind: int = 0) -> bytes:
    """Minimal PNG writer; ``kind`` is the row filter."""
    h, w = a.shape[:2]
    raw = b""
    above = np.zeros(w * (3 if colour == 2 else 1), np.int64)
    for y in range(h):
        row = a[y].reshape(-1).astype(np.int64)
        left = np.concatenate([[0], row[:-1]])
        diag = np.concatenate([[0], above[:-1]])
        p = left + above - diag
        da, db, dc = abs(p - left), abs(p - above), abs(p - diag)
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2,
                 4: np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, diag))}[kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))
    if palette:
        out += chunk(b"PLTE", bytes(range(256)) * 3)
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture()
def tree(tmp_path):
    """Two clips in the 480p layout; palette labels with ids 0, 1, 2, 4."""
    rng = np.random.default_rng(0)
    for s, n in (("bear", 3), ("cows", 2)):
        for kind in ("JPEGImages", "Annotations"):
            (tmp_path / kind / "480p" / s).mkdir(parents=True)
        for t in range(n):
            img = rng.integers(0, 255, (6, 8, 3)).astype(np.uint8)
            (tmp_path / f"JPEGImages/480p/{s}/{t * 5:05d}.png").write_bytes(png(img, 2))
            lab = np.zeros((6, 8), np.uint8)
            lab[1:3, 1:4], lab[3:5, 2:6], lab[5, 7] = 1, 2, 4
            (tmp_path / f"Annotations/480p/{s}/{t:05d}.png").write_bytes(png(lab, 3, palette=True, kind=t % 3))
    (tmp_path / "ImageSets/2017").mkdir(parents=True)
    (tmp_path / "ImageSets/2017/val.txt").write_text("cows\n\n")
    (tmp_path / "ImageSets/2017/none.txt").write_text("zebra\n")
    return tmp_path


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    """Images of one stack have their own predictions; other shapes and colours form other stacks."""
    rng = np.random.default_rng(kind)
    grey = [rng.integers(0, 255, (9, 13)).astype(np.uint8) for _ in range(5)]
    flat, wide = rng.integers(0, 255, (1, 1)).astype(np.uint8), rng.integers(0, 255, (3, 40)).astype(np.uint8)
    back = read_png([png(a, 0, kind=(kind + i) % 5) for i, a in enumerate(grey)] + [png(flat, 0, kind=kind), png(wide, 3, kind=kind)])
    assert all((a == b).all() for a, b in zip([*grey, flat, wide], back))


@pytest.mark.parametrize("kind", range(3))
def test_png_round_trip(kind):
    rng = np.random.default_rng(kind)
    for a in (rng.integers(0, 255, (7, 5)).astype(np.uint8), rng.integers(0, 255, (4, 6, 3)).astype(np.uint8)):
        assert (read_png([write_png(a, kind)])[0] == a).all()
    with pytest.raises(ValueError):
        write_png(a, 3)


def test_png_low_depth():
    bits = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1]], np.uint8)
    packed = np.packbits(bits, axis=1)
    data = png(packed, 3, depth=1)
    data = data.replace(struct.pack(">II", 2, 1), struct.pack(">II", 9, 1), 1)
    assert (read_png([data])[0] == bits).all()
    with pytest.raises(ValueError):
        read_png([png(np.zeros((2, 2), np.uint8), 0, depth=16)])
    with pytest.raises(ValueError):
        read_png([b"GIF89a"])


def test_frame_tree(spark, tree):
    frames_dir, labels_dir = files.dataset_dirs(spark, "davis", ["/nonexistent-root", str(tree)])
    idx = {(r.seq, r.name): r.frame for r in files.list_frames(spark, frames_dir).collect()}
    assert idx == {("bear", "00000"): 0, ("bear", "00005"): 1, ("bear", "00010"): 2,
                   ("cows", "00000"): 0, ("cows", "00005"): 1}
    f = files.read_frames(spark, frames_dir).orderBy("seq", "frame").collect()
    first = np.random.default_rng(0).integers(0, 255, (6, 8, 3)).astype(np.uint8)
    assert len(f) == 5 and (f[0].h, f[0].w) == (6, 8) and bytes(f[0].rgb) == first.tobytes()
    assert labels_dir.endswith("Annotations/480p")
    lab = labels.palette_labels(ft.read_tree(spark, "davis", str(tree), what="labels", split="any", allow_missing_split=True))
    ids = np.frombuffer(bytes(lab.where("seq = 'bear' AND frame = 1").first().ids), np.uint8)
    assert set(ids) == {0, 1, 2, 4}
    with pytest.raises(FileNotFoundError):
        files.dataset_dirs(spark, "davis", "/nonexistent-root")
    with pytest.raises(KeyError):
        files.dataset_dirs(spark, "nope", str(tree))


def test_split_filter(spark, tree):
    d = files.list_frames(spark, str(tree / "JPEGImages/480p"))
    lists = tree / "ImageSets/2017"
    assert {r.seq for r in files.filter_split(d, spark, str(lists / "val.txt")).collect()} == {"cows"}
    for bad, err in (("none.txt", ValueError), ("missing.txt", FileNotFoundError)):
        with pytest.raises(err):
            files.filter_split(d, spark, str(lists / bad))
        assert files.filter_split(d, spark, str(lists / bad), allow_missing_split=True).count() == 5


def test_tree_source(spark, tree):
    """Split list, missing list, chosen clips and frames, labels without frames, and errors before any job."""
    read = lambda *a, **k: sorted((r.seq, r.frame, r.number) for r in ft.read_tree(spark, "davis", *a, **k).collect())
    every = [("bear", 0, 0), ("bear", 1, 5), ("bear", 2, 10), ("cows", 0, 0), ("cows", 1, 5)]
    assert read([str(tree / "absent"), str(tree)]) == every[3:]
    assert read(str(tree), "nowhere", allow_missing_split=True) == every
    assert read(str(tree), "none", allow_missing_split=True) == every
    assert read(str(tree), clips=["bear"], split_list="false") == every[:3]
    assert read(str(tree), clips=["zebra"], split_list="false") == []
    assert read(str(tree), frames=(1, 3), split_list="false") == [every[1], every[2], every[4]]
    for bad in ("none", "nowhere"):
        with pytest.raises(Exception, match="split list"):
            read(str(tree), bad)
    with pytest.raises(FileNotFoundError):
        ft.read_tree(spark, "davis", str(tree / "absent"))
    with pytest.raises(KeyError):
        ft.read_tree(spark, "nope", str(tree))
    with pytest.raises(ValueError):
        ft.read_tree(spark, "davis", str(tree), what="masks")


def test_tree_source_reads_large_and_odd_files(spark, tmp_path, monkeypatch):
    """Batches are cut by bytes; names without a number, other extensions and an empty clip do no harm."""
    rows = [(f"v/JPEGImages/a/{i:05d}.jpg", bytes([i]) * 1000) for i in range(150)] + [
        ("v/JPEGImages/a/note.txt", b"x"), ("v/JPEGImages/a/z1.PNG", b""), ("v/JPEGImages/b/.keep", b""), ("v/JPEGImages/a/00000.jpg", bytes([0]) * 1000)]
    ft.write_tree(spark.createDataFrame(rows, "file string, content binary"), str(tmp_path))
    got = ft.read_tree(spark, "mose", str(tmp_path), "v").orderBy("frame").collect()
    assert [(r.frame, r.number, bytes(r.content)) for r in got] == [(i, i, bytes([i]) * 1000) for i in range(150)] + [(150, None, b"")]
    monkeypatch.setattr(ft, "BATCH_BYTES", 2500)
    reader = ft.FrameTreeReader({"kind": "mose", "path": str(tmp_path), "split": "v"})
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert max(sizes) <= 3 and sum(sizes) == 151
    assert not list(tmp_path.rglob("*.part"))


def _label_rows(spark, *maps):
    return spark.createDataFrame([(f"s{i}", i, m) for i, m in enumerate(maps)], "seq string, number long, content binary")


def test_binary_label_is_one_object(spark):
    rows = _label_rows(spark, png(np.array([[0, 255], [255, 0]], np.uint8), 0), png(np.array([[0, 7], [255, 0]], np.uint8), 0))
    got = [list(bytes(r.ids)) for r in labels.palette_labels(rows).orderBy("seq").collect()]
    assert got == [[0, 1, 1, 0], [0, 7, 255, 0]]


def test_colour_labels(spark):
    a = np.zeros((2, 3, 3), np.uint8)
    a[0, 1], a[1, 2] = (10, 0, 0), (0, 0, 7)
    rows = _label_rows(spark, png(a, 2), png(np.full((1, 2, 3), 9, np.uint8), 2), png(np.array([[0, 3]], np.uint8), 0))
    ids = lambda d: [list(bytes(r.ids)) for r in d.orderBy("seq").collect()]
    # sorted keys: black, blue (7), red (655360); black uses up number 1
    assert ids(labels.colour_labels(rows)) == [[0, 3, 0, 0, 0, 2], [1, 1], [0, 2]]
    meta = json.dumps({"objects": {"": {"5": {"palette": [10, 0, 0]}, "6": {"palette": [1, 1, 1]}}}})
    named = labels.meta_colours(spark.createDataFrame([(meta,)], "value string"))
    assert ids(labels.colour_labels(rows, named)) == [[0, 5, 0, 0, 0, 0], [0, 0], [0, 0]]
    # a category without colours falls back to ranks
    other = F.when(F.col("seq") == "s0", "").otherwise("cat")
    assert ids(labels.colour_labels(rows, named, other)) == [[0, 5, 0, 0, 0, 0], [1, 1], [0, 2]]
    assert labels.colour_labels(rows.limit(0), named).count() == 0


HEADER = "seq,obj_id,mode,degradation,level,n_frames,J&F"


def test_torn_line_and_format_checks(spark, tmp_path):
    a = tmp_path / "run_a.csv"
    a.write_text(HEADER + "\nbear,1,greedy,fog,3.0,4,0.5\nbear,2,greedy,fog,3,4,nan\ncows,1,greedy,fog,3.0,4,0.25\ncows,1,gree")
    rows, dropped = results.scan_results(spark, str(a))
    assert rows.count() == 2 and dropped.count() == 2
    assert {r.level for r in rows.collect()} == {3.0}
    b = tmp_path / "run_b.csv"
    b.write_text(HEADER + ",frame\nbear,1,greedy,fog,3.0,4,0.5,0\n")
    with pytest.raises(ValueError):
        results.scan_results(spark, [str(a), str(b)])
    (tmp_path / "run_out.csv").write_text(HEADER + "\n")
    found = results.discover_chunks(spark, str(tmp_path), "run_", exclude=["run_out.csv"])
    assert [p.rsplit("/", 1)[-1] for p in found] == ["run_a.csv", "run_b.csv"]
    with pytest.raises(ValueError):
        results.check_headers(spark, found)
    assert results.check_headers(spark, [found[0], str(tmp_path / "run_out.csv")]) == HEADER.split(",")


def test_union_header_csv(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "seq string, n int")
    b = spark.createDataFrame([("y", 2.5)], "seq string, v double")
    results.write_results_csv([a, b], str(tmp_path / "o"))
    d = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert d.columns == ["seq", "n", "v"] and d.count() == 2


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    r = files.file_hashes(spark, str(tmp_path)).first()
    assert r.sha256 == hashlib.sha256(b"abc").hexdigest() and r.length == 3


def test_files_beyond_the_binary_source_are_hashed_in_pieces(spark, tmp_path):
    """A low limit stands for the 2 GiB of a value: any bytes, names and last lines give the digest of the whole file."""
    import hashlib
    import os

    mark, noise, key = b"\xef\xbb\xbf", os.urandom(200_000), "spark.sql.sources.binaryFile.maxLength"
    held = {"a b%20+.bin": noise, "s/ü#x.bin": mark + noise + b"\n", "s/marked": mark + mark + noise, "feeds": b"\n" * 5000, "crlf": b"\r\n" * 3000,
            "one": b"\0" * 9000, "n.gz": noise, "n.bz2": noise[::-1], "x.snappy": mark + noise + b"\n\n", "z.zst": noise, "d.deflate": noise, "l.lz4": noise, "small.gz": b"\n1", "limit": b"x" * 4096}
    os.mkdir(tmp_path / "s")
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get(key)
    spark.conf.set(key, 4096)
    try:
        rows = files.file_hashes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    found = {os.path.relpath(r.path.removeprefix("file:"), tmp_path): (r.length, r.sha256) for r in rows}
    assert len(rows) == len(held) and found == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in held.items()}


def test_shard_inventory_reads_ids_only(spark, tmp_path):
    d = spark.range(20).select((F.col("id") % 4).alias("video_id"), F.col("id").alias("frame_id"),
                               F.struct(F.lit(b"x").alias("bytes")).alias("image"),
                               F.struct(F.lit(b"y").alias("bytes")).alias("annotation"))
    d.write.parquet(str(tmp_path / "s"))
    inv = files.shard_inventory(spark, str(tmp_path / "s"))
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<video_id:bigint,frame_id:bigint>" in plan
    img = files.shard_images(spark, str(tmp_path / "s"), inv.where("video_id = 2").select("video_id").distinct())
    assert img.count() == 5 and bytes(img.first().image) == b"x"


def test_checkpoint_dir_is_read_from_the_session(spark, tmp_path):
    from types import SimpleNamespace

    from maskbench.session import shared_dir

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "/shared/ck"))
    assert shared_dir(named) == "/shared/ck"
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None),
                              sparkContext=SimpleNamespace(master="yarn", applicationId="x"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_chunks_are_read_by_their_own_headers(spark, tmp_path):
    """Columns in another order are mapped by name; a chunk with other names is reported and, if asked, refused."""
    cols = HEADER.split(",")
    values = {c: "1" for c in cols} | {"seq": "s", "mode": "base", "degradation": "fog"}
    for name, order in (("run_a", cols), ("run b", cols[::-1]), ("run_c", cols[1:] + ["odd"])):
        (tmp_path / f"{name}.csv").write_text("\ufeff" * (name == "run_a") + ",".join(order) + "\n" + ",".join(values.get(c, "9") for c in order) + "\n")
    (tmp_path / "run_empty.csv").write_text("")
    heads = {r.path.rsplit("/", 1)[-1]: r for r in results.header_report(results.file_headers(spark, str(tmp_path), "run*.csv"), cols).collect()}
    assert len(heads) == 3 and heads["run_c.csv"].missing == [cols[0]] and heads["run_c.csv"].extra == ["odd"]
    assert [heads[k].reordered for k in ("run_a.csv", "run%20b.csv")] == [0, 1]
    rows, dropped = results.scan_results(spark, str(tmp_path))
    got = [r.asDict() for r in rows.drop("_src").collect()]
    assert len(got) == 2 and got[0] == got[1] and got[0]["mode"] == "base" and dropped.count() == 1
    with pytest.raises(ValueError, match="run_c"):
        results.check_headers(spark, [str(tmp_path / "run_a.csv"), str(tmp_path / "run_c.csv")])


def test_live_table_is_compacted(spark, tmp_path):
    """After 50 epochs as many files are read as after 6; a repeated epoch and an old one change nothing."""
    from maskbench.streaming import results_stream as rs

    path, want, files_at = str(tmp_path / "t"), {}, {}
    for epoch in range(50):
        rows = [(k, epoch * 10 + k) for k in (epoch % 7, (epoch + 3) % 7)]
        want.update(rows)
        rs.land_epoch(spark.createDataFrame(rows, "k int, v int").coalesce(1), path, epoch, ["k"])
        if epoch in (5, 24, 49):
            t = rs.latest(spark, path, ["k"])
            files_at[epoch] = len(t.inputFiles())
            assert t.columns == ["k", "v"] and {r.k: r.v for r in t.collect()} == want
    assert files_at[49] <= files_at[5] <= 4 and len(list((tmp_path / "t").glob("*-*"))) < 12
    rs.land_epoch(spark.createDataFrame(rows, "k int, v int").coalesce(1), path, 49, ["k"])
    assert {r.k: r.v for r in rs.latest(spark, path, ["k"]).collect()} == want
    with pytest.raises(FileNotFoundError):
        rs.latest(spark, str(tmp_path / "none"), ["k"])
