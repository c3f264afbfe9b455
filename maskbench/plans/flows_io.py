"""Queries that go through files and streams: Spark writes rows derived from the given tables
to the shared folder, and the operator under test reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..session import materialise, shared_dir
from ..sources import files, results
from ..streaming import results_stream as rs
from . import views as V
from .association import _PROFILE, _gate_sql
from .registry import query


def scratch(spark, name: str) -> str:
    """A new folder below the shared one for each run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# ---- files --------------------------------------------------------------------------------


def _csv_rows(spark, sf):
    c = V.cell_rows(spark, sf)
    return c.select("seq", "obj_id", "mode", "degradation", "level", "n_frames", F.col("jf").alias("J&F"),
                    "n_reanchors", "n_encoder_calls")


@query("result_csv_scan", """SELECT mode, count(*) FILTER (seq % 25 <> 7) AS rows, count(*) FILTER (seq % 25 = 7) AS dropped, avg(jf) FILTER (seq % 25 <> 7) AS jf
FROM rc GROUP BY mode""", ["rc"], "jf")
def _(spark, sf):
    """Result CSV in two folders; the rows of some clips stop after the mode column."""
    d = _csv_rows(spark, sf)
    torn = F.col("seq") % 25 == 7
    keep = ("seq", "obj_id", "mode")
    d = d.select(*keep, *[F.when(~torn, F.col(f"`{c}`")).alias(c) for c in d.columns if c not in keep])
    path = scratch(spark, "csv")
    for half in (0, 1):
        d.where(F.col("seq") % 2 == half).write.option("header", True).csv(f"{path}/{half}")
    rows, dropped = results.scan_results(spark, [f"{path}/0", f"{path}/1"])
    return rows.select("mode", F.lit(1).alias("ok"), F.col("`J&F`").alias("v")).unionByName(
        dropped.select("mode", F.lit(0).alias("ok"), F.lit(None).cast("double").alias("v"))
    ).groupBy("mode").agg(F.count_if(F.col("ok") == 1).alias("rows"),
                          F.count_if(F.col("ok") == 0).alias("dropped"), F.avg("v").alias("jf"))


def _chunks(spark, sf):
    """Result CSV by arm: one chunk with its columns in reverse order, one with a column more and one less."""
    d, path = _csv_rows(spark, sf), scratch(spark, "chunks")
    for i, m in enumerate(V.MODES):
        one = d.where(F.col("mode") == m)
        if i % 3 == 1:
            one = one.select(*[F.col(f"`{c}`") for c in reversed(d.columns)])
        if i % 3 == 2:
            one = one.drop("n_reanchors").withColumn("note", F.lit("x"))
        one.write.option("header", True).csv(f"{path}/run_{m}")
    return path, d.columns


_CHUNK_NO = "CASE mode " + " ".join(f"WHEN '{m}' THEN {i % 3}" for i, m in enumerate(V.MODES)) + " END"


@query("chunk_scan", f"""SELECT mode AS chunk, mode, count(*) AS rows, avg(jf) AS jf, sum(CASE WHEN {_CHUNK_NO} = 2 THEN NULL ELSE n_reanchors END)::DOUBLE AS reanchors,
sum(n_encoder_calls)::DOUBLE AS calls FROM rc GROUP BY mode""", ["rc"], "jf reanchors calls")
def _(spark, sf):
    """Chunks are read by their own headers: columns in another order are mapped by name, a missing one is NULL."""
    rows, dropped = results.scan_results(spark, _chunks(spark, sf)[0])
    both = rows.unionByName(dropped)
    return both.withColumn("chunk", F.regexp_extract("_src", "/run_([^/]+)/", 1)).groupBy("chunk", "mode").agg(
        F.count("*").alias("rows"), F.avg("`J&F`").alias("jf"), F.sum("n_reanchors").cast("double").alias("reanchors"),
        F.sum("n_encoder_calls").cast("double").alias("calls"))


@query("chunk_headers", f"""SELECT mode AS chunk, CASE WHEN {_CHUNK_NO} = 2 THEN 'n_reanchors' ELSE '' END AS missing,
CASE WHEN {_CHUNK_NO} = 2 THEN 'note' ELSE '' END AS extra, CASE WHEN {_CHUNK_NO} = 1 THEN 1 ELSE 0 END AS reordered FROM rc GROUP BY mode""", ["rc"])
def _(spark, sf):
    """Every chunk's deviation from the expected columns, from one scan of first lines."""
    path, expected = _chunks(spark, sf)
    report = results.header_report(results.file_headers(spark, path, "*.csv"), expected)
    return report.select(F.regexp_extract("path", "/run_([^/]+)/", 1).alias("chunk"), F.array_join("missing", ",").alias("missing"),
                         F.array_join("extra", ",").alias("extra"), "reordered").distinct()


@query("result_sink", "SELECT mode, count(*) AS n, avg(jf) AS jf FROM cl WHERE degradation = 'fog' AND level = 2 GROUP BY mode", ["cl"], "jf")
def _(spark, sf):
    path = scratch(spark, "sink")
    results.write_results(V.clip_rows(spark, sf), path)
    d = results.read_results(spark, path).where("degradation = 'fog' AND level = 2")
    return d.groupBy("mode").agg(F.count("*").alias("n"), F.avg("jf").alias("jf"))


@query("append_sink", "SELECT degradation, level, count(*) AS n FROM cl GROUP BY ALL", ["cl"])
def _(spark, sf):
    path, c = scratch(spark, "append"), V.clip_rows(spark, sf)
    for m in V.MODES:
        results.append_results(c.where(F.col("mode") == m), path)
    return results.read_results(spark, path).groupBy("degradation", "level").agg(F.count("*").alias("n"))


@query("degraded_frames_sink", """SELECT degradation, level, count(*) AS n, CAST(sum(96 * greatest(1, ceil(strlen(text) / 96))) AS BIGINT) AS bytes
FROM documents, (VALUES ('clean', 1.0::DOUBLE), ('fog', 3.0::DOUBLE)) t(degradation, level) GROUP BY ALL""")
def _(spark, sf):
    path = scratch(spark, "frames")
    d = fr.degraded_sequences(V.text_frames(spark, sf), [("clean", 1.0), ("fog", 3.0)])
    fr_cols = ["seq", "frame", "h", "w", "rgb", "severity", "degradation", "level"]
    results.write_degraded(d.select(*fr_cols), path)
    return results.read_results(spark, path).groupBy("degradation", "level").agg(
        F.count("*").alias("n"), F.sum(F.length("rgb")).alias("bytes"))


@query("video_shard_images", """SELECT doc_id // 16 AS video_id, count(*) AS n_frames, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents
WHERE (doc_id // 16) % 3 = 1 GROUP BY 1""")
def _(spark, sf):
    """Frames of selected videos out of shards; the inventory reads the id columns only."""
    path = scratch(spark, "shards")
    raw = F.encode("text", "UTF-8")
    V.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 16).alias("video_id"), (F.col("doc_id") % 16).alias("frame_id"),
        F.struct(raw.alias("bytes")).alias("image"), F.struct(raw.alias("bytes")).alias("annotation")
    ).write.parquet(path)
    videos = files.shard_inventory(spark, path).where("video_id % 3 = 1").select("video_id").distinct()
    return files.shard_images(spark, path, videos).groupBy("video_id").agg(
        F.count("*").alias("n_frames"), F.sum(F.length("image")).alias("bytes"))


@query("file_hashes", "SELECT CAST(count(*) > 0 AS INTEGER) AS hashed, count(*) FILTER (false) AS short FROM region")
def _(spark, sf):
    d = files.file_hashes(spark, sf, "*.parquet")
    return d.agg((F.count("*") > 0).cast("int").alias("hashed"),
                 F.count_if(F.length("sha256") != 64).alias("short"))


# ---- streams ------------------------------------------------------------------------------


def _landed(spark, df, name: str, parts: int = 4) -> str:
    """Rows as several files, so that a stream meets them in several batches."""
    path = scratch(spark, name)
    df.repartition(parts).write.parquet(path)
    return path


@query("stream_ingest", "SELECT mode, count(*) AS n, avg(jf) AS jf FROM rc GROUP BY mode", ["rc"], "jf")
def _(spark, sf):
    """Every row arrives twice; each key lands once."""
    d = V.cell_rows(spark, sf).select("seq", "obj_id", "mode", "degradation", "level", "jf", "n_frames")
    keys = ["seq", "obj_id", "mode", "degradation", "level"]
    d = d.withColumn("jf", F.round("jf", 12))
    src = _landed(spark, d.unionByName(d), "in", 2)
    out = scratch(spark, "out")
    rs.ingest_results(rs.result_stream(spark, src, d.schema, files_per_trigger=1), f"{out}/rows",
                      f"{out}/conflicts", keys, ["jf", "n_frames"], f"{out}/ck", ["degradation", "level"])
    return spark.read.parquet(f"{out}/rows").groupBy("mode").agg(
        F.count("*").alias("n"), F.avg("jf").alias("jf"))


@query("stream_ingest_conflicts", "SELECT mode, count(*) AS n FROM rc WHERE seq % 10 = 4 GROUP BY mode", ["rc"])
def _(spark, sf):
    """A later file disagrees on some rows: they go to the side table, the first version stays."""
    keys = ["seq", "obj_id", "mode", "degradation", "level"]
    d = V.cell_rows(spark, sf).select(*keys, "n_frames")
    src, out = scratch(spark, "in"), scratch(spark, "out")
    d.write.parquet(src)
    rs.ingest_results(rs.result_stream(spark, src, d.schema), f"{out}/rows", f"{out}/conflicts", keys,
                      ["n_frames"], f"{out}/ck")
    late = d.where("seq % 10 IN (4, 5)").withColumn(
        "n_frames", F.col("n_frames") + F.when(F.col("seq") % 10 == 4, 1).otherwise(0))
    late.write.mode("append").parquet(src)
    rs.ingest_results(rs.result_stream(spark, src, d.schema), f"{out}/rows", f"{out}/conflicts", keys,
                      ["n_frames"], f"{out}/ck")
    return spark.read.parquet(f"{out}/conflicts").groupBy("mode").agg(F.count("*").alias("n"))


@query("stream_means", "SELECT mode, degradation, level, count(*) AS n, avg(jf_frame) AS mean FROM rows_raw GROUP BY ALL", ["rows_raw"], "mean")
def _(spark, sf):
    d = V.rows_raw(spark, sf).select("mode", "degradation", "level", F.col("jf_frame").alias("jf"))
    src, out = _landed(spark, d, "in"), scratch(spark, "out")
    live = rs.live_means(rs.result_stream(spark, src, d.schema, files_per_trigger=2))
    keys = ["mode", "degradation", "level"]
    rs.upsert_latest(live, f"{out}/rows", f"{out}/ck", keys)
    return rs.latest(spark, f"{out}/rows", keys)


_CELL = "seq, obj_id, mode, degradation, level"


@query("stream_complete_cells", f"""SELECT {_CELL}, count(*) AS n_rows, avg(jf_frame) AS jf, min(CASE WHEN seq % 6 = 3 AND n >= 2 THEN 0 ELSE 1 END)::INTEGER AS complete
FROM (SELECT *, count(*) OVER (PARTITION BY {_CELL}) AS n FROM rf) WHERE NOT (seq % 6 = 3 AND n >= 2 AND frame = 0) GROUP BY ALL""", ["rf"], "jf")
def _(spark, sf):
    """Cells are emitted once all declared frames came. Every third clip lacks its first frame: for half of these it comes an hour
    late, the others are given up when the clock has moved on. Rows of finished cells that come again change nothing."""
    inst = _CELL.split(", ")
    d = V.frame_rows(spark, sf)
    n = d.groupBy(*inst).agg(F.count("*").alias("n_frames"))
    # every wave reads the rows: they are numbered once
    d = materialise(d.join(n, inst).select(*inst, "frame", F.col("jf_frame").alias("score"), "n_frames"))
    gap = "seq % 3 = 0 AND n_frames >= 2 AND frame = 0"
    clock = d.where("seq % 3 = 1").groupBy().agg(F.min(F.struct(*d.columns)).alias("r")).where("r IS NOT NULL").select("r.*")
    waves = [(d.where(f"NOT ({gap})"), "2024-01-01 00:00:00"), (d.where(f"{gap} AND seq % 6 = 0 OR seq % 3 = 1"), "2024-01-01 01:00:00"),
             (clock, "2024-01-03 00:00:00")]
    rs.use_rocksdb(spark)
    src, out, hour = scratch(spark, "in"), scratch(spark, "out"), 3_600_000
    for rows, at in waves:
        rows = rows.withColumn("at", F.lit(at).cast("timestamp"))
        rows.repartition(4).write.mode("append").parquet(src)
        cells = rs.complete_cells(rs.result_stream(spark, src, rows.schema, files_per_trigger=2), inst, 6 * hour, 24 * hour)
        rs.run_available(cells.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), f"{out}/ck")
    return spark.read.parquet(f"{out}/rows")


_SRC4 = "src AS (SELECT *, 0.4::DOUBLE AS tau FROM gf)"


@query("stream_gate", "SELECT inst, f.frames AS frames, coalesce(g.events, 0) AS events, coalesce(g.rejections, 0) AS rejections, coalesce(g.longest, 0) AS longest FROM "
       "(SELECT inst, count(*) AS frames FROM gf GROUP BY inst) f LEFT JOIN (WITH " + _SRC4 + " " + _gate_sql("tau", False) + ") g USING (inst)", ["gf"])
def _(spark, sf):
    """Frames arrive in arbitrary order over several batches; the counter equals the batch one."""
    d = V.gate_frames(spark, sf).select("inst", "frame", "is_keyframe", "vacuity")
    rs.use_rocksdb(spark)
    src, out = _landed(spark, d, "in"), scratch(spark, "out")
    live = rs.live_gate(rs.result_stream(spark, src, d.schema, files_per_trigger=2), ["inst"], 0.4, 2)
    rs.upsert_latest(live, f"{out}/rows", f"{out}/ck", ["inst"])
    return rs.latest(spark, f"{out}/rows", ["inst"])


@query("stream_profile", "SELECT * FROM (WITH " + _PROFILE + " SELECT inst, op, n_updates, w FROM w)", ["gf"], "w")
def _(spark, sf):
    """Operator profiles as live state over decisions that arrive out of order."""
    from ..functions.ordered import number_chunk, ordinal
    g = V.gate_frames(spark, sf).where("is_keyframe = 1")
    g = ordinal(g, ["inst"], ["frame"], number_chunk("frame"), "k")
    mass = F.array(*[F.when(F.col("op") == i, F.col("vacuity")).otherwise(0.0) for i in range(5)])
    d = g.select("inst", "k", mass.alias("mass"))
    rs.use_rocksdb(spark)
    src, out = _landed(spark, d, "in"), scratch(spark, "out")
    live = rs.live_profile(rs.result_stream(spark, src, d.schema, files_per_trigger=2), ["inst"], 5)
    rs.upsert_latest(live, f"{out}/rows", f"{out}/ck", ["inst"])
    t = rs.latest(spark, f"{out}/rows", ["inst"]).where("n_updates > 0")
    return t.select("inst", F.col("n_updates"), F.posexplode("w").alias("op", "w"))
