"""Result, mask and frame tables derived from the given tables, in Spark and as SQL.

Every view grows with its table: clips are suppliers, users, customers or runs of vectors, so
more data means more clips of the same length. Each Spark view has its SQL text in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordered import number_chunk, ordinal
from ..operators.gate import decision_frame
from ..operators.masks import bits_from_array

MODES = ("base", "method", "memory")
DEGRADATIONS = ("clean", "fog", "noise", "fog_noise", "blur")
LEVELS = (1.0, 2.0, 3.0)
COMPOUND_MAP = {"fog_noise": ("fog", "noise")}
METRICS = ("iqa_a", "iqa_b", "iqa_c")

SQL: dict[str, str] = {}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views, and what they build on, as common table expressions."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in DEPENDS.get(n, ()):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- result rows from lineitem ------------------------------------------------------------

SQL["rows_raw"] = """
SELECT l_suppkey AS seq, CAST(1 + l_linenumber % 2 AS INTEGER) AS obj_id,
  CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'N' THEN 'method' ELSE 'memory' END AS mode,
  CASE CAST(round(l_tax * 100) AS INTEGER) % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'fog'
    WHEN 2 THEN 'noise' WHEN 3 THEN 'fog_noise' ELSE 'blur' END AS degradation,
  CAST(1 + l_partkey % 3 AS DOUBLE) AS level, '' AS arm,
  l_quantity / 50 AS jf_frame, l_extendedprice / 700 AS iqa_a, l_discount AS iqa_b,
  CAST(l_partkey % 101 AS DOUBLE) AS iqa_c, (l_partkey % 97) / 97.0::DOUBLE AS vacuity,
  l_extendedprice / 30000 AS area_ratio, CAST(l_partkey % 13 AS INTEGER) AS selected_op,
  l_linenumber, l_discount, l_orderkey, l_partkey, l_extendedprice, l_shipdate
FROM lineitem"""

SQL["rf"] = """
SELECT *, CASE WHEN frame > 0 AND (frame % 5 = 0 OR frame = 1) THEN 1 ELSE 0 END AS is_keyframe
FROM (SELECT *, row_number() OVER (PARTITION BY seq, obj_id, mode, degradation, level
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, jf_frame, iqa_b) - 1 AS frame
  FROM rows_raw)"""

SQL["rc"] = """
SELECT seq, obj_id, mode, degradation, level, arm, round(avg(jf_frame), 12) AS jf, avg(jf_frame) AS jf_exact, stddev_pop(jf_frame) AS jf_std,
  count(*) AS n_frames, count(*) FILTER (l_discount >= 0.09) AS n_reanchors,
  count(*) FILTER (l_discount >= 0.07) AS n_rejected,
  CAST(sum(1 + l_linenumber % 3) AS BIGINT) AS n_encoder_calls,
  count(*) FILTER (l_discount >= 0.1) AS n_predict_failures,
  CASE WHEN degradation = 'clean' THEN 1.0::DOUBLE ELSE avg(1 + 40 * l_discount) END AS severity_mean,
  CASE WHEN degradation = 'clean' THEN 1.0::DOUBLE ELSE max(1 + 40 * l_discount) END AS severity_max
FROM rows_raw GROUP BY seq, obj_id, mode, degradation, level, arm"""

SQL["cl"] = """
SELECT seq, mode, degradation, level, arm, round(avg(jf_exact), 12) AS jf, stddev_pop(jf) AS jf_std,
  count(*) AS n_objects, avg(n_encoder_calls) AS n_encoder_calls, avg(n_reanchors) AS n_reanchors
FROM rc GROUP BY seq, mode, degradation, level, arm"""


def score(x) -> Column:
    """Mean score to twelve decimals: equal scores then tie however they were summed.

    Further means start from the unrounded ``jf_exact``, since halving a rounded score would
    put it on the edge of the next rounding.
    """
    return F.round(F.avg(x), 12).alias("jf")


def rows_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored frames without frame numbers: a projection of lineitem, no shuffle."""
    d = table(spark, sf_dir, "lineitem")
    flag, tax = F.col("l_returnflag"), F.round(F.col("l_tax") * 100).cast("int") % 5
    deg = F.element_at(F.array(*[F.lit(x) for x in DEGRADATIONS]), tax + 1)
    return d.select(
        F.col("l_suppkey").alias("seq"),
        (1 + F.col("l_linenumber") % 2).cast("int").alias("obj_id"),
        F.when(flag == "A", "base").when(flag == "N", "method").otherwise("memory").alias("mode"),
        deg.alias("degradation"),
        (1 + F.col("l_partkey") % 3).cast("double").alias("level"),
        F.lit("").alias("arm"),
        (F.col("l_quantity") / 50).alias("jf_frame"),
        (F.col("l_extendedprice") / 700).alias("iqa_a"),
        F.col("l_discount").alias("iqa_b"),
        (F.col("l_partkey") % 101).cast("double").alias("iqa_c"),
        ((F.col("l_partkey") % 97) / 97.0).alias("vacuity"),
        (F.col("l_extendedprice") / 30000).alias("area_ratio"),
        (F.col("l_partkey") % 13).cast("int").alias("selected_op"),
        "l_linenumber", "l_discount", "l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate",
    )


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored frames, numbered per instance cell by the chunked ordinal."""
    d = ordinal(rows_raw(spark, sf_dir), ["seq", "obj_id", "mode", "degradation", "level"],
                ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
                 "jf_frame", "iqa_b"], number_chunk("l_orderkey"), "frame", small_keys=True)
    return d.withColumn("is_keyframe", decision_frame("frame", 5).cast("int"))


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instance cell with its counters."""
    clean = F.col("degradation") == "clean"
    sev = 1 + 40 * F.col("l_discount")
    return rows_raw(spark, sf_dir).groupBy(
        "seq", "obj_id", "mode", "degradation", "level", "arm").agg(
        score("jf_frame"), F.avg("jf_frame").alias("jf_exact"), F.stddev_pop("jf_frame").alias("jf_std"),
        F.count("*").alias("n_frames"),
        F.count_if(F.col("l_discount") >= 0.09).alias("n_reanchors"),
        F.count_if(F.col("l_discount") >= 0.07).alias("n_rejected"),
        F.sum(1 + F.col("l_linenumber") % 3).alias("n_encoder_calls"),
        F.count_if(F.col("l_discount") >= 0.1).alias("n_predict_failures"),
        F.avg(sev).alias("_m"), F.max(sev).alias("_x"),
    ).select("*", F.when(clean, 1.0).otherwise(F.col("_m")).alias("severity_mean"),
             F.when(clean, 1.0).otherwise(F.col("_x")).alias("severity_max")).drop("_m", "_x")


def clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per clip, arm and condition."""
    return cell_rows(spark, sf_dir).groupBy("seq", "mode", "degradation", "level", "arm").agg(
        score("jf_exact"), F.stddev_pop("jf").alias("jf_std"), F.count("*").alias("n_objects"),
        F.avg("n_encoder_calls").alias("n_encoder_calls"), F.avg("n_reanchors").alias("n_reanchors"))


# ---- ablation and sweep arms --------------------------------------------------------------

SQL["abl_cells"] = """
SELECT l_suppkey AS seq, CAST(1 + l_partkey % 2 AS INTEGER) AS obj_id, 'method' AS mode,
  CASE WHEN l_returnflag = 'A' THEN 'fog' ELSE 'fog_noise' END AS degradation,
  3.0::DOUBLE AS level, 'A' || (l_linenumber - 1) AS arm, round(avg(l_quantity / 50), 12) AS jf, avg(l_quantity / 50) AS jf_exact,
  CAST(sum(1 + l_linenumber % 3) AS BIGINT) AS n_encoder_calls
FROM lineitem GROUP BY ALL"""

SQL["abl"] = """
SELECT seq, mode, degradation, level, arm, round(avg(jf_exact), 12) AS jf, avg(n_encoder_calls) AS n_encoder_calls
FROM abl_cells GROUP BY ALL"""

SQL["swp"] = """
SELECT seq, arm, round(avg(jf), 12) AS jf FROM (
  SELECT l_suppkey AS seq, l_linenumber % 2 AS obj_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'A8' WHEN 1 THEN 'A9' ELSE 'A10' END || '=' || (3 + 2 * (l_partkey % 3)) AS arm,
    avg(l_quantity / 50) AS jf
  FROM lineitem GROUP BY ALL) GROUP BY ALL"""


def ablation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.groupBy(
        F.col("l_suppkey").alias("seq"), (1 + F.col("l_partkey") % 2).cast("int").alias("obj_id"),
        F.lit("method").alias("mode"),
        F.when(F.col("l_returnflag") == "A", "fog").otherwise("fog_noise").alias("degradation"),
        F.lit(3.0).alias("level"),
        F.concat(F.lit("A"), (F.col("l_linenumber") - 1).cast("string")).alias("arm"),
    ).agg(score(F.col("l_quantity") / 50), F.avg(F.col("l_quantity") / 50).alias("jf_exact"),
          F.sum(1 + F.col("l_linenumber") % 3).alias("n_encoder_calls"))


def ablation_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation_cells(spark, sf_dir).groupBy("seq", "mode", "degradation", "level", "arm").agg(
        score("jf_exact"), F.avg("n_encoder_calls").alias("n_encoder_calls"))


def sweep_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    third = F.col("l_linenumber") % 3
    arm = F.concat(F.when(third == 0, "A8").when(third == 1, "A9").otherwise("A10"), F.lit("="),
                   (3 + 2 * (F.col("l_partkey") % 3)).cast("string"))
    return d.groupBy(F.col("l_suppkey").alias("seq"), (F.col("l_linenumber") % 2).alias("obj_id"),
                     arm.alias("arm")).agg(F.avg(F.col("l_quantity") / 50).alias("jf")
                                           ).groupBy("seq", "arm").agg(score("jf"))


# ---- decision frames from events ----------------------------------------------------------

SQL["gf"] = """
SELECT inst, frame, vacuity, jf, op,
  CASE WHEN frame > 0 AND (frame % 5 = 0 OR frame = 1) THEN 1 ELSE 0 END AS is_keyframe
FROM (SELECT user_id AS inst, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  value / (value + 50) AS vacuity, ((event_id * 37) % 101) / 100.0::DOUBLE AS jf,
  CAST(event_id % 5 AS INTEGER) AS op FROM events)"""


def gate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("inst"), "ts", "event_id",
        (F.col("value") / (F.col("value") + 50)).alias("vacuity"),
        ((F.col("event_id") * 37 % 101) / 100.0).alias("jf"),
        (F.col("event_id") % 5).cast("int").alias("op"))
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    d = ordinal(d, ["inst"], ["ts", "event_id"], hour, "frame", small_keys=True)
    return d.select("inst", "frame", "vacuity", "jf", "op",
                    decision_frame("frame", 5).cast("int").alias("is_keyframe"))


# ---- masks, candidates and small frames from embeddings -----------------------------------

SQL["px"] = """
SELECT vec_id, CAST(t.i // 8 AS INTEGER) AS y, CAST(t.i % 8 AS INTEGER) AS x,
  embedding[t.i + 1] AS v, embedding[t.i + 1] > 0 AS is_on
FROM embeddings, range(64) t(i)"""

SQL["mset"] = "SELECT vec_id, y, x FROM px WHERE is_on"


def masks8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 masks: a pixel is set where the vector is positive. 16 vectors make a clip."""
    d = table(spark, sf_dir, "embeddings")
    m = d.select("vec_id", F.floor(F.col("vec_id") / 16).alias("seq"), F.lit(1).alias("obj_id"),
                 (F.col("vec_id") % 16).alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"),
                 bits_from_array(F.transform("embedding", lambda x: x.cast("double"))).alias("bits"))
    return m.withColumn("area", F.size(F.filter(F.split(F.conv(F.hex("bits"), 16, 2), ""),
                                                lambda x: x == "1")).cast("bigint"))


def mask_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted masks and, as truth, the mask of the following vector."""
    m = masks8(spark, sf_dir)
    gt = m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits"))
    return m, gt


SQL["cand"] = """
SELECT vec_id, vec_id // 40 AS seq, (vec_id // 5) % 8 AS frame, CAST(vec_id % 5 AS INTEGER) AS op
FROM embeddings"""


def candidates8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidate masks per frame, eight frames per clip."""
    return masks8(spark, sf_dir).select(
        "vec_id", F.floor(F.col("vec_id") / 40).alias("seq"),
        (F.floor(F.col("vec_id") / 5) % 8).alias("frame"),
        (F.col("vec_id") % 5).cast("int").alias("op"), "h", "w", "bits", "area")


def anchors8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warped anchor of a frame: its first candidate, shifted by the next vector's mask."""
    c = candidates8(spark, sf_dir).where(F.col("op") == 0)
    return c.select("seq", "frame", "bits", "area")


SQL["fpx"] = """
SELECT vec_id // 3 AS fid, (vec_id // 3) // 16 AS seq, (vec_id // 3) % 16 AS frame, vec_id % 3 AS ch, y, x,
  CAST(least(255, greatest(0, floor((v::DOUBLE + 1) * 127.5))) AS INTEGER) AS u
FROM px WHERE vec_id // 3 < (SELECT count(*) // 3 FROM embeddings)"""


def frames8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 RGB frames: three consecutive vectors are the channels; a short rest is no frame."""
    d = table(spark, sf_dir, "embeddings")
    u8 = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(
        F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int"))
    pick = lambda k: F.max(F.when(F.col("ch") == k, F.col("u")))
    g = d.select(F.floor(F.col("vec_id") / 3).alias("fid"), (F.col("vec_id") % 3).alias("ch"),
                 u8.alias("u")).groupBy("fid").agg(
        *[pick(k).alias(f"c{k}") for k in range(3)], F.count("*").alias("k")).where("k = 3")
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    rgb = F.zip_with("c0", F.arrays_zip("c1", "c2"),
                     lambda a, b: F.concat(byte(a), byte(b["c1"]), byte(b["c2"])))
    return g.select("fid", F.floor(F.col("fid") / 16).cast("string").alias("seq"),
                    (F.col("fid") % 16).alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"),
                    F.unhex(F.array_join(rgb, "")).alias("rgb"))


def text_frames(spark: SparkSession, sf_dir: str, width: int = 32) -> DataFrame:
    """Frames of varied size from whole texts: the UTF-8 bytes are the pixels, zero-padded to
    full rows. 16 documents make a clip."""
    d = table(spark, sf_dir, "documents")
    row = 3 * width
    raw = F.encode("text", "UTF-8")
    h = F.greatest(F.lit(1), F.ceil(F.length(raw) / row)).cast("int")
    return d.select(F.col("doc_id"), F.floor(F.col("doc_id") / 16).cast("string").alias("seq"),
                    (F.col("doc_id") % 16).alias("frame"), h.alias("h"), F.lit(width).alias("w"),
                    F.rpad(raw, h * row, F.lit(b"\x00")).alias("rgb"))


# ---- smaller stand-ins --------------------------------------------------------------------

SQL["prof"] = """
SELECT o_custkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'base' WHEN 'F' THEN 'method' ELSE 'memory' END AS mode,
  'fog' AS degradation, 4.0::DOUBLE AS level, 10 + o_custkey % 50 AS n_frames,
  (10 + o_custkey % 50) + o_orderkey % 40 AS encoder_calls, o_totalprice / 100000 AS fps
FROM orders"""


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    n = 10 + F.col("o_custkey") % 50
    return d.select(F.col("o_custkey").alias("seq"),
                    F.when(st == "O", "base").when(st == "F", "method").otherwise("memory").alias("mode"),
                    F.lit("fog").alias("degradation"), F.lit(4.0).alias("level"), n.alias("n_frames"),
                    (n + F.col("o_orderkey") % 40).alias("encoder_calls"),
                    (F.col("o_totalprice") / 100000).alias("fps"))


SQL["vid"] = """
SELECT conv_id AS video_id, turn AS frame_id FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)"""


def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as frame ids; every seventh video lacks frame 1."""
    d = table(spark, sf_dir, "conversations")
    return d.where(~((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1))).select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_id"))


SQL["pres"] = """
SELECT seq, obj_id, mode, degradation, level, count(*) AS n_clip, count(*) FILTER (l_discount > 0) AS n_present
FROM rows_raw GROUP BY ALL"""

SQL["p0"] = """
SELECT seq, obj_id, mode, degradation, level, arm, avg(CASE WHEN l_discount > 0 THEN jf_frame ELSE 0 END) AS jf,
  count(*) AS n_frames FROM rows_raw GROUP BY ALL HAVING count(*) FILTER (l_discount > 0) > 0"""


def presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_raw(spark, sf_dir).groupBy("seq", "obj_id", "mode", "degradation", "level").agg(
        F.count("*").alias("n_clip"), F.count_if(F.col("l_discount") > 0).alias("n_present"))


def p0_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose absent frames scored 0; cells where the object never appears are no cells."""
    g = rows_raw(spark, sf_dir).groupBy("seq", "obj_id", "mode", "degradation", "level", "arm").agg(
        F.avg(F.when(F.col("l_discount") > 0, F.col("jf_frame")).otherwise(0.0)).alias("jf"),
        F.count("*").alias("n_frames"), F.count_if(F.col("l_discount") > 0).alias("_p"))
    return g.where(F.col("_p") > 0).drop("_p")


DEPENDS = {
    "rf": ("rows_raw",), "rc": ("rows_raw",), "cl": ("rc",), "abl": ("abl_cells",),
    "mset": ("px",), "fpx": ("px",), "pres": ("rows_raw",), "p0": ("rows_raw",),
}
