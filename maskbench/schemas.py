"""Explicit schemas of the result tables and the key sets that identify their rows."""

from __future__ import annotations

from pyspark.sql.types import (BinaryType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

INSTANCE_KEY = ("seq", "obj_id", "mode", "degradation", "level", "arm")
SEQUENCE_KEY = ("seq", "mode", "degradation", "level", "arm")
CELL_KEY = ("seq", "mode", "degradation", "level")
CONDITION = ("degradation", "level")

IQA_FULL_REFERENCE = ("iqa_psnr", "iqa_ssim")
IQA_NO_REFERENCE = ("iqa_laplacian_var", "iqa_dark_channel", "iqa_contrast", "iqa_entropy",
                    "iqa_tenengrad", "iqa_saturation")
IQA_METRICS = IQA_FULL_REFERENCE + IQA_NO_REFERENCE

COUNTERS = ("n_decisions", "n_reanchors", "n_rejected", "n_reseeds", "n_encoder_calls",
            "n_predict_failures")


def _fields(spec: str) -> list[StructField]:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "d": DoubleType(),
             "b": BinaryType()}
    return [StructField(n, kinds[k]) for n, k in (item.split(":") for item in spec.split())]


def row_type(spec: str) -> StructType:
    """Struct type from ``name:kind`` items, usable before a session exists."""
    return StructType(_fields(spec))


RESULTS_CELL = StructType(_fields(
    "seq:s obj_id:i mode:s degradation:s is_compound:i level:d severity_mean:d severity_max:d "
    "frame_stride:i n_frames:i J:d F:d J&F:d n_decisions:i n_reanchors:i tau_score:d "
    "reseed_stride:i n_rejected:i n_reseeds:i n_encoder_calls:i n_predict_failures:i "
    "wall_time_s:d arm:s arm_note:s bank_size:i"))

RESULTS_FRAME = StructType(RESULTS_CELL.fields + _fields(
    "frame:i J_frame:d F_frame:d JF_frame:d vacuity:d selected_op:i n_evaluated:i agree_a:d "
    "agree_c:d agree_u:d is_keyframe:i clean_reference:i " + " ".join(f"{m}:d" for m in IQA_METRICS)))

CORRECTED_CELL = StructType(RESULTS_CELL.fields + _fields(
    "n_present:i n_clip:i p1_scale:d protocol:s J_raw:d F_raw:d J&F_raw:d"))

FRAMES = StructType(_fields("seq:s frame:l h:i w:i rgb:b"))
LABELS = StructType(_fields("seq:s frame:l h:i w:i ids:b"))
MASKS = StructType(_fields("seq:s obj_id:i frame:l h:i w:i bits:b area:l"))
PRESENCE = StructType(_fields("seq:s obj_id:i n_clip:i n_present:i"))
MANIFEST = StructType(_fields("video_id:s n_frames:i n_objects:i object_ids:s"))
TRACE = StructType(_fields(
    "seq:s mode:s mask_prompt:s degradation:s level:d frame:i J:d F:d JF:d pred_area:l "
    "gt_area:l area_ratio:d n_evaluated:i is_keyframe:i backend_score:d"))
