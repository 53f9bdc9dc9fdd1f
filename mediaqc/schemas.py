"""Schemas of the verdict, the forensic record, the stored tables and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOLEAN, TIME = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
TEXTS, FLOATS = T.ArrayType(STRING), T.ArrayType(T.FloatType())

# fixed values: the columns of a verdict, their types and defaults
VERDICT_COLUMNS = [
    ("pv_image_id", STRING, ""),
    ("validation_status", STRING, "Pending Review"),
    ("duplicate_status", STRING, "Unique"),
    ("matched_image_id", STRING, ""),
    ("original_status", STRING, ""),
    ("similarity_score", DOUBLE, 0.0),
    ("exit_layer", INT, 0),
    ("has_face", BOOLEAN, False),
    ("face_count", INT, 0),
    ("is_screenshot", BOOLEAN, False),
    ("is_manipulated", BOOLEAN, False),
    ("has_required_branding", BOOLEAN, False),
    ("branding_details", STRING, ""),
    ("image_quality", STRING, ""),
    ("ai_confidence", DOUBLE, 0.0),
    ("gps_lat", DOUBLE, 0.0),
    ("gps_lon", DOUBLE, 0.0),
    ("gps_valid", BOOLEAN, False),
    ("cluster_id", STRING, ""),
    ("forensic_reasoning", STRING, ""),
    ("error_reason", STRING, ""),
    ("flash_model", STRING, ""),
    ("pro_model", STRING, ""),
    ("flash_prompt_tokens", INT, 0),
    ("flash_output_tokens", INT, 0),
    ("flash_total_tokens", INT, 0),
    ("flash_cost_usd", DOUBLE, 0.0),
    ("flash_cost_inr", DOUBLE, 0.0),
    ("pro_prompt_tokens", INT, 0),
    ("pro_output_tokens", INT, 0),
    ("pro_total_tokens", INT, 0),
    ("pro_cost_usd", DOUBLE, 0.0),
    ("pro_cost_inr", DOUBLE, 0.0),
    ("total_ai_tokens", INT, 0),
    ("total_ai_cost_usd", DOUBLE, 0.0),
    ("total_ai_cost_inr", DOUBLE, 0.0),
    ("usd_inr_rate", DOUBLE, 83.0),
    ("processing_time_ms", INT, 0),
    ("processed_at", STRING, ""),
    ("row_index", INT, -1),
]
# fixed values: the columns of the export and what they hold
EXPORT = [
    ("PV_Image_ID", "pv_image_id"),
    ("PV_Validation_Status", "validation_status"),
    ("PV_Duplicate_Status", "duplicate_status"),
    ("PV_Matched_Image_ID", "matched_image_id"),
    ("PV_Original_Status", "original_status"),
    ("PV_Similarity_Score_%", "similarity_score"),
    ("PV_Exit_Layer", "exit_layer"),
    ("PV_Has_Face", "has_face"),
    ("PV_Face_Count", "face_count"),
    ("PV_Is_Screenshot", "is_screenshot"),
    ("PV_Is_Manipulated", "is_manipulated"),
    ("PV_Has_Branding", "has_required_branding"),
    ("PV_Branding_Details", "branding_details"),
    ("PV_Image_Quality", "image_quality"),
    ("PV_AI_Confidence_%", "ai_confidence"),
    ("PV_GPS_Lat", "gps_lat"),
    ("PV_GPS_Lon", "gps_lon"),
    ("PV_GPS_Valid", "gps_valid"),
    ("PV_Cluster_ID", "cluster_id"),
    ("PV_Forensic_Reasoning", "forensic_reasoning"),
    ("PV_Error_Reason", "error_reason"),
    ("PV_Flash_Model", "flash_model"),
    ("PV_Pro_Model", "pro_model"),
    ("PV_Flash_Total_Tokens", "flash_total_tokens"),
    ("PV_Flash_Cost_INR", "flash_cost_inr"),
    ("PV_Pro_Total_Tokens", "pro_total_tokens"),
    ("PV_Pro_Cost_INR", "pro_cost_inr"),
    ("PV_Total_AI_Tokens", "total_ai_tokens"),
    ("PV_Total_AI_Cost_INR", "total_ai_cost_inr"),
    ("PV_Processing_Time_ms", "processing_time_ms"),
    ("PV_Processed_At", "processed_at"),
]

VERDICT = T.StructType([T.StructField(name, kind) for name, kind, _ in VERDICT_COLUMNS])
VERDICT_DEFAULTS = {name: default for name, _, default in VERDICT_COLUMNS}

# fixed values
FORENSICS = T.StructType([
    T.StructField("has_moire", BOOLEAN),
    T.StructField("moire_score", DOUBLE),
    T.StructField("has_bezel", BOOLEAN),
    T.StructField("bezel_score", DOUBLE),
    T.StructField("ela_score", DOUBLE),
    T.StructField("is_blurry", BOOLEAN),
    T.StructField("blur_score", DOUBLE),
    T.StructField("face_count", INT),
    T.StructField("has_gps", BOOLEAN),
    T.StructField("gps_lat", DOUBLE),
    T.StructField("gps_lon", DOUBLE),
    T.StructField("ss_software", BOOLEAN),
    T.StructField("flags", TEXTS),
    T.StructField("score", DOUBLE),
    T.StructField("is_borderline_moire", BOOLEAN),
    T.StructField("is_photo_of_photo", BOOLEAN),
    T.StructField("ioi_score", DOUBLE),
    T.StructField("ioi_signals", TEXTS),
])
# fixed values
REGISTRY = T.StructType([
    T.StructField("image_id", STRING),
    T.StructField("md5", STRING),
    T.StructField("ph_hi", LONG),
    T.StructField("ph_lo", LONG),
    T.StructField("dh_hi", LONG),
    T.StructField("dh_lo", LONG),
    T.StructField("wh_hi", LONG),
    T.StructField("wh_lo", LONG),
    T.StructField("seq", LONG),
    T.StructField("created_at", TIME),
])
# fixed values
VECTORS = T.StructType([
    T.StructField("image_id", STRING),
    T.StructField("emb", FLOATS),
    T.StructField("seq", LONG),
])
# fixed values
CLUSTERS = T.StructType([
    T.StructField("cluster_id", STRING),
    T.StructField("image_id", STRING),
    T.StructField("is_original", INT),
    T.StructField("created_at", TIME),
])


def completed(df: DataFrame, schema: T.StructType = VERDICT, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones and nulls get the default (additive migration)."""
    defaults = VERDICT_DEFAULTS if defaults is None else defaults
    have = set(df.columns)

    def column(f: T.StructField):
        default = F.lit(defaults.get(f.name)).cast(f.dataType)
        return (F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in have else default).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])
