"""Schemas of the job store and of summary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIDEOS = "id long, filename string, original_path string, fps double, total_frames long, duration double, width int, height int, file_size long, created_at timestamp"
JOBS = (
    "id long, video_id long, status string, progress double, current_stage string, stage_detail string, error_message string, frames_extracted long, frames_filtered long, clusters_found long, "
    "video_pacing string, summary_confidence string, stability_ratio double, compression_ratio double, redundancy_removed double, temporal_coverage_score double, summary_reason string, "
    "created_at timestamp, updated_at timestamp, started_at timestamp, completed_at timestamp"
)
KEYFRAMES = "id long, job_id long, frame_index long, timestamp double, cluster_id int, distance_to_centroid double, output_path string, is_representative boolean"
LOGS = "id long, job_id long, stage string, message string, level string, created_at timestamp"

_FACTORS = "struct<representativeness:double,dominance:double,visual_richness:double,temporal_coverage:double,visual_novelty:double,motion_context:double>"
_LABELLED = "array<struct<label:string,score:double>>"
_KEYFRAME = (
    "struct<index:long,frame_id:long,timestamp:double,timestamp_formatted:string,cluster_id:long,scene_id:long,distance_to_centroid:double,path:string,importance_score:double,importance_confidence:string,"
    f"importance_factors:{_FACTORS},context:string,domain:string,deep_analysis:struct<caption:string,domain:string,domain_confidence:double,objects:{_LABELLED},actions:{_LABELLED},environment:{_LABELLED},attributes:{_LABELLED}>>"
)
SUMMARY = (
    "job_id long, video_filename string, video_duration double, total_frames_original long, frames_after_filtering long, num_clusters long, generated_at string, output_format string, grid_path string, "
    "video_pacing string, summary_confidence string, stability_ratio double, compression_ratio double, redundancy_removed double, temporal_coverage_score double, summary_reason string, scene_count long, "
    f"importance_weights {_FACTORS}, scenes array<struct<scene_id:long,start_time:double,end_time:double,start_frame:long,end_frame:long,duration:double,keyframe_count:long>>, keyframes array<{_KEYFRAME}>, _corrupt_record string"
)


def migrate(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks as nulls, cast and in the schema's order; others follow."""
    empty = df.sparkSession.createDataFrame([], schema)
    have = set(df.columns)
    wanted = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema]
    return df.select(*wanted, *[c for c in df.columns if c not in empty.columns])
