"""Parameters of the timeline operators."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
FACTORS = ("representativeness", "dominance", "visual_richness", "temporal_coverage", "visual_novelty", "motion_context")
BASE_WEIGHTS = {"representativeness": 0.25, "dominance": 0.15, "visual_richness": 0.20, "temporal_coverage": 0.15, "visual_novelty": 0.15, "motion_context": 0.10}
PROGRESS = {"pending": 0, "uploaded": 5, "extracting_frames": 15, "filtering_redundancy": 30, "extracting_features": 45, "normalizing": 55, "finding_optimal_k": 65, "clustering": 75, "selecting_keyframes": 85, "generating_summary": 95, "completed": 100, "failed": 0}


@dataclass(frozen=True)
class Settings:
    """Thresholds in the units of the timeline (seconds, grey levels). The defaults are fixed values."""

    skip_intro: float = 3.0
    dark: float = 25.0
    blur: float = 30.0
    similarity: float = 0.75
    scene_floor: float = 0.3
    low_entropy: float = 2.5
    low_score: float = 0.40
    max_per_cluster: int = 2
    first_gap: float = 0.5
    second_gap: float = 1.0
    min_clusters: int = 4
    max_clusters: int = 30
    kmeans_inits: int = 15
    kmeans_steps: int = 300
    seed: int = 42
    max_upload_mb: int = 500
    max_duration: float = 600.0
    extensions: tuple[str, ...] = ("mp4", "avi", "mov", "mkv", "webm")
    image_formats: tuple[str, ...] = ("jpg", "png", "webp")
    weights: dict[str, float] = field(default_factory=lambda: dict(BASE_WEIGHTS))

    def public(self, spark: SparkSession) -> DataFrame:
        """The settings a client may see, one row."""
        shown = {k: v for k, v in asdict(self).items() if k in ("max_upload_mb", "max_duration", "min_clusters", "max_clusters", "similarity", "blur", "dark", "max_per_cluster")}
        return spark.createDataFrame([tuple(shown.values())], list(shown))


DEFAULT = Settings()
