"""Table schemas, settings and constants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

DISCOVERED, ANALYZING, ANALYZED, FAILED = "DISCOVERED", "ANALYZING", "ANALYZED", "ERROR"
PROPOSED, APPROVED, DONE = "PROPOSED", "APPROVED", "DONE"
IMAGE, VIDEO, SIDECAR, RAW, UNKNOWN = "IMAGE", "VIDEO", "SIDECAR", "RAW", "UNKNOWN"
LEVELS = ("date", "location", "device", "orientation", "media")
GAP_SECONDS = 12 * 3600
SPAN_SECONDS = 24 * 3600
CAPTURE_SECONDS = 5 * 60
NEAR_DEGREES, FAR_DEGREES, FAR_SQUARED, KM_PER_DEGREE = 0.09, 0.45, 0.2025, 111.0
NEAREST_FETCH = 32


def _struct(spec: str) -> StructType:
    kinds = {"l": LongType(), "s": StringType(), "i": IntegerType(), "d": DoubleType(), "b": BooleanType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


FILE_REGISTRY = _struct(
    "id:l file_dir:s file_name:s file_size:l file_modified_at:s volume_uuid:s discovered_at:s last_seen_at:s deleted_at:s "
    "media_type:s file_extension:s scan_status:s file_origin:s"
)
FILE_METADATA = _struct(
    "file_id:l file_hash:s hash_kind:s exif_image_width:i exif_image_height:i exif_image_orientation:i exif_gps_latitude:d exif_gps_longitude:d "
    "exif_make:s exif_model:s exif_date_time_original:s exif_create_date:s exif_creation_date:s exif_media_create_date:s is_screenshot:b is_master:b created_at:s"
)
ENTRIES = _struct("file_id:l source_path:s target_path:s cluster_id:s status:s location_dir:s taken_at:s created_at:s")
USER_LABELS = _struct("label:s kind:s created_at:s")
PLACES = _struct("rowid:l city:s latitude:d longitude:d state:s country:s country_code:s")


@dataclass(frozen=True)
class PlanConfig:
    """Settings that decide target folders.  ``rules`` of just "none" means no levels, empty rules the default."""

    rules: tuple[str, ...] = ("date", "location")
    fallback: str = "Unsorted"
    gap_seconds: int = GAP_SECONDS
    collapse_levels: bool = True
    saved_places_date_only: bool = True
    merge_days: bool = True
    saved_places: tuple[str, ...] = field(default=())

    @property
    def levels(self) -> tuple[str, ...]:
        if tuple(self.rules) == ("none",):
            return ()
        return tuple(self.rules) or ("date", "location")

    @property
    def gap(self) -> int:
        return self.gap_seconds if self.gap_seconds > 0 else GAP_SECONDS
