"""Run parameters. Every operator takes one ``Settings`` or the single value it needs."""

from __future__ import annotations

from dataclasses import dataclass, field

# Class codes, labels and default weights that results depend on.
CLASS_TITLES = {
    "D00": "Longitudinal Crack",
    "D10": "Transverse Crack",
    "D20": "Alligator Crack",
    "D40": "Pothole",
}
CLASS_CODES = ("D00", "D10", "D20", "D40")
EXCLUDED_CLASSES = ("D44", "D01", "D43", "D11", "D50", "D0w0")
THREE_CLASS = {"D00": 0, "D10": 0, "D20": 1, "D40": 2}
THREE_CLASS_NAMES = ("crack", "alligator", "pothole")
ORIENTATION = {"D00": "longitudinal", "D10": "transverse"}
SEVERITIES = ("Low", "Medium", "High")
STATUSES = ("New", "Open", "Repaired", "Failed", "unverified")
MEDIA_EXTENSIONS = (".jpg", ".jpeg", ".png", ".mp4", ".avi", ".mkv", ".webp")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mkv")
GPS_EXTENSIONS = (".csv", ".gpx")
EARTH_RADIUS_M = 6_371_000.0
SNAP_METRES_PER_DEGREE = 111_139.0


@dataclass(frozen=True)
class Settings:
    min_track_frames: int = 3
    frame_stride: int = 1
    fps: float = 30.0
    low_max_ratio: float = 0.02
    medium_max_ratio: float = 0.08
    near_zone_top_fraction: float = 0.5
    fair_min_index: float = 0.05
    poor_min_index: float = 0.15
    severity_weights: dict = field(default_factory=lambda: {"Low": 1.0, "Medium": 2.0, "High": 3.0})
    road_weights: dict = field(
        default_factory=lambda: {"primary": 1.5, "secondary": 1.25, "residential": 1.0}
    )
    exposed_factor: float = 1.5
    standard_factor: float = 1.0
    recurrent_factor: float = 1.5
    first_factor: float = 1.0
    match_radius_m: float = 10.0
    coverage_radius_m: float = 15.0
    exposure_radius_m: float = 200.0
    sensitive_kinds: tuple = ("school", "hospital")
    nominal_area_m2: dict = field(default_factory=lambda: {"Low": 0.5, "Medium": 1.5, "High": 3.0})
    unit_rate: float = 1500.0
    merge_radius_m: float = 5.0
    segment_length_m: float = 50.0
    conf_thres: float = 0.25
    iou_threshold: float = 0.45
    retention_days: int = 30
    max_time_gap_s: float = 5.0
    max_accuracy_m: float | None = None
    road_trust_m: float = 50.0
    default_road: str = "residential"
    max_upload_mb: int = 50


DEFAULTS = Settings()
