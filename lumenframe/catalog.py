"""Rules as data: profiles, gate metrics, ladders, setting keys. Driver-side constants of a few rows, so joins with them are broadcasts of a proven size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Marketplace profiles.
PROFILES = [
    # name, longest_side_min, longest_side_max, max_pixels, square, background, fill_ratio_min, max_bytes, formats, alpha_allowed, srgb_required
    ("amazon", 500, 10000, None, False, [255, 255, 255], 0.85, None, ["jpeg", "png"], False, True),
    ("shopify", None, 5000, 25_000_000, False, None, None, 19_999_999, ["png", "jpeg", "webp"], True, False),
    ("square-white", 1000, None, None, True, [255, 255, 255], 0.85, None, ["jpeg", "png"], False, True),
]
PROFILE_TYPE = "name string, longest_side_min int, longest_side_max int, max_pixels long, square boolean, background array<int>, fill_ratio_min double, max_bytes long, formats array<string>, alpha_allowed boolean, srgb_required boolean"

# Gate metrics in the order of checks, with the limits of thresholds and the codes of the default rule.
METRICS = [
    # name, place, is_flag, low, high, default codes
    ("foreground_ratio", 0, False, 0.0, 1.0, ["FOREGROUND_TOO_SMALL", "FOREGROUND_TOO_LARGE"]),
    ("separability", 1, False, 0.0, None, ["NOT_SEPARABLE"]),
    ("halo_ratio", 2, False, 0.0, 1.0, ["HALO_REMAINS"]),
    ("edge_width", 3, False, 0.0, None, []),
    ("contour_roughness", 4, False, 0.0, None, ["CONTOUR_ROUGH"]),
    ("rim_contamination", 5, False, 0.0, 1.0, ["RIM_CONTAMINATED"]),
    ("touches_edge", 6, True, 0.0, None, ["SUBJECT_TOUCHES_EDGE", "BBOX_RECOMMENDED"]),
]
METRIC_TYPE = "metric string, place int, is_flag boolean, low double, high double, codes array<string>"

# Compose gate metrics: calibrated operator and threshold, and whether a profile is needed.
COMPOSE_METRICS = [
    ("text_overflow", 0, ">", 0.0, False),
    ("text_contrast", 1, "<", 4.5, False),
    ("text_obscured", 2, ">", 0.10, False),
    ("layer_overlap", 3, ">", 0.02, False),
    ("outside_safe_area", 4, None, None, False),
    ("display_text_size", 5, "<", 11.0, True),
    ("display_contrast", 6, "<", 4.5, True),
    ("display_strokes_lost", 7, None, None, True),
]

# Ladders, thresholds and search settings.
CANVAS_LADDER = [1000, 1500, 2000, 2500, 3000]
QUALITY_LADDER = [85, 75, 65, 55, 45, 35, 25]
SEARCH_TOLERANCES = [12, 20, 30, 45, 60]
FOREGROUND_COLLAPSE = 0.30
UNIFORM_DELTA_E, MIN_UNIFORMITY = 5.0, 0.90
HALO_WARN, ROUGH_WARN, RIM_WARN = 0.10, 0.16, 0.02
FOREGROUND_MIN, FOREGROUND_MAX = 0.01, 0.99
BACKGROUND_TOLERANCE, FILL_MARGIN = 2.0, 0.01
TRIMAP_FG, TRIMAP_BG, ALPHA_FG, ALPHA_BG, MASK_FG = 192, 63, 250, 5, 128
COMPOSE_PROFILE = {"name": "note", "canvas": (1280, 670), "safe_area": (0.0, 108.0, 1280.0, 454.0), "max_bytes": 10_000_000, "displays": {"pc_list": 192, "mobile_list": 144}}
ASPECT_TOLERANCE = 0.005

# Setting names of batch items that queries use.
SETTING_KEYS = ["input", "output", "bbox", "normalized", "tolerance", "border", "cleanup", "feather", "despill", "refine", "matting", "optimize", "auto", "profile", "canvas", "fill_ratio", "format", "quality", "effort", "fail_on", "max_bytes", "rotate", "derive", "naming"]

# Codes that make a cut unusable.
FATAL_CODES = ["FOREGROUND_TOO_SMALL", "FOREGROUND_TOO_LARGE", "NOT_SEPARABLE", "SUBJECT_TOUCHES_EDGE"]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_TYPE)


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, METRIC_TYPE)
