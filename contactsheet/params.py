"""Defaults and fixed values of the catalog operators."""

from __future__ import annotations

from dataclasses import dataclass

# Extension sets as the different analyses use them.
SCAN_PHOTO = (".jpg", ".jpeg", ".heic", ".png", ".tiff", ".tif", ".webp")
ALL_PHOTO = (".jpg", ".jpeg", ".heic", ".heif", ".png", ".tiff", ".tif", ".webp", ".bmp")
VIDEO = (".mov", ".mp4", ".avi", ".mkv", ".m4v")
SORT_IMAGE, SORT_HEIC, SORT_VIDEO = (".jpg", ".jpeg", ".png"), (".heic",), (".mov", ".mp4")
TRANSCODE_VIDEO = (".mov", ".mp4")
ROTATE_JPEG, ROTATE_PIXELS = (".jpg", ".jpeg"), (".heic", ".png", ".tiff", ".tif", ".webp", ".bmp")
MEDIA = (".jpg", ".jpeg", ".heic", ".png", ".mov", ".mp4")
SKIP_DIRS = ("Unknown", ".thumbnails", ".previews", "__pycache__")

# File-name patterns by category.
SCREENSHOT = (
    r"^Screenshot \d{4}-\d{2}-\d{2} at \d{1,2}\.\d{2}\.\d{2}", r"^Screen Shot \d{4}-\d{2}-\d{2}", r"^Snip_\d{8}_\d{6}", r"^Screenshot\s*\(\d+\)",
    r"^Screenshot[-_]\d{8}[-_]\d{6}", r"^screenshot[-_]\d{8}", r"^(截圖|截屏|スクリーンショット|スクショ|화면캡처)", r"\bscreenshot\b", r"^CleanShot\s", r"^(flameshot|shutter|greenshot|snagit)",
)
RECORDING = (r"^Screen Recording \d{4}-\d{2}-\d{2}", r"^RPReplay", r"screen[-_ ]?recording", r"^screenrecord[-_]", r"^Screen_Recording_\d{8}")
MESSAGING = (
    r"^IMG-\d{8}-WA\d+", r"^VID-\d{8}-WA\d+", r"^LINE[-_]", r"^photo_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}", r"^video_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}",
    r"^mmexport\d{13}", r"^signal-\d{4}-\d{2}-\d{2}", r"^received_\d{5,}", r"^KakaoTalk[-_]",
)
DOCUMENT = (r"^scan[-_ ]?\d", r"^scanned[-_ ]", r"^CamScanner", r"^Adobe Scan", r"^(Microsoft|Office)[-_ ]?Lens", r"(receipt|invoice|contract|certificate|license|passport|id[-_ ]?card)")
CATEGORIES = ("screenshot", "screen_recording", "messaging", "document")

# Screen sizes in one orientation; both count.
SCREENS = (
    (1170, 2532), (1179, 2556), (1290, 2796), (1125, 2436), (1242, 2688), (828, 1792), (750, 1334), (1080, 1920), (640, 1136), (2048, 2732), (1668, 2388), (2048, 1536), (2880, 1800),
    (3024, 1964), (3456, 2234), (2560, 1600), (2560, 1440), (3840, 2160), (5120, 2880), (1080, 2400), (1080, 2340), (1440, 3200), (1440, 3120), (1440, 2960), (1440, 3088),
)

# Texts of the orientation tag.
ORIENTATIONS = {1: "Normal", 2: "Mirrored horizontal", 3: "Rotated 180°", 4: "Mirrored vertical", 5: "Mirrored horizontal & rotated 270° CW", 6: "Rotated 90° CW", 7: "Mirrored horizontal & rotated 90° CW", 8: "Rotated 90° CCW"}


@dataclass(frozen=True)
class Params:
    base_dir: str = "/library"
    time_window_s: float = 10.0
    radius_m: float = 100.0
    hash_distance: int = 12
    date_tolerance_s: float = 2.0
    min_h264_bytes: int = 100 * 1024 * 1024
    recompress: bool = False
    rate_limit_s: float = 1.1
    accept_language: str = "en"
    earth_radius_m: float = 6_371_000.0
    burst_gap_s: int = 10
    rotation_confidence: float = 0.7


DEFAULTS = Params()
