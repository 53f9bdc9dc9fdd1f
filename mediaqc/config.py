"""Thresholds and prices. Tests and queries over other data pass their own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values
    phash: int = 6
    dhash: int = 8
    whash: int = 5
    votes: int = 2
    cosine: float = 0.90
    cosine_strong: float = 0.97
    cosine_votes: int = 1
    top_k: int = 100
    candidates: int = 24
    cosine_floor: float = 0.64
    keypoint_matches: int = 30
    keypoint_inliers: int = 26
    keypoint_ratio: float = 0.46
    strong_inliers: int = 60
    strong_score: float = 0.58
    face_veto: float = 0.55
    cv: float = 0.85
    ela: float = 0.50
    blur: float = 80.0
    moire_ratio: float = 8.0
    moire: float = 0.40
    ioi: float = 0.48
    poster_edges: float = 0.18
    agree: float = 0.82
    direct: float = 0.85
    cv_clean: float = 0.15
    fallback: float = 0.70
    borderline_low: float = 0.35
    borderline_high: float = 0.50
    lookback_days: int = 10
    recent_images: int = 200
    branding_color_gate: bool = True
    branding_required: bool = True
    minor_policy: bool = True
    pending_as_invalid: bool = True


@dataclass(frozen=True)
class Prices:
    """US dollars a million tokens, and rupees a dollar."""

    # fixed values
    flash_in: float = 0.15
    flash_out: float = 0.60
    pro_in: float = 3.50
    pro_out: float = 10.50
    inr_per_usd: float = 83.0


# fixed values: texts of verdicts
SCREENSHOT_GATE = "Screenshot detected (device bezel + screenshot software metadata)"
MANIPULATED_GATE = "Extreme digital manipulation (high ELA + device bezel)"
BLANK_GATE = "Blank or corrupted image"
IOI_GATE = "Screen/printed-photo detected (IoI score=%.2f): %s. Photo appears to be taken from a digital screen or printed photograph."
NO_FACE_GATE = "No human face + device bezel/ELA signals detected"
BRANDING_GATE = (
    "No political branding colours detected (NCP blue, scheme pink/red, saffron, green). "
    "Valid survey photos must show political/scheme branding materials."
)
ONLY_CHILDREN = "Minor policy: only children/minors present in photo (no adult)."
MINOR_HOLDS = "Minor policy: child/minor is holding the branding/pamphlet."
NO_ADULT_HOLDS = "Minor policy: child present but no adult clearly holds branding."
FLASH_SCREEN = "Photo-of-screen/photo/manipulated image detected by Flash"
FLASH_NO_FACE = "No clearly visible live human face detected by Flash"
FLASH_NO_BRANDING = "No required political branding detected by Flash"
HARD_SCREEN = "Photo-of-screen/photo/manipulated image detected"
HARD_NO_FACE = "No clearly visible live human face detected"
HARD_NO_BRANDING = "No required political branding detected"
PENDING = "Pending Review → Invalid (production policy)"
CV_ANOMALY = "CV anomaly"
CV_FLAGS = "CV forensic flags (AI unavailable)"
INCONCLUSIVE = "Flash and Pro inconclusive; defaulting to Invalid by production policy"
PRO_FAILED = "AI pipeline error (graceful): "
LOAD_FAILED = "Image load failed"
EXACT = "MD5 fingerprint matched a recent/current-batch image."
VOTED = "Hash votes=%d/3 (pHash=%d, dHash=%d, wHash=%d)."
SUPPORTED = "%s: score=%.3f, support=%d."
