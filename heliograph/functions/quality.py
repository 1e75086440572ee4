"""Face and frame quality as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and breakpoints of the scores.
SIZE_RANGE, SIZE_SCORES = (80.0, 250.0), (0.25, 1.0)
WEIGHTS = {"size": 0.35, "pose": 0.30, "occlusion": 0.10, "sharpness": 0.25}
LINEAR_WEIGHTS = {"size": 0.35, "pose": 0.20, "occlusion": 0.20, "sharpness": 0.25}
NEUTRAL_OCCLUSION = 0.625
EMPTY_CROP_SHARPNESS = 0.25


def _d(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def interp(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between the points; above x1 it stays y1, below x0 it goes on down to 0 at least."""
    line = F.lit(y0) + (_d(x) - F.lit(x0)) * F.lit(y1 - y0) / F.lit(x1 - x0)
    return F.when(_d(x) >= F.lit(x1), F.lit(y1)).when(_d(x) > F.lit(x0), line).otherwise(F.greatest(F.lit(y0) - (F.lit(x0) - _d(x)) * F.lit(y1 - y0) / F.lit(x1 - x0), F.lit(0.0)))


def clipped_min_side(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Smaller side of a box after clipping it to its frame."""
    w = F.least(width, x2) - F.greatest(F.lit(0), x1)
    h = F.least(height, y2) - F.greatest(F.lit(0), y1)
    return F.least(w, h)


def size_score(min_side: Column) -> Column:
    return interp(min_side, *SIZE_RANGE, *SIZE_SCORES)


def pose_score(yaw: Column, pitch: Column, roll: Column) -> Column:
    """cos^2 of yaw, damped by pitch and roll the more the face is turned; angles in degrees."""
    y, p, r = F.abs(_d(yaw)), F.abs(_d(pitch)), F.abs(_d(roll))
    facing = F.cos(F.radians(F.least(F.lit(90.0), y)))
    damp = F.least(F.lit(1.0), y / 60.0) * (F.least(F.lit(1.0), p / 45.0) * 0.3 + F.least(F.lit(1.0), r / 90.0) * 0.1)
    return F.greatest(F.lit(0.0), facing * facing / (damp + 1.0))


def raw_occlusion_score(pred: Column, prob: Column) -> Column:
    return interp(F.when(pred == 0, _d(prob)).otherwise(-_d(prob)), -1.0, 1.0, 0.25, 1.0)


def occlusion_score(raw: Column, pose: Column) -> Column:
    return pose * raw + (F.lit(1.0) - pose) * NEUTRAL_OCCLUSION


def composite(size: Column, pose: Column, occlusion: Column, sharpness: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    total = size * weights["size"] + pose * weights["pose"] + occlusion * weights["occlusion"] + sharpness * weights["sharpness"]
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def face_quality(min_side: Column, yaw: Column, pitch: Column, roll: Column, pred: Column, prob: Column, sharpness: Column) -> Column:
    """struct(size, pose, occlusion, sharpness, composite); a null sharpness is an empty crop's."""
    size, pose = size_score(min_side), pose_score(yaw, pitch, roll)
    occlusion = occlusion_score(raw_occlusion_score(pred, prob), pose_score(_d(yaw) * 1.5, pitch, roll))
    sharp = F.coalesce(_d(sharpness), F.lit(EMPTY_CROP_SHARPNESS))
    return F.struct(size.alias("size"), pose.alias("pose"), occlusion.alias("occlusion"), sharp.alias("sharpness"), composite(size, pose, occlusion, sharp).alias("composite"))


def linear_pose_score(yaw: Column, pitch: Column) -> Column:
    return (interp(F.abs(_d(yaw)), 0, 45, 1.0, 0.25) + interp(F.abs(_d(pitch)), 0, 35, 1.0, 0.25)) / 2.0


def linear_quality(size: Column, pose: Column, occlusion: Column, sharpness: Column) -> Column:
    return composite(size, pose, occlusion, sharpness, LINEAR_WEIGHTS)


def laplacian_sharpness(variance: Column) -> Column:
    return F.least(F.greatest((_d(variance) - 50.0) / 200.0, F.lit(0.0)), F.lit(1.0))


def frame_quality(lap_var: Column, std: Column, mean: Column) -> Column:
    sharp, contrast = F.least(_d(lap_var) / 1000.0, F.lit(1.0)), F.least(_d(std) / 128.0, F.lit(1.0))
    light = F.lit(1.0) - F.abs(_d(mean) / 255.0 - 0.5) * 2.0
    return sharp * 0.7 + contrast * 0.2 + light * 0.1


def quality_class(score: Column) -> Column:
    return F.when(score >= 0.7, "excellent").when(score >= 0.5, "good").when(score >= 0.3, "fair").otherwise("poor")


def pose_bucket(yaw: Column, roll: Column) -> Column:
    """Strict at 15 degrees; what fits no bucket is ``right``."""
    level = F.abs(yaw) < 15
    return F.when(level & (F.abs(roll) < 15), "front").when(level & (roll < -15), "front-rotate-left").when(level & (roll > 15), "front-rotate-right").when(yaw < -15, "left").otherwise("right")


def eye_angle(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    return F.degrees(F.atan2(_d(ry) - _d(ly), _d(rx) - _d(lx)))


def geometric_pose(lx: Column, ly: Column, rx: Column, ry: Column, nx: Column) -> Column:
    """Pose from landmarks: the eyes' angle, then the nose's offset against a tenth of the eyes' distance."""
    angle, offset = eye_angle(lx, ly, rx, ry), _d(nx) - (_d(lx) + _d(rx)) / 2.0
    apart = F.hypot(_d(rx) - _d(lx), _d(ry) - _d(ly))
    turned = F.when(F.abs(offset) < apart * 0.1, "front").when(offset > 0, "right").otherwise("left")
    return F.when(F.abs(angle) < 15, turned).when(angle > 15, "front-rotate-right").otherwise("front-rotate-left")


def landmark_angles(lx: Column, ly: Column, rx: Column, ry: Column, nx: Column, mx: Column, my: Column) -> Column:
    """struct(yaw, pitch, roll) in degrees; zeros if the eyes are tilted by 15 degrees or more."""
    roll = eye_angle(lx, ly, rx, ry)
    apart = F.hypot(_d(rx) - _d(lx), _d(ry) - _d(ly))
    cx, cy = (_d(lx) + _d(rx)) / 2.0, (_d(ly) + _d(ry)) / 2.0
    yaw = F.degrees(F.atan2(_d(nx) - cx, apart)) * 2.0
    pitch = (F.hypot(_d(mx) - cx, _d(my) - cy) / apart - 0.7) * 50.0
    level = F.abs(roll) < 15
    zero = F.lit(0.0)
    return F.struct(F.when(level, yaw).otherwise(zero).alias("yaw"), F.when(level, pitch).otherwise(zero).alias("pitch"), F.when(level, roll).otherwise(zero).alias("roll"))


def should_enhance(size: Column, sharpness: Column, pose: Column, quality: Column, confidence: Column, area: Column, trigger: float = 0.0, min_quality: float = 0.0, min_confidence: float = 0.0, sprites: bool = False) -> Column:
    """Whether a face is worth enhancing: middling size, or quality under the trigger; sharp and frontal enough."""
    usable = (sharpness >= 0.25) & (pose >= 0.5)
    middling = (size >= 0.25) & (size < 0.5) & usable
    weak = (F.lit(trigger) > 0) & (quality < trigger) & usable
    return (middling | weak) & (quality >= min_quality) & (confidence >= min_confidence) & F.lit(not sprites) & (area <= 2_073_600)


def detector_size(width: Column, height: Column, has_1024: bool = True) -> Column:
    side = F.least(width, height)
    return F.when(side < 500, 320).when((side < 1500) | F.lit(not has_1024), 640).otherwise(1024)


def redetect(valid: Column, detected: Column, det_size: Column) -> Column:
    """Whether a low share of valid detections at a large size calls for another try at 640."""
    return (det_size > 640) & (detected > 0) & (valid / detected < 0.5)


def keep_redetection(valid: Column, detected: Column, valid_640: Column, detected_640: Column) -> Column:
    share = lambda v, d: F.when(d > 0, v / d).otherwise(0.0)
    return share(valid_640, detected_640) > share(valid, detected)


def use_enhanced(similarity: Column, enhanced: Column, original: Column, threshold: float = 0.6) -> Column:
    """The enhanced face counts only for the same identity and a strictly better score."""
    return F.coalesce((similarity > threshold) & (enhanced > original), F.lit(False))
