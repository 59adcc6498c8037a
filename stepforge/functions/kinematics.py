"""Angles, poses, normalisation and image geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 2 * math.pi


def wrap_angle(difference: Column) -> Column:
    """A difference of angles in [-pi, pi)."""
    return F.pmod(difference + F.lit(math.pi), F.lit(TURN)) - F.lit(math.pi)


def quaternion_rpy(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw of a quaternion of any length; null if its length is (nearly) 0."""
    norm = F.sqrt(w * w + x * x + y * y + z * z)
    ok = norm > 1e-12
    w, x, y, z = (F.when(ok, c / norm) for c in (w, x, y, z))
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return roll, F.when(ok, pitch), yaw


def minmax_normalize(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), with a range of 0 taken as 1; values outside aren't clipped."""
    return (x - low) / F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)


def minmax_denormalize(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def quantile_normalize(x: Column, low: Column, high: Column, clip: bool = True) -> Column:
    """As minmax_normalize between two quantiles, first clipped to them; null stays null."""
    inside = F.when(x.isNotNull(), F.greatest(low, F.least(high, x))) if clip else x
    return minmax_normalize(inside, low, high)


def online_normalize(x: Column, low: Column, high: Column) -> Column:
    """As minmax_normalize, but null for a range of 0."""
    return F.try_divide(x - low, high - low)


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> dict[str, Column]:
    """Size and offsets of an image scaled into a frame, centred, with whole pixels cut off."""
    scale = F.least(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    w, h = F.floor(width * scale).cast("bigint"), F.floor(height * scale).cast("bigint")
    return {
        "new_width": w,
        "new_height": h,
        "left": F.floor((F.lit(to_width) - w) / 2).cast("bigint"),
        "top": F.floor((F.lit(to_height) - h) / 2).cast("bigint"),
    }


def t_shape_height(height: Column) -> Column:
    """Height of a head view with two half-size wrist views below it."""
    return height + F.floor(height / 2)


def smart_resize(height: Column, width: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """Height and width as multiples of ``factor`` within a budget of pixels; null if one side is over 200 times the other."""
    f = float(factor)
    h0 = F.greatest(F.lit(f), F.bround(height / f, 0) * f)
    w0 = F.greatest(F.lit(f), F.bround(width / f, 0) * f)
    down = F.sqrt(height * width / F.lit(float(most)))
    up = F.sqrt(F.lit(float(least)) / (height * width))
    ok = F.greatest(height, width) / F.least(height, width) <= 200

    def side(x: Column, rounded: Column) -> Column:
        return F.when(
            ok,
            F.when(h0 * w0 > most, F.greatest(F.lit(f), F.floor(x / down / f) * f))
            .when(h0 * w0 < least, F.ceil(x * up / f) * f)
            .otherwise(rounded),
        ).cast("bigint")

    return side(height, h0), side(width, w0)


def smart_frames(total: Column, video_fps: Column, fps: float = 2.0, least: int = 4, most: int = 768) -> Column:
    """An even number of frames at ``fps``, at least ``least`` and at most ``most`` or all there are."""
    top = F.least(F.lit(float(most)), F.floor(total / 2) * 2)
    n = total / video_fps * F.lit(fps)
    bounded = F.least(F.least(F.greatest(n, F.lit(float(least))), top), total.cast("double"))
    return (F.floor(bounded / 2) * 2).cast("bigint")


def linspace_indices(total: Column, n: int) -> Column:
    """``n`` indices spread evenly over 0 ... total - 1, halves rounded to even."""
    if n == 1:
        return F.array(F.lit(0).cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (total - 1) / F.lit(float(n - 1)), 0).cast("bigint")
    )
