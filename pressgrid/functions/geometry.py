"""Face geometry from landmarks that are given."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Pose limit in degrees, least eye gap in pixels, and the aligned frame.
POSE_LIMIT, LEAST_EYE_GAP = 15.0, 25
FRAME, EYE_GAP, EYE_X, EYE_Y = 300.0, 80.0, 150.0, 105.0


def classify_pose(yaw: Column) -> Column:
    return F.when(yaw >= POSE_LIMIT, "right").when(yaw <= -POSE_LIMIT, "left").when(yaw.isNotNull(), "front")


def estimate_yaw(nose_x: Column, left_x: Column, right_x: Column) -> Column:
    gap = F.abs(right_x - left_x)
    return F.when(gap < 1, F.lit(0.0)).otherwise(F.lit(60.0) * (nose_x - (left_x + right_x) / 2) / F.when(gap >= 1, gap))


def estimate_roll(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def estimate_pitch(nose_z: Column, chin_z: Column) -> Column:
    return F.lit(100.0) * (nose_z - chin_z)


def eye_geometry(mesh: Column, left: tuple[int, int], right: tuple[int, int]) -> Column:
    """Eye centres, each the mean of two landmarks (from 0), their whole distance, and whether it is enough (P20)."""
    def centre(axis: str, pair: tuple[int, int]) -> Column:
        return (mesh[pair[0]][axis].cast("double") + mesh[pair[1]][axis].cast("double")) / 2

    lx, ly, rx, ry = centre("x", left), centre("y", left), centre("x", right), centre("y", right)
    distance = F.hypot(rx - lx, ry - ly).cast("int")
    return F.struct(lx.alias("lx"), ly.alias("ly"), rx.alias("rx"), ry.alias("ry"), distance.alias("distance"), (distance >= LEAST_EYE_GAP).alias("usable"))


def align_matrix(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    """Rows of the 2x3 matrix that turns the eyes level, 80 pixels apart, centred at (150, 105)."""
    dx, dy = rx - lx, ry - ly
    gap2 = dx * dx + dy * dy
    c, s = F.lit(EYE_GAP) * dx / gap2, F.lit(EYE_GAP) * dy / gap2
    mx, my = (lx + rx) / 2, (ly + ry) / 2
    return F.when(gap2 > 0, F.array(c, s, F.lit(EYE_X) - c * mx - s * my, -s, c, F.lit(EYE_Y) + s * mx - c * my))


def transform_mesh(mesh: Column, matrix: Column) -> Column:
    """Points moved by the matrix, in units of the frame."""
    def moved(p: Column) -> Column:
        x, y = p["x"].cast("double"), p["y"].cast("double")
        return F.struct(
            ((matrix[0] * x + matrix[1] * y + matrix[2]) / FRAME).alias("x"),
            ((matrix[3] * x + matrix[4] * y + matrix[5]) / FRAME).alias("y"))

    return F.transform(mesh, moved)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a blob; a length that isn't a multiple of four gives null."""
    return blob.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def _decode_pairs(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None or len(b) % 8 else list(np.frombuffer(b, "<f4").reshape(-1, 2)))


def decode_mesh(blob: Column) -> Column:
    """A blob of x, y pairs as points; an odd number of floats gives null."""
    return F.transform(_decode_pairs(blob), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


@F.pandas_udf(T.BinaryType())
def encode_f32(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
