"""Transforms of 3-D points: small matrices on the driver, applied to columns of any number of rows."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum
from math import cos, sin, tan

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ieee

EPS = float(np.finfo(float).eps)


class Mode(IntEnum):
    PROJECTIVE = 0
    AFFINE = 1
    ISOMETRY = 2


@dataclass(frozen=True)
class Transform:
    """Matrix of d + 1 rows; products take the weaker mode of both."""

    matrix: np.ndarray
    mode: Mode = Mode.AFFINE

    @classmethod
    def of(cls, linear, shift=None, mode: Mode = Mode.AFFINE) -> Transform:
        linear = np.asarray(linear, float)
        m = np.eye(len(linear) + 1)
        m[:-1, :-1] = linear
        m[:-1, -1] = 0.0 if shift is None else shift
        return cls(m, mode)

    @property
    def linear(self) -> np.ndarray:
        return self.matrix[:-1, :-1]

    @property
    def translation(self) -> np.ndarray:
        return self.matrix[:-1, -1]

    @property
    def vector(self) -> np.ndarray:
        """Of a translation."""
        return self.translation

    @property
    def factors(self) -> np.ndarray:
        """Of a scaling."""
        return np.diag(self.linear).copy()

    @property
    def angle(self) -> float:
        """Of a rotation in space, from 0 to pi."""
        turn = self.linear - self.linear.T
        return float(np.arctan2(np.sqrt((turn * turn).sum() / 2), np.trace(self.linear) - 1))

    @property
    def axis(self) -> np.ndarray:
        """Of a rotation in space: a unit vector; of no rotation at all the first axis."""
        turn = np.array([self.linear[2, 1] - self.linear[1, 2], self.linear[0, 2] - self.linear[2, 0], self.linear[1, 0] - self.linear[0, 1]])
        if (size := np.linalg.norm(turn)) > 1e-12:
            return turn / size
        # Half a turn (or none): the outer product of the axis is left.
        whole = (self.linear + np.eye(3)) / 2
        best = int(np.argmax(np.diag(whole)))
        return whole[:, best] / np.linalg.norm(whole[:, best])

    def __matmul__(self, other: Transform) -> Transform:
        return Transform(self.matrix @ other.matrix, Mode(min(self.mode, other.mode)))

    def inverse(self) -> Transform:
        if self.mode == Mode.ISOMETRY:
            return Transform.of(self.linear.T, -self.linear.T @ self.translation, self.mode)
        if self.mode == Mode.AFFINE:
            back = np.linalg.inv(self.linear)
            return Transform.of(back, -back @ self.translation, self.mode)
        return Transform(np.linalg.inv(self.matrix), self.mode)

    def apply(self, *point: Column) -> list[Column]:
        """Columns of the moved point; projective transforms divide by the last coordinate."""
        rows = [sum((F.lit(float(c)) * p for c, p in zip(row[:-1], point, strict=True)), F.lit(float(row[-1]))) for row in self.matrix]
        return [ieee.div(r, rows[-1]) for r in rows[:-1]] if self.mode == Mode.PROJECTIVE else rows[:-1]

    def apply_vector(self, *vector: Column) -> list[Column]:
        """Columns of a moved direction: the translation does not act."""
        return [sum((F.lit(float(c)) * p for c, p in zip(row, vector, strict=True)), F.lit(0.0)) for row in self.linear]


def translation(*v: float) -> Transform:
    return Transform.of(np.eye(len(v)), v, Mode.ISOMETRY)


def scaling(*v: float) -> Transform:
    return Transform.of(np.diag(v))


def rotation_matrix(angle: float, axis) -> np.ndarray:
    """About a unit axis: its outer product stays, the plane across it turns."""
    axis = np.asarray(axis, float)
    along = np.outer(axis, axis)
    turn = np.cross(np.eye(3), axis)
    return along + cos(angle) * (np.eye(3) - along) + sin(angle) * turn


def rotation(angle: float, axis) -> Transform:
    axis = np.asarray(axis, float)
    return Transform.of(rotation_matrix(angle, axis / np.linalg.norm(axis)), None, Mode.ISOMETRY)


def look_at(eye, centre, up) -> Transform:
    """Right-handed view: the eye looks along -z."""
    eye, centre, up = (np.asarray(x, float) for x in (eye, centre, up))
    unit = lambda x: x / np.linalg.norm(x)
    ahead = unit(centre - eye)
    side = unit(np.cross(ahead, up))
    turn = np.stack((side, np.cross(side, ahead), -ahead))
    return Transform.of(turn, -turn @ eye, Mode.ISOMETRY)


def ortho(left, right, bottom, top, near=-1.0, far=1.0) -> Transform:
    low, high = np.array((left, bottom, near), float), np.array((right, top, far), float)
    scale = 2 / (high - low) * (1, 1, -1)
    return Transform.of(np.diag(scale), -(high + low) / (high - low))


def frustum(left, right, bottom, top, near, far) -> Transform:
    m = np.zeros((4, 4))
    m[0, 0], m[1, 1] = 2 * near / (right - left), 2 * near / (top - bottom)
    m[0, 2], m[1, 2] = (right + left) / (right - left), (top + bottom) / (top - bottom)
    m[2, 2], m[2, 3], m[3, 2] = -(far + near) / (far - near), -2 * far * near / (far - near), -1.0
    return Transform(m, Mode.PROJECTIVE)


def perspective(fovy, aspect, near, far) -> Transform:
    high = near * tan(fovy / 2)
    return frustum(-high * aspect, high * aspect, -high, high, near, far)


def infinite_perspective(fovy, aspect, near) -> Transform:
    m = perspective(fovy, aspect, near, 2 * near).matrix.copy()
    m[2, 2], m[2, 3] = -1.0, -2.0 * near
    return Transform(m, Mode.PROJECTIVE)


def project(point, view: Transform, projection: Transform, viewport) -> list[Column]:
    """Window coordinates of a point; depth from 0 to 1. viewport: x, y, width, height."""
    x, y, width, height = viewport
    flat = Transform((projection.matrix @ view.matrix), Mode.PROJECTIVE).apply(*point)
    a, b, c = (p * 0.5 + 0.5 for p in flat)
    return [a * float(width) + float(x), b * float(height) + float(y), c]


def unproject(window, view: Transform, projection: Transform, viewport) -> list[Column]:
    x, y, width, height = viewport
    a, b, c = window
    flat = ((a - float(x)) / float(width) * 2 - 1, (b - float(y)) / float(height) * 2 - 1, c * 2 - 1)
    return Transform(np.linalg.inv(projection.matrix @ view.matrix), Mode.PROJECTIVE).apply(*flat)


def trs_decompose(t: Transform) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Translation, rotation matrix and scales; a mirrored matrix has a negative first scale."""
    scale = np.linalg.norm(t.linear, axis=0)
    if np.linalg.det(t.linear) < 0:
        scale[0] = -scale[0]
    return t.translation.copy(), t.linear / scale, scale


def _dot(a, b) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def distance(a, b) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def reflect(incident, normal) -> list[Column]:
    twice = 2 * _dot(normal, incident)
    return [i - twice * n for i, n in zip(incident, normal, strict=True)]


def refract(incident, normal, eta: float) -> list[Column]:
    """Bent direction; zero where all light is reflected."""
    c = _dot(normal, incident)
    k = 1 - eta * eta * (1 - c * c)
    along = eta * c + F.sqrt(F.greatest(k, F.lit(0.0)))
    return [F.when(k < 0, F.lit(0.0)).otherwise(eta * i - along * n) for i, n in zip(incident, normal, strict=True)]


def face_forward(normal, incident, reference) -> list[Column]:
    """normal, turned to the side that the incident direction comes from."""
    keep = _dot(reference, incident) < 0
    return [F.when(keep, n).otherwise(-n) for n in normal]
