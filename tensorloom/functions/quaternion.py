"""Quaternions as STRUCT<w, x, y, z> columns, scalar first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee

PARTS = ("w", "x", "y", "z")


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once per row: parts of it would repeat its whole expression."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def quaternion(w, x, y, z) -> Column:
    lit = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return F.struct(*(lit(c).cast("double").alias(n) for n, c in zip(PARTS, (w, x, y, z), strict=True)))


def _each(fn, *qs) -> Column:
    return F.struct(*(fn(*(q[n] for q in qs)).alias(n) for n in PARTS))


def add(p, q):
    return _each(lambda a, b: a + b, p, q)


def sub(p, q):
    return _each(lambda a, b: a - b, p, q)


def negate(q):
    return _each(lambda a: -a, q)


def scale(q, s):
    return _each(lambda a: a * s, q)


def divide(q, s):
    return _each(lambda a: ieee.div(a, s), q)


def mul(p: Column, q: Column) -> Column:
    """Hamilton product."""
    vector = lambda n, m, k: p["w"] * q[n] + p[n] * q["w"] + p[m] * q[k] - p[k] * q[m]
    w = p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]
    return quaternion(w, vector("x", "y", "z"), vector("y", "z", "x"), vector("z", "x", "y"))


def conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def dot(p: Column, q: Column) -> Column:
    return sum((p[n] * q[n] for n in PARTS[1:]), p["w"] * q["w"])


def squared_norm(q: Column) -> Column:
    return dot(q, q)


def norm(q: Column) -> Column:
    return F.sqrt(squared_norm(q))


def normalized(q: Column) -> Column:
    return let(norm(q), lambda n: divide(q, n))


def inverse(q: Column) -> Column:
    return let(squared_norm(q), lambda n: divide(conjugate(q), n))


def equal(p: Column, q: Column) -> Column:
    out = ieee.equal(p["w"], q["w"])
    for n in PARTS[1:]:
        out = out & ieee.equal(p[n], q[n])
    return out


def angle_axis(angle: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation by an angle about a unit axis."""
    s = F.sin(angle / 2)
    return quaternion(F.cos(angle / 2), x * s, y * s, z * s)


def from_euler(pitch: Column, yaw: Column, roll: Column) -> Column:
    """Rotation of angles about x, y and z."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a / 2), F.sin(a / 2)) for a in (pitch, yaw, roll))
    return quaternion(cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz)


def to_euler(q: Column) -> Column:
    """Angles (pitch, yaw, roll) of a unit quaternion; the yaw's sine is clamped to [-1, 1]."""
    return let(q, _to_euler)


def _to_euler(q: Column) -> Column:
    w, x, y, z = (q[n] for n in PARTS)
    sine = F.least(F.greatest(2 * (w * y - x * z), F.lit(-1.0)), F.lit(1.0))
    return F.struct(F.atan2(2 * (y * z + w * x), w * w - x * x - y * y + z * z).alias("pitch"), F.asin(sine).alias("yaw"), F.atan2(2 * (x * y + w * z), w * w + x * x - y * y - z * z).alias("roll"))


def to_matrix(q: Column) -> Column:
    """Rotation matrix of a unit quaternion, row-major array of 9."""
    w, x, y, z = (q[n] for n in PARTS)
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def from_matrix(m: Column) -> Column:
    """Unit quaternion of a rotation matrix (row-major array of 9): divides by the largest component."""
    at = lambda i, j: F.element_at(m, 3 * i + j + 1)
    squares = {"w": 1 + at(0, 0) + at(1, 1) + at(2, 2), "x": 1 + at(0, 0) - at(1, 1) - at(2, 2), "y": 1 - at(0, 0) + at(1, 1) - at(2, 2), "z": 1 - at(0, 0) - at(1, 1) + at(2, 2)}
    cross = {
        frozenset("wx"): at(2, 1) - at(1, 2), frozenset("wy"): at(0, 2) - at(2, 0), frozenset("wz"): at(1, 0) - at(0, 1),
        frozenset("xy"): at(0, 1) + at(1, 0), frozenset("xz"): at(0, 2) + at(2, 0), frozenset("yz"): at(1, 2) + at(2, 1),
    }

    def by(part: str) -> Column:
        s = F.sqrt(squares[part]) * 2
        return quaternion(*(squares[n] / s if n == part else cross[frozenset((n, part))] / s for n in PARTS))

    trace = at(0, 0) + at(1, 1) + at(2, 2)
    big_x = (at(0, 0) > at(1, 1)) & (at(0, 0) > at(2, 2))
    return F.when(trace > 0, by("w")).when(big_x, by("x")).when(at(1, 1) > at(2, 2), by("y")).otherwise(by("z"))


def rotate(q: Column, x: Column, y: Column, z: Column) -> Column:
    """A point turned by a unit quaternion: array of 3."""
    half = let(F.struct(q.alias("q"), quaternion(0, x, y, z).alias("v")), lambda s: F.struct(s["q"].alias("q"), mul(s["q"], s["v"]).alias("h")))
    turned = let(half, lambda s: mul(s["h"], conjugate(s["q"])))
    return let(turned, lambda out: F.array(out["x"], out["y"], out["z"]))


def slerp(p: Column, q: Column, t: Column) -> Column:
    """Along the shorter arc; quaternions that are nearly alike are mixed linearly, without a new norm."""
    return let(F.struct(p.alias("p"), q.alias("q"), dot(p, q).alias("c")), lambda s: _slerp(s["p"], s["q"], s["c"], t))


def _slerp(p: Column, q: Column, cosine: Column, t: Column) -> Column:
    far = F.when(cosine < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    c = F.abs(cosine)
    near = c > 1 - 2.220446049250313e-16
    angle = F.acos(F.least(c, F.lit(1.0)))
    sine = F.when(near, F.lit(1.0)).otherwise(F.sin(angle))
    a = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / sine)
    b = F.when(near, t).otherwise(F.sin(t * angle) / sine) * far
    return let(F.struct(a.alias("a"), b.alias("b")), lambda w: _each(lambda u, v: u * w["a"] + v * w["b"], p, q))
