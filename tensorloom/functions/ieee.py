"""Arithmetic with the results of IEEE 754, where ANSI Spark raises or gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def div(a: Column, b: Column) -> Column:
    """a / b; x/0 is an infinity with the sign of x, 0/0 and NaN/0 are NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _log(fn):
    """fn where Spark has a value; 0 gives -inf, values below it and NaN give NaN, and NULL stays."""

    def run(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(fn(F.when(x <= 0, F.lit(1.0)).otherwise(x)))

    return run


ln, log2, log10 = _log(F.ln), _log(F.log2), _log(F.log10)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a, in double precision; by 0, and of an infinity, it is NaN."""
    a, b = a.cast("double"), b.cast("double")
    fine = (b != 0) & (F.abs(a) < INF)
    # Spark's remainder by an infinity is NaN; it is a.
    return F.when(~fine | F.isnan(a) | F.isnan(b), F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(a % F.when(fine, b).otherwise(F.lit(1.0)))


def is_nan(x: Column) -> Column:
    """True for NaN; integers and truth values never are."""
    return F.isnan(x.cast("double"))


def less(a: Column, b: Column) -> Column:
    """a < b, false with NaN."""
    return (a < b) & ~is_nan(a) & ~is_nan(b)


def equal(a: Column, b: Column) -> Column:
    """a = b, false with NaN; truth values compare too."""
    return (a == b) & ~is_nan(a)


def spaceship(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NULL where either is NaN."""
    return F.when(is_nan(a) | is_nan(b), F.lit(None)).when(a < b, -1).when(a == b, 0).otherwise(1).cast("tinyint")


def _whole(fn):
    """fn by way of BIGINT; doubles from 2^53 on are whole, and NaN and infinities stay."""

    def run(x: Column) -> Column:
        x = x.cast("double")
        large = F.isnan(x) | (F.abs(x) >= float(1 << 53))
        return F.when(large, x).otherwise(fn(F.when(large, F.lit(0.0)).otherwise(x)).cast("double"))

    return run


floor, ceil, round_ = _whole(F.floor), _whole(F.ceil), _whole(F.round)


def sign(x: Column) -> Column:
    """-1, 0 or 1 as double; NaN gives 0."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.signum(x))


#: Functions of one value; those in ZERO_PRESERVING map 0 to 0.
MATH = {
    "abs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "log": ln, "log2": log2, "log10": log10,
    "floor": floor, "ceil": ceil, "round": round_, "sign": sign, "negate": lambda x: -x,
}
ZERO_PRESERVING = {"abs", "sqrt", "cbrt", "sin", "tan", "asin", "atan", "sinh", "tanh", "floor", "ceil", "round", "sign", "negate"}
