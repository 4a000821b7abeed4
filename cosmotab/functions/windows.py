"""Fourier-space smoothing windows W(y), y = kR, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The windows' names.
WINDOWS = ("Top-hat", "Gaussian", "Sharp-k")
#: From y^0 on, the denominators of the series of the top-hat window in y^2, with alternating signs.
SERIES = (1.0, 10.0, 280.0, 15120.0, 1330560.0, 172972800.0)
#: Below this |y| the series is used.
SMALL = 0.1


def top_hat_series(y: Column) -> Column:
    """The series to 10th order around y = 0."""
    total = F.lit(1.0)
    for n, d in enumerate(SERIES[1:], 1):
        total = total + F.pow(y, F.lit(2.0 * n)) * ((-1.0) ** n / d)
    return total


def top_hat_exact(y: Column) -> Column:
    """3 (sin y - y cos y) / y^3, and 1 at y = 0."""
    return F.when(y == 0, F.lit(1.0)).otherwise(3.0 * (F.sin(y) - y * F.cos(y)) / (y * y * y))


def top_hat(y: Column) -> Column:
    return F.when(F.abs(y) < SMALL, top_hat_series(y)).otherwise(top_hat_exact(y))


def gaussian(y: Column) -> Column:
    return F.exp(-0.5 * y * y)


def sharp_k(y: Column) -> Column:
    return F.when(y <= 1.0, F.lit(1.0)).otherwise(F.lit(0.0))


def window(y: Column, name: str | Column) -> Column:
    """W(y) of the named window; any other name means top-hat."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(name == "Gaussian", gaussian(y)).when(name == "Sharp-k", sharp_k(y)).otherwise(top_hat(y))


def window_squared(y: Column, name: str | Column) -> Column:
    w = window(y, name)
    return w * w
