"""Halo multiplicity functions f(sigma) as Column expressions, their catalogue, and the choice by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, range text, redshift text of each fit.
CATALOG = (
    ("Press-Schechter 1974", "analytic", "all"),
    ("Sheth-Tormen 2001", "analytic", "all"),
    ("Jenkins 2001", "-1.2 < ln sigma^-1 < 1.05", "0-5"),
    ("Reed 2003", "-1.7 < ln sigma^-1 < 0.9", "0-15"),
    ("Warren 2006", "10^10 < M/Msun < 10^15", "0"),
    ("Reed 2007", "-1.7 < ln sigma^-1 < 0.9", "0-30"),
    ("Tinker 2008", "-0.6 < ln sigma^-1 < 0.4", "0-2.5"),
    ("Crocce 2010", "10^10.5 < M/Msun < 10^15.5", "0-2"),
    ("Courtin 2010", "-0.8 < ln sigma^-1 < 0.7", "0"),
    ("Bhattacharya 2011", "10^11.8 < M/Msun < 10^15.5", "0-2"),
    ("Angulo 2012", "10^8 < M/Msun < 10^16", "0"),
    ("Watson FOF 2013", "-0.55 < ln sigma^-1 < 1.31", "0-30"),
    ("Watson SO 2013", "redshift-dependent peak-height range", "0-30"),
)
#: Short names.
ALIASES = {"Press-Schechter": "Press-Schechter 1974", "Sheth-Tormen": "Sheth-Tormen 2001"}
#: The published coefficients of each fit; a name that ends with _z is an exponent of 1 + z.
COEFFICIENTS: dict[str, dict[str, float]] = {
    "Sheth-Tormen 2001": {"A": 0.3222, "a": 0.707, "p": 0.3},
    "Jenkins 2001": {"A": 0.315, "b": 0.61, "c": 3.8},
    "Reed 2003": {"A": 0.3222, "a": 0.707, "p": 0.3, "c": 0.7, "q": 5.0},
    "Warren 2006": {"A": 0.7234, "a": 1.625, "b": 0.2538, "c": 1.1982},
    "Reed 2007": {"A": 0.3222, "a": 0.707, "p": 0.3, "ca": 1.08, "g1": 0.6, "at1": 0.4, "width1": 0.72, "g2": 0.4, "at2": 0.75, "width2": 0.08, "n": 0.03, "q": 0.6},
    "Tinker 2008": {"A": 0.186, "A_z": -0.14, "a": 1.47, "a_z": -0.06, "b": 2.57, "c": 1.19, "alpha": 0.75, "alpha_q": 1.2, "delta": 75.0},
    "Crocce 2010": {"A": 0.58, "A_z": -0.13, "a": 1.37, "a_z": -0.15, "b": 0.30, "b_z": -0.084, "c": 1.036, "c_z": -0.024},
    "Courtin 2010": {"A": 0.348, "a": 0.695, "p": 0.1},
    "Bhattacharya 2011": {"A": 0.333, "A_z": -0.11, "a": 0.788, "a_z": -0.01, "p": 0.807, "q": 1.795},
    "Angulo 2012": {"A": 0.201, "a": 1.7, "b": 2.08, "c": 1.172},
    "Angulo 2012, subhalos": {"A": 0.265, "a": 1.9, "b": 1.675, "c": 1.4},
    "Watson FOF 2013": {"A": 0.282, "a": 1.406, "b": 2.163, "c": 1.210},
    "Watson SO 2013": {
        "A0": 0.194, "a0": 2.267, "b0": 1.805, "c0": 1.287, "A6": 0.563, "a6": 0.874, "b6": 3.810, "c6": 1.453,
        "A": 1.907, "A_z": -3.216, "A_add": 0.074, "a": 3.136, "a_z": -3.058, "a_add": 2.349, "b": 5.907, "b_z": -3.599, "b_add": 2.344, "c": 1.318,
        "delta": 178.0, "g1": 0.023, "g2": 0.456, "g3": 0.139, "g4": 0.072, "g5": 2.130,
    },
}
DELTA_C = 1.686


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _pow(x: Column, e: Column | float) -> Column:
    return F.pow(x, _c(e))


def _floor(sigma: Column) -> Column:
    return F.greatest(sigma, F.lit(1e-30))


def peak_height(sigma: Column, delta_c: Column | float = DELTA_C) -> Column:
    """nu = delta_c / sigma."""
    return _c(delta_c) / _floor(sigma)


def f_press_schechter(sigma, delta_c=DELTA_C, z=0.0, **_):
    nu = peak_height(sigma, delta_c)
    return math.sqrt(2 / math.pi) * nu * F.exp(-0.5 * nu * nu)


def _ellipsoidal(sigma, delta_c, A, a, p):
    nu = peak_height(sigma, delta_c)
    an2 = a * nu * nu
    return A * math.sqrt(2 * a / math.pi) * (1.0 + _pow(an2, -p)) * nu * F.exp(-0.5 * an2)


def f_sheth_tormen(sigma, delta_c=DELTA_C, z=0.0, **_):
    return _ellipsoidal(sigma, delta_c, **COEFFICIENTS["Sheth-Tormen 2001"])


def f_jenkins(sigma, delta_c=DELTA_C, z=0.0, **_):
    k = COEFFICIENTS["Jenkins 2001"]
    return k["A"] * F.exp(-_pow(F.abs(-F.ln(_floor(sigma)) + k["b"]), k["c"]))


def f_reed03(sigma, delta_c=DELTA_C, z=0.0, **_):
    s, k = _floor(sigma), COEFFICIENTS["Reed 2003"]
    return _ellipsoidal(s, delta_c, k["A"], k["a"], k["p"]) * F.exp(-k["c"] / _pow(s * F.cosh(2.0 * s), k["q"]))


def f_warren(sigma, delta_c=DELTA_C, z=0.0, **_):
    s, k = _floor(sigma), COEFFICIENTS["Warren 2006"]
    return k["A"] * (_pow(s, -k["a"]) + k["b"]) * F.exp(-k["c"] / (s * s))


def f_reed07(sigma, delta_c=DELTA_C, z=0.0, n_eff: float = -2.0, **_):
    s, k = _floor(sigma), COEFFICIENTS["Reed 2007"]
    nu, up = peak_height(s, delta_c), -F.ln(s)
    bump = lambda i: k[f"g{i}"] * F.exp(-(up - k[f"at{i}"]) * (up - k[f"at{i}"]) / k[f"width{i}"])
    an2 = k["a"] * nu * nu
    shape = 1.0 + _pow(an2, -k["p"]) + bump(1) + bump(2)
    return k["A"] * math.sqrt(2 * k["a"] / math.pi) * shape * nu * F.exp(-0.5 * k["ca"] * an2 - k["n"] / (n_eff + 3.0) ** 2 * _pow(nu, k["q"]))


def _power_cut(s, A, a, b, c):
    return A * (_pow(b / s, a) + 1.0) * F.exp(-c / (s * s))


def _at_z(k: dict[str, float], name: str, zp: Column) -> Column:
    """A coefficient times (1 + z) to its exponent."""
    return k[name] * _pow(zp, k[f"{name}_z"])


def f_tinker08(sigma, delta_c=DELTA_C, z=0.0, delta_halo=200.0, **_):
    """Needs delta_halo above 75."""
    zp, k = 1.0 + _c(z), COEFFICIENTS["Tinker 2008"]
    alpha = F.pow(F.lit(10.0), -_pow(k["alpha"] / F.log10(_c(delta_halo) / k["delta"]), k["alpha_q"]))
    return _power_cut(_floor(sigma), _at_z(k, "A", zp), _at_z(k, "a", zp), k["b"] * F.pow(zp, -alpha), F.lit(k["c"]))


def f_crocce10(sigma, delta_c=DELTA_C, z=0.0, **_):
    s, zp, k = _floor(sigma), 1.0 + _c(z), COEFFICIENTS["Crocce 2010"]
    return _at_z(k, "A", zp) * (F.pow(s, -_at_z(k, "a", zp)) + _at_z(k, "b", zp)) * F.exp(-_at_z(k, "c", zp) / (s * s))


def f_courtin10(sigma, delta_c=DELTA_C, z=0.0, **_):
    return _ellipsoidal(sigma, delta_c, **COEFFICIENTS["Courtin 2010"])


def f_bhattacharya11(sigma, delta_c=DELTA_C, z=0.0, **_):
    nu, zp, k = peak_height(sigma, delta_c), 1.0 + _c(z), COEFFICIENTS["Bhattacharya 2011"]
    a = _at_z(k, "a", zp)
    an2 = a * nu * nu
    return _at_z(k, "A", zp) * math.sqrt(2 / math.pi) * F.exp(-0.5 * an2) * (1.0 + _pow(an2, -k["p"])) * _pow(nu * F.sqrt(a), k["q"])


def f_angulo12(sigma, delta_c=DELTA_C, z=0.0, subhalos: bool = False, **_):
    return _power_cut(_floor(sigma), **COEFFICIENTS["Angulo 2012, subhalos" if subhalos else "Angulo 2012"])


def f_watson_fof13(sigma, delta_c=DELTA_C, z=0.0, **_):
    return _power_cut(_floor(sigma), **COEFFICIENTS["Watson FOF 2013"])


def f_watson_so13(sigma, delta_c=DELTA_C, z=0.0, delta_halo=200.0, omega_m_z=0.3, **_):
    s, z, om, zp, k = _floor(sigma), _c(z), _c(omega_m_z), 1.0 + _c(z), COEFFICIENTS["Watson SO 2013"]
    by_z = lambda n, between: F.when(z == 0, F.lit(k[f"{n}0"])).when(z >= 6, F.lit(k[f"{n}6"])).otherwise(between)
    A, a, b = (by_z(n, om * (_at_z(k, n, zp) + k[f"{n}_add"])) for n in ("A", "a", "b"))
    d = _c(delta_halo) / k["delta"]
    gamma = F.exp(k["g1"] * (d - 1.0)) * F.pow(d, -k["g2"] * om - k["g3"]) * F.exp(k["g4"] * (1.0 - d) / _pow(s, k["g5"]))
    return gamma * _power_cut(s, A, a, b, by_z("c", F.lit(k["c"])))


FITS: dict[str, Callable[..., Column]] = {
    "Press-Schechter 1974": f_press_schechter,
    "Sheth-Tormen 2001": f_sheth_tormen,
    "Jenkins 2001": f_jenkins,
    "Reed 2003": f_reed03,
    "Warren 2006": f_warren,
    "Reed 2007": f_reed07,
    "Tinker 2008": f_tinker08,
    "Crocce 2010": f_crocce10,
    "Courtin 2010": f_courtin10,
    "Bhattacharya 2011": f_bhattacharya11,
    "Angulo 2012": f_angulo12,
    "Watson FOF 2013": f_watson_fof13,
    "Watson SO 2013": f_watson_so13,
}


def canonical_name(name: str) -> str:
    """The fit's full name; an unknown one is an error."""
    name = ALIASES.get(name, name)
    if name not in FITS:
        raise ValueError(f"unknown fit: {name}")
    return name


def multiplicity(sigma: Column, fit: str | Column, **params) -> Column:
    """f(sigma) of the named fit, or of the fit named in a column; unknown names are errors, at once or when met."""
    if isinstance(fit, str):
        return FITS[canonical_name(fit)](sigma, **params)
    chain = None
    for name, f in FITS.items():
        hit = fit.isin(name, *[short for short, full in ALIASES.items() if full == name])
        chain = F.when(hit, f(sigma, **params)) if chain is None else chain.when(hit, f(sigma, **params))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown fit: "), fit)).cast("double"))
