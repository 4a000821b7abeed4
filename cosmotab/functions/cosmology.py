"""Cosmological scalars as Column expressions over the columns of a run."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of the derived quantities.
RHO_CRIT_COEFF = 2.775e11
T_CMB = 2.7255
OMEGA_GAMMA_H2 = 2.469e-5
NEUTRINO_FACTOR = 0.22710731766


def h(H0: Column) -> Column:
    return H0 / 100.0


def omega_r(H0: Column, tcmb: Column | float = T_CMB, n_eff: Column | float = 3.046) -> Column:
    t = F.lit(tcmb) if isinstance(tcmb, float) else tcmb
    n = F.lit(n_eff) if isinstance(n_eff, float) else n_eff
    return OMEGA_GAMMA_H2 * F.pow(t / T_CMB, F.lit(4.0)) * (1.0 + NEUTRINO_FACTOR * n) / (h(H0) * h(H0))


def rho_crit(H0: Column) -> Column:
    return RHO_CRIT_COEFF * h(H0) * h(H0)


def rho0(H0: Column, Omega_m: Column) -> Column:
    return Omega_m * rho_crit(H0)


def omega_m_of_z(z: Column, Omega_m: Column, Omega_r: Column, Omega_k: Column | float = 0.0) -> Column:
    """Matter share at z; dark energy is the rest of 1, not below 0."""
    k = F.lit(Omega_k) if isinstance(Omega_k, float) else Omega_k
    a = 1.0 + z
    rest = F.greatest(1.0 - Omega_m - Omega_r - k, F.lit(0.0))
    return Omega_m * a * a * a / (Omega_r * a * a * a * a + Omega_m * a * a * a + k * a * a + rest)


def radius_of_mass(m: Column, rho: Column) -> Column:
    """R in Mpc of a sphere of mean density rho that holds mass m."""
    return F.pow(3.0 * m / (4.0 * math.pi * rho), F.lit(1.0) / F.lit(3.0))


def mass_of_radius(r: Column, rho: Column) -> Column:
    return 4.0 * math.pi * rho * r * r * r / 3.0


def delta2(k: Column, p: Column) -> Column:
    """Dimensionless power k^3 P / (2 pi^2)."""
    return k * k * k * p / (2.0 * math.pi**2)


def primordial(k: Column, A_s: Column, n_s: Column, k_pivot: Column | float = 0.05) -> Column:
    return A_s * F.pow(k / k_pivot, n_s - 1.0)
