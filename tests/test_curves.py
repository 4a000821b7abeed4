"""Kernels over curves: exact cases, properties, golden rows."""

import math

import pytest
from pyspark.sql import functions as F

from cosmotab.operators import curves, hmf, sigma


def curve(spark, points, name="c"):
    return spark.createDataFrame([(name, float(x), float(y)) for x, y in points], "curve string, x double, y double").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_simpson_is_exact_for_quadratics(spark, n):
    xs = [0.5 * i + 0.1 * i * i for i in range(n)]
    f = (lambda x: 2 - x + 3 * x * x) if n > 2 else (lambda x: 2 - x)
    whole = (lambda x: 2 * x - x * x / 2 + x**3) if n > 2 else (lambda x: 2 * x - x * x / 2)
    got = curves.simpson_integral(curve(spark, [(x, f(x)) for x in xs]), ["curve"]).first().integral
    assert got == pytest.approx(whole(xs[-1]) - whole(xs[0]), abs=1e-12)


def test_log_gradient_of_a_power_law(spark):
    points = [(10 ** (8 + 4 * i / 9), (10 ** (8 + 4 * i / 9)) ** -0.1) for i in range(10)]
    for order in (1, 2):
        got = [r.slope for r in curves.log_gradient(curve(spark, points), ["curve"], edge_order=order).collect()]
        assert got == pytest.approx([-0.1] * 10, abs=1e-12)
    assert curves.log_gradient(curve(spark, points[:1]), ["curve"]).first().slope is None


def test_tail_falls_and_ends_at_the_floor(spark):
    points = [(10 ** (10 + 4 * i / 19), (10 ** (10 + 4 * i / 19)) ** -0.5) for i in range(20)]
    rows = [r.tail for r in curves.tail_cumulative(curve(spark, points), ["curve"]).orderBy("x").collect()]
    assert all(a >= b for a, b in zip(rows, rows[1:], strict=False)) and rows[-1] == 1e-300
    strips = sum(0.5 * (a[1] + b[1]) * math.log(b[0] / a[0]) for a, b in zip(points, points[1:], strict=False))
    assert rows[0] == pytest.approx(strips, rel=1e-13)


def test_interpolation_rules(spark):
    base = curve(spark, [(1, 1), (10, 100), (100, 10000)])
    ask = curve(spark, [(0.5, 7), (1, 7), (3, 7), (1000, 7)])
    get = lambda **k: {r.x: r.v for r in curves.interpolate(ask, base, ["curve"], out="v", **k).collect()}
    assert get() == pytest.approx({0.5: 1, 1: 1, 3: 9, 1000: 10000})
    assert get(log=False) == pytest.approx({0.5: 1, 1: 1, 3: 23, 1000: 10000})
    strict = get(strict=True, log=True)
    assert strict[0.5] is None and strict[1000] is None and strict[3] == pytest.approx(9)
    from_zero = curves.interpolate(curve(spark, [(0, 1), (0.5, 1)]), curve(spark, [(0, 1), (1, 3)]), ["curve"], out="v").collect()
    assert sorted(r.v for r in from_zero) == pytest.approx([1, 2])
    assert curves.interpolate(curve(spark, [(1, 1)], "other"), base, ["curve"], out="v").first().v is None


def power(spark, n, points=129):
    ks = [10 ** (-4 + 6 * i / (points - 1)) for i in range(points)]
    return spark.createDataFrame([(1, 0.0, k, k**n) for k in ks], "run_id bigint, z double, k double, p double")


@pytest.mark.parametrize("points", [400, 401])
def test_gaussian_sigma_of_a_power_law(spark, points):
    radii = spark.createDataFrame([(1, 1.0, 1.0, 2.0)], "run_id bigint, m_h double, m double, r double")
    got = sigma.sigma_m(power(spark, 1, points), radii, ("Gaussian",)).first().sigma
    assert got**2 == pytest.approx(math.gamma(2) / (4 * math.pi**2 * 2.0**4), rel=1e-4)


def test_packed_sigma_equals_the_join(spark):
    radii = spark.createDataFrame([(1, float(i), float(i), 0.3 * i) for i in range(1, 7)], "run_id bigint, m_h double, m double, r double")
    names = ("Top-hat", "Gaussian", "Sharp-k")
    key = lambda r: (r.window_type, r.m_h)
    a = {key(r): r.sigma for r in sigma.sigma_m(power(spark, 0.5), radii, names).collect()}
    b = {key(r): r.sigma for r in sigma.sigma_m_packed(power(spark, 0.5), radii, names).collect()}
    assert a == pytest.approx(b, rel=1e-9) and len(a) == 18


def test_golden_mass_function_row(spark):
    rho0, h = 26012744694.870667, 0.55
    runs = spark.createDataFrame([(1, 100 * h, rho0 / (2.775e11 * h * h))], "run_id bigint, H0 double, Omega_m double")
    row = spark.createDataFrame([(1, "Top-hat", 0.0, 1e8, 1e8 / h, 4.692791622106946, -0.07697823764348932)], "run_id bigint, window_type string, z double, m_h double, m double, sigma double, dlns double")
    got = {r.fit: r.hmf for r in hmf.hmf(row, runs, ["Press-Schechter", "Sheth-Tormen"]).collect()}
    assert got == pytest.approx({"Press-Schechter 1974": 17.789599442469036, "Sheth-Tormen 2001": 14.983881563768081}, rel=1e-12)


def test_calibration_ranges(spark):
    catalog = {r.fit: r for r in hmf.fit_catalog(spark).collect()}
    assert (catalog["Jenkins 2001"].variable, catalog["Jenkins 2001"].lo, catalog["Jenkins 2001"].hi, catalog["Jenkins 2001"].z_hi) == ("ln_inv_sigma", -1.2, 1.05, 5.0)
    assert (catalog["Crocce 2010"].variable, catalog["Crocce 2010"].lo, catalog["Crocce 2010"].z_hi) == ("log10_m", 10.5, 2.0)
    assert catalog["Warren 2006"].z_lo == catalog["Warren 2006"].z_hi == 0.0
    assert catalog["Press-Schechter 1974"].variable is None and catalog["Press-Schechter 1974"].z_lo is None


def test_strict_redshifts(spark):
    ask = spark.createDataFrame([(1, 0.0), (1, 1.0 + 5e-10), (1, 1.1)], "run_id bigint, z double")
    have = spark.createDataFrame([(1, 0.0), (1, 1.0)], "run_id bigint, z double")
    found, missing = hmf.strict_z(ask, have)
    assert sorted(r.z_used for r in found.collect()) == [0.0, 1.0] and [r.z for r in missing.collect()] == [1.1]
