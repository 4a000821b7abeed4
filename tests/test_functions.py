"""Closed forms and golden values of the Column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from cosmotab.functions import cosmology as cos
from cosmotab.functions import fits, windows
from cosmotab.operators import params


def values(spark, column, xs, kind="double"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in xs], f"x {kind}").select(column).collect()]


def test_press_schechter_closed_form(spark):
    for s, got in zip((0.5, 1.0, 2.0), values(spark, fits.f_press_schechter(F.col("x")), [0.5, 1.0, 2.0]), strict=True):
        nu = 1.686 / s
        assert got == pytest.approx(math.sqrt(2 / math.pi) * nu * math.exp(-nu * nu / 2), rel=1e-13)


def test_sheth_tormen_golden(spark):
    assert values(spark, fits.f_sheth_tormen(F.col("x")), [0.8, 1.2]) == pytest.approx([0.1619997779967776, 0.2879055779409089], rel=1e-7)


def test_all_fits_are_finite_and_not_negative(spark):
    grid = [10 ** (-0.7 + 1.2 * i / 63) for i in range(64)]
    for name in fits.FITS:
        got = values(spark, fits.multiplicity(F.col("x"), name, z=0.5, omega_m_z=0.59, delta_halo=200.0, delta_c=1.686), grid)
        assert all(math.isfinite(v) and v >= 0 for v in got), name


def test_fit_names(spark):
    assert fits.canonical_name("Sheth-Tormen") == "Sheth-Tormen 2001"
    with pytest.raises(ValueError):
        fits.canonical_name("nobody 1999")
    with pytest.raises(Exception, match="unknown fit"):
        spark.createDataFrame([(1.0, "nobody")], "x double, f string").select(fits.multiplicity(F.col("x"), F.col("f"))).collect()


def test_windows(spark):
    assert values(spark, windows.top_hat(F.col("x")), [0.0, 1e-8, 1e-4]) == pytest.approx([1, 1, 1], abs=1e-8)
    ys = [0.01, 0.05, 0.09]
    assert values(spark, windows.top_hat(F.col("x")), ys) == values(spark, windows.top_hat_series(F.col("x")), ys)
    assert values(spark, windows.top_hat_series(F.col("x")), ys) == pytest.approx(values(spark, windows.top_hat_exact(F.col("x")), ys), rel=1e-9)
    assert values(spark, windows.sharp_k(F.col("x")), [0.0, 0.5, 1.0, 1.1]) == [1, 1, 1, 0]
    assert values(spark, windows.window(F.col("x"), "no such"), [0.5]) == values(spark, windows.top_hat(F.col("x")), [0.5])
    assert all(v >= 0 for v in values(spark, windows.window_squared(F.col("x"), "Gaussian"), [10 ** (i / 20) for i in range(-80, 40)]))


def test_densities_and_radii(spark):
    assert values(spark, cos.rho_crit(F.col("x")), [70.0]) == pytest.approx([2.775e11 * 0.49])
    assert values(spark, cos.rho0(F.lit(70.0), F.col("x")), [0.3]) == pytest.approx([2.775e11 * 0.49 * 0.3])
    back = cos.mass_of_radius(cos.radius_of_mass(F.col("x"), F.lit(1e11)), F.lit(1e11))
    assert values(spark, back, [1e10, 1e12]) == pytest.approx([1e10, 1e12], rel=1e-12)
    assert values(spark, fits.peak_height(F.col("x")), [1.0, 2.0]) == pytest.approx([1.686, 0.843])


def test_redshift_texts(spark):
    got, issues = params.parse_redshifts("x")
    row = spark.createDataFrame([("0.5, x, -1, ,10",), ("",)], "x string").select(got.alias("v"), issues.alias("i")).collect()
    assert row[0].v == [0.5, 10.0] and len(row[0].i) == 2 and "'x'" in row[0].i[0]
    assert row[1].v == [] and row[1].i == []


def test_solver_settings(spark):
    base = spark.createDataFrame([(1, True, 3.0, [0.0, 1.0, 10.0]), (2, False, 3.0, [0.0])], "run_id int, enable_ede boolean, single_z double, z_values array<double>")
    a, b = params.merge_defaults(base).orderBy("run_id").select(params.solver_settings().alias("m")).collect()
    assert a.m["z_pk"] == "0,1,3,10" and a.m["z_max_pk"] == "10" and a.m["n_axion"] == "3" and a.m["scf_potential"] == "axion"
    assert b.m["z_pk"] == "0,3" and "n_axion" not in b.m and "scf_potential" not in b.m


def test_names_and_keys(spark):
    df = params.merge_defaults(spark.createDataFrame([(1, None, False), (2, 2.6e-9, False)], "run_id int, A_s double, enable_ede boolean"))
    names = [r[0] for r in df.orderBy("run_id").select(params.auto_name(F.col("run_id"))).collect()]
    assert names == ["Run 001 — Baseline LCDM", "Run 002 — High A_s"]
    keys = [r[0] for r in df.unionByName(df).orderBy("run_id").select(params.cache_key()).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 20
    assert values(spark, params.safe_stem(F.col("x")), [" a / b: c?", " :"], "string") == ["a_b_c", "run"]
