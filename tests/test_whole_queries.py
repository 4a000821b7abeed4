"""The queries that give whole results: nothing of their input's domain is left out."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cosmotab.plans.queries import Q  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_series_error_over_the_whole_range(spark):
    rows = Q["series_error"](spark, str(DATA)).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/part.parquet").count()
    small = [r for r in rows if r.log_y < -1]
    assert min(r.log_y for r in rows) < -6.9 and max(r.log_y for r in rows) > 1.8 and len(small) > len(rows) / 2
    assert all(r.log_error <= max(-9, -14.3979 - 2 * r.log_y) + 1e-3 for r in small)


def test_sigma_integrand_at_every_k(spark):
    rows = Q["sigma_integrand"](spark, str(DATA)).collect()
    samples = Q["export_power"](spark, str(DATA)).count()  # of P(k) at z = 0
    by_window = {w: [r.ln_i for r in rows if r.window_type == w] for w in ("Top-hat", "Gaussian", "Sharp-k")}
    assert [len(v) for v in by_window.values()] == [samples] * 3
    assert sum(v < -690 for v in by_window["Sharp-k"]) > samples / 4 and min(by_window["Gaussian"]) < -690 < min(by_window["Top-hat"])


def test_calibration_label_of_every_fit(spark):
    rows = Q["calibration_label"](spark, str(DATA)).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.fit, set()).add(r.calibrated)
    assert len(seen) == 13
    assert all(seen[n] == {True, False} for n in ("Warren 2006", "Crocce 2010", "Bhattacharya 2011", "Angulo 2012", "Watson FOF 2013"))
