"""Normal tail arithmetic against the exact complementary error function."""

import math

import duckdb
import pytest

from liftlab.functions.normal import (detectable_shift, log_sf_sql, num, ppf, sf_scalar,
                                      sf_sql)


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.96, 2.49, 2.5, 3.7, 6.0, 12.0, 30.0])
def test_sf_and_log_sf_match_erfc(z):
    con = duckdb.connect()
    got_sf, got_log = con.sql(f"SELECT {sf_sql(num(z))}, {log_sf_sql(num(z))}").fetchall()[0]
    ref = 0.5 * math.erfc(z / math.sqrt(2))
    assert got_sf == pytest.approx(ref, rel=1e-12)
    assert got_log == pytest.approx(math.log(ref), rel=1e-12)


def test_log_sf_is_finite_beyond_underflow():
    con = duckdb.connect()
    (v,) = con.sql(f"SELECT {log_sf_sql(num(40.0))}").fetchall()[0]
    # asymptotic: -z^2/2 - log(z) - log(sqrt(2 pi)) to first order
    assert v == pytest.approx(-800 - math.log(40) - 0.5 * math.log(2 * math.pi), abs=1e-3)


def test_ppf_round_trip():
    assert ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-15)
    assert sf_scalar(ppf(0.9)) == pytest.approx(0.1, rel=1e-12)


def test_detectable_shift_solves_power_equation():
    c = ppf(0.975)
    for power in (0.8, 0.9):
        d = detectable_shift(power)
        assert sf_scalar(c - d) + sf_scalar(c + d) == pytest.approx(power, rel=1e-13)
