import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tsfoundry.operators.align import band_counts
from tsfoundry.operators.quantiles import exact_quantiles, value_cumcounts

PROBS = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]


def check(df, values, split_above=200_000):
    row = exact_quantiles(df, [], "y", PROBS).first()
    assert np.allclose(list(row), np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 1.0, 1.0, 7.0], [0.0] * 50 + [-1e9, 1e9, 5.5], [1e6 + i * 1e-6 for i in range(300)],
])
def test_exact_quantiles(series, values):
    check(series({"y": values}), values)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3)), min_size=1, max_size=60))
def test_exact_quantiles_of_any_list(series, values):
    check(series({"y": values}), values)


def test_ranks_when_a_bucket_is_split(series):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(1000, 1e-3, 400), rng.normal(0, 50, 100), np.repeat(1000.0, 30)])
    rows = value_cumcounts(series({"y": values}), [], "y", split_above=20).collect()
    assert sum(r.c for r in rows) == len(values)
    for r in rows:
        assert r.below == int((values < r.v).sum()) and r.n == len(values)


def test_nulls_are_ignored_and_keys_kept(series):
    df = series({"y": [1, None, 3]}, "a").union(series({"y": [10, 20]}, "b"))
    got = {r.series_id: r["q0.5"] for r in exact_quantiles(df, ["series_id"], "y", [0.5]).collect()}
    assert got == {"a": 2.0, "b": 15.0}


def test_band_counts(series):
    rng = np.random.default_rng(3)
    x = np.round(rng.random(120), 2)
    row = band_counts(series({"y": x}), ["series_id"], "y", 0.1).first()
    lo, hi = x - 0.1, x + 0.1
    want = sum(int(((x > a) & (x < b)).sum()) - 1 for a, b in zip(lo, hi))
    assert (row.pairs, row.n) == (want, 120)
