"""Property-based checks of the exact-size rules and the distributed rank."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftlab.operators.ranking import curve_counts, decile_bounds, policy_counts, rank_rows
from liftlab.operators.sampling import _largest_remainder, split_sizes

strata = st.dictionaries(st.integers(0, 7), st.integers(1, 10_000), min_size=1, max_size=8)


@given(strata, st.floats(0.05, 0.95))
def test_split_sizes_are_exact_and_complete(sizes, holdout):
    out = split_sizes(sizes, holdout, 0.5)
    n = sum(sizes.values())
    n_hold = math.ceil(holdout * n)
    assert sum(a + b + c for a, b, c in out.values()) == n
    assert sum(a for a, _, _ in out.values()) == n - n_hold
    assert sum(c for _, _, c in out.values()) == math.ceil(0.5 * n_hold)
    assert all(min(v) >= 0 and sum(v) == sizes[s] for s, v in out.items())


@given(strata, st.integers(0, 50_000))
def test_largest_remainder_is_proportional(sizes, take):
    n = sum(sizes.values())
    take = min(take, n)
    got = _largest_remainder(sizes, take)
    assert sum(got.values()) == take
    assert all(abs(got[s] - sizes[s] * take / n) < 1 for s in sizes)


@given(st.integers(1, 100_000), st.integers(1, 200))
def test_curve_points_are_monotone_and_end_at_n(n, points):
    ks = [k for _, _, k in curve_counts(n, points)]
    assert ks[0] == 0 and ks[-1] == n and ks == sorted(ks) and len(ks) == points + 1


@given(st.integers(1, 100_000), st.integers(1, 20))
def test_deciles_partition_the_ranks(n, groups):
    bounds = decile_bounds(n, groups)
    assert bounds[0][1] == 0 and bounds[-1][2] == n
    assert all(a[2] == b[1] for a, b in zip(bounds, bounds[1:]))
    sizes = [hi - lo for _, lo, hi in bounds]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@given(st.integers(1, 100_000))
def test_policy_counts_are_bounded(n):
    assert all(1 <= k <= n for _, k in policy_counts(n))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300), st.integers(1, 6))
def test_rank_equals_sorted_order(spark, scores, parts):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "id long, s double")
    got = {r.id: r.rank for r in rank_rows(df, [F.col("s").desc(), F.col("id").asc()],
                                           partitions=parts).collect()}
    want = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    assert got == {i: k + 1 for k, i in enumerate(want)}
