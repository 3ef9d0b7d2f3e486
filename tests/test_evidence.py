"""Verdicts at the edges: empty and one-point series, NaN, zero means, vacuous optima."""

import math

import pytest

from lodeweave.operators import evidence as V

S = "series_id string, x double, y double"


def one(df):
    r = df.collect()
    return r[0].verdict if r else None


def series(spark, *ys):
    return spark.createDataFrame([("s", float(i + 1), y) for i, y in enumerate(ys)], S)


@pytest.mark.parametrize(
    "ys, want",
    [((1.0, 2.0, 3.0), "VERIFIED"), ((1.0, 3.0, 2.0), "VERIFIED_WITH_CAVEAT"), ((3.0, 2.0), "REFUTED"), ((2.0, 2.0), "FLAGGED"), ((1.0,), "FLAGGED"), ((0.0, 0.0), "FLAGGED"), ((1.0, float("nan"), 2.0), "VERIFIED"), ((), None)],
)
def test_direction(spark, ys, want):
    assert one(V.direction(series(spark, *ys))) == want


@pytest.mark.parametrize("ys, want", [((1.0, 2.0, 1.5), "VERIFIED_WITH_CAVEAT"), ((1.0, 2.0), "VERIFIED"), ((2.0, 1.0), "VERIFIED_WITH_CAVEAT"), ((1.0, 0.5, 3.0), "REFUTED")])
def test_optimum(spark, ys, want):
    assert one(V.optimum(series(spark, *ys))) == want


def test_elasticity_flags_what_has_no_logarithm(spark):
    assert one(V.elasticity(series(spark, 1.0, 0.0), -9, 9)) == "FLAGGED"
    assert one(V.elasticity(series(spark, 1.0, 2.0, 3.0), 0.9, 1.1)) == "VERIFIED"


def test_invariance_of_zero_and_negative_means(spark):
    assert one(V.invariance(series(spark, -1.0, 1.0), cov_max=0.1)) == "FLAGGED"
    assert one(V.invariance(series(spark, -5.0, -1.0), cov_max=0.1)) == "VERIFIED"
    assert one(V.invariance(series(spark, 1.0, 2.0), cov_max=0.1, range_max=0.5)) == "FLAGGED"


def test_corner_never_accepts_nan(spark):
    assert one(V.corner(series(spark, 2.0, float("nan")), 1.0)) == "REFUTED"
    assert one(V.corner(series(spark, 2.0), 1.0)) == "FLAGGED"


def test_statistical(spark):
    assert one(V.statistical(series(spark, *[1.0] * 7), 1.0)) == "FLAGGED"
    assert one(V.statistical(series(spark, *[-1.0, 1.0] * 4), 9.0, absolute=False)) == "FLAGGED"
    assert V.probit(100) == pytest.approx(2.3263, abs=1e-4)
    ys = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    sd = math.sqrt(sum((y - 4.5) ** 2 for y in ys) / 8)
    assert V.statistical(series(spark, *ys), 1.0, three_sigma=True).first().stat == pytest.approx(3 * sd, abs=1e-6)


def test_lookup_clamps_and_interpolates(spark):
    t = spark.createDataFrame([("s", 1.0, 10.0), ("s", 3.0, 30.0)], S)
    r = spark.createDataFrame([("s", a) for a in (0.0, 1.0, 2.0, 3.0, 9.0)], "series_id string, at double")
    assert {x["at"]: x.y for x in V.lookup(t, r).collect()} == {0.0: 10.0, 1.0: 10.0, 2.0: 20.0, 3.0: 30.0, 9.0: 30.0}


def test_demotion_and_recovery(spark):
    fresh = spark.createDataFrame([("a", "divergent", "process_scoped"), ("b", "divergent", "process_scoped"), ("c", "law", "law")], "claim_id string, reason string, status string")
    stored = spark.createDataFrame([("a", "law"), ("b", "demoted"), ("c", "demoted")], "claim_id string, status string")
    got = {r.claim_id: (r.status, r.newly_demoted) for r in V.demotions(fresh, stored).collect()}
    assert got == {"a": ("demoted", True), "b": ("demoted", False), "c": ("law", False)}
