"""Every registered query of the recordings against its SQL, and plans without Python."""

import glob
import os

import duckdb
import pytest

from spectralake.plans import catalog, extended, further  # noqa: F401  the others register their queries in catalog

SF = "/root/testdata/sf0.01"
FITTED = {"m2_microstate_maps", "m6_connectivity_states", "m8_mixture_states", "m10_change_regression", "m11_feature_components"}


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else float(f"{v:.6g}") if isinstance(v, (int, float)) else v
    return sorted(str(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert len(got) > 0 and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_has_no_python_row_by_row(spark, name):
    if name in FITTED:
        pytest.skip("fits a model first")
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["f11_coherence_null_full", "i1_circular_shift_full", "i2_time_shuffle_full", "i9_metric_against_surrogates_full"])
def test_full_replicates(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if "reps" in got:  # all shifts of 29 frames that move them
        assert set(got.reps) == {28}
    if "rep" in got:
        assert set(got.rep) == set(range(1, 101))
    if "p" in got:
        assert got.p.min() < 0.05


def test_gaussian_information(spark):
    """Against the determinants of the covariances of the whole series."""
    import numpy as np

    from spectralake.operators.complexity import gaussian_information

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 200))
    x[2] += x[0]
    data = [("s", f"c{i}", j, float(j), float(x[i, j])) for i in range(3) for j in range(200)]
    got = gaussian_information(spark.createDataFrame(data, "session_id string, channel string, idx long, t double, x double")).first()
    cov = np.cov(x, bias=True)
    h = lambda c: 0.5 * np.log(np.linalg.det(np.atleast_2d(c)))
    rest = [h(np.delete(np.delete(cov, i, 0), i, 1)) for i in range(3)]
    total, dual = sum(h(cov[i, i]) for i in range(3)) - h(cov), sum(rest) - 2 * h(cov)
    assert np.allclose([got.total, got.dual, got.o_information], [total, dual, total - dual], atol=1e-6)


def test_band_pass_keeps_the_band(spark):
    """A tone in the band stays, one outside goes."""
    import math

    from spectralake.operators.spectral import band_phase, blocks_of

    data = [("s", c, i, float(i), math.sin(2 * math.pi * i / n)) for c, n in (("in", 24), ("out", 4)) for i in range(720)]
    samples = spark.createDataFrame(data, "session_id string, channel string, idx long, t double, x double")
    found = band_phase(blocks_of(samples, 240, 96, 1.0), spark.createDataFrame([("daily", 0.03, 0.06)], "band string, f_lo double, f_hi double"))
    kept = {r.channel: r.a for r in found.where("idx between 200 and 500").groupBy("channel").agg({"amp": "avg"}).withColumnRenamed("avg(amp)", "a").collect()}
    assert 0.9 < kept["in"] < 1.1 and kept["out"] < 0.05
