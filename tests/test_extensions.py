"""Solvers and fluxes of one's own, rules per field, and what the engine says of itself."""

import numpy as np
import pytest

from fieldloom import inspect
from fieldloom.functions import physics
from fieldloom.functions.expr import const
from fieldloom.operators import elliptic, fv
from fieldloom.plans.program import Program
from fieldloom.plans.relation import Given
from fieldloom.sources import fields


def _numbers(exprs):
    return [e.evaluate({}) for e in exprs]


@pytest.mark.parametrize("solver", ["hllc", "roe"])
def test_isothermal_contacts(solver):
    """Equal states give the plain flux, and a resting shear layer has no flux across it."""
    cold, run = physics.Isothermal(2.0), physics.RIEMANN[solver]
    u = [const(x) for x in (1.3, 0.4, -0.2)]
    for d in (0, 1):
        assert np.allclose(_numbers(run(cold, u, {}, u, {}, d)), _numbers(cold.flux(u, {}, d)))
    a, b = [const(x) for x in (1.0, 0.0, 0.7)], [const(x) for x in (1.0, 0.0, -0.3)]
    assert np.allclose(_numbers(run(cold, a, {}, b, {}, 0)), [0.0, 2.0, 0.0])
    with pytest.raises(ValueError):
        run(physics.Advection(), [const(1.0)], {}, [const(1.0)], {}, 0)


def test_isothermal_roe_against_the_matrix():
    cold = physics.Isothermal(2.0)
    l, r = np.array([1.0, 0.3, 0.5]), np.array([1.6, -0.4, 0.1])
    wl, wr = np.sqrt(l[0]), np.sqrt(r[0])
    v, w = ((wl * l[k] / l[0] + wr * r[k] / r[0]) / (wl + wr) for k in (1, 2))
    jacobian = np.array([[0, 1, 0], [2.0 - v * v, 2 * v, 0], [-v * w, w, v]])
    values, vectors = np.linalg.eig(jacobian)
    size = np.where(abs(values) < 0.1 * np.sqrt(2), (values**2 / (0.1 * np.sqrt(2)) + 0.1 * np.sqrt(2)) / 2, abs(values))
    size = np.where(np.isclose(values, v), abs(v), size)
    def flux(u):
        return np.array(_numbers(cold.flux([const(x) for x in u], {}, 0)))
    want = (flux(l) + flux(r)) / 2 - (vectors @ np.diag(size) @ np.linalg.inv(vectors) @ (r - l)) / 2
    got = _numbers(physics.RIEMANN["roe"](cold, [const(x) for x in l], {}, [const(x) for x in r], {}, 0))
    assert np.allclose(got, want)


def test_a_solver_of_ones_own(spark):
    def steepest(c, tolerance, max_iter):
        c.combine("r", (1.0, "b"))
        first = c.norm2("r")
        for k in range(max_iter):
            c.apply("r", "ar")
            d = c.dots(rr=("r", "r"), rar=("r", "ar"))
            if d["rr"] ** 0.5 <= tolerance * first:
                return k, d["rr"] ** 0.5
            a = d["rr"] / d["rar"]
            c.combine("x", (1.0, "x"), (a, "r"))
            c.combine("r", (1.0, "r"), (-a, "ar"))
            c.at = c.at.drop("ar")
        return max_iter, c.norm2("r")

    elliptic.register_solver("steepest", steepest)
    try:
        b = np.random.default_rng(1).normal(size=(4, 4))
        done = elliptic.KRYLOV["steepest"](elliptic.periodic_operator((4, 4), 1.0, kappa=4.0), fields.from_array(spark, {"b": b}), tolerance=1e-4, max_iter=30)
        x = fields.to_array(done.field, ["x"], (4, 4))["x"]
        assert np.abs(4 * x - elliptic.laplace(x, 1.0) - b).max() < 1e-3
        with pytest.raises(ValueError):
            elliptic.register_solver("cg", steepest)
    finally:
        del elliptic.KRYLOV["steepest"]


def test_rules_of_single_fields(spark):
    """A drift whose gradient is mirrored at the upper edge carries nothing through it."""
    rng = np.random.default_rng(2)
    v = {"n": rng.uniform(1, 2, (5, 4)), "grad_x": rng.uniform(-1, 1, (5, 4)), "grad_y": rng.uniform(-1, 1, (5, 4))}
    f = Given(fields.from_array(spark, v))
    drift = physics.ExBVelocity(1.0)
    rules = {"grad_y": (("dirichlet", 0.0), "periodic")}
    x = fv.face_fluxes(f, drift, (5, 4), bc=("foextrap", "periodic"), aux=["grad_x", "grad_y"], aux_rules=rules)
    got = fields.to_array(x.frame(spark, ""), ["fx_n"], (5, 4))["fx_n"]
    a, b = -v["grad_y"][-1], v["grad_y"][-1]  # the last cell's speed, and its ghost's
    n = v["n"][-1]
    assert np.allclose(got[-1], n * (a + b) / 2) and np.allclose(got[-1], 0)
    y = fv.face_fluxes(f, drift, (5, 4), bc=("foextrap", "periodic"), aux=["grad_x", "grad_y"])
    assert np.allclose(fields.to_array(y.frame(spark, ""), ["fx_n"], (5, 4))["fx_n"][-1], n * a)


def test_matrices_per_row(spark):
    from pyspark.sql import functions as F

    from fieldloom.functions import linalg

    rng = np.random.default_rng(8)
    ms, vs = [], []
    for _ in range(6):
        q = rng.normal(size=(3, 3))
        ms.append(q @ np.diag(rng.uniform(0.5, 3, 3) * rng.choice([-1, 1], 3)) @ np.linalg.inv(q))
        vs.append(rng.normal(size=3))
    ms.append(np.zeros((3, 3)))
    vs.append(np.ones(3))
    df = spark.createDataFrame([(k, m.tolist(), v.tolist()) for k, (m, v) in enumerate(zip(ms, vs))], "k int, m array<array<double>>, v array<double>")
    got = df.select("k", linalg.abs_apply(F.col("m"), F.col("v")).alias("a"), linalg.inverse(F.col("m")).alias("i"), linalg.norm_inf(F.col("m")).alias("n")).orderBy("k").collect()
    for m, v, r in list(zip(ms, vs, got))[:6]:
        w, q = np.linalg.eig(m)
        assert np.allclose(r["a"], (q @ np.diag(abs(w)) @ np.linalg.inv(q) @ v).real) and np.allclose(np.array(r["i"]) @ m, np.eye(3)) and np.isclose(r["n"], abs(m).sum(1).max())
        assert np.allclose(linalg.matrix_sign_apply(m, v), r["a"])
    assert got[6]["a"] == [None] * 3 and got[6]["i"] == [[None] * 3] * 3 and got[6]["n"] == 0


def test_schemes_by_name(spark):
    from fieldloom.functions.expr import var
    from fieldloom.plans import time as tm

    u = Given(fields.from_array(spark, {"u": np.ones((2, 2))}))
    rate = lambda x: x.with_(r_u=-var("u"))
    assert fields.to_array(tm.advance("euler", u, rate, ["u"], 0.1).frame(spark, ""), ["u"], (2, 2))["u"] == pytest.approx(np.full((2, 2), 0.9))
    tm.register_scheme("twice", lambda u, rate, names, dt: tm.euler(tm.euler(u, rate, names, dt / 2), rate, names, dt / 2))
    try:
        assert fields.to_array(tm.advance("twice", u, rate, ["u"], 0.1).frame(spark, ""), ["u"], (2, 2))["u"] == pytest.approx(np.full((2, 2), 0.95**2))
        with pytest.raises(ValueError):
            tm.register_scheme("rk4", tm.euler)
        with pytest.raises(KeyError):
            tm.advance("unknown", u, rate, ["u"], 0.1)
    finally:
        del tm.SCHEMES["twice"]


def test_what_there_is(spark):
    found = inspect.capabilities()
    assert "hllc" in found["riemann"] and "cg" in found["krylov"] and "solve_linear" in found["operations"]
    assert inspect.parallel_info(spark)["master"].startswith("local")
    assert inspect.doctor(spark) == []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "adaptive" in inspect.doctor(spark)[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    with pytest.raises(ValueError):
        inspect.set_partitions(spark, 0)
    p = Program(operators={"x": "local_source"})
    p.commit("u", p.state("u"))
    assert inspect.program_report(p)["operators"] == {"x": "local_source"} and inspect.program_report(p)["bodies"] == 0


def test_hdf5_says_what_it_needs(tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            fields.write_hdf5(str(tmp_path / "x.h5"), {"b": {"u": np.zeros((2, 2))}}, 0.0, 0)
