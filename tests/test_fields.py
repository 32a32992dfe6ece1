"""Field operators against another SQL engine, NumPy and analytic solutions."""

import numpy as np
import pytest
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import expr as ex
from fieldloom.functions import moments, physics
from fieldloom.operators import amr, coupling, elliptic, fv, grid, reduce, stencil
from fieldloom.operators.grid import Box
from fieldloom.plans import queries as named
from fieldloom.plans import time as tm
from fieldloom.plans.relation import Given
from fieldloom.sources import fields

SQL_CHECKED = sorted(set(named.oracle_sql()) - {"tag_bbox"})  # no tags on the smallest tables


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_same_as_other_engine(spark, duck, name):
    df = named.queries()[name](spark, SMALL)
    same_rows(df.toPandas(), duck.sql(named.oracle_sql()[name]).df())


def _field(spark, seed, shape=(8, 8), names=("u",), low=1.0, high=9.0):
    rng = np.random.default_rng(seed)
    values = {n: rng.uniform(low, high, shape) for n in names}
    return values, Given(fields.from_array(spark, values))


def _array(plan, spark, c, shape=(8, 8)):
    return fields.to_array(plan.frame(spark, ""), [c], shape)[c]


def test_laplacian_is_numpys(spark):
    v, f = _field(spark, 1)
    got = _array(stencil.laplacian(f, "u", (8, 8), 0.5, 0.5), spark, "lap")
    assert np.allclose(got, elliptic.laplace(v["u"], 0.5))


def test_partitions_do_not_change_results(spark):
    _, f = _field(spark, 2)
    plan = fv.rhs(f, physics.Advection(1.0, 0.5), (8, 8), 0.1, 0.1, limiter="vanleer")
    one = _array(plan, spark, "r_u")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = _array(plan, spark, "r_u")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (one == again).all()


@pytest.mark.parametrize("limiter", ["none", "minmod", "vanleer", "weno5"])
@pytest.mark.parametrize("riemann", ["rusanov", "hll", "hllc", "roe"])
def test_rate_conserves(spark, limiter, riemann):
    gas = physics.Euler()
    rng = np.random.default_rng(3)
    v = {"rho": rng.uniform(1, 2, (8, 8)), "mx": rng.uniform(-0.2, 0.2, (8, 8)), "my": rng.uniform(-0.2, 0.2, (8, 8)), "e": rng.uniform(4, 5, (8, 8))}
    f = Given(fields.from_array(spark, v))
    out = fv.rhs(f, gas, (8, 8), 0.1, 0.1, limiter=limiter, riemann=riemann).frame(spark, "")
    sums = out.groupBy().sum("r_rho", "r_mx", "r_my", "r_e").first()
    assert max(abs(x) for x in sums) < 1e-9


def test_equal_states_have_the_plain_flux():
    gas = physics.Euler()
    u = [ex.const(x) for x in (1.3, 0.4, -0.2, 3.0)]
    for d in (0, 1):
        plain = [e.evaluate({}) for e in gas.flux(u, {}, d)]
        for solver in physics.RIEMANN.values():
            assert np.allclose([e.evaluate({}) for e in solver(gas, u, {}, u, {}, d)], plain)


def test_weno_order():
    errors = []
    for n in (32, 64, 128):
        edges = np.arange(-3, n + 4) / n
        mean = (np.cos(2 * np.pi * edges[:-1]) - np.cos(2 * np.pi * edges[1:])) * n / (2 * np.pi)
        env = {c: mean[k : n + k] for k, c in enumerate("abcde")}
        face = physics.weno5z(*(ex.var(c) for c in "abcde")).evaluate(env)
        errors.append(np.abs(face - np.sin(2 * np.pi * np.arange(0, n) / n)).max())
    assert np.log2(errors[0] / errors[1]) > 4.5 and np.log2(errors[1] / errors[2]) > 4.5


def test_symbolic_derivative():
    x, y = ex.var("x"), ex.var("y")
    f = x * x * y / (x + 2.0) + ex.sqrt(x) - ex.abs_(y - x) + x**3
    env = {"x": np.array([0.7, 1.9]), "y": np.array([1.1, 0.4])}
    for n in "xy":
        h = 1e-6
        up, down = ({**env, n: env[n] + s * h} for s in (1, -1))
        assert np.allclose(ex.diff(f, n).evaluate(env), (f.evaluate(up) - f.evaluate(down)) / (2 * h), rtol=1e-6)
    assert ex.simplify(x * 0.0 + y * 1.0) == y


def test_spark_numpy_agree_on_expressions(spark):
    v, f = _field(spark, 5, names=("a", "b"))
    e = ex.where(ex.var("a") > 4.0, physics.van_leer(ex.var("a"), ex.var("b")), ex.smooth_floor(ex.var("b") - 4.0, 0.1))
    assert np.allclose(_array(f.select("i", "j", z=e), spark, "z"), e.evaluate(v))


def test_multigrid_and_fft_agree():
    x = (np.arange(32) + 0.5) / 32
    f = np.sin(2 * np.pi * x)[:, None] * np.sin(2 * np.pi * x)[None, :]
    u, cycles, r = elliptic.Multigrid(rel=1e-10).solve(f, 1 / 32)
    v = elliptic.fft_poisson(f, 1 / 32)
    assert cycles < 50 and r < 1e-8
    assert np.allclose(u, v - v.mean(), atol=1e-10)
    robust = elliptic.Multigrid(rel=1e-10).solve_robust(f, 1 / 32)[0]
    assert np.allclose(robust, u, atol=1e-9)


def test_spectral_poisson_is_exact():
    x = (np.arange(16) + 0.5) / 16
    f = np.tile(1e-3 * np.cos(2 * np.pi * x)[:, None], (1, 16))
    assert np.allclose(elliptic.fft_poisson(f, 1 / 16, spectral=True), -f / (2 * np.pi) ** 2, atol=1e-12)


def test_polar_poisson_order():
    def error(n):
        r0, r1, dr = 0.3, 1.0, 0.7 / n
        r = (r0 + (np.arange(n) + 0.5) * dr)[:, None]
        t = 2 * np.pi * np.arange(16)[None, :] / 16
        k = np.pi / (r1 - r0)
        s, c = np.sin(k * (r - r0)), np.cos(k * (r - r0))
        f = (-k * k * s + k * c / r - 4 * s / r**2) * np.cos(2 * t)
        return np.abs(elliptic.polar_poisson(f, r0, r1) - s * np.cos(2 * t)).max()

    assert np.log2(error(32) / error(64)) > 1.7
    with pytest.raises(ValueError):
        elliptic.polar_poisson(np.zeros((4, 4)), 0.0, 1.0)


def test_composite_solve_is_second_order_small():
    x = (np.arange(32) + 0.5) / 32
    X, Y = np.meshgrid(x, x, indexing="ij")
    exact = lambda a, b: np.sin(2 * np.pi * a) * np.sin(2 * np.pi * b)
    f = -8 * np.pi**2 * exact(X, Y)
    xf = 8 / 32 + (np.arange(32) + 0.5) / 64
    XF, YF = np.meshgrid(xf, xf, indexing="ij")
    phi, fine = elliptic.fac_two_level(f, -8 * np.pi**2 * exact(XF, YF), (8, 8), 1 / 32)
    assert np.abs(fine - exact(XF, YF)).max() < 0.01
    assert np.abs(phi - exact(X, Y)).max() < 0.01


@pytest.mark.parametrize("method", ["cg", "bicgstab", "gmres", "richardson"])
def test_krylov_solves(spark, method):
    v, f = _field(spark, 6, (4, 4), names=("b",))
    op = elliptic.periodic_operator((4, 4), 1.0, kappa=4.0)
    more = {"omega": 0.12} if method == "richardson" else {}
    done = elliptic.KRYLOV[method](op, f.frame(spark, ""), tolerance=1e-3, max_iter=40, **more)
    x = fields.to_array(done.field, ["x"], (4, 4))["x"]
    assert np.abs(4 * x - elliptic.laplace(x, 1.0) - v["b"]).max() < 0.05


def test_ssprk3_order(spark):
    def error(steps):
        f = Given(fields.from_array(spark, {"u": np.ones((2, 2))}))
        for _ in range(steps):
            f = tm.ssprk3(f, lambda x: x.with_(r_u=ex.var("u") * -1.0), ["u"], 1.0 / steps)
        return abs(_array(f, spark, "u", (2, 2))[0, 0] - np.exp(-1))

    assert np.log2(error(2) / error(4)) > 2.6


def test_tableau_is_checked():
    with pytest.raises(ValueError):
        tm.Tableau(((), (0.5, 0.1)), (0.5, 0.5))
    with pytest.raises(ValueError):
        tm.Tableau(((), (0.5,)), (0.5, 0.4))


def test_coupled_source_conserves(spark):
    v, f = _field(spark, 7, names=("a", "b"))
    s = coupling.CoupledSource().pair("a", "b", ex.var("a") * ex.var("b") * 0.1)
    assert s.conserved() == [("a", "b")]
    out = s.step(f, 0.5)
    total = _array(out, spark, "a") + _array(out, spark, "b")
    assert np.allclose(total, v["a"] + v["b"], rtol=1e-12)


def test_missing_brick_is_an_error():
    with pytest.raises(ValueError):
        physics.make_model("unknown", "none", "charge")
    with pytest.raises(KeyError):
        physics.component(["rho"], ["Density"], "Energy")
    with pytest.raises(ValueError):
        stencil.reach_needed("weno5", 2)


def test_gaussian_closure_of_a_maxwellian():
    order = 4
    c = [ex.const(x) for x in (2.0, 0.3, -0.7, 1.5)]
    env = {k: e.evaluate({}) for k, e in moments.maxwellian(order, *c).items()}
    fx, _ = moments.fluxes(order)
    # third central moments of a Gaussian vanish, so M_50 follows the binomial rule
    u, t = 0.3, 1.5
    m5 = 2.0 * (u**5 + 10 * u**3 * t + 15 * u * t * t)
    assert np.isclose(fx["m40"].evaluate(env), m5)
    assert all(abs(e.evaluate(env)) < 1e-9 for e in moments.bgk_source(order, 1.0).values())


def test_mass_weights(spark):
    v, f = _field(spark, 8)
    assert np.isclose(reduce.mass(f, "u").frame(spark, "").first()[0], v["u"].sum())


boxes = st.builds(lambda a, b, w, h: Box(a, b, a + w, b + h), st.integers(-(2**20), 2**20), st.integers(-(2**20), 2**20), st.integers(0, 40), st.integers(0, 40))


@given(boxes, st.integers(1, 8), st.integers(0, 16))
def test_box_algebra(b, r, g):
    assert b.refine(r).coarsen(r) == b
    assert b.grow(g).grow(-g) == b
    assert b.grow(g).intersect(b) == b
    assert b.refine(r).cells == b.cells * r * r
    assert sum(p.cells for p in b.chop(7)) == b.cells


@settings(max_examples=50)
@given(st.sets(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=120))
def test_clusters_cover_all_tags_once(tags):
    found = amr.cluster(tags)
    for i, j in tags:
        assert sum(b.contains(i, j) for b in found) == 1


def test_knapsack_balances():
    weights = [7.0, 5.0, 4.0, 3.0, 3.0, 2.0]
    owner = amr.knapsack(weights, 2)
    assert amr.imbalance(weights, owner, 2) < 1.1


def test_average_of_interpolation_is_identity(spark):
    v, f = _field(spark, 9)
    assert np.allclose(_array(amr.average_down(amr.interpolate(f, ["u"]), ["u"]), spark, "u"), v["u"])


def test_uncovered_fine_cells_keep_their_values(spark):
    coarse = Given(fields.from_array(spark, {"u": np.ones((2, 2))}))
    fine = Given(fields.from_array(spark, {"u": np.full((6, 6), 5.0)}))
    got = _array(amr.inject(coarse, fine, ["u"]), spark, "u", (6, 6))
    assert (got[:4, :4] == 1).all() and got[5, 5] == 5


def test_rows_of_python_queries(spark):
    from fieldloom.plans.queries import PYTHON

    got = PYTHON["berger_rigoutsos"](spark, SMALL)
    assert got.columns == ["region", "i0", "j0", "i1", "j1"]
    s = PYTHON["spectrum_4x4"](spark, SMALL).limit(5).toPandas()
    assert s["all_real"].all()
    n = PYTHON["newton_source"](spark, SMALL).toPandas()
    assert n["residual"].max() == 0.0


@pytest.mark.parametrize("name", ["newton_source", "newton_report"])
def test_newton_of_full_cells(spark, tmp_path, name):
    """Cells of so many rows that six steps from the old state don't reach the root."""
    import duckdb

    from fieldloom.plans.queries import PYTHON, oracle_sql

    rows = spark.range(300_000).selectExpr("(id % 1000) * (id % 1000) div 40000 AS l_orderkey", "id % 3 AS l_partkey", "cast(id % 7 + 1 as int) AS l_linenumber", "if(id % 4 = 0, 'R', 'N') AS l_returnflag")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same_rows(PYTHON[name](spark, str(tmp_path)).toPandas(), duck.execute(oracle_sql()[name]).df())


def test_newton_until_settled(spark):
    from fieldloom.functions.linalg import newton_source

    u = [0.0, -3.0, 1e5, -4e7, 1e12]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(u)], "k int, x double")
    got = df.select("k", newton_source(F.array("x"), lambda v: -0.01 * v * abs(v), 1, 0.1, steps=None).alias("s")).orderBy("k").collect()
    want = [np.sign(x) * (np.sqrt(1 + 0.004 * abs(x)) - 1) / 0.002 for x in u]
    assert np.allclose([r["s"]["state"][0] for r in got], want, rtol=1e-12, atol=1e-12) and all(r["s"]["ok"] for r in got)
    none = df.select(newton_source(F.array("x"), lambda v: 10 * (v * v + 1.0) + 0 * v, 1, 1.0, steps=None).alias("s")).collect()
    assert not any(r["s"]["ok"] for r in none[:3])


def test_grid_is_complete(spark):
    assert grid.density(8).frame(spark, SMALL).count() == 64
