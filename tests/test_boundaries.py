"""Finite volumes at physical edges and cut cells, against ghost cells in plain NumPy."""

import numpy as np
import pytest

from fieldloom.functions import moments, physics
from fieldloom.functions.expr import const
from fieldloom.operators import cells, fv, stencil
from fieldloom.operators.grid import Geometry, PolarGeometry
from fieldloom.plans.relation import Edges, Given
from fieldloom.sources import fields

G = 3
SHAPE = (9, 7)


def _ghosted(a, rules):
    """``a`` with three ghost cells a side; ``rules``: per axis the rule of the lower and upper end."""
    for axis, (lo, hi) in enumerate(rules):
        a = np.moveaxis(a, axis, 0)
        low = a[-G:] if lo == "periodic" else np.repeat(a[:1], G, 0) if lo == "foextrap" else 2 * lo[1] - a[G - 1 :: -1]
        high = a[:G] if hi == "periodic" else np.repeat(a[-1:], G, 0) if hi == "foextrap" else 2 * hi[1] - a[: -G - 1 : -1]
        a = np.moveaxis(np.concatenate([low, a, high]), 0, axis)
    return a


def _weno(a, b, c, d, e):
    q = ((2 * a - 7 * b + 11 * c) / 6, (-b + 5 * c + 2 * d) / 6, (2 * c + 5 * d - e) / 6)
    s = (13 / 12 * (a - 2 * b + c) ** 2 + (a - 4 * b + 3 * c) ** 2 / 4, 13 / 12 * (b - 2 * c + d) ** 2 + (b - d) ** 2 / 4, 13 / 12 * (c - 2 * d + e) ** 2 + (3 * c - 4 * d + e) ** 2 / 4)
    w = [g * (1 + (abs(s[0] - s[2]) / (x + 1e-40)) ** 2) for g, x in zip((0.1, 0.6, 0.3), s)]
    return sum(x * y for x, y in zip(w, q)) / sum(w)


def _sides(line, limiter):
    """States on both sides of the faces 0..n of a ghosted line (first axis)."""
    n = len(line) - 2 * G

    def at(k):  # the cell k places from the one left of the face
        return line[G - 1 + k : G + n + k]

    if limiter == "none":
        return at(0), at(1)
    if limiter == "weno5":
        return _weno(*(at(k) for k in (-2, -1, 0, 1, 2))), _weno(*(at(k) for k in (3, 2, 1, 0, -1)))

    def slope(a, b):
        if limiter == "minmod":
            return np.where(a * b <= 0, 0, np.where(abs(a) < abs(b), a, b))
        return np.where(a * b <= 0, 0, 2 * a * b / np.where(a + b == 0, 1, a + b))

    return at(0) + slope(at(0) - at(-1), at(1) - at(0)) / 2, at(1) - slope(at(1) - at(0), at(2) - at(1)) / 2


def _gas_flux(u, d):
    rho, m, e = u[0], u[1:3], u[3]
    p = 0.4 * (e - (m[0] ** 2 + m[1] ** 2) / rho / 2)
    v = m[d] / rho
    f = [m[d], m[0] * v, m[1] * v, (e + p) * v]
    f[1 + d] = f[1 + d] + p
    return np.array(f), abs(v) + np.sqrt(1.4 * p / rho)


def _cold_flux(u, d):
    v = u[1 + d] / u[0]
    f = [u[1 + d], u[1] * v, u[2] * v]
    f[1 + d] = f[1 + d] + 2.0 * u[0]
    return np.array(f), abs(v) + np.sqrt(2.0)


def _wind_flux(u, d):
    a = (-1.0, 0.5)[d]
    return u * a, np.full(u.shape[1:], abs(a))


def _faces(u, flux, limiter, rules):
    """Fluxes at the faces 0..n of both axes; ``u`` is (component, i, j)."""
    out = []
    for d in (0, 1):
        padded = np.stack([_ghosted(c, rules) for c in u])
        inner = padded[:, :, G:-G] if d == 0 else padded[:, G:-G, :]
        lines = np.moveaxis(inner, 1 + d, 1)
        left, right = (np.stack(x) for x in zip(*(_sides(c, limiter) for c in lines)))
        if d == 1:
            left, right = left.swapaxes(1, 2), right.swapaxes(1, 2)
        (fl, al), (fr, ar) = flux(left, d), flux(right, d)
        out.append((fl + fr) / 2 - np.maximum(al, ar) / 2 * (right - left))
    return out


def _rate(u, flux, limiter, rules, dx, dy):
    fx, fy = _faces(u, flux, limiter, rules)
    return -np.diff(fx, axis=1) / dx - np.diff(fy, axis=2) / dy


def _gas(seed):
    rng = np.random.default_rng(seed)
    return {"rho": rng.uniform(1, 2, SHAPE), "mx": rng.uniform(-0.5, 0.5, SHAPE), "my": rng.uniform(-0.5, 0.5, SHAPE), "e": rng.uniform(4, 6, SHAPE)}


def _got(plan, spark, names):
    df = plan.frame(spark, "")
    a = fields.to_array(df, [f"r_{c}" for c in names], SHAPE)
    return np.stack([a[f"r_{c}"] for c in names])


FIXED, OTHER = ("dirichlet", 2.0), ("dirichlet", 5.0)
RULES = [
    ("foextrap", [("foextrap",) * 2] * 2),
    (FIXED, [(FIXED,) * 2] * 2),
    (("foextrap", "periodic"), [("foextrap",) * 2, ("periodic",) * 2]),
    (("periodic", FIXED), [("periodic",) * 2, (FIXED,) * 2]),
    ((Edges(FIXED, "foextrap"), Edges("foextrap", OTHER)), [(FIXED, "foextrap"), ("foextrap", OTHER)]),
]


@pytest.mark.parametrize("limiter", ["none", "minmod", "vanleer", "weno5"])
@pytest.mark.parametrize("bc, rules", RULES)
def test_rates_at_edges(spark, limiter, bc, rules):
    v = {"u": np.random.default_rng(5).uniform(1, 9, SHAPE)}
    plan = fv.rhs(Given(fields.from_array(spark, v)), physics.Advection(-1.0, 0.5), SHAPE, 0.5, 0.25, bc=bc, limiter=limiter)
    assert np.allclose(_got(plan, spark, ["u"]), _rate(np.stack([v["u"]]), _wind_flux, limiter, rules, 0.5, 0.25), atol=1e-9)


@pytest.mark.parametrize("limiter", ["none", "minmod", "weno5"])
@pytest.mark.parametrize("bc, rules", [RULES[0], RULES[2]])
def test_gas_rates_at_edges(spark, limiter, bc, rules):
    v = _gas(6)
    plan = fv.rhs(Given(fields.from_array(spark, v)), physics.Euler(), SHAPE, 0.1, 0.2, bc=bc, limiter=limiter)
    assert np.allclose(_got(plan, spark, list(v)), _rate(np.stack(list(v.values())), _gas_flux, limiter, rules, 0.1, 0.2), atol=1e-9)


def test_diffusion_at_edges(spark):
    v = {"u": np.random.default_rng(7).uniform(1, 9, SHAPE)}
    bc, rules = RULES[4]
    plan = fv.rhs(Given(fields.from_array(spark, v)), physics.Advection(0.0, 0.0), SHAPE, 0.5, 0.25, bc=bc, viscosity=0.3)
    p = _ghosted(v["u"], rules)[G - 1 : -G + 1, G - 1 : -G + 1]
    lap = (p[2:, 1:-1] - 2 * p[1:-1, 1:-1] + p[:-2, 1:-1]) / 0.25 + (p[1:-1, 2:] - 2 * p[1:-1, 1:-1] + p[1:-1, :-2]) / 0.0625
    assert np.allclose(_got(plan, spark, ["u"])[0], 0.3 * lap)


@pytest.mark.parametrize("wall", [False, True])
@pytest.mark.parametrize("limiter", ["none", "minmod"])
def test_ring(spark, wall, limiter):
    g = PolarGeometry(*SHAPE, 0.4, 1.3)
    v = {c: x for c, x in _gas(8).items() if c != "e"}
    model = physics.Isothermal(2.0)
    plan = fv.rhs_polar(Given(fields.from_array(spark, v)), model, SHAPE, g, lambda u, r: model.polar_geometric_source(u, r), limiter, wall=wall)
    u = np.stack(list(v.values()))
    fr, ft = _faces(u, _cold_flux, limiter, [("foextrap",) * 2, ("periodic",) * 2])
    if wall:
        fr[:, [0, -1]] = 0
    face = (0.4 + np.arange(SHAPE[0] + 1) * g.dr)[None, :, None]
    r = (0.4 + (np.arange(SHAPE[0]) + 0.5) * g.dr)[None, :, None]
    want = -np.diff(face * fr, axis=1) / (r * g.dr) - np.diff(ft, axis=2) / (r * g.dt)
    vr, vt = u[1] / u[0], u[2] / u[0]
    want = want + np.stack([0 * vr, u[0] * (vt**2 + 2.0), -u[0] * vr * vt]) / r
    got = _got(plan, spark, list(v))
    assert np.allclose(got, want)
    if wall:
        assert abs((got[0] * r[0]).sum()) < 1e-9


def test_a_mask_closes_faces(spark):
    v = _gas(9)
    mask = np.random.default_rng(1).uniform(size=SHAPE) < 0.7
    plan = fv.rhs_masked(Given(fields.from_array(spark, v | {"mask": mask.astype(float)})), physics.Euler(), SHAPE, 0.1, 0.2, "mask", bc="foextrap", limiter="minmod")
    fx, fy = _faces(np.stack(list(v.values())), _gas_flux, "minmod", [("foextrap",) * 2] * 2)
    wide = np.pad(mask, 1, mode="edge")
    fx *= wide[1:, 1:-1] & wide[:-1, 1:-1]
    fy *= wide[1:-1, 1:] & wide[1:-1, :-1]
    want = (-np.diff(fx, axis=1) / 0.1 - np.diff(fy, axis=2) / 0.2) * mask
    assert np.allclose(_got(plan, spark, list(v)), want)


def _way(here, there):
    return np.where(there < 0, 1.0, np.clip(here / (here - there), 1e-3, 1))


@pytest.mark.parametrize("least", [1e-2, 0.6])
def test_cut_cells(spark, least):
    g = Geometry(*SHAPE)
    v = _gas(10)
    x, y = (np.arange(SHAPE[0]) + 0.5)[:, None] * g.dx, (np.arange(SHAPE[1]) + 0.5)[None, :] * g.dy

    def level(a, b):
        return (a - 0.45) ** 2 + (b - 0.55) ** 2 - 0.13

    at = level(x, y)
    ways = [_way(at, level(x + a * g.dx, y + b * g.dy)) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    kappa = (ways[0] + ways[1]) / 2 * (ways[2] + ways[3]) / 2
    inside = at < 0
    assert 0 < kappa[inside].min() < 0.6 and kappa[inside].max() == 1
    fx, fy = _faces(np.stack(list(v.values())), _gas_flux, "none", [("foextrap",) * 2] * 2)
    wide = np.pad(inside, 1, mode="edge")
    fx *= wide[1:, 1:-1] & wide[:-1, 1:-1]
    fy *= wide[1:-1, 1:] & wide[1:-1, :-1]
    want = (-np.diff(fx, axis=1) / g.dx - np.diff(fy, axis=2) / g.dy) / np.maximum(kappa, least) * inside
    plan = fv.rhs_cut_cells(Given(fields.from_array(spark, v)), physics.Euler(), SHAPE, g.dx, g.dy, cells.disc(0.45, 0.55, 0.13), geometry=g, least=least)
    assert np.allclose(_got(plan, spark, list(v)), want)
    df = plan.frame(spark, "")
    assert np.allclose(fields.to_array(df, ["vol"], SHAPE)["vol"], np.where(inside, np.maximum(kappa, least), 0))


def test_crossings_keep_away_from_the_cell():
    for here, there, want in ((-1e-9, 1.0, 1e-3), (-1.0, 3.0, 0.25), (-1.0, 0.0, 1.0), (-1.0, -2.0, 1.0)):
        assert stencil.cut_distance(const(here), const(there)).evaluate({}) == pytest.approx(want)


def test_the_closure_of_order_four_is_the_gaussian_one():
    s = {k: const(0.3 if k == (1, 1) else 1.0) for k in moments.indices(4)}
    a, b = moments.hyqmom15_closure()(s), moments.gaussian_closure(4)(s)
    assert {k: e.evaluate({}) for k, e in a.items()} == {k: e.evaluate({}) for k, e in b.items()}
    with pytest.raises(ValueError):
        moments.hyqmom15_closure("other")


def test_long_lines_with_copied_edges(spark):
    """The edge of a line is found once, so time grows with its length alone."""
    import time

    from pyspark.sql import functions as F

    took = []
    for n in (10_000, 80_000):
        line = spark.range(n).select(F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.col("id").cast("double").alias("u"))
        began = time.perf_counter()
        last = Given(line).shift(["u"], {"p2": (2, 0)}, (n, 1), "foextrap").frame(spark, "").agg(F.sum("u_p2")).first()[0]
        took.append(time.perf_counter() - began)
        assert last == sum(min(k + 2, n - 1) for k in range(n))
    assert took[1] < 5


def test_one_shuffle_a_stage(spark):
    from fieldloom.plans import time as tm

    u = Given(fields.from_array(spark, {"u": np.ones((8, 8))}))
    step = tm.ssprk3(u, lambda x: fv.rhs(x, physics.Advection(1.0, 0.5), (8, 8), 0.1, 0.1, limiter="minmod"), ["u"], 0.01)
    plan = step.frame(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
