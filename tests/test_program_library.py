"""Step programs over field plans, against NumPy."""

import numpy as np
import pytest

from fieldloom.functions import physics
from fieldloom.functions.expr import var
from fieldloom.operators import elliptic, lines
from fieldloom.plans.library import Block, Library
from fieldloom.plans.program import Machine, Program, optimize, report
from fieldloom.plans.relation import Given
from fieldloom.sources import fields
from fieldloom.streaming.schedule import every

S = (4, 4)
H = (0.25, 0.25)


def _given(spark, **v):
    return Given(fields.from_array(spark, v))


def _arr(spark, x, c):
    return fields.to_array(x.frame(spark, ""), [c], S)[c]


def _rng(names, seed=1, low=1.0):
    rng = np.random.default_rng(seed)
    return {n: rng.uniform(low, low + 1, S) for n in names}


def _upwind(u, a=(1.0, 0.5)):
    return sum(-w * (u - np.roll(u, 1, k)) / 0.25 for k, w in enumerate(a))


def _scalar(spark, **more):
    decay = lambda u, aux: [u[0] * -2.0]
    block = Block(physics.Advection(1.0, 0.5), sources={"decay": decay}, linear={"relax": lambda aux: [[-3.0]]}, **more)
    return Library(spark, S, H, {"u": block})


def test_rates_sources_and_local_solves(spark):
    lib, v = _scalar(spark), _rng("u")
    p = Program(operators={"transport": "grid_operator", "decay": "local_source", "relax": "local_linear_operator"})
    u = p.state("u")
    r = p.call("transport", u)
    both = p.rhs(u, True, ("decay",))
    s = p.call("decay", u)
    lu = p.call("relax", u)
    p.commit("a", p.linear_combine([(1.0, u), (0.1, r), (0.1, s)]))
    p.commit("b", p.linear_combine([(1.0, u), (0.1, both)]))
    p.commit("c", p.solve_local_linear("relax", u, 0.5))
    p.commit("d", p.linear_combine([(1.0, lu)]))
    p.commit("e", p.rhs(u, False, ("decay",)))
    with pytest.raises(KeyError):
        p.call("unknown", u)
    out = lib.machine({"u": _given(spark, **v)}).execute(p, 0.1)
    want = v["u"] + 0.1 * (_upwind(v["u"]) - 2 * v["u"])
    assert np.allclose(_arr(spark, out["a"], "u"), want) and np.allclose(_arr(spark, out["b"], "u"), want)
    assert np.allclose(_arr(spark, out["c"], "u"), v["u"] / 2.5) and np.allclose(_arr(spark, out["d"], "u"), -3 * v["u"])
    assert np.allclose(_arr(spark, out["e"], "u"), -2 * v["u"])


def test_newton_in_cells(spark):
    lib, v = _scalar(spark), _rng("u")
    p = Program()
    u = p.state("u")
    p.commit("u", p.solve_local_nonlinear(lambda x, old: x + 0.5 * x**3 - old, u, u))
    got = _arr(spark, lib.machine({"u": _given(spark, **v)}).execute(p)["u"], "u")
    assert np.allclose(got + 0.5 * got**3, v["u"])
    q = Program()
    q.commit("u", q.solve_local_nonlinear(lambda x: x * x + 1.0, q.state("u"), steps=3))
    with pytest.raises(Exception, match="Newton"):
        lib.machine({"u": _given(spark, **v)}).execute(q)


def test_scalars_masks_and_time_steps(spark):
    lib, v = _scalar(spark), _rng("u")
    p = Program()
    u = p.state("u")
    for kind in ("norm2", "norm_inf", "sum", "max", "min"):
        p.record_scalar(kind, p.reduce(u, kind))
    p.record_scalar("dot", p.reduce(u, "dot", p.rhs(u)))
    p.record_scalar("h", p.hmin())
    p.record_scalar("speed", p.max_wave_speed(u))
    dt = p.cfl(u, 0.4)
    p.record_scalar("dt", dt)
    p.commit("u", p.where(p.cell_compare(u, "gt", 1.5), p.linear_combine([(1.0, u), (dt, p.rhs(u))]), u))
    m = lib.machine({"u": _given(spark, **v)})
    out = m.execute(optimize(p))
    x, got = v["u"], {n: s for _, n, s in m.records}
    want = {"norm2": np.sqrt((x**2).sum()), "norm_inf": x.max(), "sum": x.sum(), "max": x.max(), "min": x.min(), "dot": (x * _upwind(x)).sum(), "h": 0.25, "speed": 1.0, "dt": 0.1}
    assert got == pytest.approx(want)
    assert np.allclose(_arr(spark, out["u"], "u"), np.where(x > 1.5, x + 0.1 * _upwind(x), x))


def test_matrix_free_solve(spark):
    """(2 - Laplacian) x = u, the 2 being a scalar from outside the operator."""
    lib, v = _scalar(spark), _rng("u")
    p = Program()
    u = p.state("u")
    two = p.scalar_op("add", 1.0, 1.0)
    body = p.inside()
    x = body.apply_in()
    body.apply_out(body.linear_combine([(two, x), (-1.0, body.laplacian(x))]))
    for method in ("cg", "bicgstab", "gmres"):
        p.commit(method, p.solve_linear(p.matrix_free_operator(body), u, method, tolerance=1e-9, max_iter=60))
    out = lib.machine({"u": _given(spark, **v)}).execute(optimize(p))
    for method in ("cg", "bicgstab", "gmres"):
        x = _arr(spark, out[method], "u")
        assert np.allclose(2 * x - elliptic.laplace(x, 0.25), v["u"], atol=1e-7)
    with pytest.raises(ValueError):
        p.matrix_free_operator(p.inside())


def test_implicit_flux_by_jacobian_products(spark):
    """Backward Euler of the transport: (1 - dt J) du = dt R(u)."""
    lib, v = _scalar(spark), _rng("u")
    p, dt = Program(), 0.2
    u = p.state("u")
    body = p.inside()
    x = body.apply_in()
    body.apply_out(body.linear_combine([(1.0, x), (-dt, body.rhs_jacvec(u, x))]))
    du = p.solve_linear(p.matrix_free_operator(body), p.linear_combine([(dt, p.rhs(u))]), "gmres", tolerance=1e-8, max_iter=80)
    p.commit("u", p.linear_combine([(1.0, u), (1.0, du)]))
    new = _arr(spark, lib.machine({"u": _given(spark, **v)}).execute(p)["u"], "u")
    assert np.allclose(new - dt * _upwind(new), v["u"], atol=1e-5)
    with pytest.raises(ValueError):
        Program().rhs_jacvec(u, u)


def test_condensed_source_stage(spark):
    """One stage against the coupled implicit system, solved densely."""
    gas, th, alpha = physics.Euler(), 0.05, 4.0
    v = _rng(["rho", "mx", "my"]) | {"e": np.full(S, 9.0)}
    phi0, bz = np.random.default_rng(3).normal(size=S), np.random.default_rng(4).uniform(1, 2, S)
    lib = Library(spark, S, H, {"gas": Block(gas)}, aux=_given(spark, b_z=bz))
    p = Program()
    u, phi = p.state("gas"), p.state("phi")
    tensor = p.schur_coeffs(u, th * th * alpha, th)
    body = p.inside()
    x = body.apply_in()
    body.apply_out(body.linear_combine([(-1.0, body.apply_laplacian_coeff(x, tensor))]))
    solved = p.solve_linear(p.matrix_free_operator(body), p.schur_rhs(phi, u, th, th * alpha), "bicgstab", tolerance=1e-10, max_iter=200)
    moved = p.schur_reconstruct(u, solved, th)
    p.commit("gas", p.schur_energy(moved, u))
    p.commit("phi", solved)
    out = lib.machine({"gas": _given(spark, **v), "phi": _given(spark, x=phi0)}).execute(optimize(p))

    w = th * bz
    inv = np.array([[np.ones(S), w], [-w, np.ones(S)]]) / (1 + w * w)
    k = th * th * alpha * v["rho"]

    def d(a, axis):
        return (np.roll(a, -1, axis) - np.roll(a, 1, axis)) / 0.5

    def face(a, axis):
        b = np.roll(a, -1, axis)
        return 2 * a * b / (a + b)

    ex, ey, xy, yx = 1 + k * inv[0, 0], 1 + k * inv[1, 1], k * inv[0, 1], k * inv[1, 0]

    def operator(f):
        total = np.zeros(S)
        for axis, eps in ((0, ex), (1, ey)):
            up = face(eps, axis) * (np.roll(f, -1, axis) - f) / 0.25
            total += (up - np.roll(up, 1, axis)) / 0.25
        return -(total + d(xy * d(f, 1), 0) + d(yx * d(f, 0), 1))

    dense = np.stack([operator(e.reshape(S)).ravel() for e in np.eye(S[0] * S[1])], axis=1)
    f = np.einsum("abij,bij->aij", inv, np.stack([v["mx"], v["my"]]))
    rhs = -elliptic.laplace(phi0, 0.25) - th * alpha * (d(f[0], 0) + d(f[1], 1))
    want = np.linalg.lstsq(dense, rhs.ravel(), rcond=None)[0].reshape(S)
    got = _arr(spark, out["phi"], "x")
    assert np.allclose(got - got.mean(), want - want.mean(), atol=1e-6)
    g = np.stack([v["mx"] - v["rho"] * th * d(want, 0), v["my"] - v["rho"] * th * d(want, 1)])
    m = np.einsum("abij,bij->aij", inv, g)
    assert np.allclose(_arr(spark, out["gas"], "mx"), m[0], atol=1e-6) and np.allclose(_arr(spark, out["gas"], "my"), m[1], atol=1e-6)
    energy = v["e"] + ((m**2).sum(0) - v["mx"] ** 2 - v["my"] ** 2) / v["rho"] / 2
    assert np.allclose(_arr(spark, out["gas"], "e"), energy, atol=1e-6)


def test_fields_from_blocks_and_couplings(spark):
    drift = physics.ExBVelocity(2.0)
    ions = physics.Advection(0.5, 0.0)
    v = _rng(["n", "u"])

    def solver(f):
        return Given(lines.poisson(f.frame(spark, ""), "f", S, H))

    blocks = {"electrons": Block(drift, aux=("grad_x", "grad_y"), elliptic=lambda s: s[0] * -1.0), "ions": Block(ions, elliptic=lambda s: s[0])}
    lib = Library(spark, S, H, blocks, solver=solver, couplings={"exchange": lambda x: {"electrons": {"n": x["ions"]["u"] - x["electrons"]["n"]}, "ions": {"u": x["electrons"]["n"] - x["ions"]["u"]}}})
    p = Program(operators={"exchange": "coupled_rate", "poisson": "field_operator"})
    e, i = p.state("electrons"), p.state("ions")
    both = p.solve_fields(e, i)
    p.commit("phi", p.component(p.solve_fields_from_blocks({"electrons": e}), "phi"))
    rates = p.call("exchange", {"electrons": e, "ions": i})
    p.commit("electrons", p.linear_combine([(1.0, e), (0.1, p.rhs(e, fields=both)), (0.1, p.coupled_rate_out(rates, "electrons"))]))
    p.commit("ions", p.linear_combine([(1.0, i), (0.1, p.coupled_rate_out(rates, "ions"))]))
    m = lib.machine({"electrons": _given(spark, n=v["n"]), "ions": _given(spark, u=v["u"])})
    out = m.execute(optimize(p))
    phi = elliptic.fft_poisson(v["u"] - v["n"], 0.25)
    assert np.allclose(_arr(spark, out["phi"], "x"), phi, atol=1e-9)
    gx, gy = ((np.roll(phi, -1, k) - np.roll(phi, 1, k)) / 0.5 for k in (0, 1))
    rate = np.zeros(S)
    for k, vel in ((0, -gy / 2), (1, gx / 2)):
        l, r, a, b = v["n"], np.roll(v["n"], -1, k), vel, np.roll(vel, -1, k)
        flux = (l * a + r * b) / 2 - np.maximum(abs(a), abs(b)) / 2 * (r - l)
        rate -= (flux - np.roll(flux, 1, k)) / 0.25
    assert np.allclose(_arr(spark, out["electrons"], "n"), v["n"] + 0.1 * (rate + v["u"] - v["n"]))
    assert np.allclose(_arr(spark, out["ions"], "u"), v["u"] + 0.1 * (v["n"] - v["u"]))


def test_loops_read_outer_values(spark):
    lib, v = _scalar(spark), _rng("u")
    p = Program()
    u = p.state("u")
    half = p.scalar_op("div", 1.0, 2.0)
    test, body = p.inside(), p.inside()
    test.compare("gt", test.reduce(test.state("u"), "max"), 0.6)
    body.commit("u", body.linear_combine([(half, body.state("u"))]))
    p.while_(test, body, 5)
    more = p.inside()
    more.commit("u", more.linear_combine([(1.0, more.state("u")), (1.0, u)]))
    p.range(2, more)
    other, yes = p.inside(), p.inside()
    yes.commit("flag", yes.linear_combine([(half, u)]))
    other.commit("flag", u)
    p.if_(p.compare("lt", p.reduce(u, "max"), 100.0), yes, other)
    q = optimize(p)
    assert report(q)["operations"]["scalar_op"] == 1 and q.hash() == optimize(p).hash()
    out = lib.machine({"u": _given(spark, **v)}).execute(q)
    x = v["u"].copy()
    while x.max() > 0.6:
        x = x / 2
    assert np.allclose(_arr(spark, out["u"], "u"), x + 2 * v["u"]) and np.allclose(_arr(spark, out["flag"], "u"), v["u"] / 2)
    endless = Program()
    t, b = endless.inside(), endless.inside()
    t.compare("gt", 1.0, 0.0)
    b.state("u")
    endless.while_(t, b, 3)
    with pytest.raises(RuntimeError, match="still holds"):
        lib.machine({"u": _given(spark, **v)}).execute(endless)


def test_schedules_in_programs():
    p = Program()
    u = p.state("u")
    body = p.inside()
    body.reduce(u, "sum")
    p.record_scalar("held", p.scheduled("sum", every(2), body))
    p.commit("u", p.linear_combine([(2.0, u)]))
    m = Machine({"reduce": lambda x, kind: float(x), "linear_combine": lambda terms: sum(c * x for c, x in terms)}, {"u": 1.0})
    for _ in range(4):
        m.execute(p, 0.5)
    assert [s for _, _, s in m.records] == [1.0, 1.0, 4.0, 4.0] and m.t == 2.0
    with pytest.raises(ValueError):
        p.scheduled("none", every(2), p.inside())


def test_what_has_no_meaning_is_an_error():
    p = Program()
    p.commit("u", p.project(p.state("u")))
    with pytest.raises(NotImplementedError):
        Machine({}, {"u": 1.0}).execute(p)
    q = Program()
    with pytest.raises(TypeError):
        q.divergence(q.state("u"))
    with pytest.raises(ValueError):
        q.reduce(q.state("u"), "median")
    inner = q.inside()
    stray = inner.state("u")
    q.values.append(stray)
    with pytest.raises(TypeError):
        q.linear_combine([(q.state("u"), q.state("u"))])
    assert var("x").key()
