"""Models written as equations, macros, and the ring's tensor operator."""

import numpy as np
import pytest

from fieldloom.functions import physics
from fieldloom.functions.expr import abs_, const, var
from fieldloom.functions.expr import sqrt as root
from fieldloom.operators import elliptic, fv, lines, polar
from fieldloom.operators.grid import PolarGeometry
from fieldloom.plans import macros
from fieldloom.plans.library import Block, Library
from fieldloom.plans.model import Model, Module, ddt, div, dx, dy, grad, integral, laplacian, left, rewritten, right
from fieldloom.plans.program import Program, optimize
from fieldloom.plans.relation import Given
from fieldloom.sources import fields

S, H = (4, 4), (0.25, 0.25)


def _given(spark, **v):
    return Given(fields.from_array(spark, v))


def _arr(spark, x, c, shape=S):
    return fields.to_array(x.frame(spark, ""), [c], shape)[c]


def _gas_board():
    m = Model("gas")
    u = m.state("U", ("rho", "mx", "my", "e"), ("Density", "MomentumX", "MomentumY", "Energy"))
    gamma = m.param("gamma", 1.4)
    vx, vy = m.primitive("vx", u["mx"] / u["rho"]), m.primitive("vy", u["my"] / u["rho"])
    p = m.primitive("p", (u["e"] - (u["mx"] * vx + u["my"] * vy) * 0.5) * (gamma - 1.0))
    c = m.primitive("c", root(gamma * p / u["rho"]))
    phi = m.field("phi")
    f = m.flux("F", u, [u["mx"], u["mx"] * vx + p, u["my"] * vx, (u["e"] + p) * vx], [u["my"], u["mx"] * vy, u["my"] * vy + p, (u["e"] + p) * vy], waves=((vx - c, vx + c), (vy - c, vy + c)))
    s = m.source("pull", u, [const(0.0), -u["rho"] * dx(phi), -u["rho"] * dy(phi), -(u["mx"] * dx(phi) + u["my"] * dy(phi))])
    m.solve_field("poisson", laplacian(phi) == u["rho"] - 1.0)
    m.rate("advance", ddt(u) == -div(f) + s)
    m.invariant("mass", integral(u["rho"]))
    return m


def test_a_board_gives_the_brick_of_its_equations(spark):
    rng = np.random.default_rng(1)
    v = {"rho": rng.uniform(1, 2, S), "mx": rng.uniform(-0.3, 0.3, S), "my": rng.uniform(-0.3, 0.3, S), "e": rng.uniform(4, 5, S)}
    f = _given(spark, **v)
    m = _gas_board()
    assert m.check() == [] and "rate advance: U" in m.inspect() and list(m.invariants) == ["mass"]
    block = m.finite_volume("advance", "minmod", "hll")
    assert block.aux == ("grad_x", "grad_y") and set(block.sources) == {"pull"}
    for gamma in (1.4, 1.6):
        m.module.parameters.set(gamma=gamma)  # the same model, another value
        a = fv.rhs(f, block.model, S, *H, **block.scheme)
        b = fv.rhs(f, physics.Euler(gamma), S, *H, limiter="minmod", riemann="hll")
        for c in v:
            assert np.allclose(_arr(spark, a, f"r_{c}"), _arr(spark, b, f"r_{c}"))
    with pytest.raises(KeyError):
        m.module.parameters.set(other=1.0)


def test_a_board_runs_as_a_program(spark):
    m = _gas_board()
    rng = np.random.default_rng(2)
    v = {"rho": rng.uniform(1, 2, S), "mx": rng.uniform(-0.3, 0.3, S), "my": rng.uniform(-0.3, 0.3, S), "e": rng.uniform(4, 5, S)}
    problem = m.field_problems["poisson"]
    block = m.finite_volume("advance", elliptic=lambda u: rewritten(problem.rhs, lambda e: u[0] if e.key() == var("rho").key() else None))
    lib = Library(spark, S, H, {"U": block}, solver=lambda f: Given(lines.poisson(f.frame(spark, ""), "f", S, H)))
    p = m.module.program()
    u = p.state("U")
    done = p.call("poisson", u)
    p.commit("U", p.linear_combine([(1.0, u), (0.01, p.call("advance", u, done)), (0.01, p.call("pull", u, done))]))
    out = lib.machine({"U": _given(spark, **v)}).execute(optimize(p))["U"]
    phi = elliptic.fft_poisson(v["rho"] - 1.0, 0.25)
    gx = (np.roll(phi, -1, 0) - np.roll(phi, 1, 0)) / 0.5
    plain = fv.rhs(_given(spark, **v), physics.Euler(), S, *H)
    assert np.allclose(_arr(spark, out, "mx"), v["mx"] + 0.01 * (_arr(spark, plain, "r_mx") - v["rho"] * gx))


def test_equations_that_do_not_hold_are_errors():
    m = Model("m")
    u, w = m.state("U", ("a",)), m.state("W", ("b",))
    phi = m.field()
    f = m.flux("F", u, [u["a"]], [u["a"]])
    s = m.source("S", w, [w["b"]])
    for wrong in (ddt(u) == -div(f) + s, ddt(u) == div(f), div(f) == ddt(u), ddt(u) == -div(f) - div(f)):
        with pytest.raises(ValueError):
            m.rate("r", wrong)
    with pytest.raises(ValueError):
        m.solve_field("p", laplacian(phi) + laplacian(phi) == u["a"])
    with pytest.raises(KeyError):
        u["c"]
    with pytest.raises(ValueError):
        m.flux("G", u, [u["a"], u["a"]], [u["a"]])
    m.rate("r", ddt(u) == -div(f))
    assert m.check() == ["r: the flux has no wave speeds"]
    m.flux("K", u, [u["a"] * var("unheard")], [u["a"]], waves=((1.0, 1.0), (1.0, 1.0)))
    m.rate("k", ddt(u) == -div(m.fluxes["K"]))
    with pytest.raises(KeyError, match="unheard"):
        m.finite_volume("k")


def test_field_equations():
    m = Model("m")
    u, phi = m.state("U", ("n",)), m.field()
    p = m.solve_field("screened", laplacian(phi) - 3.0 * phi == u["n"])
    assert [type(t).__name__ for t in p.terms] == ["Laplacian", "Reaction"] and p.terms[1].kappa == 3.0
    q = m.solve_field("minus", 3.0 * phi - laplacian(phi) == -u["n"])
    assert q.terms[1].kappa == 3.0 and q.rhs.evaluate({"n": 2.0}) == 2.0
    a = m.solve_field("varying", div(grad(phi, ("ex", "ey"))) == u["n"])
    assert (a.terms[0].eps_x, a.terms[0].eps_y) == ("ex", "ey")


def test_modules_register_typed_operators():
    m = Module("m")
    m.state_space("U", ("a", "b"))
    k = m.param("k", 2.0)

    @m.operator(kind="local_source", inputs=("U",), output="U", requires=("b_z",), capabilities=("stiff",))
    def relax(u, aux):
        return [-u[0] * k, -u[1] * k]

    m.rate_operator("transport")
    assert m.list_operators() == ["relax", "transport"] and m.signature_of("relax") == "(U) -> U" and m.requirements_of("relax") == ("b_z",) and m.capabilities_of("relax") == ("stiff",)
    assert relax([const(1.0), const(2.0)], {})[1].evaluate({}) == -4.0
    before = m.hash()
    m.parameters.set(k=5.0)
    assert m.hash() == before and relax([const(1.0), const(2.0)], {})[0].evaluate({}) == -5.0
    m.aux_field("b_z")
    assert m.hash() != before
    for wrong in (lambda: m.operator("x", "unknown"), lambda: m.operator("x", inputs=("V",)), lambda: m.state_space("U", ("a",)), lambda: m.state_space("V", ("a", "a"))):
        with pytest.raises((ValueError, KeyError)):
            wrong()
    with pytest.raises(KeyError):
        m.program().call("unknown")


def test_fluxes_between_two_states(spark):
    """A flux of one's own from both sides is the built-in one."""
    m = Model("m")
    u = m.state("U", ("u",))
    m.flux("F", u, [u["u"]], [u["u"] * 0.5], waves=((1.0, 1.0), (0.5, 0.5)))
    m.rate("r", ddt(u) == -div(m.fluxes["F"]))
    m.riemann_flux("sides", [[(left("u") + right("u")) * 0.5 - (right("u") - left("u")) * 0.5], [(left("u") + right("u")) * 0.25 - (right("u") - left("u")) * 0.25]])
    v = {"u": np.random.default_rng(3).uniform(1, 2, S)}
    a = fv.rhs(_given(spark, **v), m.finite_volume("r", riemann="sides").model, S, *H, riemann="sides")
    b = fv.rhs(_given(spark, **v), physics.Advection(1.0, 0.5), S, *H)
    assert np.allclose(_arr(spark, a, "r_u"), _arr(spark, b, "r_u"))
    with pytest.raises(ValueError):
        left("u").column()


def test_coupled_rates_preserve():
    m = Model("m")
    a, b = m.species("A", ("n",)), m.species("B", ("n",))
    k = m.param("k", 0.5)
    r = (var("A.n") - var("B.n")) * k
    m.coupled_rate("swap", {"A": a, "B": b}, {"A": {"n": -r}, "B": {"n": r}}, preserves=("n",))
    got = m.couplings["swap"]({"A": {"n": const(4.0)}, "B": {"n": const(1.0)}})
    assert got["A"]["n"].evaluate({}) == -1.5 and got["B"]["n"].evaluate({}) == 1.5
    with pytest.raises(ValueError, match="preserve"):
        m.coupled_rate("leak", {"A": a, "B": b}, {"A": {"n": -r}, "B": {"n": r * 2.0}}, preserves=("n",))


# macros


def _lib(spark):
    block = Block(physics.Advection(1.0, 0.5), linear={"relax": lambda aux: [[-3.0]]}, sources={"push": lambda u, aux: [u[0] * 0.0 + 1.0]})
    return Library(spark, S, H, {"u": block})


def _up(u):
    return sum(-w * (u - np.roll(u, 1, k)) / 0.25 for k, w in enumerate((1.0, 0.5)))


def _run(spark, record, steps=1, seed=4):
    v = np.random.default_rng(seed).uniform(1, 2, S)
    m = _lib(spark).machine({"u": _given(spark, u=v)})
    p = Program(operators={"transport": "grid_operator", "relax": "local_linear_operator"})
    record(p)
    for _ in range(steps):
        out = m.execute(optimize(p), 0.1)
    return v, _arr(spark, out["u"], "u"), m


def test_explicit_macros(spark):
    dt = 0.05
    u, got, _ = _run(spark, lambda p: macros.forward_euler(p, "u", dt, sources=("push",)))
    assert np.allclose(got, u + dt * (_up(u) + 1))
    u, got, _ = _run(spark, lambda p: macros.rk4(p, "u", dt))
    a = _up(u)
    b = _up(u + dt / 2 * a)
    c = _up(u + dt / 2 * b)
    assert np.allclose(got, u + dt / 6 * (a + 2 * b + 2 * c + _up(u + dt * c)))
    u, got, _ = _run(spark, lambda p: macros.ssprk(p, "u", dt, 2))
    one = u + dt * _up(u)
    assert np.allclose(got, (u + one + dt * _up(one)) / 2)
    u, got, _ = _run(spark, lambda p: macros.ssprk(p, "u", dt, 3))
    two = 0.75 * u + 0.25 * (one + dt * _up(one))
    assert np.allclose(got, u / 3 + 2 / 3 * (two + dt * _up(two)))


def test_macros_with_memory(spark):
    dt = 0.05
    u, got, _ = _run(spark, lambda p: macros.adams_bashforth(p, "u", dt, 2), 2)
    one = u + dt * _up(u)
    assert np.allclose(got, one + dt * (1.5 * _up(one) - 0.5 * _up(u)))
    u, got, _ = _run(spark, lambda p: macros.bdf_local_linear(p, "u", dt, 2, "relax", flux=False), 2)
    c = 2 / 3 * dt
    one = u / (1 + 3 * c)  # the history starts full of the first state
    assert np.allclose(got, (4 / 3 * one - u / 3) / (1 + 3 * c))


def test_implicit_macros(spark):
    dt = 0.1
    u, got, _ = _run(spark, lambda p: macros.imex_local(p, "u", dt, "relax", theta=0.5))
    assert np.allclose(got, (u + dt * _up(u)) / (1 + 1.5 * dt))
    u, got, _ = _run(spark, lambda p: macros.imex_local_linear(p, "u", dt, "transport", "relax"))
    assert np.allclose(got, (u + dt * _up(u)) / (1 + 3 * dt))
    u, got, _ = _run(spark, lambda p: macros.predictor_corrector_local_linear(p, "u", dt, "transport", "relax"))
    star = (u + dt * _up(u)) / (1 + 3 * dt)
    assert np.allclose(got, (u + dt / 2 * (_up(u) + _up(star) - 3 * star)) / (1 + 1.5 * dt))
    u, got, m = _run(spark, lambda p: macros.bdf_implicit_flux(p, "u", 0.02, 1, newton=1, tolerance=1e-4))
    assert np.allclose(got - 0.02 * _up(got), u, atol=1e-3) and m.records[0][1] == "u.bdf_residual" and m.records[0][2] < 1e-3
    for wrong in (lambda p: macros.imex_local(p, "u", dt, "relax", theta=0.0), lambda p: macros.bdf_local_linear(p, "u", dt, 3, "relax")):
        with pytest.raises(ValueError):
            wrong(Program())


# rings


def _ring(seed=5):
    g = PolarGeometry(5, 6, 0.5, 1.4)
    rng = np.random.default_rng(seed)
    v = {"a_rr": rng.uniform(2, 3, (5, 6)), "a_tt": rng.uniform(2, 3, (5, 6)), "a_rt": rng.uniform(-0.4, 0.4, (5, 6)), "a_tr": rng.uniform(-0.4, 0.4, (5, 6))}
    return g, v


def _plain_ring(g, v, phi, sign):
    """Face by face, with ghosts of ``sign`` times the end cells."""
    def ghost(a, s=1.0):
        a = np.concatenate([s * a[:1], a, s * a[-1:]])
        return np.concatenate([a[:, -1:], a, a[:, :1]], axis=1)

    p, (rr, tt, rt, tr) = ghost(phi, sign), (ghost(v[k]) for k in polar.TENSOR)
    out = np.zeros_like(phi)
    for i in range(g.nr):
        for j in range(g.nt):
            r, a, b = g.r0 + (i + 0.5) * g.dr, i + 1, j + 1
            for s in (1, -1):
                face = r + s * g.dr / 2
                out[i, j] += face * (rr[a, b] + rr[a + s, b]) / 2 * (p[a + s, b] - p[a, b]) / (r * g.dr**2)
                around = (p[a, b + 1] + p[a + s, b + 1] - p[a, b - 1] - p[a + s, b - 1]) / (4 * g.dt)
                out[i, j] += s * (rt[a, b] + rt[a + s, b]) / 2 * around / (r * g.dr)
                out[i, j] += (tt[a, b] + tt[a, b + s]) / 2 * (p[a, b + s] - p[a, b]) / (r * g.dt) ** 2
                along = (p[a + 1, b] + p[a + 1, b + s] - p[a - 1, b] - p[a - 1, b + s]) / (4 * g.dr)
                out[i, j] += s * (tr[a, b] + tr[a, b + s]) / 2 * along / (r * g.dt)
    return out


@pytest.mark.parametrize("bc, sign", [(("dirichlet", 0.0), -1.0), ("foextrap", 1.0)])
def test_ring_tensor_operator(spark, bc, sign):
    g, v = _ring()
    phi = np.random.default_rng(6).normal(size=(5, 6))
    got = _arr(spark, polar.tensor_operator(_given(spark, phi=phi, **v), "phi", g, bc), "value", (5, 6))
    assert np.allclose(got, _plain_ring(g, v, phi, sign))


@pytest.mark.parametrize("kind", ["jacobi", "radial_line"])
def test_ring_tensor_solve(spark, kind):
    g, v = _ring()
    f = np.random.default_rng(7).normal(size=(5, 6))
    done = polar.tensor_krylov(fields.from_array(spark, v), fields.from_array(spark, {"f": f}), "f", g, precondition=kind, tolerance=1e-8)
    x = fields.to_array(done.field, ["x"], (5, 6))["x"]
    assert np.allclose(_plain_ring(g, v, x, -1.0), f, atol=1e-5) and done.iterations < (12 if kind == "radial_line" else 25)
    with pytest.raises(ValueError):
        polar.preconditioner("unknown", fields.from_array(spark, v), g)
