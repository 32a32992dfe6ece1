"""Named queries over the test tables: one plan each, and its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import moments as mo
from fieldloom.functions import physics as ph
from fieldloom.functions.expr import Expr, abs_, const, diff, floor, maximum, minimum, safe_div, sign, smooth_floor, sqrt, var, where
from fieldloom.functions.linalg import eig2, lorentz_inverse, solve2
from fieldloom.operators import amr, cells, coupling, elliptic, fv, grid, halo, lines, multigrid, polar, problems, reduce, stencil
from fieldloom.operators.grid import Box, Geometry, PolarGeometry
from fieldloom.plans import time as tm
from fieldloom.plans.relation import Edges, Given, Plan, raw, rounded

N = 32
SHAPE = (N, N)
H = 1.0 / N
GAS = ph.Euler(1.4)
WIND = ph.Advection(1.0, 0.5)
COLD = ph.Isothermal(2.0)


def _round(plan: Plan, digits: int = 6) -> Plan:
    """All columns but the indices rounded, for comparison between engines."""
    whole = {"i", "j", "step", "box_id", "n", "rank", "z"}
    return plan.select(**{c: var(c) if c in whole else rounded(c, digits) for c in plan.columns})


def _gas(n: int = N) -> Plan:
    return grid.euler_state(n)


def _u(n: int = N) -> Plan:
    return grid.density(n)


def _disc(n: int = N) -> Expr:
    return cells.disc_level(Geometry(n, n), 0.5, 0.5, 0.16)


def _advect(x: Plan) -> Plan:
    return fv.rhs(x, WIND, SHAPE, H, H, limiter="minmod", viscosity=0.001)


def _slim_rate(x: Plan) -> Plan:
    return fv.rhs(x, WIND, SHAPE, H, H)


def _slopes(limiter: Callable[[Expr, Expr], Expr]) -> Plan:
    x = stencil.neighbours(_u(), ["u"], SHAPE)
    return x.select("i", "j", sx=limiter(var("u") - var("u_xm"), var("u_xp") - var("u")), sy=limiter(var("u") - var("u_ym"), var("u_yp") - var("u")))


def _faces(limiter: str, primitive: bool = False, floor_: float | None = None) -> Plan:
    x = _gas().shift(GAS.names, {"m2": (-2, 0), "m1": (-1, 0), "p1": (1, 0), "p2": (2, 0), "p3": (3, 0)}, SHAPE)
    left, right = fv.face_states(GAS, limiter, primitive, floor_)
    return x.select("i", "j", **{f"l_{c}": e for c, e in zip(GAS.names, left)}, **{f"r_{c}": e for c, e in zip(GAS.names, right)})


def _flux(riemann: str, limiter: str = "none") -> Plan:
    x = fv.face_fluxes(_gas(), GAS, SHAPE, limiter, riemann)
    return x.select("i", "j", *[f"f{a}_{c}" for a in "xy" for c in GAS.names])


def _only_rates(plan: Plan) -> Plan:
    return plan.select("i", "j", *[c for c in plan.columns if c.startswith("r_")])


def _aux(x: Plan) -> Plan:
    """A potential with its gradient and a field, from the density."""
    y = x.with_(phi=var("u") / 7.0)
    return stencil.gradient(y, "phi", SHAPE, H, H, divide=True).with_(b_z=var("u") * 0.1 + 1.0)


def _fluid_aux() -> Plan:
    x = _gas().join(_aux(_u()).select("i", "j", "grad_x", "grad_y", "b_z"), ["i", "j"])
    return x


def _blocks() -> Plan:
    return grid.species()


def _two_fluids() -> Plan:
    a = _gas()
    b = _gas().with_(rho=var("rho") * 2.0, mx=var("my"), my=var("mx")).with_(e=var("rho") * 8.0 + var("mx") * var("mx") + var("my") * var("my"))
    return coupling.together({"a": a, "b": b})


def _tags() -> Plan:
    return amr.tags(_u(), amr.above("u", 65.0))


_BOXES = [Box(8, 8, 23, 23), Box(40, 16, 55, 31)]


def _amr_pair() -> tuple[Plan, Plan]:
    """A coarse level and a fine level of two boxes that differs from it."""
    fine = amr.box_cells(_BOXES).join(amr.interpolate(_u(), ["u"]), ["i", "j"]).with_(u=var("u") + raw("cast((i * 3 + j) % 5 as double)", "((i * 3 + j) % 5)::DOUBLE"))
    return _u(), fine


def _reflux() -> Plan:
    coarse = _u().filter(raw("i = 11 AND j >= 4 AND j <= 11")).select("i", "j", f=var("u"))
    fine = amr.interpolate(_u(), ["u"]).filter(raw("i = 23 AND j >= 8 AND j <= 23"))
    both = fine.with_(f=var("u") * 2.0 + raw("cast(j % 3 as double)", "(j % 3)::DOUBLE")).select("i", "j", "f")
    return amr.reflux(coarse, both, "f", 0.01, H)


def _moment_state() -> Plan:
    """Moments of two Gaussians per cell, weights from the counts."""
    x = _gas().select("i", "j", rho=var("rho"), u=var("mx") / var("rho"), v=var("my") / var("rho"), t=const(2.0))
    env = mo.maxwellian(2, var("rho"), var("u"), var("v"), var("t"))
    other = mo.maxwellian(2, var("rho") * 0.5, var("u") * 0.5 + 1.0, var("v") - 1.0, var("t") * 0.5)
    return x.select("i", "j", **{k: env[k] + other[k] for k in env})


def _moment_state4() -> Plan:
    x = _gas().select("i", "j", rho=var("rho"), u=var("mx") / var("rho"), v=var("my") / var("rho"), t=const(2.0))
    env = mo.maxwellian(4, var("rho"), var("u"), var("v"), var("t"))
    other = mo.maxwellian(4, var("rho") * 0.5, var("u") * 0.5 + 1.0, var("v") - 1.0, var("t") * 0.5)
    return x.select("i", "j", **{k: env[k] + other[k] for k in env})


def _steps() -> Plan:
    return grid.daily(8)


def _series() -> Plan:
    """``step, u``: events per day."""
    return _steps().group(["step"], u=("sum", "u")).with_(grp=raw("cast(0 as int)", "0::INTEGER"))


def _stride(k: int = 3) -> Plan:
    """The accumulated input that a block of stride k has taken by each step (window end)."""
    x = _series().running("upto", "sum", "u", ["grp"], ["step"])
    done = x.filter(raw(f"(step + 1) % {k} = 0")).select("grp", last=raw("step"), taken=var("upto"))
    held = x.with_(last=raw(f"cast(((step + 1) div {k}) * {k} - 1 as int)", f"(((step + 1) // {k}) * {k} - 1)::INTEGER"))
    return held.join(done, ["grp", "last"], "left").select("step", due=where(raw(f"(step + 1) % {k} = 0"), 1.0, 0.0), u="u", taken=raw("coalesce(taken, 0D)", "coalesce(taken, 0::DOUBLE)"))


def _hold(k: int = 4) -> Plan:
    """``every(k)`` with policy hold, and with accumulate_dt (dt = 1)."""
    x = _series()
    due = x.select("grp", last=raw("step"), held=var("u"))
    y = x.with_(last=raw(f"cast((step div {k}) * {k} as int)", f"((step // {k}) * {k})::INTEGER"))
    since = raw(f"cast(step % {k} as double)", f"(step % {k})::DOUBLE")
    return y.join(due, ["grp", "last"], "left").select("step", u="u", held=raw("coalesce(held, 0D)", "coalesce(held, 0::DOUBLE)"), accumulated=since, effective=where(raw(f"step % {k} = 0"), float(k), 0.0))


def _schur() -> Plan:
    """Explicit right-hand side and reconstruction of the condensed source stage, and its coefficients."""
    dt, theta, alpha = 0.1, 0.5, 2.0
    x = _fluid_aux().with_(w=var("b_z") * (theta * dt), phi=var("rho") / 9.0)
    inv = lorentz_inverse(var("w"))
    x = x.with_(fx=inv[0][0] * var("mx") + inv[0][1] * var("my"), fy=inv[1][0] * var("mx") + inv[1][1] * var("my"), axx=var("rho") * inv[0][0] * (theta * theta * dt * dt * alpha) + 1.0, axy=var("rho") * inv[0][1] * (theta * theta * dt * dt * alpha))
    x = stencil.divergence(x, "fx", "fy", SHAPE, H, H)
    x = stencil.laplacian(x, "phi", SHAPE, H, H)
    x = x.with_(rhs=-var("lap") - var("div") * (theta * dt * alpha))
    x = stencil.gradient(x.drop("grad_x", "grad_y"), "phi", SHAPE, H, H, divide=True)
    px, py = var("mx") - var("rho") * var("grad_x") * (theta * dt), var("my") - var("rho") * var("grad_y") * (theta * dt)
    return x.select("i", "j", "axx", "axy", "rhs", vx=(inv[0][0] * px + inv[0][1] * py) / var("rho"), vy=(inv[1][0] * px + inv[1][1] * py) / var("rho"))


def _polar(**more) -> Plan:
    g = PolarGeometry(N, N, 0.3, 1.0)
    x = _gas().select("i", "j", "rho", "mx", "my")
    return fv.rhs_polar(x, COLD, SHAPE, g, source=lambda u, r: COLD.polar_geometric_source(u, r), **more)


def _cold_flux(riemann: str) -> Plan:
    x = fv.face_fluxes(_gas().select("i", "j", "rho", "mx", "my"), COLD, SHAPE, "minmod", riemann)
    return x.select("i", "j", *[f"{s}{a}_{c}" for s in "fg" for a in "xy" for c in COLD.names])


def _polar_tensor() -> Plan:
    """The full tensor on a ring, with cross terms."""
    x = grid.counts().select("i", "j", phi="u", a_rr=var("m") + 1.0, a_tt=var("f") + 1.0, a_rt=var("u") * 0.1, a_tr=var("m") * 0.05)
    return polar.tensor_operator(x, "phi", PolarGeometry(N, N, 0.3, 1.0)).select("i", "j", "value")


@lru_cache(maxsize=1)
def _board():
    """Shallow water written down as equations, with a drag."""
    from fieldloom.plans import model as m

    b = m.Model("water")
    u = b.state("U", ("h", "mx", "my"))
    g, k = b.param("g", 9.8), b.param("k", 0.1)
    vx, vy = b.primitive("vx", u["mx"] / u["h"]), b.primitive("vy", u["my"] / u["h"])
    p, c = b.primitive("p", u["h"] * u["h"] * g * 0.5), b.primitive("c", sqrt(u["h"] * g))
    f = b.flux("F", u, [u["mx"], u["mx"] * vx + p, u["my"] * vx], [u["my"], u["mx"] * vy, u["my"] * vy + p], waves=((vx - c, vx + c), (vy - c, vy + c)))
    s = b.source("drag", u, [const(0.0), -u["mx"] * k, -u["my"] * k])
    b.rate("advance", m.ddt(u) == -m.div(f) + s)
    return b.finite_volume("advance", "minmod", "hll", bc="foextrap")


def _board_rate() -> Plan:
    block = _board()
    x = _gas().select("i", "j", h="rho", mx=var("mx"), my=var("my"))
    x = fv.rhs(x, block.model, SHAPE, H, H, bc=block.bc, **block.scheme)
    drag = block.sources["drag"]([var(c) for c in block.model.names], {})
    return x.with_(**{f"r_{c}": var(f"r_{c}") + e for c, e in zip(block.model.names, drag)})


def _jacobian_vector() -> Plan:
    """J v by two residuals, v = m."""
    eps = 1e-3
    x = grid.counts().select("i", "j", "u", "m")
    base = _slim_rate(x).rename(r_u="r0")
    moved = fv.rhs(base.with_(u=var("u") + var("m") * eps), WIND, SHAPE, H, H)
    return moved.select("i", "j", jv=(var("r_u") - var("r0")) / eps)


def _polar_operator() -> Plan:
    """(1/r) d(r a dphi/dr)/dr + (1/r^2) d(b dphi/dtheta)/dtheta on a ring."""
    g = PolarGeometry(N, N, 0.3, 1.0)
    x = grid.counts().select("i", "j", phi="u", a=var("m") + 1.0, b=var("f") + 1.0).shift(["phi", "a", "b"], stencil.CROSS, SHAPE, ("foextrap", "periodic"))
    r, lo, hi = g.r(), g.r_face(0), g.r_face(1)
    up = hi * (var("a") + var("a_xp")) * 0.5 * (var("phi_xp") - var("phi"))
    down = lo * (var("a") + var("a_xm")) * 0.5 * (var("phi") - var("phi_xm"))
    left = (var("b") + var("b_yp")) * 0.5 * (var("phi_yp") - var("phi"))
    right = (var("b") + var("b_ym")) * 0.5 * (var("phi") - var("phi_ym"))
    return x.select("i", "j", value=(up - down) / (r * (g.dr * g.dr)) + (left - right) / (r * r * (g.dt * g.dt)))


def _expr_zoo() -> Plan:
    """Every scalar node over one field, and derivatives of a formula."""
    u, m = var("u"), var("m")
    f = u * u * m / (u + 1.0) + sqrt(u + 1.0) - abs_(m - u)
    return grid.counts().select(
        "i", "j", add=u + m, sub=u - m, mul=u * m, div=safe_div(u, m), power=(u + 1.0) ** 2, neg=-u, root=sqrt(u), absolute=abs_(u - m), signum=sign(u - m),
        floored=smooth_floor(u - 50.0, 1e-3), low=minimum(u, m), high=maximum(u, m), whole=floor(u / 7.0), chosen=where((u > 50.0) & (m >= 60.0), u, m), du=diff(f, "u"), dm=diff(f, "m"),
    )


def _eig() -> Plan:
    u, m, f = var("u"), var("m"), var("f")
    e = eig2([[u, m], [f, u - m]])
    x = solve2([[u + 1.0, m], [f, u + 100.0]], [u, m])
    return grid.counts().select("i", "j", **e, x0=x[0], x1=x[1])


def _coupled() -> Plan:
    s = coupling.CoupledSource().pair("n_a", "n_b", var("n_a") * var("n_c") * 0.01).add("n_c", -var("n_c") * 0.1)
    return s.step(_blocks(), 0.5)


def _sfc() -> Plan:
    """Boxes of 4 x 4 cells, weighted by their sum, in eight contiguous segments of the Z curve."""
    boxes = amr.average_down(_u(), ["u"], 4).with_(u=var("u") * 16.0)
    x = boxes.select("i", "j", "u", z=amr.morton(4), grp=raw("cast(0 as int)", "0::INTEGER"))
    total = boxes.group([], total=("sum", "u")).with_(grp=raw("cast(0 as int)", "0::INTEGER"))
    y = x.running("upto", "sum", "u", ["grp"], ["z"]).join(total, ["grp"])
    share = "floor((upto - u) * 8 / total)"
    return y.select("i", "j", "z", "u", rank=raw(f"cast(least({share}, 7) as int)", f"least({share}, 7)::INTEGER"))


def _coeffs() -> Plan:
    x = grid.counts().select("i", "j", u=var("u"), ex=var("m") + 1.0, ey=var("f") + 1.0, k=var("f") * 0.5, axy=var("u") * 0.01, ayx=var("m") * 0.01)
    return x


@lru_cache(maxsize=1)
def plans() -> dict[str, Plan]:
    u = _u()
    gas = _gas()
    g = Geometry(N, N)
    mask = u.with_(mask=where(_disc() < 0.0, 1.0, 0.0))
    gas_mask = gas.with_(mask=where(_disc() < 0.0, 1.0, 0.0))
    inside = {"limiter": "minmod", "riemann": "hll"}
    coarse, fine = _amr_pair()
    pois = u.with_(f=var("u") / 3.0 - 10.0, mask=where(_disc() < 0.0, 1.0, 0.0))
    small = grid.density(16).with_(f=var("u") - 234.375)
    aux = _aux(u)
    drift = ph.ExBVelocity(2.0)
    fluid = _fluid_aux()
    state4 = [var(c) for c in GAS.names]
    own = {k: var(k) for k in ("grad_x", "grad_y", "b_z")}
    lorentz = ph.CompositeSource((ph.PotentialForce(0.5), ph.MagneticLorentzForce(0.5)))
    hall = _fluid_aux()
    theta = {s: stencil.cut_distance(var("level"), var(f"level_{s}")) for s in ("xm", "xp", "ym", "yp")}
    cut = stencil.neighbours(u.with_(level=_disc()), ["u", "level"], SHAPE, "foextrap")
    fx2, fy2 = mo.fluxes(2)
    m4 = mo.central(4)
    s4 = mo.standardized(m4)
    step_names = ["u"]
    relax = {"u": -2.0}

    out = {
        # scans, reductions
        "raster_density": u,
        "stats": reduce.stats(u, "u"),
        "norm_l1": reduce.norm(gas, GAS.names, "l1"),
        "norm_l2": _round(reduce.norm(gas, GAS.names, "l2")),
        "norm_linf": reduce.norm(gas, GAS.names, "linf"),
        "dot": reduce.dot(gas, [("rho", "mx"), ("mx", "my")]),
        "mass": reduce.mass(gas, "rho"),
        "mass_polar": _round(reduce.mass(gas, "rho", PolarGeometry(N, N, 0.3, 1.0).r() * 0.5)),
        "integral": _round(reduce.integral(gas, "rho", H * H)),
        "max_speed": _round(reduce.max_speed(gas, GAS)),
        "hotspot": _round(reduce.hotspot(gas, GAS, N)),
        "cfl_dt": _round(reduce.cfl_dt(gas, GAS, H, 0.4, 2, 3), 9),
        "cfl_dt_source": _round(reduce.cfl_dt(fluid, GAS, H, frequency=ph.MagneticLorentzForce(40.0).source_frequency(state4, own)), 9),
        "model_check": _round(reduce.model_check(gas, GAS)),
        # expressions, cells
        "expressions": _round(_expr_zoo()),
        "eig_solve_2x2": _round(_eig()),
        "saxpy": cells.saxpy(grid.counts(), "u", 0.25, "m"),
        "lincomb": cells.lincomb(grid.counts(), "out", [(0.5, "u"), (-2.0, "m"), (4.0, "f")]),
        "mask_where": cells.select_where(cells.compare(grid.counts(), "u", "ge", 60.0), "mask", [("chosen", "u", "m")]),
        "compare_ops": cells.compare(cells.compare(cells.compare(cells.compare(u, "u", "gt", 60.0, "gt"), "u", "ge", 60.0, "ge"), "u", "lt", 60.0, "lt"), "u", "le", 60.0, "le"),
        "project_pointwise": _round(cells.project(gas.with_(rho=var("rho") - 60.0), GAS)),
        "cons_prim_roundtrip": _round(cells.to_conservative(cells.to_primitive(gas, GAS), GAS)),
        "isothermal_primitive": _round(cells.to_primitive(gas.select("i", "j", "rho", "mx", "my"), COLD)),
        "temperature": _round(cells.temperature(gas, GAS)),
        "level_set_mask": mask,
        "wall_circle": u.filter(cells.wall(g, "circle", 0.35)),
        "zero_conductor": stencil.zero_conductor(mask, "u", "mask"),
        # physics
        "exb_flux": _round(aux.select("i", "j", fx=drift.flux([var("u")], own, 0)[0], fy=drift.flux([var("u")], own, 1)[0], w=maximum(drift.max_speed([var("u")], own, 0), drift.max_speed([var("u")], own, 1)))),
        "sources": _round(fluid.select("i", "j", **{f"s_{c}": e for c, e in zip(GAS.names, lorentz.apply(state4, own))})),
        "euler_eigenvalues": _round(gas.select("i", "j", **{f"l{k}": e for k, e in enumerate(GAS.eigenvalues(state4, 0))})),
        "elliptic_rhs": _round(gas.select("i", "j", charge=ph.ChargeDensity(-1.0).rhs(state4), background=ph.BackgroundDensity(2.0, 50.0).rhs(state4), gravity=ph.GravityCoupling(3.0, 50.0, -1.0).rhs(state4))),
        # stencils
        "laplacian_periodic": stencil.laplacian(u, "u", SHAPE),
        "laplacian_foextrap": stencil.laplacian(u, "u", SHAPE, bc="foextrap"),
        "laplacian_dirichlet": stencil.laplacian(u, "u", SHAPE, bc=("dirichlet", 2.0)),
        "laplacian_mixed": stencil.laplacian(u, "u", SHAPE, bc=("periodic", ("dirichlet", 1.0))),
        "gradient": _round(stencil.gradient(u, "u", SHAPE, H, H, scale=0.5)),
        "gradient_aux": _round(stencil.gradient(u, "u", SHAPE, H, H, divide=True)),
        "divergence": _round(stencil.divergence(grid.counts(), "u", "m", SHAPE, H, H)),
        "neg_div_flux": _round(stencil.divergence(grid.counts(), "u", "m", SHAPE, H, H, sign=-1.0)),
        "poisson_residual": _round(stencil.residual(pois, "u", "f", SHAPE, H, H, mask="mask")),
        "aniso_laplacian": _round(stencil.coefficient_operator(_coeffs(), "u", SHAPE, eps_x="ex", eps_y="ey")),
        "reaction_laplacian": _round(stencil.coefficient_operator(_coeffs(), "u", SHAPE, eps_x="ex", eps_y="ex", kappa="k")),
        "cross_div": _round(stencil.coefficient_operator(_coeffs(), "u", SHAPE, eps_x="ex", eps_y="ey", cross=("axy", "ayx"))),
        "ghost_reach_3": u.shift(["u"], {"xm3": (-3, 0), "xp3": (3, 0), "ym3": (0, -3), "yp3": (0, 3), "mp": (-1, 2)}, SHAPE),
        "ghost_dirichlet_2": u.shift(["u"], {"xm2": (-2, 0), "xp2": (2, 0), "yp1": (0, 1)}, SHAPE, (("dirichlet", 3.0), "foextrap")),
        "shortley_weller": _round(cut.select("i", "j", lap=stencil.shortley_weller("u", theta, H, H), **{f"cut_{s}": e for s, e in theta.items()})),
        # finite volumes
        "slope_minmod": _slopes(ph.minmod),
        "slope_vanleer": _round(_slopes(ph.van_leer)),
        "recon_conservative": _round(_faces("minmod")),
        "recon_primitive": _round(_faces("vanleer", primitive=True)),
        "weno5_faces": _round(_faces("weno5")),
        "positivity_floor": _round(_faces("minmod", floor_=40.0)),
        "flux_rusanov": _round(_flux("rusanov")),
        "flux_hll": _round(_flux("hll")),
        "flux_hllc": _round(_flux("hllc")),
        "flux_roe": _round(_flux("roe")),
        "rhs_euler_muscl": _round(_only_rates(fv.rhs(gas, GAS, SHAPE, H, H, **inside)), 4),
        "rhs_weno5": _round(_only_rates(fv.rhs(gas, GAS, SHAPE, H, H, limiter="weno5")), 4),
        "rhs_with_source": _round(_only_rates(fv.rhs(hall, GAS, SHAPE, H, H, source=lorentz, aux=["grad_x", "grad_y", "b_z"])), 4),
        "rhs_cached_speeds": _round(_only_rates(fv.rhs_cached_speeds(gas, GAS, SHAPE, H, H)), 4),
        "rhs_masked": _round(_only_rates(fv.rhs_masked(gas_mask, GAS, SHAPE, H, H, "mask", **inside)), 4),
        "rhs_cutcell": _round(_only_rates(fv.rhs_cut_cells(gas, GAS, SHAPE, H, H, cells.disc(0.5, 0.5, 0.16), geometry=g)), 4),
        "volume_fraction": _round(fv.rhs_cut_cells(gas, GAS, SHAPE, H, H, cells.disc(0.5, 0.5, 0.16), geometry=g).select("i", "j", "vol", "inside")),
        "rhs_exb": _round(_only_rates(fv.rhs(aux.select("i", "j", "grad_x", "grad_y", n=var("u")), drift, SHAPE, H, H, aux=["grad_x", "grad_y"])), 4),
        "rhs_global_speed": _round(_only_rates(fv.global_speed_rhs(u, WIND, SHAPE, H, H, 1.5))),
        "polar_rhs": _round(_only_rates(_polar()), 4),
        "polar_rhs_wall": _round(_only_rates(_polar(wall=True)), 4),
        "flux_hllc_isothermal": _round(_cold_flux("hllc")),
        "flux_roe_isothermal": _round(_cold_flux("roe")),
        "polar_tensor": _round(_polar_tensor(), 3),
        "board_rate": _round(_only_rates(_board_rate()), 4),
        "rhs_copied_edges": _round(_only_rates(fv.rhs(gas, GAS, SHAPE, H, H, bc="foextrap", **inside)), 4),
        "rhs_fixed_edges": _round(_only_rates(fv.rhs(u, WIND, SHAPE, H, H, bc=(Edges(("dirichlet", 50.0), "foextrap"), ("dirichlet", 2.0)), limiter="vanleer", viscosity=0.01)), 4),
        "isothermal_hll": _round(_only_rates(fv.rhs(gas.select("i", "j", "rho", "mx", "my"), COLD, SHAPE, H, H, riemann="hll")), 4),
        # time
        "step_fe": _round(tm.euler(u, _advect, step_names, 0.01)),
        "step_ssprk2": _round(tm.ssprk2(u, _slim_rate, step_names, 0.01)),
        "step_ssprk3": _round(tm.ssprk3(u, _slim_rate, step_names, 0.01)),
        "step_rk4": _round(tm.runge_kutta(u, _slim_rate, step_names, 0.01)),
        "step_ab2": _round(tm.adams_bashforth(u, _slim_rate, step_names, 0.01, 2, 2)),
        "step_imex": _round(tm.imex_euler(u, _slim_rate, step_names, lambda x, dt: x.with_(u=tm.backward_euler_linear("u", -2.0, dt)), 0.01)),
        "step_ars222": _round(tm.ars222(u, _slim_rate, step_names, relax, 0.01)),
        "step_strang": _round(tm.strang(u, lambda x, dt: tm.euler(x, _slim_rate, step_names, dt), lambda x, dt: x.with_(u=var("u") * (1.0 - 2.0 * dt)), 0.01)),
        "step_bdf2": _round(grid.counts().select("i", "j", u=tm.bdf2_linear("u", "m", -3.0, 0.1))),
        "lorentz_rotation": _round(fluid.with_(**tm.rotate_velocity("mx", "my", var("b_z") * 0.2, 0.5)).select("i", "j", "mx", "my")),
        "euler_step": _round(tm.euler(gas, lambda x: fv.rhs(x, GAS, SHAPE, H, H, limiter="minmod", riemann="hllc"), GAS.names, 0.0005)),
        "schur_stage": _round(_schur(), 5),
        # cadence
        "stride_catchup": _stride(),
        "hold_cache": _hold(),
        "history_lag": _series().running("u1", "sum", "u", ["grp"], ["step"], back=1).running("u2", "sum", "u", ["grp"], ["step"], back=2).drop("grp"),
        # coupling
        "ionization": coupling.ionization(_blocks(), "n_a", "n_b", "n_c", 0.25, 0.5),
        "collision": _round(coupling.collision(_two_fluids(), ("a_rho", "a_mx", "a_my"), ("b_rho", "b_mx", "b_my"), 2.0, 0.1), 9),
        "thermal_exchange": _round(coupling.thermal_exchange(_two_fluids(), GAS, [f"a_{c}" for c in GAS.names], [f"b_{c}" for c in GAS.names], 2.0, 0.1)),
        "coupled_source": _round(_coupled()),
        "coupled_frequency": _round(coupling.CoupledSource(frequency=var("n_c") * 0.3).frequency_bound(_blocks(), 0.4)),
        "charge_density_rhs": _round(coupling.charge_density({"a": (_blocks(), "n_a", -1.0), "b": (_blocks(), "n_b", 1.0), "c": (_blocks(), "n_c", 2.0)})),
        # refinement
        "average_down": amr.average_down(u, ["u"]),
        "inject": amr.interpolate(u, ["u"]),
        "prolong_bilinear": _round(amr.interpolate_bilinear(u, "u", SHAPE)),
        "tag_cells": _tags(),
        "tag_gradient": amr.gradient_tags(u, "u", SHAPE, 25.0),
        "grow_tags": amr.grow(_tags(), 1, Box.of(N, N)),
        "tag_union": amr.union(_tags(), amr.tags(u, amr.below("u", 50.0))),
        "tag_signature": amr.signature(_tags(), "i"),
        "tag_bbox": amr.bounding_box(_tags()),
        "coverage_semi": amr.covered(u, _BOXES),
        "uncovered_anti": amr.uncovered(u, _BOXES),
        "coarse_to_fine": amr.inject(coarse, fine, ["u"]),
        "regrid": amr.regrid(fine, coarse, [Box(16, 8, 31, 23)], ["u"]),
        "average_down_patch": amr.average_down(fine, ["u"]),
        "reflux_correction": _round(_reflux()),
        "morton_partition": _sfc(),
        "ghosts_in_time": _round(grid.counts().select("i", "j", u=amr.in_time(var("u"), var("m"), 0.25))),
        # layouts
        "halo_fill": halo.ghosts(u, ["u"], 8, 4, 2),
        "parallel_copy": halo.copy_to_layout(halo.with_boxes(u, 8, 4), ["u"], 16, 2),
        "max_drift_speed": _round(reduce.max_speed(aux.select("i", "j", "grad_x", "grad_y", n=var("u")), ph.ExBVelocity(2.0), own)),
        "rhs_jacvec": _round(_jacobian_vector(), 4),
        "polar_operator": _round(_polar_operator(), 3),
        # elliptic
        "gs_red_sweep": _round(stencil.gauss_seidel_half(pois, "u", "f", SHAPE, 0, H, H)),
        "gs_black_sweep": _round(stencil.gauss_seidel_half(stencil.gauss_seidel_half(pois, "u", "f", SHAPE, 0, H, H), "u", "f", SHAPE, 1, H, H)),
        "dft_poisson": _round(elliptic.dft_poisson(small, "f", 16, 1 / 16)),
        "dft_poisson_spectral": _round(elliptic.dft_poisson(small, "f", 16, 1 / 16, spectral=True)),
        # moments
        "moments_central": _round(_moment_state4().select("i", "j", **{f"c{p}{q}": e for (p, q), e in m4.items()}), 4),
        "moments_standardized": _round(_moment_state4().select("i", "j", **{f"s{p}{q}": e for (p, q), e in s4.items() if p + q <= 3}), 4),
        "moments_flux": _round(_moment_state().select("i", "j", **{f"fx_{k}": e for k, e in fx2.items()}, **{f"fy_{k}": e for k, e in fy2.items()}), 7),
        "bgk_source": _round(_moment_state().select("i", "j", **mo.bgk_source(2, 0.7)), 8),
        "lorentz_sources": _round(_moment_state().select("i", "j", **mo.lorentz_sources(2, 0.5, const(0.25), const(-0.5), const(2.0))), 8),
        "realizability": _round(_moment_state().with_(m20=var("m20") - 500.0).with_(**mo.RealizabilityProjection().apply()), 5),
    }
    return out


def _four_boxes(spark: SparkSession, sf_dir: str, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One solve over a 64 x 64 grid that four boxes of 32 x 32 make up."""
    phi = solve(grid.density(2 * N).frame(spark, sf_dir))
    return _round(halo.with_boxes(Given(phi), N, 2).select("box_id", "i", "j", "phi"), 5).frame(spark, sf_dir)


def mg_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic Poisson problem by multigrid."""
    p = problems.PoissonProblem(var("u"))
    return _four_boxes(spark, sf_dir, lambda x: problems.solve(p, problems.GeometricMG(rel=1e-12), x, (2 * N, 2 * N), 1 / (2 * N)))


def fft_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by transforms over lines."""
    p = problems.PoissonProblem(var("u"))
    return _four_boxes(spark, sf_dir, lambda x: problems.solve(p, problems.FFT(), x, (2 * N, 2 * N), 1 / (2 * N)))


def _four_boxes_sql() -> str:
    phi = elliptic.dft_poisson(grid.density(2 * N), "u", 2 * N, 1 / (2 * N))
    return _round(halo.with_boxes(phi, N, 2).select("box_id", "i", "j", "phi"), 5).sql()


def polar_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring, zero at both ends."""
    phi = lines.polar_poisson(grid.density().frame(spark, sf_dir), "u", SHAPE, 0.3, 1.0)
    return _round(Given(phi)).frame(spark, sf_dir)


#: A transform of the angle by sums, a forward and a backward recursion along the radius, and back.
POLAR_SQL = """
WITH RECURSIVE cells AS (SELECT i::INTEGER AS i, j::INTEGER AS j, coalesce(n, 0)::DOUBLE AS f FROM range(32) a(i), range(32) b(j)
  LEFT JOIN (SELECT l_orderkey % 32 AS p, l_partkey % 32 AS q, count(*) AS n FROM lineitem GROUP BY ALL) ON p = i AND q = j),
hat AS (SELECT i, m, sum(f * cos(2 * pi() * ((j * m) % 32) / 32)) AS re, -sum(f * sin(2 * pi() * ((j * m) % 32) / 32)) AS im FROM cells, range(32) c(m) GROUP BY i, m),
w AS (SELECT i, m, re, im, (r - dr / 2) / (r * dr * dr) AS lo, (r + dr / 2) / (r * dr * dr) AS hi, (CASE WHEN 2 * m > 32 THEN m - 32 ELSE m END) ** 2 / (r * r) AS k
  FROM (SELECT *, 0.7::DOUBLE / 32 AS dr, 0.3::DOUBLE + (i + 0.5) * 0.7 / 32 AS r FROM hat)),
sys AS (SELECT i, m, re, im, lo, hi, -(lo + hi) - k - CASE WHEN i = 0 THEN lo WHEN i = 31 THEN hi ELSE 0 END AS d FROM w),
down(i, m, c, x, y) AS (SELECT i, m, hi / d, re / d, im / d FROM sys WHERE i = 0
  UNION ALL SELECT s.i, s.m, s.hi / (s.d - s.lo * p.c), (s.re - s.lo * p.x) / (s.d - s.lo * p.c), (s.im - s.lo * p.y) / (s.d - s.lo * p.c) FROM down p JOIN sys s ON s.i = p.i + 1 AND s.m = p.m),
up(i, m, x, y) AS (SELECT i, m, x, y FROM down WHERE i = 31
  UNION ALL SELECT q.i, q.m, q.x - q.c * p.x, q.y - q.c * p.y FROM up p JOIN down q ON q.i = p.i - 1 AND q.m = p.m)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(x * cos(2 * pi() * ((j * m) % 32) / 32) - y * sin(2 * pi() * ((j * m) % 32) / 32)) / 32, 6) + 0.0 AS phi
FROM up, range(32) c(j) GROUP BY i, j
"""


def fac_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level composite solve in each of four boxes of 32 x 32; the coarse level."""

    def solve(f):
        fine = f[8:24, 8:24].repeat(2, 0).repeat(2, 1)
        return elliptic.fac_two_level(f, fine, (8, 8), 1 / 32)[0]

    cells_ = grid.density(2 * N).frame(spark, sf_dir)
    key = F.expr(f"cast((i div {N}) * 2 + (j div {N}) as int)")
    boxes = cells_.select(key.alias("box_id"), F.expr(f"cast(i % {N} as int)").alias("i"), F.expr(f"cast(j % {N} as int)").alias("j"), "u")
    return elliptic.solve_blocks(boxes, "u", solve)


_SHARES = {"n_a": -1.0, "n_b": 1.0, "n_c": 0.5}


def solve_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The potential of three species, and its gradient."""
    x = _blocks()
    shares = {c[-1]: (x, var(c) * q) for c, q in _SHARES.items()}
    solve = problems.FieldSolve(problems.PoissonProblem(problems.RHS), problems.FFT(), SHAPE, H)
    return _round(Given(solve.aux(shares, spark, sf_dir))).frame(spark, sf_dir)


def _solve_fields_sql() -> str:
    charge = _blocks().select("i", "j", f=var("n_a") * -1.0 + var("n_b") + var("n_c") * 0.5)
    return _round(stencil.gradient(elliptic.dft_poisson(charge, "f", N, H), "phi", SHAPE, H, H, divide=True)).sql()


def screened_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian(phi) - 4 phi = u by CG, preconditioned by two levels."""
    cells_ = grid.density(16).frame(spark, sf_dir)
    p = problems.ScreenedPoissonProblem(var("u"), 4.0)
    more = {"precondition": multigrid.two_level((16, 16), (1.0, 1.0), kappa=4.0, tile=8)}
    phi = problems.solve(p, problems.Krylov("bicgstab", max_iter=30, tolerance=1e-12, **more), cells_, (16, 16), 1.0)
    return _round(Given(phi), 5).frame(spark, sf_dir)


def _newton(spark: SparkSession, sf_dir: str, steps: int | None) -> DataFrame:
    from fieldloom.functions.linalg import newton_source as solve

    x = _gas().frame(spark, sf_dir)
    done = solve(F.array("rho", "mx"), lambda u: -0.01 * u * abs(u), 2, 0.1, steps=steps)
    return x.select("i", "j", done.alias("s")).select("i", "j", F.col("s.state")[0].alias("rho"), F.col("s.state")[1].alias("mx"), "s.residual", "s.ok")


def newton_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward Euler of a nonlinear decay, solved to rounding in each cell."""
    return _round(Given(_newton(spark, sf_dir, None).drop("ok"))).frame(spark, sf_dir)


def newton_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a single Newton step: the worst residual, failed cells, and the first cell with the worst residual."""
    x = _newton(spark, sf_dir, 1)
    worst = F.max(F.struct(F.round("residual", 3).alias("residual"), (-(F.col("j") * N + F.col("i"))).alias("place")))
    out = x.agg(worst.alias("w"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"))
    return out.select(F.col("w.residual").alias("residual"), (-F.col("w.place")).cast("long").alias("place"), F.col("failed").cast("long").alias("failed"))


_GAS_SQL = """
cells AS (SELECT i::INTEGER AS i, j::INTEGER AS j, 1 + coalesce(n, 0)::DOUBLE AS rho, coalesce(m, 0)::DOUBLE AS mx, coalesce(f, 0)::DOUBLE AS my FROM range(32) a(i), range(32) b(j)
  LEFT JOIN (SELECT l_orderkey % 32 AS p, l_partkey % 32 AS q, count(*) AS n, sum(l_linenumber) AS m, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY ALL) ON p = i AND q = j)"""
#: The root of x + 0.001 x |x| = u; and one Newton step towards it, with what is left.
NEWTON_SQL = f"""WITH {_GAS_SQL}
SELECT i, j, round(sign(rho) * (sqrt(1 + 0.004::DOUBLE * abs(rho)) - 1) / 0.002::DOUBLE, 6) + 0.0 AS rho,
  round(sign(mx) * (sqrt(1 + 0.004::DOUBLE * abs(mx)) - 1) / 0.002::DOUBLE, 6) + 0.0 AS mx, 0.0::DOUBLE AS residual FROM cells"""
NEWTON_REPORT_SQL = f"""WITH {_GAS_SQL},
step AS (SELECT i, j, rho, mx, rho - 0.001::DOUBLE * rho * abs(rho) / (1 + 0.002::DOUBLE * abs(rho)) AS x, mx - 0.001::DOUBLE * mx * abs(mx) / (1 + 0.002::DOUBLE * abs(mx)) AS y FROM cells),
rest AS (SELECT j * 32 + i AS place, round(greatest(abs(x - rho + 0.001::DOUBLE * x * abs(x)), abs(y - mx + 0.001::DOUBLE * y * abs(y))), 3) AS residual FROM step)
SELECT max(residual) AS residual, (SELECT min(place) FROM rest WHERE residual = (SELECT max(residual) FROM rest))::BIGINT AS place, 0::BIGINT AS failed FROM rest"""
SPECTRUM_SQL = f"""WITH {_GAS_SQL},
gas AS (SELECT i, j, mx / rho AS v, sqrt(1.4::DOUBLE * 0.4 * (10 * rho + mx * mx + my * my - (mx * mx + my * my) / rho / 2) / rho) AS c FROM cells)
SELECT i, j, 0.0::DOUBLE AS max_im, round(v - c, 4) + 0.0 AS lmin, round(v + c, 4) + 0.0 AS lmax, true AS all_real FROM gas"""


def _krylov(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rhs = grid.density(16).select("i", "j", b=var("u") / 100.0).frame(spark, sf_dir)
        op = elliptic.periodic_operator((16, 16), 1.0, kappa=4.0)
        more = {"omega": 0.125} if name == "richardson" else {}
        return _round(Given(elliptic.KRYLOV[name](op, rhs, tolerance=1e-10, max_iter=60, **more).field), 5).frame(spark, sf_dir)

    run.__name__ = f"{name}_solve"
    run.__doc__ = f"(4 - Laplacian) x = b by {name}."
    return run


def _screened_sql(rhs: Expr, name: str, digits: int, kappa: float = 4.0, h: float = 1.0) -> str:
    """Laplacian(x) - kappa x = rhs over 16 x 16 cells, by sums."""
    phi = elliptic.dft_poisson(grid.density(16).select("i", "j", f=rhs), "f", 16, h, kappa=kappa)
    return _round(phi.rename(phi=name), digits).sql()


def berger_rigoutsos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the tags, region by region (one group per 16 x 16 cells)."""
    tagged = amr.grow(_tags(), 1, Box.of(N, N)).frame(spark, sf_dir).withColumn("region", F.expr("cast((i div 16) * 2 + (j div 16) as int)"))

    def run(found):
        import pandas as pd

        boxes = amr.cluster(set(zip(found["i"].tolist(), found["j"].tolist())))
        region = int(found["region"].iloc[0])
        return pd.DataFrame([(region, b.i0, b.j0, b.i1, b.j1) for b in boxes], columns=["region", "i0", "j0", "i1", "j1"])

    return tagged.groupBy("region").applyInPandas(run, "region int, i0 int, j0 int, i1 int, j1 int")


def spectrum_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme eigenvalues of the gas flux's Jacobian, built by symbolic derivatives."""
    from fieldloom.functions.expr import jacobian
    from fieldloom.functions.linalg import spectrum

    rows = jacobian(GAS.flux([var(c) for c in GAS.names], {}, 0), GAS.names)
    x = _gas().frame(spark, sf_dir)
    matrix = F.array(*[F.array(*[e.column() for e in r]) for r in rows])
    found = x.select("i", "j", spectrum(matrix).alias("s")).select("i", "j", "s.*")
    return found.select("i", "j", *[(F.round(c, 4) + 0.0).alias(c) for c in ("max_im", "lmin", "lmax")], "all_real")


def _two_levels():
    """A coarse level of 16 x 16 and two touching boxes above it, one step of two half steps."""
    from fieldloom.operators.hierarchy import Hierarchy, Level, Scheme

    boxes = [Box(8, 8, 19, 23), Box(20, 12, 27, 19)]
    scheme = Scheme(ph.Advection(1.0, -0.5), (1 / 16, 1 / 16), (16, 16), limiter="minmod")
    fine = amr.box_cells(boxes).select("i", "j").join(amr.interpolate(_u(16), ["u"]), ["i", "j"])
    fine = fine.with_(u=var("u") + raw("cast((i * 3 + j) % 5 as double)", "((i * 3 + j) % 5)::DOUBLE"))
    return Hierarchy(scheme, [Level(_u(16)), Level(fine, boxes)])


def _amr_step(level: int, cut: Callable[[Plan], Plan] | None = None) -> Plan:
    h = _two_levels()
    h.cut = cut
    h.sync()
    h.step(0.01)
    return h.levels[level].state


def _amr_query(level: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One step of both levels, each level's state and fluxes written once."""
        return _round(_amr_step(level, lambda p: Given(elliptic._cut(p.frame(spark, sf_dir))))).frame(spark, sf_dir)

    return run


def program_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSPRK2 as a recorded program, after the passes, over plans."""
    from fieldloom.plans.program import Machine, Program, optimize

    p = Program()
    u0 = p.state("u")
    u1 = p.linear_combine([(1.0, u0), (0.01, p.rhs(u0))])
    p.rhs(u0)  # dead
    p.commit("u", p.linear_combine([(0.5, u0), (0.5, u1), (0.005, p.rhs(u1))]))

    def combine(terms: list[tuple[float, Plan]]) -> Plan:
        out = None
        for k, (a, x) in enumerate(terms):
            y = x.select("i", "j", **{f"x{k}": var("u") * a})
            out = y if out is None else out.join(y, ["i", "j"])
        total = var("x0")
        for k in range(1, len(terms)):
            total = total + var(f"x{k}")
        return out.select("i", "j", u=total)

    rate = lambda x, **_: _slim_rate(x).select("i", "j", u=var("r_u"))
    done = Machine({"rhs": rate, "linear_combine": combine}, {"u": _u()}).execute(optimize(p))["u"]
    return _round(done).frame(spark, sf_dir)


def program_matrix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(2 - Laplacian) x = u by a recorded program whose operator is a body of it."""
    from fieldloom.plans.library import Block, Library
    from fieldloom.plans.program import Program, optimize

    p = Program()
    u, two = p.state("u"), p.scalar_op("add", 1.0, 1.0)
    body = p.inside()
    x = body.apply_in()
    body.apply_out(body.linear_combine([(two, x), (-1.0, body.laplacian(x))]))
    p.commit("u", p.solve_linear(p.matrix_free_operator(body), u, "cg", tolerance=1e-11, max_iter=100))
    lib = Library(spark, (16, 16), (1.0, 1.0), {"u": Block(WIND)}, sf_dir)
    return _round(lib.machine({"u": _u(16)}).execute(optimize(p))["u"], 5).frame(spark, sf_dir)


def _schur_state(n: int = 8) -> Plan:
    return grid.counts(n).select("i", "j", rho=const(2.0), mx=var("m") / 100.0, my=var("f") / 100.0)


def program_schur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condensed source stage as a program, for a constant density and field."""
    from fieldloom.plans.library import Block, Library
    from fieldloom.plans.macros import condensed_schur
    from fieldloom.plans.program import Program, optimize

    p = Program()
    condensed_schur(p, "gas", 0.4, 3.0, theta=0.5, tolerance=1e-12)
    aux = grid.counts(8).select("i", "j", b_z=const(1.5))
    lib = Library(spark, (8, 8), (1.0, 1.0), {"gas": Block(COLD)}, sf_dir, aux=aux)
    out = lib.machine({"gas": _schur_state(), "phi": grid.counts(8).select("i", "j", x=const(0.0))}).execute(optimize(p))
    return _round(out["gas"].select("i", "j", "rho", "mx", "my"), 5).frame(spark, sf_dir)


def _schur_sql() -> str:
    """With constant coefficients the cross terms cancel: eps Laplacian(phi) = g div(B^-1 m)."""
    th, alpha, w = 0.2, 3.0, 0.3
    d = 1 + w * w
    x = _schur_state().with_(fx=(var("mx") + var("my") * w) / d, fy=(var("my") - var("mx") * w) / d)
    x = stencil.divergence(x, "fx", "fy", (8, 8), 1.0, 1.0)
    eps = 1 + th * th * alpha * 2.0 / d
    phi = elliptic.dft_poisson(x.select("i", "j", f=var("div") * (th * alpha / eps)), "f", 8, 1.0)
    g = stencil.gradient(phi, "phi", (8, 8), 1.0, 1.0, divide=True).select("i", "j", "grad_x", "grad_y")
    x = x.join(g, ["i", "j"])
    px, py = var("mx") - var("grad_x") * (2.0 * th), var("my") - var("grad_y") * (2.0 * th)
    x = x.select("i", "j", "rho", mx=(px + py * w) / d * 2.0 - var("mx"), my=(py - px * w) / d * 2.0 - var("my"))
    return _round(x, 5).sql()


PYTHON = {
    "amr_step": _amr_query(0),
    "amr_step_fine": _amr_query(1),
    "program_matrix_free": program_matrix_free,
    "program_schur": program_schur,
    "mg_solve": mg_solve,
    "fft_solve": fft_solve,
    "polar_solve": polar_solve,
    "fac_solve": fac_solve,
    "solve_fields": solve_fields,
    "screened_solve": screened_solve,
    "newton_report": newton_report,
    **{f"{n}_solve": _krylov(n) for n in ("cg", "bicgstab", "gmres", "richardson")},
    "berger_rigoutsos": berger_rigoutsos,
    "newton_source": newton_source,
    "spectrum_4x4": spectrum_4x4,
    "program_step": program_step,
}


def at_size(n: int) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Headline steps on an n x n grid, for timing; the queries use 32 x 32."""
    h, shape = 1.0 / n, (n, n)
    gas = grid.euler_state(n)
    made = {
        "rhs_euler_muscl": fv.rhs(gas, GAS, shape, h, h, limiter="minmod", riemann="hll"),
        "euler_step": tm.euler(gas, lambda x: fv.rhs(x, GAS, shape, h, h, limiter="minmod", riemann="hllc"), GAS.names, 1e-5),
        "step_ssprk3": tm.ssprk3(grid.density(n), lambda x: fv.rhs(x, WIND, shape, h, h), ["u"], 1e-4),
        "step_weno5": tm.euler(grid.density(n), lambda x: fv.rhs(x, WIND, shape, h, h, limiter="weno5"), ["u"], 1e-4),
        "average_down": amr.average_down(grid.density(n), ["u"]),
    }
    out = {k: (lambda spark, folder, p=p: p.frame(spark, folder)) for k, p in made.items()}
    out["fft_solve"] = lambda spark, folder: lines.poisson(grid.density(n).frame(spark, folder), "u", shape, (h, h))
    return out


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans()[name].frame(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: _query(name) for name in plans()}, **PYTHON}


def oracle_sql() -> dict[str, str]:
    out = {name: plan.sql() for name, plan in plans().items()}
    out["program_step"] = plans()["step_ssprk2"].sql()
    out |= {"amr_step": _round(_amr_step(0)).sql(), "amr_step_fine": _round(_amr_step(1)).sql()}
    out |= {"mg_solve": _four_boxes_sql(), "fft_solve": _four_boxes_sql(), "polar_solve": POLAR_SQL, "solve_fields": _solve_fields_sql()}
    out |= {"newton_source": NEWTON_SQL, "newton_report": NEWTON_REPORT_SQL, "spectrum_4x4": SPECTRUM_SQL}
    out |= {f"{k}_solve": _screened_sql(var("u") / -100.0, "x", 5) for k in elliptic.KRYLOV}
    out |= {"screened_solve": _screened_sql(var("u"), "phi", 5), "program_matrix_free": _screened_sql(-var("u"), "u", 5, 2.0), "program_schur": _schur_sql()}
    return out
