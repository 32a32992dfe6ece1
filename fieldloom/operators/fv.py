"""Finite volumes: face states, numerical fluxes and residuals.

Each cell has the fluxes through its upper faces (``fx_``, ``fy_``) and its lower ones
(``gx_``, ``gy_``). On a periodic axis a lower flux is the neighbour's upper one, moved along
the same lines as the states, so it costs no further shuffle. Elsewhere the lower flux is
computed from the states on its two sides, ghost states among them, by the same
arithmetic as the neighbour's upper one.
"""

from __future__ import annotations

from collections.abc import Callable

from fieldloom.functions import physics
from fieldloom.functions.expr import Expr, maximum, minimum, safe_div, var, where
from fieldloom.operators.stencil import cut_distance, reach_needed
from fieldloom.plans.relation import Boundary, Plan, axis_rules, derived_rules

AXES = ("x", "y")


def _near(direction: int, k: int) -> tuple[int, int]:
    return (k, 0) if direction == 0 else (0, k)


def _name(c: str, k: int) -> str:
    return c if k == 0 else f"{c}_{'m' if k < 0 else 'p'}{abs(k)}"


def _moves(direction: int, ks: list[int]) -> dict[str, tuple[int, int]]:
    return {f"{'m' if k < 0 else 'p'}{abs(k)}": _near(direction, k) for k in ks if k}


def face_states(model, limiter: str, primitive: bool = False, floor: float | None = None, at: int = 0) -> tuple[list[Expr], list[Expr]]:
    """States left and right of the upper face, over columns ``c_m2 .. c_p3``; ``at`` = -1: of the lower face.

    ``primitive``: reconstruct those variables instead. ``floor``: where a reconstructed
    density is below it, the cell mean stands on that side.
    """
    names = model.names

    def cell(k: int) -> list[Expr]:
        u = [var(_name(c, k + at)) for c in names]
        return model.to_primitive(u) if primitive else u

    if limiter == "weno5":
        cells = {k: cell(k) for k in range(-2, 4)}
        left = [physics.weno5z(*(cells[k][q] for k in (-2, -1, 0, 1, 2))) for q in range(len(names))]
        right = [physics.weno5z(*(cells[k][q] for k in (3, 2, 1, 0, -1))) for q in range(len(names))]
    elif limiter == "none":
        left, right = cell(0), cell(1)
    else:
        slope = physics.LIMITERS[limiter][0]
        m, c, p, q = cell(-1), cell(0), cell(1), cell(2)
        left = [b + slope(b - a, d - b) * 0.5 for a, b, d in zip(m, c, p)]
        right = [b - slope(b - a, d - b) * 0.5 for a, b, d in zip(c, p, q)]
    if primitive:
        left, right = model.to_conservative(left), model.to_conservative(right)
    if floor is not None:
        mean_l, mean_r = ([var(_name(c, k + at)) for c in names] for k in (0, 1))
        left, right = ([where(side[0] < floor, b, a) for a, b in zip(side, mean)] for side, mean in ((left, mean_l), (right, mean_r)))
    return left, right


_READS = {"none": (0, 1), "minmod": (-1, 2), "vanleer": (-1, 2), "weno5": (-2, 3)}


def _both_faces(field: Plan, names: list[str], shape, bc: Boundary, reads: tuple[int, int], flux: Callable, columns: list[str], aux: list[str], second: bool = False, within: tuple[str, ...] = (), aux_rules: dict[str, Boundary] | None = None) -> Plan:
    """``f{axis}_{name}`` and ``g{axis}_{name}``, axis by axis, the one that the rows lie along first.

    ``flux(x, d, at)`` gives a plan with the columns ``_f_{name}`` of the upper (0) or lower
    (-1) face. ``second``: also ``d{axis}_{name}``, the undivided second difference.
    """
    rules, kept = axis_rules(bc), derived_rules(bc)
    out = field
    for d in (1, 0) if field.along == "j" else (0, 1):
        axis, wraps = AXES[d], rules[d] in ("periodic", "none")
        lo, hi = reads
        ks = range(lo if wraps else lo - 1, hi + 1)
        near = [-1, 1] if second else [1]
        moved = out.shift(columns, _moves(d, sorted({*ks, *near})), shape, bc, within)
        own = aux_rules or {}
        for rule in [kept, *dict.fromkeys(own.values())]:
            those = [a for a in aux if (axis_rules(own[a]) if a in own else kept) == axis_rules(rule)]
            if those and (rule is kept or axis_rules(rule) != kept):
                moved = moved.shift(those, _moves(d, [1] if wraps else [-1, 1]), shape, rule, within)
        more = {f"d{axis}_{c}": var(_name(c, 1)) - var(c) * 2.0 + var(_name(c, -1)) for c in names} if second else {}
        keep = [*out.columns, *[f"f{axis}_{c}" for c in names]]
        if wraps:
            x = flux(moved.with_(**more) if more else moved, d, 0).rename(**{f"_f_{c}": f"f{axis}_{c}" for c in names})
            x = x.select(*keep, *more).shift([f"f{axis}_{c}" for c in names], {"low": _near(d, -1)}, shape, bc, within)
            out = x.rename(**{f"f{axis}_{c}_low": f"g{axis}_{c}" for c in names})
        else:
            x = flux(moved.with_(**more) if more else moved, d, 0).rename(**{f"_f_{c}": f"f{axis}_{c}" for c in names})
            x = flux(x, d, -1).rename(**{f"_f_{c}": f"g{axis}_{c}" for c in names})
            out = x.select(*keep, *[f"g{axis}_{c}" for c in names], *more)
    return out


def face_fluxes(
    field: Plan,
    model,
    shape,
    limiter: str = "none",
    riemann: str = "rusanov",
    bc: Boundary = "periodic",
    primitive: bool = False,
    floor: float | None = None,
    aux: list[str] | None = None,
    ghosts: int = 3,
    second: bool = False,
    mask: str | None = None,
    within: tuple[str, ...] = (),
    aux_rules: dict[str, Boundary] | None = None,
) -> Plan:
    """``f{x|y}_{component}`` and ``g{x|y}_{component}``: the fluxes through each cell's upper and lower faces.

    States are columns first, so that each reconstruction is computed once. ``mask``: no
    flux through faces between cells where it isn't 0.5 or more on both sides. Auxiliary
    columns and masks are periodic where the states are, and else copied at the edges, but
    for those with a rule of their own in ``aux_rules``.
    """
    reach_needed(limiter, ghosts)
    solver = physics.RIEMANN[riemann]
    aux = aux or []
    beside = [*aux, *([mask] if mask else [])]

    def flux(x: Plan, d: int, at: int) -> Plan:
        left, right = face_states(model, limiter, primitive, floor, at)
        x = x.with_(**{f"_l_{c}": e for c, e in zip(model.names, left)}, **{f"_r_{c}": e for c, e in zip(model.names, right)})
        ul, ur = ([var(f"_{s}_{c}") for c in model.names] for s in "lr")
        al, ar = ({a: var(_name(a, k + at)) for a in aux} for k in (0, 1))
        found = solver(model, ul, al, ur, ar, d)
        if mask:
            open_ = (var(_name(mask, at)) >= 0.5) & (var(_name(mask, at + 1)) >= 0.5)
            found = [where(open_, e, 0.0) for e in found]
        return x.with_(**{f"_f_{c}": e for c, e in zip(model.names, found)})

    return _both_faces(field, model.names, shape, bc, _READS[limiter], flux, model.names, beside, second, within, aux_rules)


def rhs(field: Plan, model, shape, dx: float, dy: float, source=None, aux: list[str] | None = None, bc: Boundary = "periodic", viscosity: float = 0.0, fluxes: Plan | None = None, prefix: str = "r_", volume: Expr | None = None, **scheme) -> Plan:
    """R = S - div F (+ nu Lap U), as columns ``r_{component}``; ``volume``: the part of the cell that is filled."""
    x = face_fluxes(field, model, shape, bc=bc, aux=aux, second=bool(viscosity), **scheme) if fluxes is None else fluxes
    added = source.apply([var(c) for c in model.names], {a: var(a) for a in aux or []}) if source else None
    out = {}
    for k, c in enumerate(model.names):
        across, up = (var(f"fx_{c}") - var(f"gx_{c}")) / dx, (var(f"fy_{c}") - var(f"gy_{c}")) / dy
        value = -across - up if volume is None else -(across / volume) - up / volume
        if added is not None:
            value = value + added[k]
        if viscosity:
            value = value + (var(f"dx_{c}") / (dx * dx) + var(f"dy_{c}") / (dy * dy)) * viscosity
        out[f"{prefix}{c}"] = value
    return x.select(*field.columns, **out)


def rhs_masked(field: Plan, model, shape, dx, dy, mask: str, bc: Boundary = "periodic", source=None, aux: list[str] | None = None, **scheme) -> Plan:
    """Staircase boundary: closed faces, and zero in inactive cells."""
    x = rhs(field, model, shape, dx, dy, source, aux, bc, mask=mask, **scheme)
    return x.with_(**{f"r_{c}": where(var(mask) >= 0.5, var(f"r_{c}"), 0.0) for c in model.names})


def cut_geometry(level: dict[str, Expr]) -> dict[str, Expr]:
    """Of an active cell: the open part of the way to each neighbour (``xm, xp, ym, yp``), and
    ``volume``, the product of the two axes' mean open parts. ``level``: also the cell's own, as ``here``."""
    ways = {s: cut_distance(level["here"], level[s]) for s in ("xm", "xp", "ym", "yp")}
    return ways | {"volume": (ways["xm"] + ways["xp"]) * 0.5 * ((ways["ym"] + ways["yp"]) * 0.5)}


def levels(level: str | Callable[[Expr, Expr], Expr], field: Plan, shape, geometry=None, bc: Boundary = "foextrap") -> tuple[Plan, dict[str, Expr]]:
    """A level set in a cell and its four neighbours: a column, moved, or a function of the place,
    which is known beyond the edges too and moves nothing."""
    offsets = {"xm": (-1, 0), "xp": (1, 0), "ym": (0, -1), "yp": (0, 1)}
    if isinstance(level, str):
        return field.shift([level], offsets, shape, bc), {"here": var(level)} | {s: var(f"{level}_{s}") for s in offsets}
    x, y = geometry.x(), geometry.y()
    return field, {"here": level(x, y)} | {s: level(x + a * geometry.dx, y + b * geometry.dy) for s, (a, b) in offsets.items()}


def rhs_cut_cells(field: Plan, model, shape, dx, dy, level: str | Callable[[Expr, Expr], Expr], bc: Boundary = "foextrap", least: float = 1e-2, geometry=None, source=None, aux: list[str] | None = None, **scheme) -> Plan:
    """Cut cells: faces are open between two cells inside (a negative level), and a cell's volume
    is that of ``cut_geometry``, but not below ``least``. Cells outside have a rate of zero.

    The result also has ``vol``, the volume, and ``inside``.
    """
    x, at = levels(level, field, shape, geometry, bc)
    inside = where(at["here"] < 0.0, 1.0, 0.0)
    x = x.with_(_here=at["here"], **{f"_{s}": at[s] for s in ("xm", "xp", "ym", "yp")})
    ways = cut_geometry({"here": var("_here")} | {s: var(f"_{s}") for s in ("xm", "xp", "ym", "yp")})
    x = x.with_(inside=inside, vol=where(var("_here") < 0.0, maximum(ways["volume"], least), 0.0)).select(*field.columns, "vol", "inside")
    out = rhs(x, model, shape, dx, dy, source, aux, bc, mask="inside", volume=maximum(var("vol"), least), **scheme)
    return out.with_(**{f"r_{c}": where(var("inside") >= 0.5, var(f"r_{c}"), 0.0) for c in model.names})


def rhs_cached_speeds(field: Plan, model, shape, dx, dy, bc: Boundary = "periodic", limiter: str = "minmod", source=None, aux: list[str] | None = None) -> Plan:
    """HLL with each cell's speeds computed once; a face takes the bounds of its two cells."""
    u, aux = [var(c) for c in model.names], aux or []
    x, bounds = field, []
    for d, axis in enumerate(AXES):
        lo, hi = model.speeds(u, {a: var(a) for a in aux}, d)
        bounds += [f"_lo{axis}", f"_hi{axis}"]
        x = x.with_(**{f"_lo{axis}": lo, f"_hi{axis}": hi})

    def flux(y: Plan, d: int, at: int) -> Plan:
        left, right = face_states(model, limiter, at=at)
        a, b = f"_lo{AXES[d]}", f"_hi{AXES[d]}"
        sl, sr = minimum(var(_name(a, at)), var(_name(a, at + 1))), maximum(var(_name(b, at)), var(_name(b, at + 1)))
        y = y.with_(_sl=sl, _sr=sr, **{f"_l_{c}": e for c, e in zip(model.names, left)}, **{f"_r_{c}": e for c, e in zip(model.names, right)})
        ul, ur = ([var(f"_{s}_{c}") for c in model.names] for s in "lr")
        al, ar = ({c: var(_name(c, k + at)) for c in aux} for k in (0, 1))
        found = physics.hll_with_speeds(model, ul, al, ur, ar, d, var("_sl"), var("_sr"))
        return y.with_(**{f"_f_{c}": e for c, e in zip(model.names, found)})

    fluxes = _both_faces(x, model.names, shape, bc, _READS[limiter], flux, model.names, [*aux, *bounds])
    return rhs(field, model, shape, dx, dy, source, aux, bc, fluxes=fluxes)


def rhs_polar(field: Plan, model, shape, geometry, source=None, limiter: str = "none", riemann: str = "rusanov", bc: Boundary = ("foextrap", "periodic"), wall: bool = False, aux: list[str] | None = None, **scheme) -> Plan:
    """-(1/r) d(r F_r)/dr - (1/r) dF_theta/dtheta + S(u, r); the angle wraps.

    ``wall``: no flux through the ring's two ends, so that the sum of r u is kept.
    """
    x = face_fluxes(field, model, shape, limiter, riemann, bc, aux=aux, **scheme)
    r, lo, hi = geometry.r(), geometry.r_face(0), geometry.r_face(1)
    added = source([var(c) for c in model.names], r) if source else None
    out = {}
    for k, c in enumerate(model.names):
        f, g = var(f"fx_{c}"), var(f"gx_{c}")
        if wall:
            from fieldloom.operators.grid import index

            f, g = where(index("i") >= float(shape[0] - 1), 0.0, f), where(index("i") < 0.5, 0.0, g)
        value = -(hi * f - lo * g) / (r * geometry.dr) - (var(f"fy_{c}") - var(f"gy_{c}")) / (r * geometry.dt)
        out[f"r_{c}"] = value if added is None else value + added[k]
    return x.select(*field.columns, **out)


def global_speed_rhs(field: Plan, model, shape, dx, dy, speed: float, bc: Boundary = "periodic") -> Plan:
    """First order, with one given speed at every face."""

    def flux(x: Plan, d: int, at: int) -> Plan:
        ul, ur = ([var(_name(c, k + at)) for c in model.names] for k in (0, 1))
        fl, fr = model.flux(ul, {}, d), model.flux(ur, {}, d)
        return x.with_(**{f"_f_{c}": (a + b) * 0.5 - (r - left) * (0.5 * speed) for c, a, b, left, r in zip(model.names, fl, fr, ul, ur)})

    return rhs(field, model, shape, dx, dy, bc=bc, fluxes=_both_faces(field, model.names, shape, bc, (0, 1), flux, model.names, []))


def ratio(a: Expr, b: Expr) -> Expr:
    return safe_div(a, b)
