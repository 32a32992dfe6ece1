"""Time schemes recorded as step programs.

Each takes a program, a block and a step size and commits the block's next state; they name
operators and mention no physics. ``fields``: whether the block's fields are solved before
each rate.
"""

from __future__ import annotations

from fieldloom.plans.program import Program, Value
from fieldloom.plans.time import ADAMS, RK4, Tableau


def _rate(p: Program, u: Value, fields: bool, sources: tuple[str, ...], flux: bool = True) -> Value:
    return p.rhs(u, flux, sources, p.solve_fields(u) if fields else None)


def explicit_rk(p: Program, block: str, dt: float, tableau: Tableau = RK4, fields: bool = False, sources: tuple[str, ...] = ()) -> Value:
    u = p.state(block)
    rates: list[Value] = []
    for row in tableau.a:
        terms = [(dt * a, k) for a, k in zip(row, rates) if a]
        rates.append(_rate(p, p.linear_combine([(1.0, u), *terms]) if terms else u, fields, sources))
    out = p.linear_combine([(1.0, u), *[(dt * b, k) for b, k in zip(tableau.b, rates) if b]])
    p.commit(block, out)
    return out


def forward_euler(p: Program, block: str, dt: float, **more) -> Value:
    return explicit_rk(p, block, dt, Tableau(((),), (1.0,)), **more)


def rk4(p: Program, block: str, dt: float, **more) -> Value:
    return explicit_rk(p, block, dt, RK4, **more)


def ssprk(p: Program, block: str, dt: float, stages: int, fields: bool = False, sources: tuple[str, ...] = ()) -> Value:
    """Two or three stages: each a convex mean of the start and an Euler step."""
    mixes = {2: ((0.0, 1.0), (0.5, 0.5)), 3: ((0.0, 1.0), (0.75, 0.25), (1.0 / 3.0, 2.0 / 3.0))}[stages]
    start = u = p.state(block)
    for a, b in mixes:
        r = _rate(p, u, fields, sources)
        u = p.linear_combine([*([(a, start)] if a else []), (b, u), (b * dt, r)])
    p.commit(block, u)
    return u


def adams_bashforth(p: Program, block: str, dt: float, order: int, fields: bool = False, sources: tuple[str, ...] = ()) -> Value:
    """The first rate fills the whole history."""
    u, name = p.state(block), f"{block}.rate"
    p.store_history(name, _rate(p, u, fields, sources))
    out = p.linear_combine([(1.0, u), *[(dt * w, p.history(name, k)) for k, w in enumerate(ADAMS[order])]])
    p.commit(block, out)
    return out


def _bdf_terms(p: Program, block: str, u: Value, order: int) -> tuple[list[tuple[float, Value]], float]:
    """What the next state is compared with, and the factor of dt."""
    if order == 1:
        return [(1.0, u)], 1.0
    if order != 2:
        raise ValueError("the order is 1 or 2")
    p.store_history(f"{block}.U", u)
    return [(4.0 / 3.0, u), (-1.0 / 3.0, p.history(f"{block}.U", 1))], 2.0 / 3.0


def bdf_local_linear(p: Program, block: str, dt: float, order: int, linear: str, fields: bool = False, sources: tuple[str, ...] = (), flux: bool = True) -> Value:
    """Implicit in a linear source of each cell; flux and sources are taken from the last state."""
    u = p.state(block)
    terms, c = _bdf_terms(p, block, u, order)
    if flux or sources:
        terms = [*terms, (c * dt, _rate(p, u, fields and flux, sources, flux))]
    out = p.solve_local_linear(linear, p.linear_combine(terms), c * dt)
    p.commit(block, out)
    return out


def bdf_implicit_flux(p: Program, block: str, dt: float, order: int, newton: int = 3, tolerance: float = 1e-8, max_iter: int = 200, eps: float = 1e-7, fields: bool = False, sources: tuple[str, ...] = ()) -> Value:
    """Newton's method on U - terms - c dt R(U), each correction by GMRES over Jacobian products.

    The fields are solved once, from the last state. The last residual is recorded as
    ``{block}.bdf_residual``. For blocks of one component.
    """
    u = p.state(block)
    solved = p.solve_fields(u) if fields else None
    terms, c = _bdf_terms(p, block, u, order)

    def residual(x: Value, sign: float) -> Value:
        return p.linear_combine([(sign, x), *[(-sign * a, v) for a, v in terms], (-sign * c * dt, p.rhs(x, True, sources, solved))])

    x = u
    for _ in range(newton):
        body = p.inside()
        v = body.apply_in()
        body.apply_out(body.linear_combine([(1.0, v), (-c * dt, body.rhs_jacvec(x, v, eps, solved))]))
        step = p.solve_linear(p.matrix_free_operator(body), residual(x, -1.0), "gmres", tolerance=tolerance, max_iter=max_iter)
        x = p.linear_combine([(1.0, x), (1.0, step)])
    p.record_scalar(f"{block}.bdf_residual", p.reduce(residual(x, 1.0), "norm2"))
    p.commit(block, x)
    return x


def imex_local(p: Program, block: str, dt: float, linear: str, theta: float = 1.0, fields: bool = False, sources: tuple[str, ...] = (), flux: bool = True) -> Value:
    """(I - theta dt L) U' = U + dt R."""
    if not 0 < theta <= 1:
        raise ValueError("theta is above 0 and at most 1; without the implicit part take an explicit scheme")
    u = p.state(block)
    out = p.solve_local_linear(linear, p.linear_combine([(1.0, u), (dt, _rate(p, u, fields and flux, sources, flux))]), theta * dt)
    p.commit(block, out)
    return out


def imex_local_linear(p: Program, block: str, dt: float, explicit: str, implicit: str, fields: str | None = None, theta: float = 1.0) -> Value:
    """The same, by names of registered operators."""
    if not 0 < theta <= 1:
        raise ValueError("theta is above 0 and at most 1")
    u = p.state(block)
    r = p.call(explicit, u, *([p.call(fields, u)] if fields else []))
    out = p.solve_local_linear(implicit, p.linear_combine([(1.0, u), (dt, r)]), theta * dt)
    p.commit(block, out)
    return out


def predictor_corrector_local_linear(p: Program, block: str, dt: float, explicit: str, implicit: str, fields: str | None = None) -> Value:
    """A trapezoidal step with the linear part solved in each cell:

    U* = (I - dt L)^-1 (U + dt R);  U' = (I - dt/2 L)^-1 (U + dt/2 (R + R* + L U*)).
    """
    u = p.state(block)
    r = p.call(explicit, u, *([p.call(fields, u)] if fields else []))
    star = p.solve_local_linear(implicit, p.linear_combine([(1.0, u), (dt, r)]), dt)
    again = p.call(explicit, star, *([p.call(fields, star)] if fields else []))
    half = [(0.5 * dt, x) for x in (r, again, p.call(implicit, star))]
    out = p.solve_local_linear(implicit, p.linear_combine([(1.0, u), *half]), 0.5 * dt)
    p.commit(block, out)
    return out


def condensed_schur(p: Program, block: str, dt: float, alpha: float, theta: float = 0.5, phi: str = "phi", energy: bool = False, tolerance: float = 1e-8, max_iter: int = 400) -> Value:
    """The implicit electrostatic and magnetic source: the momentum is eliminated, one tensor
    problem for the potential is solved, the velocity put back and both taken to the new time."""
    if not 0 < theta <= 1:
        raise ValueError("theta is above 0 and at most 1")
    u, old = p.state(block), p.state(phi)
    th = theta * dt
    tensor = p.schur_coeffs(u, th * th * alpha, th)
    body = p.inside()
    x = body.apply_in()
    body.apply_out(body.linear_combine([(-1.0, body.apply_laplacian_coeff(x, tensor))]))
    solved = p.solve_linear(p.matrix_free_operator(body), p.schur_rhs(old, u, th, th * alpha), "bicgstab", tolerance=tolerance, max_iter=max_iter)
    moved = p.schur_reconstruct(u, solved, th)
    if theta != 1:
        moved = p.linear_combine([(1.0 / theta, moved), (1.0 - 1.0 / theta, u)])
        solved = p.linear_combine([(1.0 / theta, solved), (1.0 - 1.0 / theta, old)])
    if energy:
        moved = p.schur_energy(moved, u)
    p.commit(block, moved)
    p.commit(phi, solved)
    return moved
