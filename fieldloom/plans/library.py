"""What the operations of a step program mean over field plans.

A ``Library`` knows the grid and each block's model, scheme, sources and linear operators.
States and rates are plans of ``i, j`` and the block's components; a field is a plan with one
column. Values of one program are brought together by joins on the cell, which Spark plans
as it does any; a step that is worth a single wide plan is in ``time``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce as fold
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.expr import Expr, abs_, const, maximum, total, var, where
from fieldloom.functions.linalg import lorentz_inverse
from fieldloom.operators import elliptic, fv, stencil
from fieldloom.plans.program import Machine
from fieldloom.plans.relation import Boundary, Given, Plan, derived_rules

#: Kinds of operators that a module can register.
OPERATOR_KINDS = ("local_source", "local_linear_operator", "grid_operator", "field_operator", "projection", "local_rate", "coupled_rate", "reduction", "riemann_solver", "diagnostic", "local_residual")

State = list[Expr]


@dataclass
class Block:
    """A block's model and how its rate is computed.

    ``sources`` and ``linear``: named functions of (state, aux), giving rates or a matrix.
    """

    model: Any
    bc: Boundary = "periodic"
    scheme: dict = field(default_factory=dict)
    sources: dict[str, Callable[[State, dict[str, Expr]], State]] = field(default_factory=dict)
    linear: dict[str, Callable[[dict[str, Expr]], list[list[Expr | float]]]] = field(default_factory=dict)
    projection: Callable[[State, dict[str, Expr]], State] | None = None
    aux: tuple[str, ...] = ()
    elliptic: Callable[[State], Expr] | None = None


def _columns(x: Plan) -> list[str]:
    return [c for c in x.columns if c not in ("i", "j")]


def _beside(plans: list[Plan]) -> tuple[Plan, list[list[str]]]:
    """One plan with the columns of all, renamed ``v{k}_{column}``; equal plans come once."""
    kept: list[Plan] = []
    places = []
    for p in plans:
        at = next((k for k, q in enumerate(kept) if q is p), None)
        if at is None:
            at = len(kept)
            kept.append(p)
        places.append(at)
    renamed = [p.select("i", "j", **{f"v{k}_{c}": var(c) for c in _columns(p)}) for k, p in enumerate(kept)]
    return fold(lambda a, b: a.join(b, ["i", "j"]), renamed), [[f"v{at}_{c}" for c in _columns(kept[at])] for at in places]


@dataclass
class Library:
    """Handlers for a ``Machine``."""

    spark: SparkSession
    shape: tuple[int, int]
    h: tuple[float, float]
    blocks: dict[str, Block]
    folder: str = ""
    solver: Callable[[Plan], Plan] | None = None  # the charge ``f`` to ``phi``
    couplings: dict[str, Callable[[dict[str, dict[str, Expr]]], dict[str, dict[str, Expr]]]] = field(default_factory=dict)
    aux: Plan | None = None  # static columns beside the solved ones
    cut_states: bool = True
    frozen: Any = field(default=None, repr=False)

    def machine(self, states: dict[str, Plan], **more: Any) -> Machine:
        """A machine over states whose blocks are found by their components."""
        names = [n for n in dir(self) if n.startswith("do_")]
        handlers = {n[3:]: getattr(self, n) for n in names}
        if self.cut_states:
            handlers["cut"] = self.cut
        self.current = dict(states)
        m = Machine(handlers, dict(states), **more)
        self.machine_ = m
        return m

    def cut(self, x: Any) -> Any:
        """The plan's rows, written, as a plan without a past."""
        if not isinstance(x, Plan):
            return x
        return Given(elliptic._cut(x.frame(self.spark, self.folder)))

    def block_of(self, x: Plan) -> tuple[str, Block]:
        names = _columns(x)
        found = [(n, b) for n, b in self.blocks.items() if list(b.model.names) == names]
        if not found:
            raise KeyError(f"no block has the components {names}")
        return found[0]

    def _with_aux(self, x: Plan, needed: tuple[str, ...] | list[str], fields: Plan | None) -> tuple[Plan, dict[str, Expr]]:
        for plan in (fields, self.aux):
            missing = [a for a in needed if a not in x.columns]
            have = [a for a in missing if plan is not None and a in plan.columns]
            if have:
                x = x.join(plan.select("i", "j", *have), ["i", "j"])
        if lacking := [a for a in needed if a not in x.columns]:
            raise KeyError(f"no auxiliary fields {lacking}; solve the fields or give them")
        return x, {a: var(a) for a in needed}

    # fields and rates

    def _charge(self, states: dict[str, Plan]) -> Plan:
        parts = []
        for name, b in self.blocks.items():
            if b.elliptic is not None and name in states:
                x = states[name]
                parts.append(x.select("i", "j", f=b.elliptic([var(c) for c in b.model.names])))
        if not parts:
            raise ValueError("no block has an elliptic right-hand side")
        x, names = _beside(parts)
        return x.select("i", "j", f=total([var(n[0]) for n in names]))

    def _fields(self, states: dict[str, Plan]) -> Plan:
        if self.solver is None:
            raise ValueError("the library has no field solver")
        phi = self.solver(self._charge(states))
        out = stencil.gradient(phi, "phi", self.shape, *self.h, bc="periodic", divide=True)
        return self.cut(out.select("i", "j", "phi", "grad_x", "grad_y"))

    def do_solve_fields(self, *states: Plan) -> Plan:
        return self._fields({self.block_of(x)[0]: x for x in states})

    def do_solve_fields_from_blocks(self, states: list[tuple[str, Plan]]) -> Plan:
        return self._fields({**self.machine_.blocks, **dict(states)})

    def do_rhs(self, state: Plan, fields: Plan | None = None, flux: bool = True, sources: tuple[str, ...] = ()) -> Plan:
        _, b = self.block_of(state)
        names = list(b.model.names)
        x, aux = self._with_aux(state, b.aux, fields)
        if flux:
            x = fv.rhs(x, b.model, self.shape, *self.h, bc=b.bc, aux=list(b.aux), **b.scheme)
        else:
            x = x.with_(**{f"r_{c}": const(0.0) for c in names})
        added = [b.sources[s]([var(c) for c in names], aux) for s in sources]
        return x.select("i", "j", **{c: total([var(f"r_{c}"), *[s[k] for s in added]]) for k, c in enumerate(names)})

    def do_source(self, name: str, state: Plan, fields: Plan | None = None) -> Plan:
        _, b = self.block_of(state)
        if name not in b.sources:
            raise KeyError(f"no source {name!r}")
        x, aux = self._with_aux(state, b.aux, fields)
        return x.select("i", "j", **dict(zip(b.model.names, b.sources[name]([var(c) for c in b.model.names], aux))))

    def _matrix(self, b: Block, name: str, state: Plan) -> tuple[Plan, list[list[Expr]]]:
        if name not in b.linear:
            raise KeyError(f"no linear operator {name!r}")
        x, aux = self._with_aux(state, b.aux, None)
        rows = b.linear[name](aux)
        return x, [[e if isinstance(e, Expr) else const(float(e)) for e in r] for r in rows]

    def do_apply(self, name: str, state: Plan) -> Plan:
        _, b = self.block_of(state)
        x, rows = self._matrix(b, name, state)
        return x.select("i", "j", **{c: total([e * var(d) for e, d in zip(r, b.model.names)]) for c, r in zip(b.model.names, rows)})

    def do_coupled_rate(self, name: str, states: list[tuple[str, Plan]]) -> dict[str, Plan]:
        if name not in self.couplings:
            raise KeyError(f"no coupling {name!r}")
        x, columns = _beside([p for _, p in states])
        named = {b: dict(zip(_columns(p), map(var, cs))) for (b, p), cs in zip(states, columns)}
        rates = self.couplings[name](named)
        return {b: x.select("i", "j", **{c: rates.get(b, {}).get(c, const(0.0)) for c in _columns(p)}) for b, p in states}

    # cells

    def do_linear_combine(self, terms: list[tuple[float, Plan]]) -> Plan:
        x, columns = _beside([p for _, p in terms])
        names = _columns(terms[0][1])
        if any(len(c) != len(names) for c in columns):
            raise ValueError("the values have different numbers of components")
        return x.select("i", "j", **{n: total([var(cs[k]) * float(a) for (a, _), cs in zip(terms, columns)]) for k, n in enumerate(names)})

    def do_project(self, state: Plan) -> Plan:
        from fieldloom.operators import cells

        _, b = self.block_of(state)
        x, _ = self._with_aux(state, b.aux, None)
        return cells.project(x, b.model, b.projection).select("i", "j", *b.model.names)

    def do_cell_compare(self, x: Plan, op: str, value: float) -> Plan:
        from fieldloom.operators import cells

        return cells.compare(x, _columns(x)[0], op, value, "mask").select("i", "j", "mask")

    def do_where(self, mask: Plan, a: Plan, b: Plan) -> Plan:
        x, (m, ca, cb) = _beside([mask, a, b])
        return x.select("i", "j", **{n: where(var(m[0]) >= 0.5, var(p), var(q)) for n, p, q in zip(_columns(a), ca, cb)})

    def do_solve_local_linear(self, name: str, rhs: Plan, a: float) -> Plan:
        """Two components or fewer in generated code, more by batched solves."""
        from fieldloom.functions.linalg import solve2, solve_dense

        _, b = self.block_of(rhs)
        names = list(b.model.names)
        x, rows = self._matrix(b, name, rhs)
        m = [[(const(1.0) if p == q else const(0.0)) - e * a for q, e in enumerate(r)] for p, r in enumerate(rows)]
        if len(names) == 1:
            return x.select("i", "j", **{names[0]: var(names[0]) / m[0][0]})
        if len(names) == 2:
            return x.select("i", "j", **dict(zip(names, solve2(m, [var(c) for c in names]))))
        df = x.frame(self.spark, self.folder)
        matrix = F.array(*[F.array(*[e.column() for e in r]) for r in m])
        done = df.select("i", "j", solve_dense(matrix, F.array(*names)).alias("x"))
        return Given(done.select("i", "j", *[F.col("x")[k].alias(c) for k, c in enumerate(names)]))

    def do_solve_local_nonlinear(self, guess: Plan, *others: Plan, residual: Callable, steps: int, tolerance: float) -> Plan:
        """``residual`` is over NumPy arrays of cells by components; a cell that doesn't settle is an error."""
        import numpy as np
        import pandas as pd

        x, columns = _beside([guess, *others])
        names, width = _columns(guess), [len(c) for c in columns]

        @F.pandas_udf("array<double>")
        def run(cells):
            if not len(cells):
                return pd.Series([], dtype=object)
            flat = np.array([list(r) for r in cells], float)
            parts = np.split(flat, np.cumsum(width)[:-1], axis=1)
            u, rest, n = parts[0].copy(), parts[1:], width[0]
            for _ in range(steps + 1):
                g = residual(u, *rest)
                if np.abs(g).max() <= tolerance:
                    return pd.Series(list(u))
                jac = np.empty((len(u), n, n))
                for k in range(n):
                    d = 1e-7 * np.maximum(1.0, np.abs(u[:, k]))
                    moved = u.copy()
                    moved[:, k] += d
                    jac[:, :, k] = (residual(moved, *rest) - g) / d[:, None]
                u = u - np.linalg.solve(jac, g[..., None])[..., 0]
            raise RuntimeError(f"Newton's method is at {np.abs(g).max():.3e} after {steps} steps")

        df = x.frame(self.spark, self.folder)
        done = df.select("i", "j", run(F.array(*[c for cs in columns for c in cs])).alias("x"))
        return Given(done.select("i", "j", *[F.col("x")[k].alias(c) for k, c in enumerate(names)]))

    # stencils and solves

    def do_scalar_field(self, value: float) -> Plan:
        from fieldloom.plans.relation import Grid

        return Grid(*self.shape).with_(x=const(float(value)))

    def do_component(self, x: Plan, name: str) -> Plan:
        return x.select("i", "j", x=var(name))

    def _one(self, x: Plan) -> Plan:
        names = _columns(x)
        if len(names) != 1:
            raise ValueError(f"needs one component, got {names}")
        return x.select("i", "j", x=var(names[0]))

    def _rule(self) -> Boundary:
        return next(iter(self.blocks.values())).bc if self.blocks else "periodic"

    def do_laplacian(self, x: Plan) -> Plan:
        return stencil.laplacian(self._one(x), "x", self.shape, *self.h, bc=derived_rules(self._rule()), out="lap").select("i", "j", x=var("lap"))

    def do_gradient(self, x: Plan) -> Plan:
        return stencil.gradient(self._one(x), "x", self.shape, *self.h, bc=derived_rules(self._rule()), divide=True).select("i", "j", "grad_x", "grad_y")

    def do_divergence(self, x: Plan) -> Plan:
        a, b = _columns(x)
        return stencil.divergence(x, a, b, self.shape, *self.h, bc=derived_rules(self._rule()), out="div").select("i", "j", x=var("div"))

    def do_apply_laplacian_coeff(self, x: Plan, coefficients: Plan) -> Plan:
        y = self._one(x).join(coefficients, ["i", "j"])
        return stencil.coefficient_operator(y, "x", self.shape, *self.h, bc=derived_rules(self._rule()), eps_x="eps_x", eps_y="eps_y", cross=("a_xy", "a_yx"), out="lap").select("i", "j", x=var("lap"))

    def do_rhs_jacvec(self, state: Plan, direction: Plan, fields: Plan | None = None, eps: float = 1e-6) -> Plan:
        """The rate at the state itself is computed once for all products."""
        if self.frozen is None or self.frozen[0] is not state or self.frozen[1] is not fields:
            kept = self.cut(state)
            self.frozen = (state, fields, kept, self.cut(self.do_rhs(kept, fields)))
        state, rate = self.frozen[2:]
        moved = self.do_linear_combine([(1.0, state), (eps, direction)])
        moved = moved.select("i", "j", **dict(zip(_columns(state), map(var, _columns(moved)))))
        return self.do_linear_combine([(1.0 / eps, self.do_rhs(moved, fields)), (-1.0 / eps, rate)]).select("i", "j", **{c: var(c) for c in _columns(state)})

    def do_solve_linear(self, operator: Callable[[Plan], Plan], rhs: Plan, method: str, tolerance: float, max_iter: int, **more: Any) -> Plan:
        """``rhs`` of one component; a solve that doesn't reach its tolerance raises."""
        name = _columns(rhs)[0]

        def op(df, c):
            x = Given(df.select("i", "j", F.col(c).alias(name)))
            y = operator(x)
            return y.select("i", "j", **{c: var(_columns(y)[0])}).frame(self.spark, self.folder)

        b = self._one(rhs).select("i", "j", b=var("x")).frame(self.spark, self.folder)
        done = elliptic.KRYLOV[method](op, b, tolerance=tolerance, max_iter=max_iter, **more)
        return Given(done.field.withColumnRenamed("x", name))

    # the condensed source stage: density first, then momenta, b_z among the auxiliary fields

    def _inverse(self, state: Plan, th_dt: float) -> tuple[Plan, list[list[Expr]], list[str]]:
        _, b = self.block_of(state)
        x, aux = self._with_aux(state, ("b_z",), None)
        x = x.with_(w_=aux["b_z"] * th_dt)
        return x, lorentz_inverse(var("w_")), list(b.model.names)

    def do_schur_coeffs(self, state: Plan, c: float, th_dt: float) -> Plan:
        x, inv, (rho, *_) = self._inverse(state, th_dt)
        k = var(rho) * c
        return x.select("i", "j", eps_x=k * inv[0][0] + 1.0, eps_y=k * inv[1][1] + 1.0, a_xy=k * inv[0][1], a_yx=k * inv[1][0])

    def do_schur_explicit_flux(self, state: Plan, th_dt: float) -> Plan:
        x, inv, (_, mx, my, *_) = self._inverse(state, th_dt)
        return x.select("i", "j", fx=inv[0][0] * var(mx) + inv[0][1] * var(my), fy=inv[1][0] * var(mx) + inv[1][1] * var(my))

    def do_schur_rhs(self, phi: Plan, state: Plan, th_dt: float, g: float) -> Plan:
        lap, div = self.do_laplacian(phi), self.do_divergence(self.do_schur_explicit_flux(state, th_dt))
        return self.do_linear_combine([(-1.0, lap), (-g, div)])

    def do_schur_reconstruct(self, state: Plan, phi: Plan, th_dt: float) -> Plan:
        grad = self.do_gradient(phi)
        x, inv, names = self._inverse(state, th_dt)
        x = x.join(grad, ["i", "j"])
        rho, mx, my = names[:3]
        px, py = var(mx) - var(rho) * var("grad_x") * th_dt, var(my) - var(rho) * var("grad_y") * th_dt
        return x.with_(**{mx: inv[0][0] * px + inv[0][1] * py, my: inv[1][0] * px + inv[1][1] * py}).select("i", "j", *names)

    def do_schur_energy(self, state: Plan, old: Plan) -> Plan:
        x, (new, was) = _beside([state, old])
        names = _columns(state)
        kinetic = [(var(c[1]) * var(c[1]) + var(c[2]) * var(c[2])) / var(c[0]) * 0.5 for c in (new, was)]
        return x.select("i", "j", **{n: var(c) for n, c in zip(names[:3], new)}, **{names[3]: var(was[3]) + (kinetic[0] - kinetic[1])})

    # scalars

    def do_reduce(self, x: Plan, other: Plan | None = None, kind: str = "sum") -> float:
        both, columns = _beside([x, other] if other is not None else [x])
        a, b = columns[0], columns[-1]
        df = both.frame(self.spark, self.folder)

        def terms(fn):
            return fold(lambda p, q: p + q, [fn(F.col(c), F.col(d)) for c, d in zip(a, b)])

        if kind in ("dot", "norm2"):
            found = df.agg(F.sum(terms(lambda p, q: p * q))).first()[0] or 0.0
            return found**0.5 if kind == "norm2" else found
        if kind == "sum":
            return df.agg(F.sum(terms(lambda p, _: p))).first()[0] or 0.0
        each = {"norm_inf": F.max, "max": F.max, "min": F.min}[kind]
        row = df.agg(*[each(F.abs(c) if kind == "norm_inf" else F.col(c)) for c in a]).first()
        return (min if kind == "min" else max)(row)

    def do_hmin(self) -> float:
        return min(self.h)

    def do_max_wave_speed(self, state: Plan, fields: Plan | None = None) -> float:
        _, b = self.block_of(state)
        x, aux = self._with_aux(state, b.aux, fields)
        u = [var(c) for c in b.model.names]
        speed = maximum(abs_(b.model.max_speed(u, aux, 0)), abs_(b.model.max_speed(u, aux, 1)))
        return x.select("i", "j", s=speed).frame(self.spark, self.folder).agg(F.max("s")).first()[0] or 0.0

    def do_cfl(self, state: Plan, fields: Plan | None = None, number: float = 0.5) -> float:
        return number * self.do_hmin() / max(self.do_max_wave_speed(state, fields), 1e-30)
