"""Field problems as declared things: an equation, a solver, and how often to solve.

``div(eps grad phi) - kappa phi = f`` and its special cases: by transforms over lines or by a
Krylov method on grids of any size, or by multigrid in one task on a grid whose size is
checked. Which pairs fit is checked before anything runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expr import Expr, const, total, var
from fieldloom.operators import elliptic, lines
from fieldloom.operators.multigrid import BLOCK_CELLS, Stencil, VCycle
from fieldloom.operators.stencil import gradient
from fieldloom.plans.relation import Given, Plan
from fieldloom.streaming.schedule import Cache, Schedule


@dataclass(frozen=True)
class Term:
    """A part of the left-hand side."""


@dataclass(frozen=True)
class Laplacian(Term):
    factor: float = 1.0


@dataclass(frozen=True)
class Reaction(Term):
    kappa: float = 0.0


@dataclass(frozen=True)
class Anisotropic(Term):
    """div(eps grad phi) with coefficient columns per axis."""

    eps_x: str = "eps_x"
    eps_y: str = "eps_y"


@dataclass(frozen=True)
class FieldProblem:
    """``sum of terms (phi) = rhs``; ``bc`` for every side."""

    terms: tuple[Term, ...]
    rhs: Expr
    bc: object = "periodic"
    name: str = "phi"

    def inspect(self) -> str:
        return f"{self.name}: {' + '.join(type(t).__name__ for t in self.terms)} = {self.rhs.key()}"


def PoissonProblem(rhs: Expr, **more) -> FieldProblem:  # noqa: N802
    return FieldProblem((Laplacian(),), rhs, **more)


def ScreenedPoissonProblem(rhs: Expr, kappa: float, **more) -> FieldProblem:  # noqa: N802
    return FieldProblem((Laplacian(), Reaction(kappa)), rhs, **more)


def AnisotropicPoissonProblem(rhs: Expr, eps_x: str = "eps_x", eps_y: str = "eps_y", **more) -> FieldProblem:  # noqa: N802
    return FieldProblem((Anisotropic(eps_x, eps_y),), rhs, **more)


@dataclass(frozen=True)
class Solver:
    """What a solver can do; ``available`` says why a problem doesn't fit."""

    kind: str
    options: dict = field(default_factory=dict)

    def available(self, p: FieldProblem) -> str:
        kinds = {type(t) for t in p.terms}
        if self.kind == "fft" and (kinds != {Laplacian} or p.bc != "periodic"):
            return "the transform needs constant coefficients and a periodic grid"
        if self.kind in ("cg", "bicgstab", "gmres", "richardson") and "max_iter" not in self.options:
            return "iterative solvers need max_iter"
        return ""


def FFT(spectral: bool = False) -> Solver:  # noqa: N802
    return Solver("fft", {"spectral": spectral})


def GeometricMG(**options) -> Solver:  # noqa: N802
    return Solver("mg", options)


def Krylov(kind: str, **options) -> Solver:  # noqa: N802
    if kind not in elliptic.KRYLOV:
        raise ValueError(f"unknown method {kind!r}")
    return Solver(kind, options)


def _kappa(p: FieldProblem) -> float:
    return sum(t.kappa for t in p.terms if isinstance(t, Reaction))


def solve(p: FieldProblem, solver: Solver, cells: DataFrame, shape: tuple[int, int], h: float) -> DataFrame:
    """``i, j`` and the potential. ``cells`` has what the right-hand side reads."""
    if why := solver.available(p):
        raise ValueError(why)
    f = cells.select("i", "j", p.rhs.column().alias("f"), *[c for t in p.terms if isinstance(t, Anisotropic) for c in (t.eps_x, t.eps_y)])
    kappa, options = _kappa(p), solver.options
    if solver.kind == "fft":
        return lines.poisson(f, "f", shape, (h, h), options["spectral"], out=p.name)
    if solver.kind == "mg":
        if shape[0] * shape[1] > BLOCK_CELLS:
            raise ValueError(f"multigrid takes grids of at most {BLOCK_CELLS} cells, in one task; take the transform or a Krylov method")
        return _by_multigrid(p, VCycle(**options), f, shape, h, kappa)
    return elliptic.KRYLOV[solver.kind](_operator(p, f, shape, h), f.withColumn("b", -F.col("f")), **solver.options).field.withColumnRenamed("x", p.name)


def _by_multigrid(p: FieldProblem, cycle: VCycle, f: DataFrame, shape: tuple[int, int], h: float, kappa: float) -> DataFrame:
    """The grid as one block; its size was checked."""
    aniso = next((t for t in p.terms if isinstance(t, Anisotropic)), None)
    names = ["f", *([aniso.eps_x, aniso.eps_y] if aniso else [])]
    bc, out = p.bc, p.name

    def run(cells):
        import pandas as pd

        arrays = []
        for c in names:
            a = np.zeros(shape)
            a[cells["i"], cells["j"]] = cells[c]
            arrays.append(a)
        eps = {"eps_x": arrays[1], "eps_y": arrays[2]} if aniso else {}
        u = cycle.solve(Stencil(shape, (h, h), bc, kappa=kappa, **eps), arrays[0])
        return pd.DataFrame({"i": cells["i"], "j": cells["j"], out: u[cells["i"], cells["j"]]})

    return f.groupBy(F.lit(0).alias("all")).applyInPandas(lambda cells: run(cells), f"i int, j int, {out} double")


def _operator(p: FieldProblem, f: DataFrame, shape: tuple[int, int], h: float) -> elliptic.Operator:
    """Minus the left-hand side, which is positive definite."""
    from fieldloom.operators.stencil import coefficient_operator

    aniso = next((t for t in p.terms if isinstance(t, Anisotropic)), None)

    def op(df: DataFrame, c: str) -> DataFrame:
        eps = {}
        if aniso:
            df = df.select("i", "j", c).join(f.select("i", "j", aniso.eps_x, aniso.eps_y), ["i", "j"])
            eps = {"eps_x": aniso.eps_x, "eps_y": aniso.eps_y}
        plan = coefficient_operator(Given(df.select("i", "j", c, *eps.values())), c, shape, h, h, bc=p.bc, **eps)
        return plan.select("i", "j", **{c: var(c) * _kappa(p) - var("lap")}).frame(df.sparkSession, "")

    return op


@dataclass
class FieldSolve:
    """Right-hand side from all blocks, solve, potential and centred gradient, by a cadence.

    A block that is held still gives its last state. ``gauss`` is ``restart`` (solve each
    time) or ``evolve`` (solve once, then keep what the caller evolves).
    """

    problem: FieldProblem
    solver: Solver
    shape: tuple[int, int]
    h: float
    cadence: Schedule = field(default_factory=Schedule)
    gauss: str = "restart"
    cache: Cache = field(default_factory=Cache)

    def aux(self, blocks: dict[str, tuple[Plan, Expr]], spark, folder: str, step: int = 0) -> DataFrame:
        """``i, j, phi, grad_x, grad_y``; ``blocks`` give a field and its share of the right-hand side."""

        def compute(_dt: float) -> DataFrame:
            state: Plan | None = None
            for name, (plan, share) in blocks.items():
                x = plan.select("i", "j", **{f"share_{name}": share})
                state = x if state is None else state.join(x, ["i", "j"])
            cells = state.select("i", "j", f=total([var(f"share_{n}") for n in blocks])).frame(spark, folder)
            phi = solve(self.problem, self.solver, cells, self.shape, self.h)
            return gradient(Given(phi), self.problem.name, self.shape, self.h, self.h, divide=True).frame(spark, folder)

        if self.gauss == "evolve" and "fields" in self.cache.slots:
            return self.cache.slots["fields"].value
        return self.cache.run("fields", self.cadence, step, 0.0, compute)


#: The right-hand side of ``FieldSolve``: the sum of the blocks' shares.
RHS = var("f")
ZERO = const(0)
