"""Elliptic solvers.

Four ways:

* ``dft_poisson``: separable transforms as joins with a table of angles and sums; relational
  throughout, exact, for small grids and checks.
* ``lines.poisson`` and ``lines.polar_poisson``: transforms line by line, two or three shuffles
  whatever the size.
* ``krylov``: matrix-free Richardson, CG, BiCGStab and GMRES over DataFrames, with
  preconditioners. One pass gives all scalars of an iteration; each iterate is written to
  the shared folder. A method that doesn't reach its tolerance raises.
* ``solve_blocks``: one NumPy solver per block of a field (one row group per block), for
  multigrid and tensor operators on blocks that fit a task, which is checked.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expr import Expr, const, var, where
from fieldloom.plans.relation import Plan, raw
from fieldloom.sources.tables import Trail, cut


def _angle(fn: str, a: str, b: str, n: int) -> Expr:
    arg = f"6.283185307179586 * ({a} * {b} % {n}) / {n}"
    return raw(f"{fn}(cast({arg} as double))", f"{fn}(({arg})::DOUBLE)")


def _transform(x: Plan, kept: str, old: str, new: str, n: int, sign: float) -> Plan:
    """Sums of (re + i im) exp(sign 2 pi i old new / n) over ``old``."""
    y = x.explode(new, list(range(n)))
    c, s = _angle("cos", old, new, n), _angle("sin", old, new, n) * sign
    y = y.select(kept, new, a=var("re") * c - var("im") * s, b=var("re") * s + var("im") * c)
    return y.group([kept, new], re=("sum", "a"), im=("sum", "b"))


def dft_poisson(field: Plan, f: str, n: int, h: float, spectral: bool = False, kappa: float = 0.0) -> Plan:
    """``phi`` of (Laplacian - kappa) phi = f on a periodic n x n grid; without kappa mode zero is dropped.

    The symbol is that of the five-point operator, or the continuous one.
    """
    x = _transform(field.select("i", "j", re=var(f), im=const(0)), "i", "j", "q", n, -1.0)
    x = _transform(x, "q", "i", "p", n, -1.0)
    if spectral:
        def part(k: str) -> str:
            return f"pow(6.283185307179586 / {n * h!r} * (CASE WHEN {k} * 2 > {n} THEN {k} - {n} ELSE {k} END), 2)"

        symbol = f"-({part('p')} + {part('q')}) - {kappa!r}"
    else:
        symbol = f"(2 * cos(6.283185307179586 * p / {n}) + 2 * cos(6.283185307179586 * q / {n}) - 4) / {h * h!r} - {kappa!r}"
    lam = raw(f"cast({symbol} as double)", f"({symbol})::DOUBLE")
    x = x.with_(lam=lam)
    small = (var("lam") < 1e-14) & (var("lam") > -1e-14)
    x = x.select("p", "q", **{c: where(small, 0.0, var(c) / where(small, 1.0, var("lam"))) for c in ("re", "im")})
    x = _transform(x, "q", "p", "i", n, 1.0)
    x = _transform(x, "i", "q", "j", n, 1.0)
    return x.select("i", "j", phi=var("re") / float(n * n))


# NumPy solvers of one block


def laplace(u: np.ndarray, h: float) -> np.ndarray:
    return (np.roll(u, 1, 0) + np.roll(u, -1, 0) + np.roll(u, 1, 1) + np.roll(u, -1, 1) - 4 * u) / (h * h)


def fft_poisson(f: np.ndarray, h: float, spectral: bool = False) -> np.ndarray:
    nx, ny = f.shape
    if spectral:
        kx, ky = 2 * np.pi * np.fft.fftfreq(nx, h), 2 * np.pi * np.fft.fftfreq(ny, h)
        lam = -(kx[:, None] ** 2 + ky[None, :] ** 2)
    else:
        lam = (2 * np.cos(2 * np.pi * np.arange(nx) / nx)[:, None] + 2 * np.cos(2 * np.pi * np.arange(ny) / ny)[None, :] - 4) / (h * h)
    hat = np.fft.fft2(f)
    zero = np.abs(lam) < 1e-14
    return np.real(np.fft.ifft2(np.where(zero, 0, hat / np.where(zero, 1, lam))))


def red_black(u: np.ndarray, f: np.ndarray, h: float, sweeps: int, kappa: float = 0.0) -> np.ndarray:
    """Gauss-Seidel sweeps of u (changed in place), red cells first."""
    color = np.add.outer(np.arange(u.shape[0]), np.arange(u.shape[1])) % 2
    diag = 4 / (h * h) + kappa
    for _ in range(sweeps):
        for c in (0, 1):
            off = (np.roll(u, 1, 0) + np.roll(u, -1, 0) + np.roll(u, 1, 1) + np.roll(u, -1, 1)) / (h * h)
            u[color == c] = ((off - f) / diag)[color == c]
    return u


@dataclass
class Multigrid:
    """V cycles over a periodic block: averages down, constants up."""

    rel: float = 1e-8
    absolute: float = 0.0
    cycles: int = 50
    before: int = 2
    after: int = 2
    bottom: int = 50
    least: int = 2
    kappa: float = 0.0

    def _cycle(self, u: np.ndarray, f: np.ndarray, h: float) -> np.ndarray:
        nx, ny = u.shape
        if nx % 2 or ny % 2 or min(nx, ny) // 2 < self.least:
            return red_black(u, f, h, self.bottom, self.kappa)
        red_black(u, f, h, self.before, self.kappa)
        r = f - laplace(u, h) + self.kappa * u
        coarse = r.reshape(nx // 2, 2, ny // 2, 2).mean(axis=(1, 3))
        e = self._cycle(np.zeros_like(coarse), coarse, 2 * h)
        u += np.repeat(np.repeat(e, 2, 0), 2, 1)
        return red_black(u, f, h, self.after, self.kappa)

    def solve(self, f: np.ndarray, h: float, start: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
        """phi, cycles and the last residual; a periodic f is made zero-mean."""
        f = f - f.mean() if not self.kappa else f
        u = np.zeros_like(f) if start is None else start.copy()
        first = np.abs(f - laplace(u, h) + self.kappa * u).max()
        now = first
        for k in range(self.cycles):
            if now <= max(self.rel * first, self.absolute):
                return u, k, float(now)
            u = self._cycle(u, f, h)
            if not self.kappa:
                u -= u.mean()
            now = np.abs(f - laplace(u, h) + self.kappa * u).max()
        return u, self.cycles, float(now)

    def solve_robust(self, f: np.ndarray, h: float) -> tuple[np.ndarray, int, float]:
        """Doubles the smoothing, from zero, until the residual falls; at most 64 sweeps."""
        tried = self
        while True:
            u, k, r = tried.solve(f, h)
            if np.isfinite(r) and (k < tried.cycles or tried.before >= 64):
                return u, k, r
            if tried.before >= 64:
                raise RuntimeError("multigrid diverges")
            tried = Multigrid(**{**tried.__dict__, "before": tried.before * 2, "after": tried.after * 2})


def polar_poisson(f: np.ndarray, r0: float, r1: float) -> np.ndarray:
    """(1/r) d(r dphi/dr)/dr + (1/r^2) d2phi/dtheta2 = f on a ring, zero at both radii.

    The angle by FFT with the continuous symbol, each mode by a tridiagonal solve.
    """
    if r0 <= 0:
        raise ValueError("only rings: the inner radius must be positive")
    nr, nt = f.shape
    dr = (r1 - r0) / nr
    r = r0 + (np.arange(nr) + 0.5) * dr
    lo, hi = r - dr / 2, r + dr / 2
    hat = np.fft.fft(f, axis=1)
    m = np.fft.fftfreq(nt, 1 / nt)
    a, c = lo / (r * dr * dr), hi / (r * dr * dr)
    out = np.empty_like(hat)
    for k in range(nt):
        b = -(a + c) - m[k] ** 2 / r**2
        b[0] -= a[0]
        b[-1] -= c[-1]
        out[:, k] = thomas(a, b, c, hat[:, k])
    return np.real(np.fft.ifft(out, axis=1))


def thomas(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Tridiagonal solve: a below, b on, c above the diagonal."""
    n = len(b)
    cp, dp = np.zeros(n, d.dtype), np.zeros(n, d.dtype)
    cp[0], dp[0] = c[0] / b[0], d[0] / b[0]
    for k in range(1, n):
        w = b[k] - a[k] * cp[k - 1]
        cp[k], dp[k] = c[k] / w, (d[k] - a[k] * dp[k - 1]) / w
    for k in range(n - 2, -1, -1):
        dp[k] -= cp[k] * dp[k + 1]
    return dp


def fac_two_level(f: np.ndarray, fine_f: np.ndarray, at: tuple[int, int], h: float, rounds: int = 12, sweeps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Composite solve of a periodic coarse block and one fine box with its low corner over coarse cell ``at``.

    Each round smooths the box under bilinear ghost values, averages it down, and corrects
    both levels by a coarse solve of the composite residual, in which coarse cells at the
    border see the mean of the fine fluxes through their face.
    """
    ni, nj = fine_f.shape[0] // 2, fine_f.shape[1] // 2
    (a, b), half = at, h / 2
    rows, cols = slice(a, a + ni), slice(b, b + nj)

    def down(x: np.ndarray) -> np.ndarray:
        return x.reshape(ni, 2, nj, 2).mean(axis=(1, 3))

    f = _with(f, rows, cols, down(fine_f))
    f, fine_f = f - f.mean(), fine_f - f.mean()
    phi = Multigrid(rel=1e-10).solve(f, h)[0]
    # Fine cells with one ring of ghosts, at places in units of coarse cells.
    x = a + (np.arange(2 * ni + 2) - 0.5) / 2 - 0.5
    y = b + (np.arange(2 * nj + 2) - 0.5) / 2 - 0.5
    fine = _bilinear(phi, x, y)[1:-1, 1:-1]
    color = np.add.outer(np.arange(2 * ni), np.arange(2 * nj)) % 2
    for _ in range(rounds):
        box = _bilinear(phi, x, y)
        box[1:-1, 1:-1] = fine

        def near(q: np.ndarray) -> np.ndarray:
            return q[2:, 1:-1] + q[:-2, 1:-1] + q[1:-1, 2:] + q[1:-1, :-2]

        for _ in range(sweeps):
            for c in (0, 1):
                box[1:-1, 1:-1] = np.where(color == c, (near(box) - half * half * fine_f) / 4, box[1:-1, 1:-1])
        fine = box[1:-1, 1:-1].copy()
        phi[rows, cols] = down(fine)
        r = f - laplace(phi, h)
        pairs = (
            (phi[a, cols] - phi[a - 1, cols], box[1, 1:-1] - box[0, 1:-1], (a - 1, cols)),
            (phi[a + ni - 1, cols] - phi[(a + ni) % len(phi), cols], box[-2, 1:-1] - box[-1, 1:-1], ((a + ni) % len(phi), cols)),
            (phi[rows, b] - phi[rows, b - 1], box[1:-1, 1] - box[1:-1, 0], (rows, b - 1)),
            (phi[rows, b + nj - 1] - phi[rows, (b + nj) % phi.shape[1]], box[1:-1, -2] - box[1:-1, -1], (rows, (b + nj) % phi.shape[1])),
        )
        for coarse, finer, where_ in pairs:
            r[where_] -= ((finer / half).reshape(-1, 2).mean(axis=1) - coarse / h) / h
        r[rows, cols] = down(fine_f - (near(box) - 4 * fine) / (half * half))
        e = Multigrid(rel=1e-8).solve(r, h)[0]
        phi = phi + e
        fine = fine + _bilinear(e, x, y)[1:-1, 1:-1]
    phi[rows, cols] = down(fine)
    return phi - phi.mean(), fine - phi.mean()


def _with(a: np.ndarray, rows: slice, cols: slice, part: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[rows, cols] = part
    return out


def _bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at all pairs of places, from the four nearest cells of a periodic block."""
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    s, t = (x - i)[:, None], (y - j)[None, :]
    n, m = a.shape

    def at(di: int, dj: int) -> np.ndarray:
        return a[np.ix_((i + di) % n, (j + dj) % m)]

    return (1 - s) * (1 - t) * at(0, 0) + s * (1 - t) * at(1, 0) + (1 - s) * t * at(0, 1) + s * t * at(1, 1)


def solve_blocks(df: DataFrame, c: str, solver: Callable[[np.ndarray], np.ndarray], out: str = "phi", key: str = "box_id") -> DataFrame:
    """``solver`` over each block's array of column ``c``; blocks are rows of one ``key``, cells ``i, j``.

    A block is one group, and must fit a task; it is the unit of the layout. One of more than
    ``BLOCK_CELLS`` cells is an error.
    """
    from fieldloom.operators.multigrid import BLOCK_CELLS

    def run(cells):
        import pandas as pd

        if len(cells) > BLOCK_CELLS:
            raise ValueError(f"a block of {len(cells)} cells is above the {BLOCK_CELLS} that one task solves")
        i, j = cells["i"] - cells["i"].min(), cells["j"] - cells["j"].min()
        a = np.zeros((i.max() + 1, j.max() + 1))
        a[i, j] = cells[c]
        return pd.DataFrame({key: cells[key], "i": cells["i"], "j": cells["j"], out: solver(a)[i, j]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "i", "j", c).groupBy(key).applyInPandas(run, f"{key} {kind}, i int, j int, {out} double")


# Krylov methods over DataFrames

Operator = Callable[[DataFrame, str], DataFrame]


@dataclass
class Solved:
    """The solution's rows (``i, j, x``), iterations and the last residual norm."""

    field: DataFrame
    iterations: int
    residual: float


def _cut(df: DataFrame) -> DataFrame:
    return cut(df)


def _sums(df: DataFrame, **pairs: tuple[str, str]) -> dict[str, float]:
    found = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for n, (a, b) in pairs.items()]).first().asDict()
    return {n: x or 0.0 for n, x in found.items()}


def _applied(df: DataFrame, op: Operator | None, c: str, out: str) -> DataFrame:
    """``op(df, c)`` gives ``i, j`` and a column named ``c``; joined on as ``out``. None is the identity."""
    if op is None:
        return df.withColumn(out, F.col(c))
    done = op(df.select("i", "j", F.col(c).alias("x")), "x").select("i", "j", F.col("x").alias(out))
    return df.join(done, ["i", "j"])


def _end(what: str, at: DataFrame, k: int, norm: float, met: bool, strict: bool) -> Solved:
    found = Solved(at.select("i", "j", "x"), k, norm)
    if strict and not met:
        from fieldloom.operators.multigrid import NotConvergedError

        raise NotConvergedError(what, k, norm, found.field)
    return found


def conjugate_gradient(op: Operator, rhs: DataFrame, tolerance: float = 1e-8, max_iter: int = 200, precondition: Operator | None = None, strict: bool = True) -> Solved:
    """For symmetric positive operators; ``rhs`` has ``i, j, b``."""
    trail = Trail()
    at = rhs.select("i", "j", F.lit(0.0).alias("x"), F.col("b").alias("r"))
    at = trail.cut(_applied(at, precondition, "r", "z").withColumn("p", F.col("z")))
    d = _sums(at, rr=("r", "r"), rz=("r", "z"))
    stop = tolerance * math.sqrt(d["rr"])
    for k in range(max_iter):
        if math.sqrt(d["rr"]) <= stop:
            return _end("CG", at, k, math.sqrt(d["rr"]), True, strict)
        with_ap = trail.cut(_applied(at, op, "p", "ap"))
        pap = _sums(with_ap, pap=("p", "ap"))["pap"]
        if pap <= 0:  # not positive definite, or p is lost to rounding
            return _end("CG (a direction of no positive energy)", at, k, math.sqrt(d["rr"]), False, strict)
        alpha = d["rz"] / pap
        x, r = F.col("x") + alpha * F.col("p"), F.col("r") - alpha * F.col("ap")
        moved = with_ap.select("i", "j", x.alias("x"), r.alias("r"), "p")
        moved = trail.cut(_applied(moved, precondition, "r", "z")) if precondition else _applied(moved, None, "r", "z")
        new = _sums(moved, rr=("r", "r"), rz=("r", "z"))
        at = trail.cut(moved.withColumn("p", F.col("z") + (new["rz"] / d["rz"] if d["rz"] else 0.0) * F.col("p")))
        trail.keep(rhs.sparkSession)
        d = new
    return _end("CG", at, max_iter, math.sqrt(d["rr"]), math.sqrt(d["rr"]) <= stop, strict)


def richardson(op: Operator, rhs: DataFrame, omega: float, tolerance: float = 1e-8, max_iter: int = 200, precondition: Operator | None = None, strict: bool = True) -> Solved:
    """x += omega M (b - A x)."""
    trail = Trail()
    at = trail.cut(rhs.select("i", "j", "b", F.lit(0.0).alias("x")))
    first = norm = None
    for k in range(max_iter + 1):
        with_ax = _applied(at, op, "x", "ax").withColumn("r", F.col("b") - F.col("ax"))
        at = trail.cut(_applied(with_ax.select("i", "j", "b", "x", "r"), precondition, "r", "z"))
        trail.keep(rhs.sparkSession)
        norm = math.sqrt(_sums(at, rr=("r", "r"))["rr"])
        first = norm if first is None else first
        if norm <= tolerance * first or k == max_iter:
            return _end("Richardson", at, k, norm, norm <= tolerance * first, strict)
        at = at.select("i", "j", "b", (F.col("x") + omega * F.col("z")).alias("x"))
    raise AssertionError


def bicgstab(op: Operator, rhs: DataFrame, tolerance: float = 1e-8, max_iter: int = 200, precondition: Operator | None = None, strict: bool = True) -> Solved:
    """For general operators; a breakdown starts anew from the last iterate."""
    trail = Trail()
    b = F.col("b")
    at = trail.cut(rhs.select("i", "j", F.lit(0.0).alias("x"), b.alias("r"), b.alias("s0"), b.alias("p")))
    rho = rr = _sums(at, rr=("r", "r"))["rr"]
    stop = tolerance * math.sqrt(rr)
    for k in range(max_iter):
        if math.sqrt(rr) <= stop:
            return _end("BiCGStab", at, k, math.sqrt(rr), True, strict)
        ready = trail.cut(_applied(at, precondition, "p", "y")) if precondition else _applied(at, None, "p", "y")
        one = trail.cut(_applied(ready, op, "y", "v"))
        d = _sums(one, d=("s0", "v"))["d"]
        if d == 0:
            at = trail.cut(at.select("i", "j", "x", "r", F.col("r").alias("s0"), F.col("r").alias("p")))
            rho = rr
            continue
        alpha = rho / d
        half = one.withColumn("s", F.col("r") - alpha * F.col("v"))
        half = trail.cut(_applied(half, precondition, "s", "z")) if precondition else _applied(half, None, "s", "z")
        two = trail.cut(_applied(half, op, "z", "t"))
        d = _sums(two, ts=("t", "s"), tt=("t", "t"))
        omega = d["ts"] / d["tt"] if d["tt"] else 0.0
        x = F.col("x") + alpha * F.col("y") + omega * F.col("z")
        three = two.select("i", "j", x.alias("x"), (F.col("s") - omega * F.col("t")).alias("r"), "s0", "p", "v")
        d = _sums(three, rr=("r", "r"), rho=("s0", "r"))
        if omega and rho and d["rho"]:
            beta = d["rho"] / rho * alpha / omega
            at = trail.cut(three.select("i", "j", "x", "r", "s0", (F.col("r") + beta * (F.col("p") - omega * F.col("v"))).alias("p")))
            rho, rr = d["rho"], d["rr"]
        else:
            at = trail.cut(three.select("i", "j", "x", "r", F.col("r").alias("s0"), F.col("r").alias("p")))
            rho = rr = d["rr"]
        trail.keep(rhs.sparkSession)
    return _end("BiCGStab", at, max_iter, math.sqrt(rr), math.sqrt(rr) <= stop, strict)


def gmres(op: Operator, rhs: DataFrame, restart: int = 30, tolerance: float = 1e-8, max_iter: int = 200, precondition: Operator | None = None, strict: bool = True) -> Solved:
    """Restarted, preconditioned from the right; the basis is columns of one DataFrame, so a
    step's products are one pass."""
    trail = Trail()
    x = trail.cut(rhs.select("i", "j", "b", F.lit(0.0).alias("x")))
    first, done = None, 0
    while True:
        at = trail.cut(_applied(x, op, "x", "ax").select("i", "j", "b", "x", (F.col("b") - F.col("ax")).alias("r")))
        beta = math.sqrt(_sums(at, rr=("r", "r"))["rr"])
        first = beta if first is None else first
        if beta <= tolerance * first or done >= max_iter:
            return _end("GMRES", at, done, beta, beta <= tolerance * first, strict)
        at = at.withColumn("v0", F.col("r") / beta)
        h = np.zeros((restart + 1, restart))
        m = 0
        for k in range(restart):
            at = trail.cut(_applied(at, precondition, f"v{k}", f"z{k}")) if precondition else _applied(at, None, f"v{k}", f"z{k}")
            at = trail.cut(_applied(at, op, f"z{k}", "w"))
            d = _sums(at, **{f"h{q}": ("w", f"v{q}") for q in range(k + 1)})
            w = F.col("w")
            for q in range(k + 1):
                h[q, k] = d[f"h{q}"]
                w = w - float(h[q, k]) * F.col(f"v{q}")
            at = trail.cut(at.withColumn("w", w))
            trail.keep(rhs.sparkSession)
            h[k + 1, k] = math.sqrt(_sums(at, ww=("w", "w"))["ww"])
            m, done = k + 1, done + 1
            e = np.zeros(m + 1)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: m + 1, :m], e, rcond=None)
            left = np.linalg.norm(e - h[: m + 1, :m] @ y)
            if left <= tolerance * first or h[k + 1, k] < 1e-14 or done >= max_iter:
                break
            at = at.withColumn(f"v{m}", F.col("w") / float(h[k + 1, k])).drop("w")
        step = F.col("x")
        for q in range(m):
            step = step + float(y[q]) * F.col(f"z{q}")
        x = at.select("i", "j", "b", step.alias("x"))


class SolverContext:
    """What an iterative method of one's own is written with, over named columns of one DataFrame.

    ``cut`` ends an iteration: the table is written and older ones are deleted.
    """

    def __init__(self, op: Operator, rhs: DataFrame, precondition: Operator | None = None):
        self.op, self.before, self.trail = op, precondition, Trail()
        self.at = rhs.select("i", "j", "b", F.lit(0.0).alias("x"))

    def set(self, **columns) -> None:
        self.at = self.at.withColumns(columns)

    def combine(self, out: str, *terms: tuple[float, str]) -> None:
        """out = sum of a * column."""
        self.set(**{out: sum((F.lit(float(a)) * F.col(c) for a, c in terms), F.lit(0.0))})

    def apply(self, c: str, out: str) -> None:
        self.cut()
        self.at = _applied(self.at, self.op, c, out)
        self.cut()

    def precondition(self, c: str, out: str) -> None:
        self.at = _applied(self.at, self.before, c, out)

    def dots(self, **pairs: tuple[str, str]) -> dict[str, float]:
        """Several products in one pass."""
        return _sums(self.at, **pairs)

    def norm2(self, c: str) -> float:
        return math.sqrt(self.dots(n=(c, c))["n"])

    def cut(self) -> None:
        self.at = self.trail.cut(self.at)
        self.trail.keep(self.at.sparkSession)


def register_solver(name: str, method: Callable[[SolverContext, float, int], tuple[int, float]]) -> None:
    """A method ``(context, tolerance, max_iter) -> (iterations, residual)`` that leaves its result in ``x``."""
    if name in KRYLOV:
        raise ValueError(f"{name!r} is taken")

    def run(op, rhs, tolerance=1e-8, max_iter=200, precondition=None, strict=True):
        c = SolverContext(op, rhs, precondition)
        k, r = method(c, tolerance, max_iter)
        return _end(name, c.at, k, r, r <= tolerance * c.norm2("b"), strict)

    KRYLOV[name] = run


KRYLOV = {"cg": conjugate_gradient, "bicgstab": bicgstab, "gmres": gmres, "richardson": richardson}


def periodic_operator(shape: tuple[int, int], h: float, kappa: float = 0.0, sign: float = -1.0) -> Operator:
    """sign * Laplacian + kappa, as an operator over DataFrames."""
    from fieldloom.operators.stencil import laplacian
    from fieldloom.plans.relation import Given

    def op(df: DataFrame, c: str) -> DataFrame:
        plan = laplacian(Given(df.select("i", "j", c)), c, shape, h, h)
        return plan.select("i", "j", **{c: var("lap") * sign + var(c) * kappa}).frame(df.sparkSession, "")

    return op
