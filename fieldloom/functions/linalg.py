"""Small dense linear algebra per cell.

Two-by-two systems are closed forms, inside generated code. Larger ones are batched NumPy
over Arrow batches: one call per batch, never per row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.expr import Expr, const, maximum, minimum, safe_div, sqrt, where


def solve2(a: list[list[Expr]], b: list[Expr]) -> list[Expr]:
    """Cramer's rule; zero where the matrix is singular."""
    det = a[0][0] * a[1][1] - a[0][1] * a[1][0]
    return [safe_div(b[0] * a[1][1] - a[0][1] * b[1], det), safe_div(a[0][0] * b[1] - b[0] * a[1][0], det)]


def lorentz_inverse(w: Expr) -> list[list[Expr]]:
    """The inverse of [[1, -w], [w, 1]], w = theta dt B_z."""
    d = w * w + 1.0
    return [[const(1) / d, w / d], [-w / d, const(1) / d]]


def eig2(a: list[list[Expr]]) -> dict[str, Expr]:
    """``max_im, lmin, lmax, all_real`` of a two-by-two matrix."""
    half = (a[0][0] + a[1][1]) * 0.5
    disc = (a[0][0] - a[1][1]) * (a[0][0] - a[1][1]) * 0.25 + a[0][1] * a[1][0]
    root = sqrt(maximum(disc, 0.0))
    return {"max_im": sqrt(maximum(-disc, 0.0)), "lmin": half - root, "lmax": half + root, "all_real": where(disc >= 0.0, 1.0, 0.0)}


def _matrices(series) -> np.ndarray:
    return np.array([[list(r) for r in m] for m in series], dtype=np.float64)


def solve_dense(a: Column, b: Column) -> Column:
    """x of A x = b per row; a singular matrix gives nulls."""

    @F.pandas_udf("array<double>")
    def run(ms, vs):
        import pandas as pd

        if not len(ms):
            return pd.Series([], dtype=object)
        m, v = _matrices(ms), np.array([list(x) for x in vs], dtype=np.float64)
        with np.errstate(all="ignore"):
            bad = np.abs(np.linalg.det(m)) == 0
            m[bad] = np.eye(m.shape[1])
            x = np.linalg.solve(m, v[..., None])[..., 0]
        x[bad] = np.nan
        return pd.Series(list(x))

    return run(a, b)


def spectrum(a: Column, im_tol: float = 1e-5) -> Column:
    """``max_im, lmin, lmax, all_real`` of a square matrix per row; imaginary parts up to ``im_tol`` times
    one and the largest size count as none."""

    @F.pandas_udf("max_im double, lmin double, lmax double, all_real boolean")
    def run(ms):
        import pandas as pd

        if not len(ms):
            return pd.DataFrame({"max_im": [], "lmin": [], "lmax": [], "all_real": []})
        values = np.linalg.eigvals(_matrices(ms))
        im = np.abs(values.imag).max(axis=1)
        return pd.DataFrame({"max_im": im, "lmin": values.real.min(axis=1), "lmax": values.real.max(axis=1), "all_real": im <= im_tol * (1 + np.abs(values).max(axis=1))})

    return run(a)


def matrix_sign(a: np.ndarray, steps: int = 60, tolerance: float = 1e-12) -> np.ndarray:
    """The signs of a batch of matrices with real eigenvalues, by Newton's iteration; an eigenvalue of
    zero has none, so matrices that are singular give NaN."""
    s = a.astype(float).copy()
    with np.errstate(all="ignore"):
        bad = ~(np.abs(np.linalg.det(s)) > 1e-14 * np.maximum(np.abs(s).sum(-1).max(-1), 1e-300) ** s.shape[-1])
        s[bad] = np.eye(s.shape[-1])
        for _ in range(steps):
            new = 0.5 * (s + np.linalg.inv(s))
            moved = np.abs(new - s).max()
            s = new
            if moved <= tolerance:
                break
    s[bad] = np.nan
    return s


def matrix_sign_apply(a: np.ndarray, v: np.ndarray, steps: int = 60, tolerance: float = 1e-12) -> np.ndarray:
    """|A| v, from the sign of A; for flux Jacobians of any model."""
    return (matrix_sign(a[None], steps, tolerance)[0] @ a) @ v


def abs_apply(a: Column, v: Column) -> Column:
    """|A| v per row, batch by batch: the dissipation of Roe's flux from a flux Jacobian; nulls for a singular matrix."""

    @F.pandas_udf("array<double>")
    def run(ms, vs):
        import pandas as pd

        if not len(ms):
            return pd.Series([], dtype=object)
        m, x = _matrices(ms), np.array([list(r) for r in vs], dtype=np.float64)
        return pd.Series(list(np.einsum("rab,rbc,rc->ra", matrix_sign(m), m, x)))

    return run(a, v)


def inverse(a: Column) -> Column:
    """The inverse per row; nulls where there is none."""

    @F.pandas_udf("array<array<double>>")
    def run(ms):
        import pandas as pd

        if not len(ms):
            return pd.Series([], dtype=object)
        m = _matrices(ms)
        bad = np.abs(np.linalg.det(m)) == 0
        m[bad] = np.eye(m.shape[1])
        out = np.linalg.inv(m)
        out[bad] = np.nan
        return pd.Series([[list(r) for r in x] for x in out])

    return run(a)


def norm_inf(a: Column) -> Column:
    """The largest row sum of sizes, in generated code."""
    sums = F.transform(a, lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + F.abs(x)))
    return F.array_max(sums)


def newton_source(u: Column, rate, width: int, dt: float, steps: int | None = 2, eps: float = 6e-6, damping: float = 1.0, most: int = 200) -> Column:
    """Backward Euler u' = u + dt S(u') per cell: Newton steps with a Jacobian by central
    differences, for all cells of a batch at once.

    ``steps``: so many for each cell; None: until the cell has settled to rounding, ``most`` at most.
    ``rate`` maps an array of cells by components to the same shape. The result has the
    state, the last residual's norm and whether it is finite and, where steps aren't fixed, has settled.
    """

    def residual(x, start):
        return x - start - dt * rate(x)

    def step(x, start):
        jac = np.empty((len(x), width, width))
        for k in range(width):
            h = eps * np.maximum(1.0, np.abs(x[:, k]))
            up, down = x.copy(), x.copy()
            up[:, k] += h
            down[:, k] -= h
            jac[:, :, k] = -dt * (rate(up) - rate(down)) / (up[:, k] - down[:, k])[:, None]
        jac += np.eye(width)
        return damping * np.linalg.solve(jac, residual(x, start)[..., None])[..., 0]

    @F.pandas_udf("state array<double>, residual double, ok boolean")
    def run(cells):
        import pandas as pd

        if not len(cells):
            return pd.DataFrame({"state": pd.Series([], dtype=object), "residual": [], "ok": []})
        start = np.array([list(x) for x in cells], dtype=np.float64).reshape(-1, width)
        x = start.copy()
        going = np.arange(len(x))
        for _ in range(most if steps is None else steps):
            moved = step(x[going], start[going])
            x[going] -= moved
            if steps is None:
                going = going[~(np.abs(moved) <= 1e-13 * np.maximum(1.0, np.abs(x[going]))).all(axis=1)]
                # no step can better a residual that is rounding alone
                at, rest = x[going], np.abs(residual(x[going], start[going]))
                size = np.abs(at) + np.abs(start[going]) + np.abs(dt * rate(at))
                going = going[~(rest <= np.finfo(np.float64).eps * size).all(axis=1)]
                if not len(going):
                    break
        ok = np.isfinite(x).all(axis=1)
        if steps is None:
            ok[going] = False
        return pd.DataFrame({"state": list(x), "residual": np.abs(residual(x, start)).max(axis=1), "ok": ok})

    return run(u)


def clamp(x: Expr, lo: float, hi: float) -> Expr:
    return minimum(maximum(x, lo), hi)
