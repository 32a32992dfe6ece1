"""Work on whole lines of a grid, many lines at once: transforms and tridiagonal solves.

A line is all cells that share one index. Rows are shuffled by that index and sorted within
partitions; Arrow batches are cut at line ends, and each task works on as many whole lines as
a batch holds. So a task's memory is a batch and a line, whatever the number of lines, and
a two-dimensional transform is two passes with one shuffle each, as a transpose would be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Takes the lines' indices and, per column, an array of lines by places; gives arrays alike.
LineWork = Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]


def on_lines(df: DataFrame, line: str, place: str, n: int, columns: list[str], work: LineWork, out: list[str] | None = None, to: str | None = None) -> DataFrame:
    """``line``, ``place`` and the results, in columns ``out`` (default: ``columns``).

    Each line needs all of its ``n`` places, 0 to n - 1. ``to``: a new name for the places.
    """
    out, to = out or columns, to or place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(rows: list[np.ndarray], whole: int) -> pa.RecordBatch:
            keys, places = rows[0][:whole].reshape(-1, n), rows[1][:whole].reshape(-1, n)
            if (keys != keys[:, :1]).any() or (places != np.arange(n)).any():
                raise ValueError(f"a line along {place!r} lacks cells, or has some twice")
            found = work(keys[:, 0], [x[:whole].reshape(-1, n) for x in rows[2:]])
            arrays = [pa.array(x[:whole].astype(np.int32)) for x in rows[:2]] + [pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()) for x in found]
            return pa.RecordBatch.from_arrays(arrays, names=[line, to, *out])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            whole = len(held[0]) // n * n
            if whole:
                yield done(held, whole)
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            raise ValueError(f"a line along {place!r} lacks cells")

    rows = df.select(line, place, *columns).repartition(line).sortWithinPartitions(line, place)
    return rows.mapInArrow(run, ", ".join([f"{line} int", f"{to} int", *(f"{c} double" for c in out)]))


def _parts(z: np.ndarray) -> list[np.ndarray]:
    return [z.real, z.imag]


def symbol(k: np.ndarray, n: int, h: float, spectral: bool) -> np.ndarray:
    """The second difference's factor of mode k, or that of the second derivative."""
    if spectral:
        wave = 2 * np.pi / (n * h) * np.where(2 * k > n, k - n, k)
        return -(wave**2)
    return (2 * np.cos(2 * np.pi * k / n) - 2) / (h * h)


def poisson(df: DataFrame, c: str, shape: tuple[int, int], h: tuple[float, float], spectral: bool = False, kappa: float = 0.0, out: str = "phi") -> DataFrame:
    """``i, j`` and the solution of (Laplacian - kappa) phi = f on a periodic grid of any size.

    Three shuffles: by j, by mode, and by j again. Without ``kappa`` the mean mode is dropped.
    """
    (nx, ny), (dx, dy) = shape, h

    def forward(_, a):
        return _parts(np.fft.fft(a[0], axis=1))

    def solve(p, a):
        hat = np.fft.fft(a[0] + 1j * a[1], axis=1)
        lam = symbol(p, nx, dx, spectral)[:, None] + symbol(np.arange(ny), ny, dy, spectral)[None, :] - kappa
        zero = np.abs(lam) < 1e-14
        return _parts(np.fft.ifft(np.where(zero, 0, hat / np.where(zero, 1, lam)), axis=1))

    def back(_, a):
        return [np.fft.ifft(a[0] + 1j * a[1], axis=1).real]

    x = on_lines(df, "j", "i", nx, [c], forward, ["re", "im"], to="p")
    x = on_lines(x, "p", "j", ny, ["re", "im"], solve)
    return on_lines(x, "j", "p", nx, ["re", "im"], back, [out], to="i").select("i", "j", out)


def polar_poisson(df: DataFrame, c: str, shape: tuple[int, int], r0: float, r1: float, ends: tuple[str, str] = ("dirichlet", "dirichlet"), out: str = "phi") -> DataFrame:
    """(1/r) d(r dphi/dr)/dr + (1/r^2) d2phi/dtheta2 = f on a ring, zero or flat at its ends.

    The angle by transform with the continuous symbol, then one tridiagonal solve a mode, all
    modes of a batch at once.
    """
    if r0 <= 0:
        raise ValueError("only rings: the inner radius must be positive")
    nr, nt = shape
    dr = (r1 - r0) / nr
    r = r0 + (np.arange(nr) + 0.5) * dr
    lower, upper = (r - dr / 2) / (r * dr * dr), (r + dr / 2) / (r * dr * dr)

    def forward(_, a):
        return _parts(np.fft.fft(a[0], axis=1))

    def solve(m, a):
        m = np.where(2 * m > nt, m - nt, m)
        diag = -(lower + upper)[None, :] - (m**2)[:, None] / (r**2)[None, :]
        diag[:, 0] += lower[0] * (1 if ends[0] == "neumann" else -1)
        diag[:, -1] += upper[-1] * (1 if ends[1] == "neumann" else -1)
        rhs = a[0] + 1j * a[1]
        if ends == ("neumann", "neumann"):
            flat = m == 0  # known but for a constant: its first value is zero
            diag[flat, 0], rhs[flat, 0] = 1.0, 0.0
            return _parts(_thomas(lower, diag, upper, rhs, flat))
        return _parts(_thomas(lower, diag, upper, rhs))

    def back(_, a):
        return [np.fft.ifft(a[0] + 1j * a[1], axis=1).real]

    x = on_lines(df, "i", "j", nt, [c], forward, ["re", "im"], to="m")
    x = on_lines(x, "m", "i", nr, ["re", "im"], solve)
    return on_lines(x, "i", "m", nt, ["re", "im"], back, [out], to="j").select("i", "j", out)


def _thomas(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, pinned: np.ndarray | None = None) -> np.ndarray:
    """Tridiagonal solves, one a row of ``b`` and ``d``; ``a`` below and ``c`` above the diagonal
    are the same in all rows or one each. ``pinned`` rows have nothing above their first place."""
    a, c = np.broadcast_to(a, b.shape), np.array(np.broadcast_to(c, b.shape))
    if pinned is not None:
        c[pinned, 0] = 0
    n = b.shape[1]
    over, out = np.zeros_like(d), np.zeros_like(d)
    over[:, 0], out[:, 0] = c[:, 0] / b[:, 0], d[:, 0] / b[:, 0]
    for k in range(1, n):
        w = b[:, k] - a[:, k] * over[:, k - 1]
        over[:, k], out[:, k] = c[:, k] / w, (d[:, k] - a[:, k] * out[:, k - 1]) / w
    for k in range(n - 2, -1, -1):
        out[:, k] -= over[:, k] * out[:, k + 1]
    return out


def tridiagonal(df: DataFrame, line: str, place: str, n: int, below: str, diagonal: str, above: str, rhs: str, out: str = "x") -> DataFrame:
    """One tridiagonal solve a line, with coefficients per cell."""

    def work(_, a):
        return [_thomas(a[0], a[1], a[2], a[3])]

    return on_lines(df, line, place, n, [below, diagonal, above, rhs], work, [out])
