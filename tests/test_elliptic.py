"""Solvers against dense systems, transforms and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import elliptic, lines, multigrid
from fieldloom.operators.multigrid import NotConvergedError, Stencil, VCycle
from fieldloom.plans.relation import Edges
from fieldloom.sources import fields


def _dense(apply, shape):
    n = shape[0] * shape[1]
    return np.stack([apply(e.reshape(shape)).ravel() for e in np.eye(n)], axis=1)


@pytest.mark.parametrize("spectral, kappa", [(False, 0.0), (True, 0.0), (False, 3.0)])
def test_transforms_by_lines(spark, spectral, kappa):
    f = np.random.default_rng(1).normal(size=(12, 10))
    df = fields.from_array(spark, {"f": f}).repartition(5)
    got = fields.to_array(lines.poisson(df, "f", (12, 10), (0.5, 0.25), spectral, kappa), ["phi"], (12, 10))["phi"]
    kx, ky = (lines.symbol(np.arange(n), n, h, spectral) for n, h in ((12, 0.5), (10, 0.25)))
    lam = kx[:, None] + ky[None, :] - kappa
    lam[np.abs(lam) < 1e-12] = np.inf
    assert np.allclose(got, np.fft.ifft2(np.fft.fft2(f) / lam).real)


def test_lines_longer_than_a_batch(spark):
    f = np.random.default_rng(2).normal(size=(64, 16))
    df = fields.from_array(spark, {"f": f})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = fields.to_array(lines.poisson(df, "f", (64, 16), (1.0, 1.0)), ["phi"], (64, 16))["phi"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(elliptic.laplace(got, 1.0), f - f.mean())
    with pytest.raises(Exception, match="lacks cells"):
        lines.poisson(df.where("NOT (i = 3 AND j = 2)"), "f", (64, 16), (1.0, 1.0)).count()


@pytest.mark.parametrize("ends", [("dirichlet", "dirichlet"), ("neumann", "dirichlet"), ("neumann", "neumann")])
def test_ring_by_lines(spark, ends):
    nr, nt, r0, r1 = 9, 8, 0.4, 1.3
    f = np.random.default_rng(3).normal(size=(nr, nt))
    dr = (r1 - r0) / nr
    r = (r0 + (np.arange(nr) + 0.5) * dr)[:, None]
    if ends == ("neumann", "neumann"):
        f = f - (f * r).sum() / (nt * r.sum())  # else there is no solution
    df = fields.from_array(spark, {"f": f})
    got = fields.to_array(lines.polar_poisson(df, "f", (nr, nt), r0, r1, ends), ["phi"], (nr, nt))["phi"]
    low = got[:1] * (1 if ends[0] == "neumann" else -1)
    high = got[-1:] * (1 if ends[1] == "neumann" else -1)
    p = np.concatenate([low, got, high])
    radial = ((r + dr / 2) * (p[2:] - p[1:-1]) - (r - dr / 2) * (p[1:-1] - p[:-2])) / (r * dr * dr)
    m = np.fft.fftfreq(nt, 1 / nt)
    around = np.fft.ifft(-(m**2) * np.fft.fft(got, axis=1), axis=1).real / r**2
    assert np.allclose(radial + around, f, atol=1e-8)
    if ends == ("dirichlet", "dirichlet"):
        assert np.allclose(got, elliptic.polar_poisson(f, r0, r1))


def test_tridiagonal_lines(spark):
    rng = np.random.default_rng(4)
    v = {c: rng.uniform(1, 2, (6, 5)) for c in "acf"} | {"b": rng.uniform(5, 6, (6, 5))}
    got = fields.to_array(lines.tridiagonal(fields.from_array(spark, v), "i", "j", 5, "a", "b", "c", "f"), ["x"], (6, 5))["x"]
    for k in range(6):
        m = np.diag(v["b"][k]) + np.diag(v["a"][k][1:], -1) + np.diag(v["c"][k][:-1], 1)
        assert np.allclose(m @ got[k], v["f"][k])


CASES = {
    "fixed": {"bc": ("dirichlet", 0.0)},
    "uneven ends": {"bc": (Edges(("dirichlet", 2.0), "foextrap"), "periodic")},
    "flat": {"bc": "foextrap"},
    "coefficients": {"bc": ("dirichlet", 1.0), "eps_x": "x", "eps_y": "y", "kappa": "k"},
    "conductor": {"mask": "m"},
    "cut cells": {"level": "l"},
}


def _case(name, n=16):
    rng = np.random.default_rng(7)
    x = (np.arange(-1, n + 1) + 0.5) / n
    disc = (x[:, None] - 0.5) ** 2 + (x[None, :] - 0.52) ** 2 - 0.14
    arrays = {"x": rng.uniform(1, 3, (n, n)), "y": rng.uniform(1, 3, (n, n)), "k": rng.uniform(0, 2, (n, n)), "m": (disc[1:-1, 1:-1] < 0).astype(float), "l": disc}
    return Stencil((n, n), (1 / n, 1 / n), **{k: arrays[v] if isinstance(v, str) and v in arrays else v for k, v in CASES[name].items()}), rng.normal(size=(n, n))


@pytest.mark.parametrize("name", CASES)
def test_multigrid_against_dense_systems(name):
    a, f = _case(name)
    if a.floating:
        f = f - f.mean()
    u = VCycle(rel=1e-10).robust(a, f)
    g = f - a.weights["shift"]
    if a.active is not None:
        g = np.where(a.active, g, 0)
    want = np.linalg.lstsq(_dense(a.apply, a.shape), g.ravel(), rcond=None)[0].reshape(a.shape)
    assert np.allclose(u, want - want.mean() if a.floating else want, atol=1e-7)


def test_fixed_ends_by_ghosts():
    """The weights at the ends against explicit ghost cells."""
    a, f = _case("uneven ends", 8)
    u = np.random.default_rng(1).normal(size=(8, 8))
    p = np.concatenate([4.0 - u[:1], u, u[-1:]])
    p = np.concatenate([p[:, -1:], p, p[:, :1]], axis=1)
    lap = (p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * p[1:-1, 1:-1]) * 64
    assert np.allclose(a.apply(u) + a.weights["shift"], lap)


def test_weights_of_cut_cells():
    a, _ = _case("cut cells")
    level, h = a.level, a.h[0]
    for i, j in [(3, 9), (8, 2), (7, 7), (12, 11)]:
        here = level[i + 1, j + 1]
        if here >= 0:
            continue
        ways = [h * (1 if there < 0 else max(1e-3, here / (here - there))) for there in (level[i, j + 1], level[i + 2, j + 1], level[i + 1, j], level[i + 1, j + 2])]
        assert np.isclose(a.weights["c"][i, j], -2 / (ways[0] * ways[1]) - 2 / (ways[2] * ways[3]))


def test_tensor_operator():
    rng = np.random.default_rng(9)
    n = 16
    a = Stencil((n, n), (1 / n, 1 / n), eps_x=rng.uniform(2, 3, (n, n)), eps_y=rng.uniform(2, 3, (n, n)), a_xy=rng.uniform(-0.5, 0.5, (n, n)), a_yx=rng.uniform(-0.5, 0.5, (n, n)), kappa=1.0)
    f = rng.normal(size=(n, n))
    x, k, r = multigrid.tensor_bicgstab(a, f)
    assert k < 30 and np.allclose(a.full(x), f, atol=1e-8)
    assert np.allclose(x.ravel(), np.linalg.solve(_dense(a.full, (n, n)), f.ravel()))
    with pytest.raises(NotConvergedError):
        multigrid.tensor_bicgstab(a, f, max_iter=1)


def test_unmet_tolerances_raise(spark):
    df = fields.from_array(spark, {"b": np.random.default_rng(2).normal(size=(4, 4))})
    op = elliptic.periodic_operator((4, 4), 1.0, kappa=4.0)
    for name, more in (("cg", {}), ("bicgstab", {}), ("gmres", {}), ("richardson", {"omega": 0.1})):
        with pytest.raises(NotConvergedError) as e:
            elliptic.KRYLOV[name](op, df, tolerance=1e-12, max_iter=1, **more)
        assert e.value.field.count() == 16
        assert elliptic.KRYLOV[name](op, df, tolerance=1e-12, max_iter=1, strict=False, **more).residual > 0
    with pytest.raises(NotConvergedError, match="energy"):
        elliptic.conjugate_gradient(elliptic.periodic_operator((4, 4), 1.0, kappa=-20.0), df)
    zero = elliptic.bicgstab(op, df.withColumn("b", F.lit(0.0)))
    assert zero.iterations == 0 and zero.residual == 0


def test_two_levels_precondition(spark):
    """Five iterations go further with it than without."""
    n = 16
    b = np.random.default_rng(5).normal(size=(n, n))
    b -= b.mean()
    df = fields.from_array(spark, {"b": b})
    op = elliptic.periodic_operator((n, n), 1.0)
    plain, helped = (elliptic.bicgstab(op, df, tolerance=1e-6, max_iter=5, strict=False, precondition=m) for m in (None, multigrid.two_level((n, n), (1.0, 1.0), tile=4)))
    assert helped.residual < plain.residual / 3
    x = fields.to_array(helped.field, ["x"], (n, n))["x"]
    assert abs(np.linalg.norm(-elliptic.laplace(x, 1.0) - b) - helped.residual) < 1e-8


def test_blocks_above_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(multigrid, "BLOCK_CELLS", 100)
    with pytest.raises(ValueError):
        VCycle().solve(Stencil((16, 16), (1.0, 1.0)), np.zeros((16, 16)))
    with pytest.raises(ValueError):
        multigrid.two_level((64, 64), (1.0, 1.0), tile=2, gather=100)
