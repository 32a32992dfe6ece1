"""Layouts and declared field problems."""

import numpy as np
import pytest

from fieldloom.functions.expr import var
from fieldloom.operators import elliptic, halo, problems
from fieldloom.plans.relation import Given
from fieldloom.sources import fields
from fieldloom.streaming.schedule import every


def test_ghosts_are_all_neighbours(spark):
    u = np.arange(36.0).reshape(6, 6)
    f = Given(fields.from_array(spark, {"u": u}))
    for depth in (1, 2):
        got = {(r["box_id"], r["i"], r["j"]): r["u"] for r in halo.ghosts(f, ["u"], 3, 2, depth).frame(spark, "").collect()}
        want = {}
        for bi in (0, 1):
            for bj in (0, 1):
                for i in range(bi * 3 - depth, bi * 3 + 3 + depth):
                    for j in range(bj * 3 - depth, bj * 3 + 3 + depth):
                        if (i // 3, j // 3) != (bi, bj):
                            want[bi * 2 + bj, i, j] = u[i % 6, j % 6]
        assert got == want
    with pytest.raises(ValueError):
        halo.ghosts(f, ["u"], 3, 2, 4)


def test_solvers_agree(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(8, 8))
    f -= f.mean()
    df = fields.from_array(spark, {"f": f})
    p = problems.PoissonProblem(var("f"))
    a, b = (fields.to_array(problems.solve(p, s, df, (8, 8), 0.125), ["phi"], (8, 8))["phi"] for s in (problems.FFT(), problems.GeometricMG(rel=1e-12)))
    assert np.allclose(a, b, atol=1e-8) and np.allclose(elliptic.laplace(a, 0.125), f)


def test_screened_by_krylov_and_multigrid(spark):
    f = np.random.default_rng(3).normal(size=(4, 4))
    df = fields.from_array(spark, {"f": f})
    p = problems.ScreenedPoissonProblem(var("f"), 3.0)
    x = fields.to_array(problems.solve(p, problems.Krylov("cg", max_iter=20, tolerance=1e-6), df, (4, 4), 1.0), ["phi"], (4, 4))["phi"]
    y = fields.to_array(problems.solve(p, problems.GeometricMG(rel=1e-10), df, (4, 4), 1.0), ["phi"], (4, 4))["phi"]
    assert np.allclose(elliptic.laplace(x, 1.0) - 3 * x, f, atol=1e-4) and np.allclose(x, y, atol=1e-4)


def test_what_does_not_fit_is_an_error(spark):
    df = fields.from_array(spark, {"f": np.ones((2, 2))})
    with pytest.raises(ValueError):
        problems.solve(problems.ScreenedPoissonProblem(var("f"), 1.0), problems.FFT(), df, (2, 2), 1.0)
    with pytest.raises(ValueError):
        problems.solve(problems.PoissonProblem(var("f")), problems.Krylov("cg"), df, (2, 2), 1.0)
    with pytest.raises(ValueError):
        problems.Krylov("unknown")


def test_field_cadence_holds(spark):
    f = Given(fields.from_array(spark, {"u": np.random.default_rng(4).normal(size=(4, 4))}))
    s = problems.FieldSolve(problems.PoissonProblem(problems.RHS), problems.FFT(), (4, 4), 1.0, every(2))
    first = s.aux({"a": (f, var("u"))}, spark, "", 0)
    assert s.aux({"a": (f, var("u") * 2.0)}, spark, "", 1) is first
    assert s.aux({"a": (f, var("u"))}, spark, "", 2) is not first
    assert first.columns == ["i", "j", "phi", "grad_x", "grad_y"]
