"""Levels against a plain NumPy version, and what they keep."""

import numpy as np
import pytest

from fieldloom.functions import physics
from fieldloom.functions.expr import var
from fieldloom.operators import elliptic, hierarchy
from fieldloom.operators.grid import Box
from fieldloom.operators.hierarchy import Hierarchy, Level, Runtime, Scheme
from fieldloom.plans.relation import Given
from fieldloom.sources import fields

N = 8
BOXES = [Box(4, 4, 9, 11), Box(10, 6, 13, 9)]  # touching, so some ghosts come from the other box


def _start(seed=3):
    rng = np.random.default_rng(seed)
    u = rng.uniform(1, 2, (N, N))
    fine = np.full((2 * N, 2 * N), np.nan)
    for b in BOXES:
        fine[b.i0 : b.i1 + 1, b.j0 : b.j1 + 1] = rng.uniform(1, 2, b.shape)
    return u, fine


def _level(spark, a):
    import pandas as pd

    i, j = np.nonzero(~np.isnan(a))
    return Given(spark.createDataFrame(pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "u": a[i, j]}), "i int, j int, u double"))


def _faces(u, a, h):
    """Upper upwind fluxes of a periodic array."""
    fx = (a[0] * (u + np.roll(u, -1, 0)) - abs(a[0]) * (np.roll(u, -1, 0) - u)) / 2
    fy = (a[1] * (u + np.roll(u, -1, 1)) - abs(a[1]) * (np.roll(u, -1, 1) - u)) / 2
    return fx, fy


def _plain_step(u, fine, a, h, dt):
    """One coarse step, two fine ones, averages and corrections, cell by cell."""
    def up(x):
        return np.repeat(np.repeat(x, 2, 0), 2, 1)

    inside = ~np.isnan(fine)
    covered = inside[::2, ::2]
    fx, fy = _faces(u, a, h)
    new = u - dt / h * (fx - np.roll(fx, 1, 0)) - dt / h * (fy - np.roll(fy, 1, 1))
    d = np.zeros_like(u)
    sums = np.zeros_like(fine), np.zeros_like(fine)
    for k in range(2):
        around = up(u * (1 - k / 2) + new * (k / 2))
        whole = np.where(inside, fine, around)
        gx, gy = _faces(whole, a, h / 2)
        sums[0][:] += gx
        sums[1][:] += gy
        moved = whole - dt / 2 / (h / 2) * (gx - np.roll(gx, 1, 0)) - dt / 2 / (h / 2) * (gy - np.roll(gy, 1, 1))
        fine = np.where(inside, moved, np.nan)
    mean_x = (sums[0][1::2, ::2] + sums[0][1::2, 1::2]) / 4  # through the upper x face of each coarse cell
    mean_y = (sums[1][::2, 1::2] + sums[1][1::2, 1::2]) / 4
    for axis, f, mean in ((0, fx, mean_x), (1, fy, mean_y)):
        gap = covered != np.roll(covered, -1, axis)
        off = np.where(gap, mean - f, 0) * dt / h
        d -= np.where(~covered, off, 0)
        d += np.where(~covered, np.roll(off, 1, axis), 0)
    down = fine.reshape(N, 2, N, 2).mean(axis=(1, 3))
    return np.where(covered, down, new + d), fine


def _hierarchy(spark, u, fine, **more):
    scheme = Scheme(physics.Advection(*more.pop("wind", (1.0, -0.5))), (1 / N, 1 / N), (N, N), **more)
    return Hierarchy(scheme, [Level(_level(spark, u)), Level(_level(spark, fine), BOXES)], cut=lambda p: Given(elliptic._cut(p.frame(spark, ""))))


def _arrays(spark, h):
    out = []
    for k, level in enumerate(h.levels):
        a = np.full((N << k, N << k), np.nan)
        for r in level.state.frame(spark, "").collect():
            a[r["i"], r["j"]] = r["u"]
        out.append(a)
    return out


def test_two_levels_are_the_plain_ones(spark):
    u, fine = _start()
    h = _hierarchy(spark, u, fine)
    for _ in range(2):
        h.step(0.02)
        u, fine = _plain_step(u, fine, (1.0, -0.5), 1 / N, 0.02)
    got = _arrays(spark, h)
    assert np.allclose(got[0], u, atol=1e-12) and np.allclose(got[1], fine, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("method, limiter", [("euler", "none"), ("euler", "minmod"), ("ssprk3", "vanleer")])
def test_sums_are_kept(spark, method, limiter):
    u, fine = _start()
    h = _hierarchy(spark, u, fine, method=method, limiter=limiter)
    h.sync()
    before = h.total("u").frame(spark, "").first()[0]
    h.step(0.01)
    after = h.total("u").frame(spark, "").first()[0]
    assert abs(after - before) < 1e-13
    assert h.levels[1].state.frame(spark, "").count() == sum(b.cells for b in BOXES)


def test_three_levels_keep_sums(spark):
    u, fine = _start()
    h = _hierarchy(spark, u, fine)
    h.regrid(2, [Box(12, 12, 17, 17)])
    with pytest.raises(ValueError, match="nested"):
        h.regrid(2, [Box(8, 8, 11, 11)])
    with pytest.raises(ValueError, match="whole coarse cells"):
        h.regrid(1, [Box(3, 4, 9, 9)])
    h.sync()
    before = h.total("u").frame(spark, "").first()[0]
    h.step(0.02)
    assert abs(h.total("u").frame(spark, "").first()[0] - before) < 1e-13
    assert h.snapshot(spark, "").groupBy("level").count().count() == 3


def test_constant_states_stay(spark):
    h = _hierarchy(spark, np.full((N, N), 2.0), np.where(np.isnan(_start()[1]), np.nan, 2.0), method="ssprk3", limiter="minmod", bc="foextrap")
    h.step(0.05)
    a, b = _arrays(spark, h)
    assert np.allclose(a, 2.0) and np.allclose(b[~np.isnan(b)], 2.0)


def test_reports(spark):
    h = _hierarchy(spark, *_start())
    assert [tuple(r)[:2] for r in h.patch_table(spark).orderBy("level", "box_id").collect()] == [(0, 0), (1, 0), (1, 1)]
    ghosts = {(r["box_id"], r["source"]): r["cells"] for r in h.explain_ghosts(spark, "", 1).collect()}
    assert ghosts[0, "same level"] == 4 and ghosts[1, "same level"] == 6 and ghosts[0, "coarse"] == 32 - 4
    faces = {r["side"]: r["faces"] for r in h.explain_reflux(spark, "", 0).collect()}
    covered = np.zeros((N, N), bool)
    for b in BOXES:
        c = b.coarsen(2)
        covered[c.i0 : c.i1 + 1, c.j0 : c.j1 + 1] = True
    for side, (axis, by) in zip(hierarchy.SIDES, ((0, 1), (0, -1), (1, 1), (1, -1))):
        assert faces[side] == (covered & ~np.roll(covered, by, axis)).sum()
    tags = Given(spark.createDataFrame([(2, 2), (5, 3), (7, 7)], "i int, j int"))
    assert {r["box_id"]: r["tags"] for r in h.explain_regrid(spark, "", 1, tags).collect()} == {0: 1, 1: 1}


def test_schemes_that_do_not_go_together():
    with pytest.raises(ValueError, match="Euler"):
        Scheme(physics.Advection(), (1, 1), (4, 4), method="ssprk3", implicit=lambda x, dt: x)
    with pytest.raises(ValueError):
        Scheme(physics.Advection(), (1, 1), (4, 4), bc=("dirichlet", 0.0))


def test_runtime(spark):
    u, fine = _start()
    h = _hierarchy(spark, u, fine)
    asked = []

    def boxes(hh, level):
        asked.append(level)
        return [Box(2, 2, 7, 7)]

    run = Runtime(h, boxes, regrid_every=2, fields=lambda x: x.select("i", "j", phi=var("u")), couple=lambda x, dt: x.with_(u=var("u") * (1 + dt)), speed=lambda x: 1.5)
    dt = run.step_cfl(0.4)
    assert dt == pytest.approx(0.4 / N / 1.5) and run.solves == 2 and not asked
    run.step(dt)
    run.step(dt)
    assert asked == [1] and h.levels[1].boxes == [Box(2, 2, 7, 7)] and run.log == ["regrid before step 2"]
    assert h.levels[1].state.frame(spark, "").count() == 36
