"""Cadence, programs, checkpoints, files, and the driver's entry."""

import os

import numpy as np
import pytest
from conftest import SMALL

from fieldloom.plans.program import Machine, Program, drop_dead, drop_repeated_solves, merge_equal, optimize, report
from fieldloom.sources import fields
from fieldloom.streaming import schedule as sc


def test_stride_fires_at_the_end_of_its_window():
    assert [sc.stride_due(k, 3) for k in range(6)] == [False, False, True, False, False, True]


def test_held_block_catches_up():
    took = []
    b = sc.Block("slow", 0.0, lambda u, dt: took.append(dt) or u + dt, substeps=2, stride=4)
    frozen = sc.Block("frozen", 1.0, lambda u, dt: u + dt, evolve=False)
    s = sc.System([b, frozen])
    for _ in range(8):
        s.advance(0.5)
    assert took == [1.0] * 4 and b.state == 4.0 and frozen.state == 1.0
    assert s.clock == sc.Clock(4.0, 8)


def test_cfl_names_what_binds():
    fast = sc.Block("fast", 0.0, lambda u, dt: u, speed=lambda u: 4.0)
    slow = sc.Block("slow", 0.0, lambda u, dt: u, speed=lambda u: 1.0)
    s = sc.System([fast, slow], bounds={"mine": lambda: 0.01, "bad": lambda: float("nan"), "off": lambda: -1.0})
    assert s.cfl_dt(0.5, 1.0) == 0.01 and s.reason == "mine"
    s.bounds = {}
    assert s.cfl_dt(0.5, 1.0) == 0.125 and s.reason == "block fast"
    s.step_adaptive(0.5, 1.0)
    assert fast.substeps == 1 and s.clock.t == 0.5  # what was declared stays; see test_adaptive_substeps_are_not_kept
    assert s.run(1.0, 0.5, 1.0) >= 1 and s.clock.t >= 1.0


def test_policies():
    cache, seen = sc.Cache(), []
    every = sc.every(3, "accumulate_dt")
    out = [cache.run("n", every, k, 1.0, lambda dt: seen.append(dt) or len(seen)) for k in range(7)]
    assert seen == [1.0, 3.0, 3.0] and out == [1, 1, 1, 2, 2, 2, 3]
    assert cache.run("z", sc.every(2, "zero"), 1, 1.0, lambda dt: 5, zero=0) == 0
    assert cache.run("s", sc.every(2, "skip"), 1, 1.0, lambda dt: 5) is None
    with pytest.raises(RuntimeError):
        cache.run("e", sc.every(2, "error"), 1, 1.0, lambda dt: 5)
    with pytest.raises(RuntimeError):
        cache.run("h", sc.every(2), 1, 1.0, lambda dt: 5)
    assert cache.run("end", sc.on_end(), 9, 1.0, lambda dt: 7, last=True) == 7
    with pytest.raises(ValueError):
        sc.Schedule("sometimes")


def test_history_fills_all_places_at_first():
    h = sc.History(3)
    h.store("a")
    assert [h.lag(k) for k in range(3)] == ["a"] * 3
    h.store("b")
    assert [h.lag(k) for k in range(3)] == ["b", "a", "a"]
    with pytest.raises(IndexError):
        h.lag(3)


def _ssprk2(p: Program) -> Program:
    u0 = p.state("u")
    p.solve_fields(u0)
    p.solve_fields(u0)
    r = p.rhs(u0)
    u1 = p.linear_combine([(1.0, u0), (0.1, r)])
    again = p.linear_combine([(1.0, u0), (0.1, r)])
    p.reduce(u1, "sum")
    p.commit("u", p.linear_combine([(0.5, u0), (0.5, again), (0.05, p.rhs(again))]))
    return p


HANDLERS = {
    "solve_fields": lambda *a: None,
    "rhs": lambda u, flux, sources: -u,
    "linear_combine": lambda terms: sum(c * x for c, x in terms),
    "reduce": lambda u, kind: float(u),
    "project": lambda u: max(u, 0.0),
}


def test_passes_keep_results():
    plain, small = _ssprk2(Program()), optimize(_ssprk2(Program()))
    assert len(small.values) < len(plain.values)
    assert report(small)["solves"] == 1 and report(plain)["solves"] == 2
    a = Machine(HANDLERS, {"u": 2.0}).execute(plain)["u"]
    b = Machine(HANDLERS, {"u": 2.0}).execute(small)["u"]
    assert a == b
    assert plain.hash() != small.hash() and small.hash() == optimize(_ssprk2(Program())).hash()


def test_each_pass():
    p = _ssprk2(Program())
    assert "reduce" not in report(drop_dead(p))["operations"]
    assert report(merge_equal(p))["operations"]["linear_combine"] == 2
    q = Program()
    u = q.state("u")
    q.solve_fields(u)
    q.commit("u", q.project(u))
    q.solve_fields(u)
    assert report(drop_repeated_solves(q))["solves"] == 2  # a projection lies between


def test_types_are_checked():
    p = Program()
    u = p.state("u")
    with pytest.raises(TypeError):
        p.record_scalar("x", u)
    with pytest.raises(TypeError):
        p.where(u, u, u)
    with pytest.raises(ValueError):
        p.add("unknown")


def test_control_flow_and_records():
    test, body = Program(), Program()
    test.compare("gt", test.reduce(test.state("u"), "sum"), 1.0)
    u = body.state("u")
    body.commit("u", body.linear_combine([(0.5, u)]))
    p = Program()
    p.while_(test, body, 50)
    p.record_scalar("size", p.reduce(p.state("u"), "sum"))
    p.store_history("u", p.state("u"))
    p.range(2, body)
    p.commit("u", p.linear_combine([(1.0, p.state("u")), (0.0, p.history("u", 1))]))
    m = Machine(HANDLERS, {"u": 16.0})
    assert m.execute(p)["u"] == 0.25
    assert m.records == [(0, "size", 1.0)]


def test_checkpoint_and_restart(spark, tmp_path):
    u = fields.from_array(spark, {"rho": np.arange(9.0).reshape(3, 3)})
    c = fields.Checkpoint({"gas": u}, (3, 3), 1.5, 7, "abc", {"r": [u, u]}, {"phi": (u, 6, 0.25)}, u)
    path = str(tmp_path / "c")
    fields.save(spark, c, path)
    d = fields.restart(spark, path, {"gas": ["rho"]}, (3, 3), "abc", ["r"])
    assert (d.t, d.step, len(d.histories["r"]), d.held["phi"][1:]) == (1.5, 7, 2, (6, 0.25))
    assert sorted(d.states["gas"].collect()) == sorted(u.collect())
    for blocks, shape, program, need in (({"x": ["rho"]}, (3, 3), "abc", []), ({"gas": ["n"]}, (3, 3), "abc", []), ({"gas": ["rho"]}, (4, 3), "abc", []), ({"gas": ["rho"]}, (3, 3), "no", []), ({"gas": ["rho"]}, (3, 3), "abc", ["q"])):
        with pytest.raises(fields.RestartError):
            fields.restart(spark, path, blocks, shape, program, need)
    with pytest.raises(fields.RestartError):
        fields.restart(spark, str(tmp_path / "none"), {}, (3, 3))


def test_a_checkpoint_that_dies_leaves_the_last_one(spark, tmp_path, monkeypatch):
    u = fields.from_array(spark, {"rho": np.arange(9.0).reshape(3, 3)})
    path = str(tmp_path / "c")
    fields.save(spark, fields.Checkpoint({"gas": u}, (3, 3), 1.0, 1), path)
    monkeypatch.setattr(fields.json, "dumps", lambda x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fields.save(spark, fields.Checkpoint({"gas": u.limit(1)}, (3, 3), 2.0, 2), path)
    monkeypatch.undo()
    d = fields.restart(spark, path, {"gas": ["rho"]}, (3, 3))
    assert d.t == 1.0 and d.states["gas"].count() == 9
    for k in range(3):  # a state read from a folder can be saved to it
        fields.save(spark, fields.Checkpoint(d.states, (3, 3), 3.0 + k, 3), path)
        d = fields.restart(spark, path, {"gas": ["rho"]}, (3, 3))
    assert d.t == 5.0 and d.states["gas"].count() == 9
    assert len([x for x in os.listdir(path) if x.startswith("data-")]) == 2


def test_a_block_leaves_the_others(spark, tmp_path):
    u = fields.from_array(spark, {"u": np.arange(4.0).reshape(2, 2)})
    for b in ("x", "y", "x"):
        fields.write_field(u, str(tmp_path / "f"), b)
    assert fields.read_field(spark, str(tmp_path / "f"), "y").count() == 4 and fields.read_field(spark, str(tmp_path / "f"), "x").count() == 4


def test_levels_in_and_out(spark, tmp_path):
    from fieldloom.functions import physics
    from fieldloom.operators.grid import Box
    from fieldloom.operators.hierarchy import Hierarchy, Level, Scheme
    from fieldloom.plans.relation import Given

    scheme = Scheme(physics.Advection(), (0.25, 0.25), (4, 4))
    h = Hierarchy(scheme, [Level(Given(fields.from_array(spark, {"u": np.arange(16.0).reshape(4, 4)})))])
    h.regrid(1, [Box(2, 2, 5, 5)])
    fields.save_levels(spark, h, "", str(tmp_path / "c"), 0.5, 3)
    g = Hierarchy(scheme, [])
    assert fields.restart_levels(spark, g, str(tmp_path / "c")) == (0.5, 3)
    assert g.levels[1].boxes == [Box(2, 2, 5, 5)]
    for a, b in zip(h.levels, g.levels):
        assert sorted(a.state.frame(spark, "").collect()) == sorted(b.state.frame(spark, "").collect())
    a = np.arange(16.0).reshape(4, 4)
    fields.write_levels(str(tmp_path / "x.npz"), [{"u": a}], [[Box(2, 2, 5, 5)]], 0.5, 3)
    z = fields.read_npz(str(tmp_path / "x.npz"))
    assert (z["level0_u"].T == a).all() and z["boxes"].tolist() == [[1, 2, 2, 5, 5]]
    fields.write_levels(str(tmp_path / "x.vti"), [{"u": a}], [[Box(2, 2, 5, 5)]], 0.5, 3)
    assert (tmp_path / "x.vti.boxes").read_text().split("\n")[1] == "1 2 2 5 5"


def test_sources_bound_the_step():
    s = sc.System([sc.Block("a", 3.0, lambda u, dt: u, speed=lambda u: 1.0)])
    s.add_frequency_bound("collisions", lambda states: states["a"] * 2.0, 0.6)
    s.add_frequency_bound("rest", lambda states: 0.0, 0.6)
    assert s.cfl_dt(0.5, 1.0) == pytest.approx(0.1) and s.reason == "collisions"
    with pytest.raises(ValueError):
        s.add_dt_bound("rest", lambda: 1.0)


def test_adaptive_substeps_are_not_kept():
    taken = []
    a = sc.Block("a", 0.0, lambda u, dt: u, speed=lambda u: 1.0)
    b = sc.Block("b", 0.0, lambda u, dt: taken.append(dt) or u, substeps=2, speed=lambda u: 3.5)
    s = sc.System([a, b])
    dt = s.step_adaptive(0.5, 0.1)
    assert dt == pytest.approx(0.05) and len(taken) == 4 and b.substeps == 2


def test_cadence_of_programs_and_host_steps():
    from fieldloom.operators.grid import Geometry, PolarGeometry

    class Counts:
        def __init__(self):
            self.parts = []

        def execute(self, program, dt):
            self.parts.append(dt)

    m, cadence = Counts(), sc.ProgramTime(substeps=2, stride=3)
    ran = [cadence.run(m, lambda dt: None, 0.1, k) for k in range(6)]
    assert ran == [False, False, True] * 2 and m.parts == pytest.approx([0.15] * 4)
    assert sc.grid_step(Geometry(4, 8)) == 0.125 and sc.grid_step(PolarGeometry(4, 100, 0.1, 1.1)) == pytest.approx(0.1 * 2 * np.pi / 100)
    rate = lambda s: {"u": -s["u"]}
    assert sc.euler_step({"u": 1.0}, rate, 0.1)["u"] == pytest.approx(0.9) and sc.ssprk2_step({"u": 1.0}, rate, 0.1)["u"] == pytest.approx(0.905)
    sc.same_layout({"a": [1], "b": [1]})
    with pytest.raises(ValueError, match="'b'"):
        sc.same_layout({"a": [1], "b": [2]})


def test_files(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3) / 7
    fields.write_npz(str(tmp_path / "x.npz"), {"b": {"u": a}}, 0.5, 3, a)
    z = fields.read_npz(str(tmp_path / "x.npz"))
    assert (z["state_b"][0].T == a).all() and int(z["macro_step"]) == 3
    fields.write_vti(str(tmp_path / "x.vti"), {"u": a})
    import xml.etree.ElementTree as ET

    data = ET.parse(tmp_path / "x.vti").find(".//DataArray")
    assert (np.array(data.text.split(), float).reshape(3, 2).T == a).all()
    df = fields.with_roles(fields.from_array(spark, {"u": a}), {"u": "Density"})
    assert fields.component_of(df, "Density") == "u"
    with pytest.raises(KeyError):
        fields.component_of(df, "Energy")
    fields.write_field(df, str(tmp_path / "f"), "b", 1)
    assert fields.read_field(spark, str(tmp_path / "f"), "b", 1).count() == 6
    assert fields.read_field(spark, str(tmp_path / "f"), "b", 0).count() == 0


def test_micro_batches(spark, tmp_path):
    for k in range(3):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    sc.micro_batches(spark, str(tmp_path / "in"), "id long", lambda df, step: seen.append((step, df.count())), str(tmp_path / "at"))
    assert [s for s, _ in seen] == [0, 1, 2] and sum(n for _, n in seen) == 3


def test_output_policy():
    p = fields.OutputPolicy(every=2, levels="coarse")
    assert p.wants(2, 0) and not p.wants(2, 1) and not p.wants(1, 0)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1024
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SMALL
