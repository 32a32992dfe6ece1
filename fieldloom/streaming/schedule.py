"""Cadence: which operators run in which macro step, and what stands in when they don't.

The clock counts macro steps from 0. A stride fires at the end of its window, when
``(step + 1) % stride == 0``, and then takes one step of ``stride * dt``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

KINDS = ("always", "every", "when", "on_start", "on_end", "subcycle")
POLICIES = ("recompute", "hold", "skip", "zero", "accumulate_dt", "error")


@dataclass(frozen=True)
class Schedule:
    kind: str = "always"
    n: int = 1
    test: Callable[[int, float], bool] | None = None
    policy: str = "hold"

    def __post_init__(self):
        if self.kind not in KINDS or self.policy not in POLICIES:
            raise ValueError(f"unknown schedule {self.kind!r} or policy {self.policy!r}")
        if self.kind in ("every", "subcycle") and self.n < 1:
            raise ValueError("n must be positive")

    def due(self, step: int, t: float = 0.0, last: bool = False) -> bool:
        return {
            "always": lambda: True,
            "every": lambda: step % self.n == 0,
            "when": lambda: bool(self.test and self.test(step, t)),
            "on_start": lambda: step == 0,
            "on_end": lambda: last,
            "subcycle": lambda: True,
        }[self.kind]()


def always() -> Schedule:
    return Schedule()


def every(n: int, policy: str = "hold") -> Schedule:
    return Schedule("every", n, policy=policy)


def when(test: Callable[[int, float], bool], policy: str = "hold") -> Schedule:
    return Schedule("when", test=test, policy=policy)


def on_start() -> Schedule:
    return Schedule("on_start")


def on_end() -> Schedule:
    return Schedule("on_end", policy="skip")


def subcycle(n: int) -> Schedule:
    return Schedule("subcycle", n)


def stride_due(step: int, stride: int) -> bool:
    return (step + 1) % stride == 0


@dataclass
class Slot(Generic[T]):
    """A scheduled node's last value, the step it is from, and the time since."""

    value: T | None = None
    step: int = -1
    accumulated: float = 0.0


@dataclass
class Cache:
    """Slots by node."""

    slots: dict[str, Slot] = field(default_factory=dict)

    def run(self, node: str, schedule: Schedule, step: int, dt: float, compute: Callable[[float], Any], zero: Any = None, t: float = 0.0, last: bool = False) -> Any:
        """``compute(dt)`` if due, with the time that was saved up; else what the policy says."""
        slot = self.slots.setdefault(node, Slot())
        if schedule.due(step, t, last):
            if schedule.kind == "subcycle":
                for _ in range(schedule.n):
                    slot.value = compute(dt / schedule.n)
            else:
                slot.value = compute(dt + (slot.accumulated if schedule.policy == "accumulate_dt" else 0.0))
            slot.step, slot.accumulated = step, 0.0
            return slot.value
        if schedule.policy == "recompute":
            return compute(dt)
        if schedule.policy == "skip":
            return None
        if schedule.policy == "zero":
            return zero
        if schedule.policy == "error":
            raise RuntimeError(f"{node} isn't due in step {step}")
        if schedule.policy == "accumulate_dt":
            slot.accumulated += dt
        if slot.step < 0:
            raise RuntimeError(f"{node} has no value to hold yet")
        return slot.value


class History(Generic[T]):
    """The last ``depth`` values; the first one stored fills all places."""

    def __init__(self, depth: int):
        self.depth = depth
        self.ring: deque = deque(maxlen=depth)

    def store(self, value: T) -> None:
        if not self.ring:
            self.ring.extend([value] * self.depth)
        else:
            self.ring.appendleft(value)

    def lag(self, n: int) -> T:
        if n >= self.depth:
            raise IndexError(f"the history holds {self.depth} values")
        return self.ring[n]


@dataclass
class Block:
    """One species: its state, its step, its cadence."""

    name: str
    state: Any
    advance: Callable[[Any, float], Any]
    substeps: int = 1
    stride: int = 1
    evolve: bool = True
    speed: Callable[[Any], float] | None = None


@dataclass
class Clock:
    t: float = 0.0
    step: int = 0


@dataclass
class System:
    """Blocks over one mesh: fields, due blocks, couplings, projections, clock, in this order."""

    blocks: list[Block]
    solve_fields: Callable[[dict[str, Any]], Any] | None = None
    couplings: list[Callable[[dict[str, Any], float], dict[str, Any]]] = field(default_factory=list)
    projections: dict[str, Callable[[Any], Any]] = field(default_factory=dict)
    clock: Clock = field(default_factory=Clock)
    bounds: dict[str, Callable[[], float]] = field(default_factory=dict)
    reason: str = ""

    def add_dt_bound(self, label: str, bound: Callable[[], float]) -> None:
        """A bound of the step of one's own; the step names the label when it binds."""
        if label in self.bounds:
            raise ValueError(f"{label!r} is taken")
        self.bounds[label] = bound

    def add_frequency_bound(self, label: str, frequency: Callable[[dict[str, Any]], float], number: float) -> None:
        """The step is at most ``number`` over the largest frequency of a source or a coupling."""

        def bound() -> float:
            f = frequency(self.states())
            return number / f if f > 0 else float("inf")

        self.add_dt_bound(label, bound)

    def states(self) -> dict[str, Any]:
        return {b.name: b.state for b in self.blocks}

    def advance(self, dt: float) -> None:
        """One macro step. Held blocks keep their state, which the fields still see."""
        if self.solve_fields:
            self.solve_fields(self.states())
        for b in self.blocks:
            if b.evolve and stride_due(self.clock.step, b.stride):
                for _ in range(b.substeps):
                    b.state = b.advance(b.state, b.stride * dt / b.substeps)
        for couple in self.couplings:
            changed = couple(self.states(), dt)
            for b in self.blocks:
                b.state = changed.get(b.name, b.state)
        for b in self.blocks:
            if b.evolve and b.name in self.projections:
                b.state = self.projections[b.name](b.state)
        self.clock.t += dt
        self.clock.step += 1

    def cfl_dt(self, cfl: float, h: float) -> float:
        """The smallest of the blocks' steps and the valid bounds; ``reason`` names it."""
        best, self.reason = float("inf"), "none"
        for b in self.blocks:
            if b.speed and b.evolve:
                dt = cfl * h * b.substeps / (b.stride * max(b.speed(b.state), 1e-30))
                if dt < best:
                    best, self.reason = dt, f"block {b.name}"
        for label, bound in self.bounds.items():
            dt = bound()
            if 0 < dt < best:  # not positive or not finite: ignored
                best, self.reason = dt, label
        return best

    def step_cfl(self, cfl: float, h: float) -> float:
        dt = self.cfl_dt(cfl, h)
        self.advance(dt)
        return dt

    def step_adaptive(self, cfl: float, h: float) -> float:
        """The slowest block sets the step; the others take as many substeps as they need, in this step only."""
        speeds = {b.name: max(b.speed(b.state), 1e-30) for b in self.blocks if b.speed and b.evolve}
        if not speeds:
            raise ValueError("no block that evolves has a speed")
        slowest = min(speeds.values())
        declared = [b.substeps for b in self.blocks]
        try:
            for b in self.blocks:
                if b.name in speeds:
                    b.substeps = max(b.substeps, -int(-(b.stride * speeds[b.name] / slowest) // 1))
            dt = cfl * h / slowest
            self.advance(dt)
        finally:
            for b, n in zip(self.blocks, declared):
                b.substeps = n
        return dt

    def run(self, t_end: float, cfl: float, h: float, max_steps: int = 10_000) -> int:
        """Until the clock passes ``t_end``; the last step isn't shortened."""
        n = 0
        while self.clock.t < t_end and n < max_steps:
            self.step_cfl(cfl, h)
            n += 1
        return n


def grid_step(geometry) -> float:
    """The length that a step is measured by: the smaller spacing, on a ring with the inner arc."""
    if hasattr(geometry, "dr"):
        return min(geometry.dr, geometry.r0 * geometry.dt)
    return min(geometry.dx, geometry.dy)


@dataclass(frozen=True)
class ProgramTime:
    """The cadence of a whole step program: every ``stride`` macro steps, in ``substeps`` parts."""

    substeps: int = 1
    stride: int = 1

    def __post_init__(self):
        if self.substeps < 1 or self.stride < 1:
            raise ValueError("substeps and stride are positive")

    def run(self, machine, program_of: Callable[[float], Any], dt: float, step: int) -> bool:
        """``program_of`` records the program for a step size; whether it ran."""
        if not stride_due(step, self.stride):
            return False
        part = self.stride * dt / self.substeps
        for _ in range(self.substeps):
            machine.execute(program_of(part), part)
        return True


def euler_step(state: dict[str, Any], rate: Callable[[dict[str, Any]], dict[str, Any]], dt: float) -> dict[str, Any]:
    """Host reference: arrays by block, U + dt R(U)."""
    r = rate(state)
    return {b: u + dt * r[b] for b, u in state.items()}


def ssprk2_step(state: dict[str, Any], rate: Callable[[dict[str, Any]], dict[str, Any]], dt: float) -> dict[str, Any]:
    """Host reference: the mean of the start and two Euler steps."""
    twice = euler_step(euler_step(state, rate, dt), rate, dt)
    return {b: 0.5 * u + 0.5 * twice[b] for b, u in state.items()}


def same_layout(layouts: dict[str, list]) -> None:
    """All blocks share one hierarchy; an error names the first that differs."""
    first = next(iter(layouts), None)
    for b, boxes in layouts.items():
        if boxes != layouts[first]:
            raise ValueError(f"block {b!r} has another layout than {first!r}")


def micro_batches(spark: SparkSession, folder: str, schema: str, on_step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Structured Streaming over a folder: each micro-batch is a macro step.

    Spark's offsets and commits in ``checkpoint`` give restart; the batch number is the clock.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(on_step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
