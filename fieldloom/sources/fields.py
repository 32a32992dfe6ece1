"""Fields in and out: Parquet checkpoints with a manifest, and array files for other tools."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1


class RestartError(ValueError):
    """What a checkpoint holds isn't what the run needs."""


def schema(names: list[str], roles: list[str] | None = None, kind: str = "Conservative") -> T.StructType:
    """``i, j`` and one double per component, with its role and kind as metadata."""
    cells = [T.StructField("i", T.IntegerType(), False), T.StructField("j", T.IntegerType(), False)]
    roles = roles or ["Custom"] * len(names)
    return T.StructType(cells + [T.StructField(n, T.DoubleType(), True, {"role": r, "kind": kind}) for n, r in zip(names, roles)])


def with_roles(df: DataFrame, roles: dict[str, str], kind: str = "Conservative") -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"role": roles[c], "kind": kind}) if c in roles else F.col(c) for c in df.columns])


def component_of(df: DataFrame, role: str) -> str:
    """The column with a role; an error if there is none or more than one."""
    found = [f.name for f in df.schema if f.metadata.get("role") == role]
    if len(found) != 1:
        raise KeyError(f"{len(found)} components have the role {role!r}")
    return found[0]


def from_array(spark: SparkSession, values: dict[str, np.ndarray], roles: list[str] | None = None) -> DataFrame:
    """Arrays [i, j] by component; for inputs that fit the driver."""
    names = list(values)
    shape = next(iter(values.values())).shape
    i, j = (x.ravel().astype(np.int32) for x in np.indices(shape))
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"i": i, "j": j, **{n: values[n].ravel().astype(float) for n in names}}), schema(names, roles))


def to_array(df: DataFrame, names: list[str], shape: tuple[int, int]) -> dict[str, np.ndarray]:
    """Arrays [i, j]; for results that fit the driver."""
    p = df.select("i", "j", *names).toPandas()
    out = {}
    for n in names:
        a = np.zeros(shape)
        a[p["i"], p["j"]] = p[n]
        out[n] = a
    return out


def write_field(df: DataFrame, path: str, block: str = "field", level: int = 0) -> None:
    """Parquet, partitioned by block and level: both are pruned when read back. Only this block's level is replaced."""
    rows = df.withColumns({"block": F.lit(block), "level": F.lit(level)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block", "level").parquet(path)


def read_field(spark: SparkSession, path: str, block: str | None = None, level: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if block is not None:
        df = df.where(F.col("block") == block)
    return df if level is None else df.where(F.col("level") == level)


def write_npz(path: str, arrays: dict[str, dict[str, np.ndarray]], t: float, step: int, phi: np.ndarray | None = None) -> None:
    """States by block, names, the clock and the potential; replaces the file at once."""
    import os

    out: dict = {"t": t, "macro_step": step, "blocks": list(arrays)}
    for block, comps in arrays.items():
        out[f"state_{block}"] = np.stack([a.T for a in comps.values()])
        out[f"names_{block}"] = list(comps)
        out["nx"], out["ny"] = next(iter(comps.values())).shape
    if phi is not None:
        out["phi"] = phi.T
    with open(f"{path}.part", "wb") as f:
        np.savez(f, **out)
    os.replace(f"{path}.part", path)


def read_npz(path: str) -> dict:
    with np.load(path, allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def write_vti(path: str, arrays: dict[str, np.ndarray]) -> None:
    """ASCII image data with cell values, 17 digits."""
    nx, ny = next(iter(arrays.values())).shape
    lines = ['<?xml version="1.0"?>', '<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">']
    lines.append(f'<ImageData WholeExtent="0 {nx} 0 {ny} 0 0" Origin="0 0 0" Spacing="{1 / nx:.17g} {1 / ny:.17g} 1">')
    lines += [f'<Piece Extent="0 {nx} 0 {ny} 0 0">', "<CellData>"]
    for n, a in arrays.items():
        lines += [f'<DataArray type="Float64" Name="{n}" format="ascii">', " ".join(f"{x:.17g}" for x in a.T.ravel()), "</DataArray>"]
    lines += ["</CellData>", "</Piece>", "</ImageData>", "</VTKFile>", ""]
    with open(path, "w") as f:
        f.write("\n".join(lines))


@dataclass
class Checkpoint:
    """Everything a run needs to go on: states, clock, histories, held values, program."""

    states: dict[str, DataFrame]
    shape: tuple[int, int]
    t: float
    step: int
    program: str = ""
    histories: dict[str, list[DataFrame]] = field(default_factory=dict)
    held: dict[str, tuple[DataFrame, int, float]] = field(default_factory=dict)
    phi: DataFrame | None = None
    boxes: list[list[list[int]]] = field(default_factory=list)  # corners, by finer level


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Complete checkpoints in a folder, oldest first."""
    files, place = _files(spark, f"{path}/manifest-*/_SUCCESS")
    found = files.globStatus(place) or []
    return sorted(int(x.getPath().getParent().getName().split("-")[1]) for x in found)


def save(spark: SparkSession, c: Checkpoint, path: str) -> None:
    """A new generation beside the last one: tables first, its manifest last.

    A run that dies midway leaves the last generation as it was. The one before the last
    stays too, as states may still be read from it; older ones are deleted.
    """
    old = _generations(spark, path)
    k = old[-1] + 1 if old else 0
    at = f"{path}/data-{k}"
    for b, df in c.states.items():
        df.write.mode("overwrite").parquet(f"{at}/state/{b}")
    for n, ring in c.histories.items():
        for q, df in enumerate(ring):
            df.write.mode("overwrite").parquet(f"{at}/history/{n}/{q}")
    for n, (df, _, _) in c.held.items():
        df.write.mode("overwrite").parquet(f"{at}/held/{n}")
    if c.phi is not None:
        c.phi.write.mode("overwrite").parquet(f"{at}/phi")
    manifest = {
        "version": VERSION, "shape": list(c.shape), "t": c.t, "step": c.step, "program": c.program, "phi": c.phi is not None,
        "blocks": {b: [x for x in df.columns if x not in ("i", "j")] for b, df in c.states.items()},
        "histories": {n: len(r) for n, r in c.histories.items()}, "held": {n: [s, a] for n, (_, s, a) in c.held.items()},
        "boxes": c.boxes,
    }
    text = spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1)
    text.write.mode("overwrite").json(f"{path}/manifest-{k}")
    for q in old[:-1]:
        for gone in (f"{path}/manifest-{q}", f"{path}/data-{q}"):
            files, place = _files(spark, gone)
            files.delete(place, True)


def restart(spark: SparkSession, path: str, blocks: dict[str, list[str]], shape: tuple[int, int], program: str = "", histories: list[str] | None = None) -> Checkpoint:
    """The checkpoint, if its version, grid, blocks (in order), components, program and histories fit."""
    found = _generations(spark, path)
    if not found:
        raise RestartError(f"no complete checkpoint in {path}")
    m = json.loads(spark.read.schema("manifest string").json(f"{path}/manifest-{found[-1]}").first()["manifest"])
    tests = [
        ("version", m["version"], VERSION), ("grid", tuple(m["shape"]), tuple(shape)), ("blocks", list(m["blocks"]), list(blocks)),
        ("components", m["blocks"], blocks), ("program", m["program"], program),
    ]
    for what, has, needs in tests:
        if has != needs:
            raise RestartError(f"{what}: the checkpoint has {has!r}, the run needs {needs!r}")
    if missing := set(histories or []) - set(m["histories"]):
        raise RestartError(f"the checkpoint lacks the histories {sorted(missing)}")
    read, path = spark.read.parquet, f"{path}/data-{found[-1]}"
    return Checkpoint(
        {b: read(f"{path}/state/{b}") for b in m["blocks"]}, tuple(m["shape"]), m["t"], m["step"], m["program"],
        {n: [read(f"{path}/history/{n}/{k}") for k in range(d)] for n, d in m["histories"].items()},
        {n: (read(f"{path}/held/{n}"), s, a) for n, (s, a) in m["held"].items()}, read(f"{path}/phi") if m["phi"] else None, m["boxes"],
    )


def save_levels(spark: SparkSession, h, folder: str, path: str, t: float, step: int) -> None:
    """A hierarchy's checkpoint: one table a level, the boxes in the manifest."""
    states = {f"level{k}": level.state.frame(spark, folder) for k, level in enumerate(h.levels)}
    boxes = [[[b.i0, b.j0, b.i1, b.j1] for b in level.boxes] for level in h.levels[1:]]
    save(spark, Checkpoint(states, h.scheme.shape, t, step, boxes=boxes), path)


def restart_levels(spark: SparkSession, h, path: str) -> tuple[float, int]:
    """Puts the levels of a checkpoint in a hierarchy of the same scheme; gives the clock."""
    from fieldloom.operators.grid import Box
    from fieldloom.operators.hierarchy import Level
    from fieldloom.plans.relation import Given

    found = _generations(spark, path)
    if not found:
        raise RestartError(f"no complete checkpoint in {path}")
    m = json.loads(spark.read.schema("manifest string").json(f"{path}/manifest-{found[-1]}").first()["manifest"])
    c = restart(spark, path, {f"level{k}": h.scheme.names for k in range(len(m["boxes"]) + 1)}, h.scheme.shape)
    h.levels = [Level(Given(df), [Box(*b) for b in c.boxes[k - 1]] if k else None) for k, df in enumerate(c.states.values())]
    return c.t, c.step


def write_levels(path: str, levels: list[dict[str, np.ndarray]], boxes: list[list], t: float, step: int) -> None:
    """The coarse level's image file (.vti) or arrays (.npz), and every box's corners beside it."""
    corners = [[k + 1, b.i0, b.j0, b.i1, b.j1] for k, found in enumerate(boxes) for b in found]
    if path.endswith(".npz"):
        with open(f"{path}.part", "wb") as f:
            np.savez(f, t=t, macro_step=step, boxes=np.array(corners, np.int64).reshape(-1, 5), **{f"level{k}_{c}": a.T for k, arrays in enumerate(levels) for c, a in arrays.items()})
        import os

        os.replace(f"{path}.part", path)
        return
    write_vti(path, levels[0])
    with open(f"{path}.boxes", "w") as f:
        f.write("level i0 j0 i1 j1\n" + "".join(" ".join(map(str, c)) + "\n" for c in corners))


def write_hdf5(path: str, arrays: dict[str, dict[str, np.ndarray]], t: float, step: int) -> None:
    """One group a block, one dataset a component; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 output needs the h5py package; Parquet, npz and vti don't") from e
    with h5py.File(path, "w") as f:
        f.attrs["t"], f.attrs["macro_step"] = t, step
        for block, comps in arrays.items():
            for c, a in comps.items():
                f.create_dataset(f"{block}/{c}", data=a.T)


@dataclass(frozen=True)
class OutputPolicy:
    """Which levels are written, how often, in which form."""

    format: str = "parquet"
    every: int = 1
    levels: str | tuple[int, ...] = "all"

    def wants(self, step: int, level: int) -> bool:
        chosen = self.levels == "all" or (self.levels == "coarse" and level == 0) or (not isinstance(self.levels, str) and level in self.levels)
        return step % self.every == 0 and chosen
