"""What this engine offers, and whether a session is fit for it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fieldloom.functions import physics
from fieldloom.operators import elliptic
from fieldloom.plans import library, program


def capabilities() -> dict[str, list[str]]:
    """Names by kind."""
    return {
        "transports": sorted(physics.TRANSPORTS),
        "sources": sorted(physics.SOURCES),
        "elliptic": sorted(physics.ELLIPTICS),
        "limiters": sorted(physics.LIMITERS),
        "riemann": sorted(physics.RIEMANN),
        "krylov": sorted(elliptic.KRYLOV),
        "operations": sorted(program.TYPES),
        "operator_kinds": list(library.OPERATOR_KINDS),
    }


def parallel_info(spark: SparkSession) -> dict[str, str | int]:
    """Where and how wide the session runs."""
    sc = spark.sparkContext
    return {"master": sc.master, "cores": sc.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "version": spark.version}


def set_partitions(spark: SparkSession, n: int) -> None:
    """Shuffle partitions of what is planned from now on."""
    if n < 1:
        raise ValueError("at least one partition")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))


def doctor(spark: SparkSession) -> list[str]:
    """What would make runs slow or fail; empty if nothing."""
    out = []
    sc = spark.sparkContext
    local = sc.master == "local" or sc.master.startswith("local[")
    if not local and not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        out.append("spark.checkpoint.dir is unset: iterative solvers and levels can't cut their plans")
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        out.append("adaptive execution is off: small shuffles keep all their partitions, skewed joins aren't split")
    if spark.conf.get("spark.sql.codegen.wholeStage") != "true":
        out.append("whole-stage code generation is off")
    return out


def program_report(p: program.Program) -> dict:
    """Operations, solves, values alive, bodies and the operators that a program may call."""
    found = program.report(p)
    return found | {"bodies": sum(len(v.bodies()) for v in p.values), "operators": dict(p.operators), "text": p.dump()}
