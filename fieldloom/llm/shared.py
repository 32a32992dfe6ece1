"""Helpers that several operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests on one machine, a folder of our own is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fieldloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    It cuts the lineage, so that what follows doesn't run the plan again, and the
    table outlives any executor. A plan may read it as long as the application runs; it is
    deleted at its end, or before by ``drop_cut``.
    """
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def release_memory() -> None:
    """Give a worker's free memory back to the system, as idle workers outlive their stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def own_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in this application's part of it, which is deleted at its end."""
    top = f"{shared_folder(spark)}/fieldloom-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def drop_cut(df: DataFrame) -> None:
    """Delete a table of ``cut`` that no later plan reads."""
    path = getattr(df, "_fieldloom_path", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fold(id_col: str, folds: int):
    """Column: the unsigned crc32 of an id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(folds)


def maybe_in(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only if no row of ``some`` has the key, a hash.

    It is a bitmap of at most 4 MB whatever the table's size, so that rows which have no
    partner needn't be shuffled to find that out.
    """
    word, bit = F.pmod(key, F.lit(1 << 18)), F.shiftrightunsigned(F.col(key), 58).cast("int")
    bits = some.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.call_function("getbit", F.col("_bits"), bit) == 1, F.lit(False))).drop("_word", "_bits")


#: A class of more rows than this, and than a ten-thousandth of all, is common.
COMMON = 100


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int | None = None, least: int | None = None) -> DataFrame:
    """``rows`` with the columns of their class, null where there is none; ``n`` of a class is
    the number of its rows, and ``total`` their sum or a number above it.

    Classes of more than ``least`` rows and a ten-thousandth of all are common. There are at most
    ten thousand of them by this definition; these are broadcast, so that no task meets all
    rows of one. The others are joined by the key, as all are where none is common.
    """
    if total is None:
        total = classes.agg(F.sum("n")).first()[0] or 0
    bound = max(COMMON if least is None else least, total // 10_000)
    common = F.col("n") > bound
    if total <= bound or classes.where(common).isEmpty():
        return rows.join(classes, key, "left")
    classes = classes.select(key, "n", F.struct(*[c for c in classes.columns if c != key]).alias("_of"))
    marked = rows.join(F.broadcast(classes.where(common).drop("n")), key, "left")
    rare = marked.where("_of IS NULL").drop("_of").join(classes.where(~common).drop("n"), key, "left")
    return rare.union(marked.where("_of IS NOT NULL").select(*rare.columns)).select(*rows.columns, "_of.*")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component (``doc_id``, ``text_hash``, ``component`` of every row).

    It is that of the smallest id, null ids last. Rows are told apart by id and text; of
    rows that are the same in both, one stays, the first by its JSON text.
    """
    rows = found.groupBy("component", "doc_id", "text_hash").count()
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n"))
    kept = F.col("first").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")))
    rows = join_classes(rows, cut(first.where("n > 1"), "copies"), "component").withColumn("kept", kept).where("count > 1 OR NOT kept")
    out = cut(rows.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash"), "kept"), "copies")
    held = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_gone_hash"))
    split = maybe_in(held, out.withColumnRenamed("_gone_hash", "_hash"), "_hash")
    stay = split.where("NOT _maybe").select("_row.*").union(split.where("_maybe").join(out, same, "left_anti").select("_row.*"))
    again = out.where("kept")
    if again.isEmpty():
        return stay
    some = maybe_in(held, again.withColumnRenamed("_gone_hash", "_hash"), "_hash").where("_maybe")
    one = some.groupBy("_id", "_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return stay.union(one.join(again, same, "left_semi").select("_row.*"))
