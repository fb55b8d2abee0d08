"""Shared plumbing of the training-data operators: scratch tables and input shaping.

Every operator takes a DataFrame and the names of its columns, selects only what it
needs under private names (so extra or clashing columns cannot interfere) and returns a
DataFrame.  Intermediate results are cut from their lineage by writing them to the shared
folder named by ``spark.checkpoint.dir``; a lost executor then costs a re-read.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows in an Arrow batch that holds whole texts
ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is read from the session.  Only where it is unset, and only on a local master
    (tests), a folder of this machine is used and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints/lexspark"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def _files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when the write is over: its rows are in the table by then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """Scratch tables that are written inside are deleted at the end, when whatever was made of them has been written with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        dropped(*_OPEN.pop())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _files_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for df in tables:
        spark, path = df.sparkSession, df.scratch_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(df: DataFrame) -> None:
    """Arrow batches of whole texts hold fewer rows: a batch is copied several times on its way.

    It decides memory, not results.  A smaller setting of the session's own stays.  Plans read it when they run, so the
    session keeps it afterwards.
    """
    conf = df.sparkSession.conf
    conf.set(BATCH, str(min(ROWS, int(conf.get(BATCH, "10000")) or ROWS)))


#: glibc's M_MMAP_THRESHOLD, and the bytes from which a block is mapped by itself and so goes back when it is freed
_MAPPED, _BLOCK = -3, 1 << 20


@functools.cache
def _frugal() -> None:
    """Large blocks of this worker, Arrow's too, go back to the machine when they are freed and aren't kept for later."""
    with contextlib.suppress(OSError, AttributeError):  # another C library has its own ways
        ctypes.CDLL("libc.so.6").mallopt(_MAPPED, _BLOCK)
        pa.set_memory_pool(pa.system_memory_pool())


def released() -> None:
    """Give the memory that Arrow and the C library hold without need back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: what a worker keeps from task to task of one stage, each with a ``clear``; and the stage
_HELD: list = []
_STAGE: list[str] = [""]


def held(kept: dict) -> dict:
    """``kept``, a worker's store, emptied when the worker turns to another stage."""
    _HELD.append(kept)
    return kept


def _entered(stage: str) -> None:
    if _STAGE[0] != stage:
        for kept in _HELD:
            kept.clear()
        _STAGE[0] = stage
        released()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``; a worker that waits for its next task holds no more than that task will need."""

    stage = uuid.uuid4().hex

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        _entered(stage)
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(wrapped, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column put together to about so many rows, no value of it on both sides of a cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            other = key != held[-1].column(0)[-1].as_py()
            cut = int(other.argmax()) if other.any() else len(key)
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if not batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def column(df: DataFrame, name: str) -> Column:
    """``name`` of ``df``; quoted, so a name with dots or spaces works too."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that no column of ``tables`` has in any case."""
    taken = {c.lower() for df in tables for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def semi(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, once: bool = False, anti: bool = False) -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is, or with ``anti`` isn't, in ``keys (_kept_id, _kept_hash)``.

    Null ids match each other.  ``once``: rows repeated whole are returned once.
    """
    name, kid, kh = (unused(n, docs) for n in ("_row_hash", "_kept_id", "_kept_hash"))
    hashed, keys = docs.withColumn(name, F.xxhash64(column(docs, text_col).cast("string"))), keys.toDF(kid, kh)
    on = column(hashed, id_col).eqNullSafe(keys[kid]) & (hashed[name] == keys[kh])
    out = hashed.join(keys, on, "left_anti" if anti else "left_semi")
    return (out.dropDuplicates([id_col, name]) if once else out).drop(name)
