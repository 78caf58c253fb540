"""What several operators share: table readers, shared-folder tables, small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let, running  # noqa: F401

#: White space as every contract here defines it: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
#: The setting above is the session's, so one write at a time has it.
_writing = threading.Lock()


def _sweep() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends here, so a lost executor costs at most the tasks of one later
    stage.  The files live until the application ends, since the frames
    returned to the caller are lazy.  The shuffle files of the write go as soon
    as it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_sweep)
    path = f"{shared_dir(spark).rstrip('/')}/spanweave-{uuid.uuid4().hex}/{label}"
    _written.append((spark, path.rpartition("/")[0]))
    with _writing:
        was = spark.conf.get(_DROP_SHUFFLES, None)
        spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(_DROP_SHUFFLES) if was is None else spark.conf.set(_DROP_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def unspool(df: DataFrame) -> None:
    """Delete a spooled table that no later frame reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/spanweave-" in path:
            drop_path(df.sparkSession, path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: a table that grows with the input must not go through the driver, however small its files are."""
    return df.hint("merge")


def give_back() -> None:
    """Returns what this process has freed to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as an Arrow pass that gives memory back as it ends: workers wait for later stages and count beside the JVM meanwhile."""

    @functools.wraps(run)
    def passed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return passed


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores behind it until no column of ``taken`` has that name in any case."""
    held = {c.lower() for c in taken}
    while base.lower() in held:
        base += "_"
    return base


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` would change other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
