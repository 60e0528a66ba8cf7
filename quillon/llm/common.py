"""Helpers that the corpus operators share: reading, shared storage and size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many estimated bytes may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20

#: Prefix of the folders that materialize writes, and their paths by the application that wrote them.
_PREFIX = "quillon-"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own; on a cluster no folder of the driver would do, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def _cleanup() -> None:
    for spark, path in _written:
        _delete(spark, path)
    _written.clear()


atexit.register(_cleanup)


def _path_of(df: DataFrame) -> str:
    """The folder that materialize wrote ``df`` to."""
    return next(path for _, path in _written if df.inputFiles() and path.rsplit("/", 1)[1] in df.inputFiles()[0])


def materialize(df: DataFrame, label: str, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and any executor can read it.

    With ``onto``, a table from here of the same columns, its rows are added to that.
    """
    spark = df.sparkSession
    if onto is not None and onto.inputFiles():
        path = _path_of(onto)
    else:
        path = f"{shared_dir(spark)}/{_PREFIX}{label}-{uuid.uuid4().hex}"
        _written.append((spark, path))
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing will read again."""
    for df in tables:
        if df.inputFiles():
            path = _path_of(df)
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table is within the broadcast bound, by its real row count."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the (materialised) table's measured size is within the bound; otherwise forbid it."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df.hint("merge")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def give_back() -> None:
    """Return free memory of this worker to the system: workers outlive their tasks, and idle ones share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
