"""What several operators share: reading tables, tables written between jobs, mixing of 64-bit hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.shipping import ship

#: A word is a longest run of bytes other than these (ASCII white space). bytes.split() has the same notion.
WHITE = r"\x20\x09-\x0D"
#: The size up to which a table is sent to all executors.
SENT_BYTES = 64 << 20
#: Rows, and bytes of text, that a Python worker works on at once.
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches between Spark and Python in this session, and with them what both sides hold; settings given at its start stay."""
    given = spark.sparkContext.getConf()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")):
        if not given.contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trailweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and it is computed once. The folder goes with the session."""
    spark = df.sparkSession
    ship(spark)
    small_batches(spark)
    path = f"{shared_dir(spark)}/trailweave/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def sent(small: DataFrame, most_bytes: int = SENT_BYTES) -> DataFrame:
    """small as a written table, sent to all executors if its rows take most_bytes at most; else Spark joins it by a shuffle."""
    small = written(small)
    size = small.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= most_bytes else small


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and short texts (a text longer than most_bytes is a slice of its own), which bounds what a worker makes of them at once."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
            yield b.slice(at, to - at)
            at = to


def released() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # not this C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, a function for mapInArrow, over slices of its batches; at its end memory is released."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(in_slices(batches))
        released()

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_crc32(name: str = "text") -> Column:
    return F.crc32(F.encode(text_or_empty(name), "UTF-8"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x (the finisher of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
