"""Helpers shared by the training-data operators: shared scratch tables, text batches, hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, with_settings

_LOCAL_ROOTS: dict[str, str] = {}
#: Bits of the largest filter (16 MB): past some 10^8 keys it lets through ever more, never too little.
_MOST_BITS = 27
_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a worker process keeps from task to task: one thing at a time, so that what an earlier stage kept is let go."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[name] = make()
    return _HELD[name]


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), one temporary folder per application is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_LOCAL_ROOTS[app])
    return _LOCAL_ROOTS[app]


class Scratch:
    """Tables written to the shared folder: they cut lineage, and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, rows_in_file: int = 0) -> DataFrame:
        """Write ``df`` as Parquet and give back a reader of it; ``.scratch_path`` has its place.

        Rows of megabytes need a bound on ``rows_in_file``: Parquet's writer looks at what it holds after a hundred rows first, and
        Spark's reader takes some thousand of a file's rows at once.  Python workers get as many of them in a batch, in a session
        of the table's own."""
        path = self.path(name)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_in_file).parquet(path)
        spark = with_settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_in_file)}) if rows_in_file else self.spark
        out = spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch_path)
            p.getFileSystem(conf).delete(p, True)

    def release(self, wait: float = 0.0) -> None:
        """Let Spark delete the shuffle files of finished stages now, not when the driver next collects its garbage.

        It does so in the background; ``wait`` gives it some seconds before the next stage writes much."""
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(wait)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out in taken:
        out = f"_{out}"
    return out


class Filter:
    """A bitmap of hashed keys, sized from their number, that tells rows of other keys before they are sent anywhere."""

    def __init__(self, keys: DataFrame, *names: str):
        n = keys.count()
        self.bits = min(_MOST_BITS, max(16, int(16 * n).bit_length()))
        place = F.shiftrightunsigned(F.xxhash64(*names), 64 - self.bits)
        # at most 2^27 / 2^15 rows of 4 KB
        self.map = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bits"))

    def mark(self, df: DataFrame, name: str, *names: str) -> DataFrame:
        """``df`` with a column that is false for rows whose key is surely none of the filter's."""
        place = F.shiftrightunsigned(F.xxhash64(*names), 64 - self.bits)
        bucket, bits, spot = fresh(df, "bucket"), fresh(df, "bits"), fresh(df, "spot")
        small = self.map.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(bits))
        placed = df.withColumn(spot, F.bitmap_bit_position(place)).withColumn(bucket, F.bitmap_bucket_number(place))
        octet = F.conv(F.hex(F.substring(F.col(bits), (F.col(spot) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.call_function("getbit", octet, (F.col(spot) % 8).cast("int")) == 1, F.lit(False))
        return placed.join(F.broadcast(small), bucket, "left").withColumn(name, hit).drop(bucket, bits, spot)


def slices(texts, most_bytes: int):
    """Cut an Arrow string array into (from, to) runs of about ``most_bytes`` of text, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at, n = 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield at, min(to, n)
        at = min(to, n)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two xor-shift-multiply rounds)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` numbers: a polynomial over scrambled values, wrapping."""
    if len(ids) < size:
        return np.empty(0, np.uint64)
    scrambled = mix64(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(0x5851F42D4C957F2D)
        out += scrambled[k : k + len(out)]
    return out
