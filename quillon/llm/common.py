"""What the operators share: the shared folder, stored tables and ASCII-lower-cased words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MASK64 = (1 << 64) - 1


#: Rows that go to Python at once: texts can be long, and a worker and the JVM hold a few batches each.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of batches of texts, unless the session asks for smaller ones; and keep one pool of Python workers.

    Spark hands its setting of short tracebacks to some Python nodes only, and starts workers anew for each environment.
    """
    spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, local mode makes an own one, and a
    cluster, whose executors would not see it, is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fewer(df: DataFrame) -> DataFrame:
    """df in an eighth of the shuffle partitions, but a task for each core: they are sized for texts, and rows of a few
    numbers would make very many very small files of them."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, partitions(spark) // 8))


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df, written as a table in the shared folder and read back: it survives lost executors and cuts the lineage.

    narrow: its rows are a few numbers, so that fewer files do.
    """
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    (fewer(df) if narrow else df).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path  # type: ignore[attr-defined]
    return back


def released(*tables: DataFrame) -> None:
    """Delete stored tables. Whatever was made of them must be stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:  # noqa: ANN001
    """A join of two sides that both grow with the input: never broadcast, however small they are here."""
    return left.join(right.hint("merge"), on, how)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which its operator sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Return what this worker has freed to the system: workers stay alive for other stages, beside each other's memory."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Collect the garbage of the executors' JVMs, a task for each core. A heap that has grown while much was sorted stays
    that large beside what follows, whether needed or not; a whole collection returns what is free to the system."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc')").collect()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, that gives memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of many byte ranges of one buffer at once, by prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, data: bytes | np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end]."""
        data = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
            return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
