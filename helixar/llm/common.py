"""What the corpus operators share: the shared folder, written tables and who deletes them, prefix sums over partitions."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Working:
    """The working tables written inside one `with` block, and by nobody else; release() deletes these alone.

    A frame made in the block reads them, so release it after the frame has been written. A block that fails releases at
    once. Outside of a block tables stay in the shared folder, whose owner empties it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Working":
        self._outer = _working.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _working.reset(self._outer)
        if kind:
            self.release()

    def release(self, but: str | None = None) -> None:
        """Delete them (all but one)."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in [x for x in self.paths if x != but]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
            self.paths.remove(name)


_own_dir: str | None = None
_working: ContextVar[Working | None] = ContextVar("helixar_working", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, if no
    executor runs elsewhere."""
    global _own_dir
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="helixar-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dir)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the tables of the block that asks for it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    note(path)
    return path


def note(path: str) -> None:
    """From now on the path belongs to the block around, if any."""
    if (working := _working.get()) is not None:
        working.paths.append(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of a mapInArrow whose worker, which waits for other tasks, gives free memory back when a task has ended."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    """Partitions for a shuffle that must keep its number: the session's setting, sized to the input by its owner."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of driver rows whose number is bounded by partitions, strata or parameters; safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def join_spread(many: DataFrame, few: DataFrame, key: str, salts: int = 64, share: int = 1000) -> DataFrame:
    """Left join of `many` (a written table) with `few`, which has at most one row a key. Keys with over one in `share` rows
    of many, of which there are fewer than `share`, are dealt over `salts` parts, their rows of `few` repeated for each."""
    n = many.count()
    is_hot = free_name([*many.columns, *few.columns], "_hot")
    salt = free_name([*many.columns, *few.columns], "_salt")
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias(is_hot)).filter(F.col(is_hot) > max(1, n // share)).select(key, F.lit(True).alias(is_hot))
    hot = F.broadcast(materialize(hot, "hot"))  # under `share` rows of a key
    dealt = many.join(hot, key, "left").withColumn(salt, F.when(F.col(is_hot), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop(is_hot)
    wide = few.join(hot, key, "left").withColumn(salt, F.explode(F.when(F.col(is_hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(is_hot)
    return dealt.join(wide, [key, salt], "left").drop(salt)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def free_name(taken, wanted: str) -> str:
    """wanted, with underscores until no column has that name (names compare without case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted
