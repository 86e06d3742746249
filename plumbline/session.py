"""Session construction and durable lineage cuts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Sketch and percentile buffers stay hash-based for more groups per task.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application.

    It lies in the shared folder named by `spark.checkpoint.dir`. Only a local master may
    do without that setting; it then gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="plumbline-scratch-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"


_written: dict[str, SparkSession] = {}


def _remove(path: str, spark: SparkSession) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the scratch folder once and read it from there.

    Used where a result is small relative to its inputs and feeds several later jobs. The
    files survive executor loss, so nothing upstream is recomputed; later reads prune
    columns. `discard` removes a table early; the rest goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no plan refers to any more.

    Its cleaner acts when the driver's JVM collects garbage, which may be long after a large
    exchange was last read; call this once a table made from such an exchange is written.
    """
    for _ in range(2):  # the first round tells the JVM which plans Python has let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Remove the files behind a table that `durable` returned and nothing reads any more."""
    files = df.inputFiles()[:1]
    for path in [p for p in _written if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]:
        _remove(path, _written.pop(path))


@atexit.register
def _clear_scratch() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _remove(path, spark)
    _written.clear()


# A broadcast side is built only below this row count; rows of such tables are a few
# hundred bytes, so the side stays within tens of megabytes.
BROADCAST_ROWS = 100_000


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count a per-key table, stopping early, to decide whether it may be broadcast."""
    return small.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", *, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Equi-join a table with few rows per key onto a large one.

    The small side is counted first and broadcast only when it fits; otherwise this is a
    shuffled join whose hot keys adaptive execution may split. `small` should be cheap
    to count, for example the result of `durable`; wide rows need a lower `max_rows`.
    """
    return big.join(F.broadcast(small) if fits_broadcast(small, max_rows) else small, keys, how)


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> None:
    """Bound the Arrow batches of the session's Python kernels.

    The default of 10,000 rows means tens of megabytes of documents, held several times over
    on both sides of every task. Kernels over texts and other wide rows call this first.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by `keys` into the session's full number of shuffle partitions.

    Ahead of Python kernels: adaptive execution would merge partitions that are small in
    bytes, although the work per row is large.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
