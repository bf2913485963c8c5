"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the transformations rely on at run time. AQE picks broadcast joins by the sizes it has measured, and
# splits the partitions of a key that holds a large share of the rows, also where the split
# costs one more shuffle after the join.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

STATIC_BROADCAST, MEASURED_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
ADVISORY, SPLIT = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
PARTITIONS, FINEST = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# A file above this size is not broadcast unmeasured, a task reads about this much of a shuffle or a file,
# and the largest shuffle is taken to be this many times the compressed input (4 were measured).
MOST_UNMEASURED, MOST_PER_TASK, GROWN = 16 * 2**10, 16 * 2**20, 8
MOST_PER_SLICE, MOST_SLICES = 32 * 2**20, 6

# While a stage is written: its shuffle files go when it is stored, and a join by several keys takes rows as they are dealt by one of them.
STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

_local_folders: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time settings that the transformations rely on, whatever the session had."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _limit_broadcasts(spark)
    _lower(spark, ADVISORY, MOST_PER_TASK)
    _lower(spark, SPLIT, MOST_PER_TASK)
    return spark


def cut_for(spark: SparkSession, paths: Sequence[str]) -> None:
    """Cut shuffles finely enough for the size of the input, so that no partition outgrows a task.

    AQE joins small partitions but can't cut one that holds many keys, so the fixed number of a session lets
    each partition grow with the input. The number is only raised; what the session has set higher stays.
    """
    asked = -(-GROWN * stored_bytes(spark, paths) // MOST_PER_TASK)
    if asked > int(spark.conf.get(FINEST, None) or spark.conf.get(PARTITIONS)):
        spark.conf.set(FINEST, str(asked))


@contextmanager
def stored_whole(spark: SparkSession) -> Iterator[None]:
    """Settings for a write whose result replaces everything it was made from; the session's own hold again afterwards.

    Spark keeps the shuffle files of a query until the driver's garbage collector finds them unused, which may be never
    as long as the driver has memory left. Those of a stage are of no use once it is stored.
    """
    before = {key: spark.conf.get(key, None) for key in STORING}
    for key, value in STORING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def slices(spark: SparkSession, path: str) -> int:
    """Into how many slices a step over the rows of a file is cut: one for ``MOST_PER_SLICE`` of it, ``MOST_SLICES`` at most.

    Each slice reads the whole file, so their number is bounded: the work stays in proportion to the input.
    """
    return min(MOST_SLICES, max(1, -(-stored_bytes(spark, [path]) // MOST_PER_SLICE)))


def of_slice(df: DataFrame, key: str, number: int, every: int) -> DataFrame:
    """The rows whose whole-numbered key belongs to one of ``every`` slices. A key is in one slice, and so is the null key."""
    return df if every == 1 else df.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(every)) == number)


def spread(df: DataFrame, key: str, path: str, rows: int) -> DataFrame:
    """``df`` dealt by key over tasks that each make about ``MOST_PER_TASK`` once every row of the file becomes ``rows`` rows.

    A small file is read by a few tasks; what a generator makes of it would lie in the memory of these few.
    """
    return df.repartition(max(1, -(-rows * stored_bytes(df.sparkSession, [path]) // MOST_PER_TASK)), key)


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Bytes of the files below ``paths``; a path that does not exist has none."""
    total, settings = 0, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(settings)
        total += store.getContentSummary(place).getLength() if store.exists(place) else 0
    return total


def _limit_broadcasts(spark: SparkSession) -> None:
    """Hold the session's own limit of broadcasts against measured sizes only.

    The planner guesses the size of a table from its compressed files and does not count the rows that a generator
    adds, so the guess can be a thousandth of the real size. AQE does not undo a planned broadcast either, since a
    sort-merge join has one more shuffle. It does make a broadcast of a planned sort-merge join with a small side.
    """
    if spark.conf.get(MEASURED_BROADCAST, None) is None:
        spark.conf.set(MEASURED_BROADCAST, spark.conf.get(STATIC_BROADCAST))
    _lower(spark, STATIC_BROADCAST, MOST_UNMEASURED)


def _lower(spark: SparkSession, key: str, most: int) -> None:
    """Lower a size; what the session has set lower stays."""
    if size_in_bytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it: ``10MB``, ``64m``, ``67108864b`` or ``-1``."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def local_session(cores: str | int = "*", app: str = "cohortloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own session."""
    parallelism = "8" if cores == "*" else str(max(int(cores), 1))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", parallelism)
    )
    for key, value in {**RUNTIME, **LOCAL}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="cohortloom-checkpoint-")
    return _local_folders[application]


def new_folder(spark: SparkSession) -> str:
    """A fresh path below the shared folder, for a stage that is written and read back.

    The application owns it: results are read lazily, so it is removed when the driver ends.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return f"{folder.toString()}/data"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and continue from there.

    Needed where a later step depends on exactly which partition a row fell into, so a
    recomputation after a lost executor must not be able to give another answer.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
