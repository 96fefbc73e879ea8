"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` adds or overrides settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without the setting gets a folder of its own: on a cluster a machine-local
    folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    sc.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by a hash of `keys`, whose values must be many, to three tasks per core or more.

    A table of narrow rows lies in few files and row groups, so that its scan has few tasks. Where much work per row
    follows, it is dealt out first, while the rows are still narrow.
    """
    spark = df.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once, as a Parquet table in the shared folder, and go on from there.

    This cuts the lineage without depending on any executor's memory or disk. The table brings its
    size, so later joins are planned on facts, and its readers load only the columns they need.
    Tables lie below the application's id, to be removed with the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_narrow(df: DataFrame) -> DataFrame:
    """`settle` for tables of a few numbers per row, written by at most three tasks per core.

    A task takes its partitions one after another. As many files as partitions would be mostly tiny ones, and on a local file
    system without Hadoop's native library each file has the executor start processes (chmod).
    """
    return settle(df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism))


def in_fewer_tasks(df: DataFrame) -> DataFrame:
    """The rows, made by an eighth as many tasks as a shuffle has partitions, but by three per core at least.

    For tables of long rows, for the reason told at `settle_narrow`: each task writes a file, and takes its partitions one by one.
    """
    spark = df.sparkSession
    return df.coalesce(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


@contextmanager
def settled_tables() -> Iterator[list[str]]:
    """The folders of all tables that are settled within the block, for `remove_tables`."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield made
    finally:
        _MADE.reset(token)


def remove_tables(spark: SparkSession, made: list[str], read_by: Iterable[DataFrame] = ()) -> None:
    """Delete settled tables whose readers have ended, so that disk use does not grow with the number of steps.

    Tables that any of `read_by` still reads stay, and stay in `made`.
    """
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    names = {path.rpartition("/")[2] for path in made}
    needed = {part for df in read_by for file in df.inputFiles() for part in file.split("/")[-3:] if part in names}
    for path in [p for p in made if p.rpartition("/")[2] not in needed]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)
        made.remove(path)
