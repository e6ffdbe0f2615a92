"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a session with one JVM has none, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="faultline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Bytes of input for each file of a small table, and files that it has at least.
FILE_BYTES, LEAST_FILES = 4 << 20, 16


def _bytes_read(df: DataFrame) -> int:
    """The size of all tables that the plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: Bytes of input for each partition of what is dealt by key; a plan that says it has more than UNKNOWN_BYTES doesn't know.
DEALT_BYTES, UNKNOWN_BYTES = 8 << 20, 1 << 50


def partitions_of(*tables: DataFrame) -> int:
    """As many partitions as the largest of the tables needs, by the size of what it reads, and no fewer than the session's."""
    known = [size for size in map(_bytes_read, tables) if size < UNKNOWN_BYTES]
    return max([int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), *(size // DEALT_BYTES for size in known)])


def dealt(df: DataFrame, partitions: int, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns``, so that a task's share does not grow with the input.

    Where the session's partitions are enough it is as it was, and the exchange that a join or a group makes does it.
    """
    return df.repartition(partitions, *columns) if partitions > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again: computed once, with no lineage to lose.

    A ``small`` table, as of ids, counts or links, is written by no more tasks than it takes to have ``FILE_BYTES`` of the
    tables that it is made of in each; that is all of them unless these are small. The table goes with :func:`dropped`, at
    the latest when the driver ends.
    """
    spark = df.sparkSession
    if small:
        wanted = max(LEAST_FILES, _bytes_read(df) // FILE_BYTES)
        if wanted < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(wanted)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_drop_all)
    _paths[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_in_buckets(df: DataFrame, name: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` stored like :func:`stored`, in files by a hash of ``columns``, so that a join on them moves the other side alone.

    ``buckets``: by default the session's shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    if not _paths:
        atexit.register(_drop_all)
    _paths[path] = spark
    _tables[path] = table
    # One task a bucket writes one file for it.
    df.repartition(n, *columns).write.bucketBy(n, *columns).sortBy(*columns).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stored_at = path
    return out


def _delete(path: str) -> None:
    spark = _paths.pop(path, None)
    if spark is not None:
        if path in _tables:
            spark.sql(f"drop table if exists {_tables.pop(path)}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing reads any more."""
    for table in tables:
        _delete(table._stored_at)


def _drop_all() -> None:
    for path in [*_paths]:
        with contextlib.suppress(Exception):  # the session may be gone; the folder is the cluster's to empty then
            _delete(path)
