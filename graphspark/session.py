"""Session helpers: worker import path, shared scratch folder, materialised tables.

Iterative operators cut their lineage by writing a table to the folder that the
cluster names in ``spark.checkpoint.dir``: all executors share it, so a lost
executor costs a task retry and nothing else. ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package.

    A cluster gets it through PYTHONPATH or --py-files; for workers started on
    this machine the repository folder is appended to their PYTHONPATH.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, REPO])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master gets a private folder of its own; on a cluster a folder of one
    machine would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="graphspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/graphspark-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


#: Where the tables of ``materialize`` lie, by the identity of their DataFrames.
_PATHS: dict[int, str] = {}


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads: what was computed from them has been written itself."""
    for df in tables:
        path = _PATHS.pop(id(df), None)
        if path is not None:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def loop_materialize(df: DataFrame, tag: str, previous: list[str]) -> DataFrame:
    """As ``materialize`` for a loop: keeps the paths written so far in ``previous``
    and deletes all but the two latest, so that a loop's disk use doesn't grow."""
    return loop_measured(df, tag, previous)[0]


def measured(df: DataFrame, tag: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, and aggregates of what was written (``n``, the number of rows, among them) from the same job."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()]), tag)
    return out, seen.get


def loop_measured(df: DataFrame, tag: str, previous: list[str], **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``measured`` for a loop. A stage that runs twice may count twice, so loops only ask for zero or for extremes."""
    out, found = measured(df, tag, **metrics)
    previous.append(_PATHS.pop(id(out)))
    while len(previous) > 2:
        drop_path(df.sparkSession, previous.pop(0))
    return out, found


#: Rows that a task aggregates or sorts at a time, where their number is known beforehand.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str, task_rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as keep about ``task_rows`` of its ``rows`` rows in each, so that an
    aggregation on these keys that follows runs there without another shuffle, and no task's memory grows with the input."""
    return df.repartition(max(1, -(-rows // (task_rows or TASK_ROWS))), *keys)


#: Estimated bytes up to which a table that a loop joins isn't worth dealing: its joins are broadcasts or one small shuffle.
SMALL = 64 << 20


def dealt(df: DataFrame, *keys: str, tag: str = "dealt", written: bool = False) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``keys`` and read back: a join or aggregation on these keys moves only
    the other side. For tables that every round of a loop joins, as a graph's edges. What the planner takes for small is
    written without buckets, or, if it's a scan of a ``written`` table, left as it is."""
    spark = df.sparkSession
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL:
        return df if written else materialize(df, tag)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = scratch_path(spark, tag), f"graphspark_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out
