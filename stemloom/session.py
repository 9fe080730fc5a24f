"""Session helpers: loading tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "stemloom", master: str | None = None) -> SparkSession:
    """A session with the settings the library is written for; existing settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is absent (local mode, tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stemloom-")
        sc.setCheckpointDir(found)
        return sc.getCheckpointDir()
    return found


#: Folders written by materialize that are still there.
_written: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder for a table of this process, removed as materialize says."""
    path = f"{shared_dir(spark).rstrip('/')}/stemloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors.

    With `by`, each value of that integer column gets a folder of its own, so a filter on it reads only its files.  The files go away
    when the block of a surrounding `scratch()` ends, else when the driver process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables materialized inside the block are removed at its end; results must have been consumed by then.

    For long sessions: `with scratch(): p9_found(spark, folder).write.parquet(out)`.
    """
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _remove(*_written.pop())


@atexit.register
def _remove_all() -> None:
    while _written:
        _remove(*_written.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone
        pass


def salted(df: DataFrame, salts: int, *by: str) -> DataFrame:
    """Add a `salt` column in [0, salts) from a hash of the given columns, so that a hot key spreads over tasks."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def unsalted(df: DataFrame, salts: int) -> DataFrame:
    """The other side of a salted join: every row once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


#: Rows of one key from which it counts as hot.
HOT_ROWS = 100_000
#: The most hot keys there can be, whatever the table: the bound of what is broadcast for them.
MOST_HOT = 1 << 17


def hot_limit(n_rows: int, limit: int = HOT_ROWS) -> int:
    """The number of rows above which a key is hot: at least `limit`, and so many that at most MOST_HOT keys can be."""
    return max(limit, n_rows // MOST_HOT)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, n_rows: int, limit: int = HOT_ROWS) -> DataFrame:
    """Rows joined with the one row of their group (inner join), `size` being the group's number of rows.

    Hot groups (see hot_limit; their number has a bound) are broadcast: their rows are not shuffled.  All other groups
    are too small to burden a task.
    """
    top = hot_limit(n_rows, limit)
    hot, cold = groups.where(F.col(size) > top), groups.where(F.col(size) <= top)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def join_hot(rows: DataFrame, other: DataFrame, on: list[str], hot: DataFrame, salts: int = 64) -> DataFrame:
    """Inner join in which the keys of `hot` (columns `on`, a bounded number of rows) hold many of `rows`.

    Those rows spread over `salts` by a hash of the whole row; the other side's rows of hot keys are repeated for each salt.
    """
    marked = F.broadcast(hot.select(*on).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    left = rows.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(marked, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*on, "_salt"]).drop("_salt")
