"""Tables in versions: each in a folder of its own, its record created last and never replaced, so readers see whole versions only.

The records v1.json, v2.json ... are the truth: a record is created exclusively, so of two writers of one version one fails,
and a version that exists is never written again.  current.json points to the version in use, which `restore` may set back;
where it is missing or unreadable, the newest record counts.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, value: dict) -> None:
    """Written only if nothing is there."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise ValueError(f"{path} is there already") from e
        raise
    out.write(json.dumps(value, sort_keys=True).encode())
    out.close()


def _point(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside its place, then renamed over it in one call of the file system."""
    _create(spark, temp := f"{path}.{uuid.uuid4().hex}", value)
    jvm, (fs, p), (_, q) = spark.sparkContext._jvm, _fs(spark, path), _fs(spark, temp)
    how = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(q), fs.makeQualified(p), over)


def _numbers(spark: SparkSession, base: str) -> list[int]:
    """The numbers of all records, whole or not."""
    fs, p = _fs(spark, base)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json") and x[1:-5].isdigit())


def _record(spark: SparkSession, path: str) -> dict | None:
    """A record or pointer; None where it is missing or was not written to its end."""
    try:
        return _read(spark, path)
    except ValueError:
        return None


def _now(spark: SparkSession, base: str) -> dict | None:
    """The record in use: the pointed one, else the newest whole one."""
    pointed = _record(spark, f"{base}/current.json")
    for n in [pointed["version"]] if pointed else reversed(_numbers(spark, base)):
        if found := _record(spark, f"{base}/v{n}.json"):
            return found
    return None


def fingerprint(df: DataFrame) -> dict:
    """Row count and an order-independent checksum."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
    return {"rows": r["n"], "sum": str(r["s"] or 0)}


def publish(df: DataFrame, base: str, expect: int | None = None) -> int:
    """Write the next version and point to it; returns its number.

    expect: the version the caller built on; another current one is an error, as is a version that reads back
    differently or that another writer published meanwhile.  The same rows as the current version give no new one.
    """
    spark = df.sparkSession
    now = _now(spark, base)
    number = now["version"] if now else 0
    if expect is not None and expect != number:
        raise ValueError(f"version {number} is current, not {expect}")
    mark = fingerprint(df)
    if now and now["mark"] == mark:
        return number
    new = max([number, *_numbers(spark, base)]) + 1
    folder = f"v{new}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{base}/{folder}")
    if fingerprint(spark.read.schema(df.schema).parquet(f"{base}/{folder}").select(*df.columns)) != mark:
        raise OSError(f"{folder} does not read back")
    _create(spark, f"{base}/v{new}.json", {"version": new, "parent": number, "mark": mark, "folder": folder})
    _point(spark, f"{base}/current.json", {"version": new})
    return new


def current(spark: SparkSession, base: str) -> DataFrame | None:
    now = _now(spark, base)
    return spark.read.parquet(f"{base}/{now['folder']}") if now else None


def _whole(spark: SparkSession, base: str, info: dict) -> bool:
    """Whether the rows of a version are those of its record.  Only missing or damaged files make a version bad; any
    other failure (no access, no session) is raised."""
    fs, folder = _fs(spark, f"{base}/{info['folder']}")
    if not fs.exists(folder):
        return False
    try:
        return fingerprint(spark.read.parquet(f"{base}/{info['folder']}")) == info["mark"]
    except PySparkException as e:
        if any(x in str(e) for x in ("UNABLE_TO_INFER_SCHEMA", "FILE_NOT_EXIST", "CANNOT_READ_FILE", "FileNotFound", "is not a Parquet file", "FAILED_READ_FILE")):
            return False
        raise


def restore(spark: SparkSession, base: str) -> int:
    """Point to the newest version that is whole; returns its number, 0 if there is none."""
    for n in reversed(_numbers(spark, base)):
        info = _record(spark, f"{base}/v{n}.json")
        if info and _whole(spark, base, info):
            _point(spark, f"{base}/current.json", {"version": n})
            return n
    return 0


def ancestry_faults(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """(version, fault) of records whose parent is missing or not older: the chain of versions is whole if there is none."""
    numbers = _numbers(spark, base)
    found = {n: _record(spark, f"{base}/v{n}.json") for n in numbers}
    out = [(n, "unreadable") for n in numbers if found[n] is None]
    out += [(n, "parent") for n, r in found.items() if r and r["parent"] and (r["parent"] >= n or not found.get(r["parent"]))]
    return sorted(out)


def log_event(spark: SparkSession, base: str, kind: str, **fields) -> None:
    """Append one event to the log."""
    row = {"kind": kind, "at": time.time(), "fields": json.dumps(fields, sort_keys=True)}
    spark.createDataFrame([row], "kind string, at double, fields string").coalesce(1).write.mode("append").json(f"{base}/events")
