"""Sinks: the 11-column CSV, JSON lines, write-once tables."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_OPTIONS = {"header": True, "emptyValue": "", "nullValue": "", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def write_csv(rows: DataFrame, path: str, header: tuple[str, ...] | None = None, order: str = "sequence_number") -> None:
    """A folder of CSV parts in order, range-partitioned (no single task); quoting is minimal, '"' is doubled."""
    df = rows.toDF(*header) if header else rows
    by = header[0] if header else order
    df.repartitionByRange(F.col(by)).sortWithinPartitions(by).write.options(**CSV_OPTIONS).csv(path)


def write_csv_file(rows: DataFrame, path: str, header: tuple[str, ...], order: str = "sequence_number") -> None:
    """One local CSV file, written beside its place and moved there in one step; rows are streamed in order."""
    import csv

    def fill(f) -> None:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(header)
        for r in rows.orderBy(order).toLocalIterator():
            w.writerow(["" if v is None else v for v in r])

    _replace(path, fill)


def write_json_lines(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.option("ignoreNullFields", not keep_nulls).json(path)


def _replace(path: str, fill: Callable) -> None:
    """A local text file written beside its place by `fill`, synced and moved there in one step."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            fill(f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def indented_json(value) -> str:
    """The workspace form of a document: sorted members, two blanks of indent, a final line break."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"


def bank_document(questions: DataFrame, bank: dict, path: str) -> None:
    """One bank as a JSON document with two-space indent, questions in `position` order, streamed from the executors.

    The file is there whole or not at all.
    """
    fields = [c for c in questions.columns if c != "position"]

    def fill(f) -> None:
        head = json.dumps(bank, ensure_ascii=False, indent=2)
        f.write(head[: head.rindex("}")].rstrip() + (",\n" if bank else "\n") + '  "questions": [')
        first = True
        for r in questions.orderBy("position").select(F.to_json(F.struct(*fields)).alias("j")).toLocalIterator():
            text = json.dumps(json.loads(r["j"]), ensure_ascii=False, indent=2)
            f.write(("\n" if first else ",\n") + "\n".join("    " + line for line in text.split("\n")))
            first = False
        f.write(("]" if first else "\n  ]") + "\n}\n")

    _replace(path, fill)


def write_once(df: DataFrame, path: str, key: list[str]) -> bool:
    """Write a table that may not change: False if the same rows are there already, an error if others are."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("errorifexists").parquet(path)
        return True
    old = spark.read.parquet(path).select(*df.columns)
    digest = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first()
    if digest(old) != digest(df):
        raise ValueError(f"{path} holds other rows")
    return False
