"""File sources: discovery, strict decoding, JSON and CSV."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemloom.functions.documents import safe_relative_path

# Suffixes, schemas and column names of the formats.
TEXT_SUFFIXES = r"\.(txt|md)\z"
PARSE_SUFFIXES = r"\.(txt|md|markdown)\z"
REFERENCE = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("locator", T.StringType())])
OPTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])
EXTRACTED = T.StructType([
    T.StructField("question_type", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("options", T.ArrayType(OPTION)), T.StructField("answer", T.StringType()),
    T.StructField("explanation", T.StringType()), T.StructField("chapter", T.StringType()), T.StructField("source_reference", REFERENCE), T.StructField("extraction_notes", T.StringType()),
])
CSV_COLUMNS = ("sequence_number", "paper_or_chapter", "question_type", "stem", "option_a", "option_b", "option_c", "option_d", "option_e", "correct_answer", "explanation")


def _relative(root: str) -> Column:
    """The path of a file below the folder `root`, which may have a scheme."""
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace("path", "^[a-z0-9]+:/{1,3}", "/")
    return F.substring(path, F.lit(len(base) + 2), F.length(path))


def _local(path: str) -> str | None:
    """The path of a folder on this machine's file system; None for any other."""
    return path.removeprefix("file://") if "://" not in path or path.startswith("file://") else None


def check_roots(source: str, workspace: str) -> None:
    """Refuse a source root that is missing, is the workspace, or lies inside it (local folders, links resolved)."""
    a, b = (_local(p) for p in (source, workspace))
    if a is None or b is None:
        if source.rstrip("/") == workspace.rstrip("/") or source.startswith(workspace.rstrip("/") + "/"):
            raise ValueError("the source root lies in the workspace")
        return
    if not os.path.isdir(a):
        raise ValueError(f"{source} is no folder")
    a, b = os.path.realpath(a), os.path.realpath(b)
    if a == b or a.startswith(b.rstrip(os.sep) + os.sep):
        raise ValueError("the source root lies in the workspace")


def links_below(root: str) -> list[str]:
    """Relative paths of the links below a local folder, which a scan does not follow; none for other file systems.

    Only the listing of folders runs on the driver, as Spark's own does.
    """
    top = _local(root)
    found = []
    for folder, folders, names in os.walk(top, followlinks=False) if top else ():
        found += [os.path.relpath(os.path.join(folder, n), top).replace(os.sep, "/") for n in (*folders, *names) if os.path.islink(os.path.join(folder, n))]
    return sorted(found, key=lambda p: (p.casefold(), p))


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, reason) of what a scan leaves out because it is a link."""
    return spark.createDataFrame([(p, "reparse_point") for p in links_below(root)], "relative_path string, reason string")


def discover(spark: SparkSession, root: str, workspace: str | None = None) -> DataFrame:
    """relative_path, size_bytes, content_hash, support_status of all files below a folder.

    Suffixes .txt and .md (any case) are 'builtin_text', others 'unsupported'.  The hash is that of the bytes; a file is
    read by one task, so its size is bounded by the task's memory.  Files below `workspace`, a folder relative to the
    root, are left out, as are links and what lies behind them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = _relative(root)
    for folder in (*([workspace] if workspace else []), *links_below(root)):
        files = files.where(~is_within(rel, folder))
    return files.select(rel.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.when(F.lower(rel).rlike(TEXT_SUFFIXES), "builtin_text").otherwise("unsupported").alias("support_status"))


def is_within(path: Column, folder: str) -> Column:
    """Whether a relative path is a folder or lies below it."""
    inner = folder.strip("/")
    return (path == inner) | path.startswith(inner + "/")


def discovery_issues(found: DataFrame) -> DataFrame:
    """(code, relative_path, summary) of files that cannot be taken in: of another format, or without a hash."""
    unread = F.col("content_hash").isNull()
    return found.where(unread | (F.col("support_status") == "unsupported")).select(
        F.when(unread, "QB-SOURCE-READ-FAILED").otherwise("QB-SOURCE-UNSUPPORTED").alias("code"), "relative_path",
        F.when(unread, "authorized source could not be read").otherwise("source format is not supported in Milestone 1").alias("summary"),
    )


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, content_hash, text of files that can be parsed; text is null where the bytes are not UTF-8.

    One leading byte-order mark is dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.lower("path").rlike(PARSE_SUFFIXES))
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "")
    return files.select(_relative(root).alias("relative_path"), F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def registered_texts(registry: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, refused): texts of sources whose bytes are those the registry knows, and the other sources with a reason.

    reason, the first that holds: 'not_present' (no present row), 'not_unique' (several), 'unsafe_path', 'suffix',
    'missing' (no such file), 'stale' (other bytes), 'encoding' (not UTF-8).
    """
    r = registry.groupBy("source_id").agg(F.count_if(F.col("presence") == "present").alias("n"), F.max(F.when(F.col("presence") == "present", F.struct(F.col("path").alias("relative_path"), "hash"))).alias("x"))
    j = r.select("source_id", "n", "x.*").join(texts, "relative_path", "left")
    path = F.col("relative_path")
    reason = (
        F.when(F.col("n") == 0, "not_present").when(F.col("n") > 1, "not_unique").when(~safe_relative_path(path), "unsafe_path").when(~F.lower(path).rlike(PARSE_SUFFIXES), "suffix")
        .when(F.col("content_hash").isNull(), "missing").when(~F.col("hash").eqNullSafe(F.col("content_hash")), "stale").when(F.col("text").isNull(), "encoding")
    )
    j = j.withColumn("reason", reason)
    return j.where("reason IS NULL").select("source_id", "relative_path", "text"), j.where("reason IS NOT NULL").select("source_id", "relative_path", "reason")


def read_extracted(spark: SparkSession, path: str) -> DataFrame:
    """The questions of extraction batches ({"questions": [...]} documents), with file and position."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    doc = F.from_json("value", T.StructType([T.StructField("questions", T.ArrayType(EXTRACTED))]), {"mode": "PERMISSIVE"})
    rows = files.select("file", F.posexplode(doc["questions"]).alias("p", "q"))
    return rows.select("file", (F.col("p") + 1).alias("position"), "q.*")


def read_standard_csv(spark: SparkSession, path: str, header: tuple[str, ...]) -> DataFrame:
    """The 11-column file with quoted commas and line breaks; another header is an error."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    if tuple(df.columns) != header:
        raise ValueError(f"unexpected header {df.columns}")
    return df.toDF(*CSV_COLUMNS)
