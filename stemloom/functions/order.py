"""Orders of the documents: sort keys that are stable and the same on every machine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BETWEEN = "\U0010fffe"


def fold_texts(texts: list[str | None]) -> list[str | None]:
    """The case-folded texts, folded together where none holds the separator."""
    joined = _BETWEEN.join("" if t is None else t for t in texts)
    if not texts or joined.count(_BETWEEN) != len(texts) - 1:
        return [t if t is None else t.casefold() for t in texts]
    return [t if t is None else f for t, f in zip(texts, joined.casefold().split(_BETWEEN))]


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding (which is not lower case for some letters, as the sharp s)."""
    return pd.Series(fold_texts(s.tolist()), dtype=object)


def by_path(path: str, tie: str) -> list[Column]:
    """Entries and registry rows: by folded path, then by `tie` (the path itself, a source id or an issue code)."""
    return [casefold(F.col(path)).asc(), F.col(tie).asc()]


def by_line(line: str = "line", code: str = "code", summary: str = "summary") -> list[Column]:
    """Findings: by line number, code and summary."""
    return [F.col(line).asc(), F.col(code).asc(), F.col(summary).asc()]


def by_evidence(source: str = "source_id", locator: str = "locator", fingerprint: str = "evidence_fingerprint") -> list[Column]:
    """Evidence: the locator compares as text, so line:10 stands before line:2."""
    return [F.col(source).asc(), F.col(locator).asc(), F.col(fingerprint).asc()]


def by_option(option: str) -> Column:
    """A nullable option id, without one first."""
    return F.col(option).asc_nulls_first()
