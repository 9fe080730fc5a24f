"""Text kernel: lines, white space, normal form, fingerprints, deterministic ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The 29 code points that count as white space, as a character class for Java and RE2.
WHITE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Zero-width characters that document normalisation drops.
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}"


#: A noncharacter, which composes with nothing, between the texts of a batch.
_BETWEEN = "\U0010fffe"


def compose(texts: list[str | None]) -> list[str | None]:
    """Canonical composition of many texts in two calls: joined, looked at, and only if needed composed and split again."""
    given = ["" if t is None else t for t in texts]
    joined = _BETWEEN.join(given)
    if unicodedata.is_normalized("NFC", joined):
        return texts
    if joined.count(_BETWEEN) != len(given) - 1:  # a text holds the separator itself
        return [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    return [g if g is None else t for t, g in zip(unicodedata.normalize("NFC", joined).split(_BETWEEN), texts)]


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, a batch at a time."""
    given = s.tolist()
    made = compose(given)
    return s if made is given else pd.Series(made, dtype=object)


def logical_lines(text: Column) -> Column:
    """The lines of a text; CRLF, CR and LF end a line, a final break leaves an empty last line."""
    return F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n", -1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def normalize_text(c: Column) -> Column:
    """NFC, then white space collapsed; case, punctuation and full-width forms stay.  Empty results are null."""
    return F.nullif(collapse(nfc(c)), F.lit(""))


def _json(c: Column) -> Column:
    """to_json writes these controls with upper-case digits; the canonical form has lower-case ones."""
    out = F.to_json(c)
    for n in ("0E", "0F", "1A", "1B"):
        out = F.replace(out, F.lit(f"\\u00{n}"), F.lit(f"\\u00{n.lower()}"))
    return out


def text_fingerprint(normal: Column) -> Column:
    """SHA-256 of a text in normal form."""
    return F.sha2(normal, 256)


def option_set_fingerprint(normal: Column) -> Column:
    """SHA-256 of the sorted option texts (an array in normal form), repeats kept; null for no options or a null text."""
    ok = (F.size(normal) > 0) & ~F.exists(normal, lambda x: x.isNull())
    return F.when(ok, F.sha2(_json(F.array_sort(normal)), 256))


def revision_fingerprint(stem: Column, normal: Column, question_type: Column) -> Column:
    """SHA-256 over options in order, type and stem; only of single-choice questions."""
    ok = (question_type == "single_choice") & stem.isNotNull() & (F.size(normal) > 0) & ~F.exists(normal, lambda x: x.isNull())
    return F.when(ok, F.sha2(_json(F.struct(normal.alias("options"), question_type.alias("question_type"), stem.alias("stem"))), 256))


def evidence_fingerprint(number: Column, label: Column) -> Column:
    """SHA-256 of the version tag, the question number and the label, separated by NUL."""
    nul = F.lit("\u0000")
    return F.sha2(F.concat(F.lit("m3-answer-evidence-v1"), nul, number.cast("string"), nul, label), 256)


def stable_id(*parts: Column, version: str = "5") -> Column:
    """A UUID-shaped id from the place of a record (never from its content, so equal records stay apart)."""
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    s = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", s(1, 8), s(9, 4), F.concat(F.lit(version), s(14, 3)), F.concat(F.lit("8"), s(18, 3)), s(21, 12))


def is_uuid(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")


def is_sha256(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


def normal_options(df: DataFrame, key: str, texts: str) -> DataFrame:
    """key with its array of option texts in normal form, in order.

    All texts of a row go through one Arrow call: joined by U+001D, which is itself white space, they are composed
    together and split again, so no explode and no shuffle is needed.
    """
    joined = F.array_join(F.transform(F.col(texts), lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), "\u001d", " ")), "\u001d")
    parts = F.split(nfc(joined), "\u001d", -1)
    normal = F.transform(parts, lambda t: F.nullif(F.trim(F.regexp_replace(t, f"[{WHITE}]+", " ")), F.lit("")))
    return df.withColumn(key, F.when(F.size(texts) > 0, normal).otherwise(F.array().cast("array<string>")))
