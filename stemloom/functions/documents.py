"""JSON documents: canonical form, digests, schema checks, paths, times."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names and characters that a portable path may not use, the depth of a canonical document.
RESERVED_NAMES = ["con", "prn", "aux", "nul", "conin$", "conout$", *[f"{d}{n}" for d in ("com", "lpt") for n in "123456789¹²³"]]
UNSAFE_CHARACTERS = r'[\\:<>"|?*\x{00}-\x{1f}\x{7f}-\x{9f}]'
MAX_DEPTH = 64


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


def _deeper_than(value, levels: int) -> bool:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return levels < 0 or any(_deeper_than(v, levels - 1) for v in inner if isinstance(v, (dict, list)))


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
_DECODER = json.JSONDecoder(parse_constant=_refuse)


def _canonical(text: str | None) -> str | None:
    try:
        value = _DECODER.decode(text)
        if text.count("[") + text.count("{") > MAX_DEPTH and _deeper_than(value, MAX_DEPTH):
            return None
        out = _ENCODER.encode(value)
        out.encode("utf-8")  # lone surrogates have no UTF-8 form
        return out
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """The compact form with sorted members of each JSON text; null where it is none, nests deeper than MAX_DEPTH
    or holds half a surrogate pair."""
    return s.map(_canonical, na_action="ignore")


def json_digest(c: Column) -> Column:
    """SHA-256 of the canonical form: equal for documents that differ in layout or member order only."""
    return F.sha2(canonical_json(c), 256)


def safe_relative_path(c: Column) -> Column:
    """Whether a path is relative and portable: '/'-separated, no empty, '.' or '..' part, no backslash, colon, control
    character or one of < > " | ? *, no part that ends in a dot or blank or is a reserved name before its first dot."""
    parts = F.split(c, "/", -1)
    stem = lambda p: F.lower(F.rtrim(F.substring_index(p, ".", 1)))
    good = F.forall(parts, lambda p: (p != "") & ~p.isin(".", "..") & ~p.rlike(r"[. ]\z") & ~stem(p).isin(*RESERVED_NAMES))
    return ~c.rlike(UNSAFE_CHARACTERS) & good


def utc_z(c: Column) -> Column:
    """A timestamp as ISO text in UTC ending in Z; microseconds only where there are some."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), micros, F.lit("Z")))


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, name: str) -> bool:
    if name == "integer":
        return type(value) is int
    if name == "number":
        return type(value) in (int, float)
    return type(value) is _TYPES[name]


def schema_errors(value, schema: dict, path: str = "$", search: bool = False) -> Iterator[tuple[str, str]]:
    """(path, rule) of each rule of a schema that a value breaks.

    Rules: type, const, enum, minLength, pattern (of the whole string, or with `search` anywhere in it), minimum, required,
    additionalProperties false, properties, items, minItems, oneOf.  A value of the wrong type is not checked further.
    """
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, "type"
        return
    if "const" in schema and (value != schema["const"] or type(value) is not type(schema["const"])):
        yield path, "const"
    if "enum" in schema and not any(value == x and type(value) is type(x) for x in schema["enum"]):
        yield path, "enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield path, "minLength"
        if "pattern" in schema and not (re.search if search else re.fullmatch)(schema["pattern"], value):
            yield path, "pattern"
    if type(value) in (int, float) and "minimum" in schema and value < schema["minimum"]:
        yield path, "minimum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from ((f"{path}.{k}", "required") for k in schema.get("required", ()) if k not in value)
        if schema.get("additionalProperties") is False:
            yield from ((f"{path}.{k}", "additionalProperties") for k in value if k not in known)
        for k, v in value.items():
            if k in known:
                yield from schema_errors(v, known[k], f"{path}.{k}", search)
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield path, "minItems"
        if "items" in schema:
            for i, v in enumerate(value):
                yield from schema_errors(v, schema["items"], f"{path}[{i}]", search)
    if "oneOf" in schema and sum(not any(schema_errors(value, s, path, search)) for s in schema["oneOf"]) != 1:
        yield path, "oneOf"


def schema_violations(df: DataFrame, key: str, body: str, schema: dict, search: bool = False, also: Callable | None = None) -> DataFrame:
    """(key, path, rule) of JSON documents against a schema; rule 'json' where a text is no JSON.  Null texts are left out.

    also: further rules that a schema cannot state, a function from the document to (path, rule).
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key].tolist(), b[body].tolist()):
                try:
                    value = json.loads(text)
                except (ValueError, RecursionError):
                    rows.append((k, "$", "json"))
                    continue
                rows += [(k, p, r) for p, r in schema_errors(value, schema, search=search)]
                rows += [(k, p, r) for p, r in also(value)] if also else []
            yield pd.DataFrame(rows, columns=[key, "path", "rule"])

    return df.where(F.col(body).isNotNull()).select(key, body).mapInPandas(run, f"{key} {kind}, path string, rule string")
