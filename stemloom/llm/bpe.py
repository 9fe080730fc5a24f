"""Byte-pair encoding of whole corpora by forced-boundary splitting.

A byte pair that stands inside no token of the vocabulary can never be merged across, so a cut between its bytes is
certain; so is a cut where the tokenizer's pattern begins a new word.  Both kinds of cuts are found by table gathers
over the bytes and code points of a batch.  The fragments between cuts are encoded independently - each different one
once - and their ids concatenated, which gives exactly the ids of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stemloom.llm.codepoints import gather, slices, to_bytes

OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
# The endings that the byte-level pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes handled at once; bounds a worker's memory.
CHUNK = 1 << 20
#: Fragments whose ids a worker keeps.
CACHE = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary file lies: $STEMLOOM_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    folder = os.environ.get("STEMLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for n in range(0x110000):
        c = unicodedata.category(chr(n))[0]
        out[n] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
    # The White_Space property.
    for n in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[n] = SPACE
    out[0x20] = BLANK
    return out


def inner_pairs(tokens) -> np.ndarray:
    """A table over byte pairs (first * 256 + second): True where some token holds the pair."""
    inside = np.zeros(65536, dtype=bool)
    flat = np.frombuffer(b"".join(tokens), dtype=np.uint8).astype(np.int32)
    ends = np.cumsum([len(t) for t in tokens])
    pair = flat[:-1] * 256 + flat[1:]
    ok = np.ones(len(pair), dtype=bool)
    ok[ends[:-1] - 1] = False
    inside[pair[ok]] = True
    return inside


def word_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern begins a new piece; text_start marks the first code point of each text.

    The pattern: an apostrophe with one of ENDINGS; letters, numbers or other signs, with one blank before them if there
    is one; white space, of which the last character is left to the next piece unless the text ends.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    c = _classes()[points]
    space = c >= SPACE
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = OTHER, c[:-1]
    space_before = before >= SPACE
    ends = np.ones(n, dtype=bool)  # a text ends after this code point
    ends[:-1] = text_start[1:]
    text_before_space = np.zeros(n, dtype=bool)  # white space directly before something else of its text
    text_before_space[:-1] = space[:-1] & ~space[1:] & ~ends[:-1]
    start = np.where(space, ~space_before | text_before_space, np.where(space_before, before != BLANK, c != before)) | text_start
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        same1 = np.concatenate([~ends, [False, False]])
        for e in ENDINGS:
            ok = same1[mark] & (padded[mark + 1] == ord(e[0]))
            if len(e) == 2:
                ok &= same1[mark + 1] & (padded[mark + 2] == ord(e[1]))
            at = mark[ok]
            start[at + 1] = False
            if len(e) == 2:
                start[at + 2] = False
            after = at + len(e)
            room = same1[after]
            nxt = after[room] + 1
            start[nxt] = True
    return start


class FragmentEncoder:
    """Ids of texts under one vocabulary; made from the bytes of a rank file."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = read_ranks(data)
        self.inside = inner_pairs(list(ranks))
        self.core = tiktoken.Encoding("fragments", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.cache: dict[bytes, list[int]] = {}

    def _ids(self, fragment: bytes) -> list[int]:
        found = self.cache.get(fragment)
        if found is None:
            one = self.ranks.get(fragment)
            found = [one] if one is not None else self.core._encode_single_piece(fragment)
            if len(self.cache) < CACHE and len(fragment) < 100:
                self.cache[fragment] = found
        return found

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fragment starts in the bytes, and the number of fragments before each row offset)."""
        n = len(data)
        start = np.zeros(n + 1, dtype=bool)
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        start[1:n] = ~self.inside[pair]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True
        start[lead[word_starts(points, first[:-1][lead])]] = True
        start[n] = True
        at = np.flatnonzero(start)
        return at, np.searchsorted(at, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, n + 1 row offsets); with count_only no ids."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        at, rows = self.fragments(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        lists = [self._ids(f) for f in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        which = coded.indices.to_numpy()
        each = size[which]
        off = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=off[1:])
        if count_only:
            return np.zeros(0, np.int32), off[rows]
        table = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(size.sum()))
        begin = np.cumsum(size) - size
        ids, _ = gather(table, begin[which], each)
        return ids, off[rows]

    def batches(self, texts: pa.Array, count_only: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, next row, ids, offsets) for runs of rows of at most about CHUNK bytes."""
        data, off = to_bytes(texts)
        row, n = 0, len(off) - 1
        while row < n:
            stop = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1)
            part = data[off[row] : off[stop]]
            if len(part) > 4 * CHUNK:
                yield row, stop, *self._long(part, count_only)
            else:
                yield row, stop, *self.encode(part, off[row : stop + 1] - off[row], count_only)
            row = stop

    def _long(self, data: np.ndarray, count_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """One long text, cut where a piece of the pattern begins whatever stands around: before a blank between two ASCII
        letters, and between an ideograph and a full stop or comma."""
        raw = data.tobytes()
        cuts = [0]
        while len(raw) - cuts[-1] > 2 * CHUNK:
            m = _CUT.search(raw, cuts[-1] + CHUNK)
            if not m:
                break
            cuts.append(m.end())
        parts = [self.encode(data[a:b], np.array([0, b - a], np.int64), count_only) for a, b in zip(cuts, [*cuts[1:], len(raw)])]
        return np.concatenate([p[0] for p in parts]), np.array([0, sum(int(p[1][-1]) for p in parts)], np.int64)


#: In UTF-8: an ASCII letter before a blank and a letter; an ideograph (U+5000 to U+9FFF) before U+3002 or U+FF0C.
_CUT = re.compile(rb"[A-Za-z](?= [A-Za-z])|[\xe5-\xe9][\x80-\xbf][\x80-\xbf](?=\xe3\x80\x82|\xef\xbc\x8c)")


@lru_cache(2)
def encoder(data: bytes) -> FragmentEncoder:
    return FragmentEncoder(data)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """key and ids (array of int) of each text, without special tokens.

    A null or an empty text gives an empty list; repeated rows give repeated results; an empty table gives none; other
    columns are left out.  Strings of special tokens in a text are ordinary text.  The vocabulary file (under 1 MB) is
    read on the driver and broadcast.
    """
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for b in batches:
            for lo, hi, ids, off in e.batches(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str, vocabulary: str | None = None) -> DataFrame:
    """key and text of lists of ids, the opposite of encode_texts.

    An empty or null list gives an empty text; ids outside the vocabulary are an error.
    """
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        table = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), dtype=np.uint8)
        for b in (s for x in batches for s in slices(x)):
            lists = b.column(1).fill_null([])
            flat = lists.flatten().to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or not size[flat].all()):
                raise ValueError("an id is not in the vocabulary")
            data, off = gather(table, start[flat], size[flat])
            rows = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            text = pa.LargeStringArray.from_buffers(len(b), pa.py_buffer(off[rows].astype(np.int64)), pa.py_buffer(data.tobytes()))
            text.validate(full=True)
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """key and n_tokens of each text, by the same fragments, without building the ids."""
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for b in batches:
            for lo, hi, _, off in e.batches(b.column(1), count_only=True):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(off), pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint")


def _share(df: DataFrame, vocabulary: str | None):
    with open(vocabulary or vocabulary_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
