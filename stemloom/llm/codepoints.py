"""Arrow text as flat numpy code points and back: whole buffers at a time, no call per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def to_codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, n + 1 row offsets); a null text has no code points."""
    data, offsets = to_bytes(texts)
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(points) == len(data):
        return points, offsets
    starts = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


def to_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, n + 1 row offsets from 0)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=len(texts) + 1, offset=texts.offset * (8 if wide else 4)).astype(np.int64)
    if texts.null_count:  # a null row may cover bytes
        size = np.where(np.asarray(texts.is_null()), 0, np.diff(o))
        if size.sum() != o[-1] - o[0]:
            return to_bytes(texts.fill_null(""))
    raw = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def to_arrow(points: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The opposite of to_codepoints; nulls marks rows that are null."""
    raw = points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    if len(raw) != len(points):
        size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        ends = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(size, out=ends[1:])
        offsets = ends[offsets]
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
    if nulls is not None and nulls.any():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(nulls), pa.scalar(None, out.type), out)
    return out


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes, so that arrays several times as large as the text fit a worker."""
    parts = max(1, min(len(batch), -(-batch.nbytes // limit)))
    step = max(1, -(-len(batch) // parts))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def gather(table: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices table[start : start + length] one after another, and their n + 1 offsets."""
    off = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=off[1:])
    index = np.repeat(start - off[:-1], length) + np.arange(off[-1])
    return table[index], off
