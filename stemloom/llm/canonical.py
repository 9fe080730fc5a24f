"""Duplicates hidden by formatting: Bloom filters of canonical hashes decide which rows are shuffled for exact grouping.

The filters are sharded by hash range: rows are written by range, a range holds a bounded number of rows, and each range has
a filter of its own with a fixed number of bits a row.  So the share of rows that pass by chance is the same at any size, and
no filter, broadcast or array grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.llm.codepoints import slices, to_codepoints
from stemloom.llm.plain import flat_texts, framed, letters_only, plain_points
from stemloom.session import join_groups, materialize

PROBES = 4
#: Filter bits for each row, and rows of a range: a filter has at most BITS_PER_ROW * RANGE_ROWS bits (32 MB).
BITS_PER_ROW = 16
RANGE_ROWS = 1 << 24
SEGMENT_BITS = 1 << 20


def canonical_rows(df: DataFrame, key: str, stem: str, options: str) -> DataFrame:
    """Key, canonical text, its SHA-256 and a 64-bit hash of that.

    The canonical text is the stem, then the option texts in sorted order (each as often as it occurs), all in plain
    form, lower case and letters and digits only.  A null stem or text counts as empty, null options as none.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, canonical string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            texts, rows = flat_texts(b.column(1), b.column(2))
            points, off = letters_only(*plain_points(*to_codepoints(texts)))
            one = framed(points, off, np.arange(len(texts) + 1))
            # order the options of each row: by row, stem first, then by text
            owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            place = np.ones(len(texts), dtype=np.int64)
            place[rows[:-1]] = 0
            order = pc.sort_indices(pa.table({"o": owner, "p": place, "t": one}), sort_keys=[("o", "ascending"), ("p", "ascending"), ("t", "ascending")])
            joined = pa.ListArray.from_arrays(pa.array(rows, type=pa.int32()), one.take(order))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join(joined, "")], names=[key, "canonical"])

    rows = df.select(key, stem, options).mapInArrow(run, schema)
    return rows.withColumn("digest", F.unhex(F.sha2("canonical", 256))).withColumn("hash", F.xxhash64("digest"))


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash (n x PROBES)."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def _segments(pos: np.ndarray, segment: int, n: int) -> list[bytes]:
    """Sorted bit positions as n compressed segments of packed bits."""
    cuts = np.searchsorted(pos, np.arange(n + 1, dtype=np.uint64) * np.uint64(segment))
    out = []
    for i in range(n):
        one = np.zeros(segment, dtype=bool)
        one[(pos[cuts[i] : cuts[i + 1]] - np.uint64(i * segment)).astype(np.int64)] = True
        out.append(pa.compress(np.packbits(one), codec="zstd", asbytes=True))
    return out


def bloom_filter(hashes: DataFrame, bits: int, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """The filter of the hashes seen repeatedly, as packed bits, merged from the partitions' filters.

    A partition keeps two filters, of hashes seen once and seen again, and hands them on as compressed segments.  Merging is by
    segments: once = once | other, again = again | other | (once & other once).  A hash in two partitions has all its
    bits in the last term, so no repeat is missed; other hashes may pass by chance and are sorted out by the exact grouping.
    """
    segment = min(segment_bits, bits)
    n = -(-bits // segment)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if len(b)]
        if held:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            once, again = (_segments(np.unique(_bits(x, bits)), segment, n) for x in (h, h[times > 1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(range(n)), pa.int32()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], names=["segment", "once", "again"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        unpack = lambda x: np.frombuffer(pa.decompress(x, decompressed_size=-(-segment // 8), codec="zstd", asbytes=True), np.uint8)
        for b in batches:
            for s, o, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                o, a = unpack(o), unpack(a)
                if s in held:
                    x, y = held[s]
                    y |= a | (x & o)
                    x |= o
                else:
                    held[s] = [o.copy(), a.copy()]
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())], names=["segment", "again"])

    parts = hashes.select("hash").mapInArrow(build, "segment int, once binary, again binary")
    merged = parts.repartition(min(n, 64), "segment").mapInArrow(fold, "segment int, again binary")
    out = np.zeros(-(-bits // 8), dtype=np.uint8)
    for r in merged.toLocalIterator():
        x = np.frombuffer(r["again"], np.uint8)
        out[r["segment"] * (segment // 8) : r["segment"] * (segment // 8) + len(x)] = x
    return out


def _in_filter(hash_: Column, rows: DataFrame, bits: int) -> tuple[Column, Broadcast]:
    """Whether a hash is among the repeated ones of `rows`, as far as their filter can tell; and the filter's broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_filter(rows, bits).tobytes())

    @F.pandas_udf("boolean")
    def again(h):
        import pandas as pd

        f = np.frombuffer(shared.value, np.uint8)
        pos = _bits(h.to_numpy(), bits)
        return pd.Series(((f[pos >> np.uint64(3)] >> (np.uint64(7) - (pos & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1))

    return again(hash_), shared


def possible_repeats(rows: DataFrame, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (among them `hash`), written to the shared folder, with `again`: false for a row that is surely single.

    n: the number of rows, or more.  Rows are split by hash into ranges of about `range_rows`; each range is filtered by a filter
    of its own, BITS_PER_ROW bits a row.  Several ranges are worked on at a time, each is written before its filter
    goes, so the driver never holds the filters of all rows.
    """
    ranges = max(1, -(-n // range_rows))
    bits = 1 << int(np.ceil(np.log2(max(1 << 13, -(-n // ranges) * BITS_PER_ROW))))
    shard = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(ranges)).cast("int")
    if ranges == 1:
        held = materialize(rows)
        return held.withColumn("again", _in_filter(F.col("hash"), held, bits)[0])
    held = materialize(rows.withColumn("shard", shard), by="shard")

    def one(i: int) -> DataFrame:
        part = held.where(F.col("shard") == i)
        again, shared = _in_filter(F.col("hash"), part, bits)
        out = materialize(part.withColumn("again", again).drop("shard"))
        shared.destroy()  # its rows are written
        return out

    with ThreadPool(min(8, ranges)) as pool:
        done = pool.map(one, range(ranges))
    # one reader over all folders, so the plan does not grow with the ranges
    return rows.sparkSession.read.schema(done[0].schema).parquet(*[p for d in done for p in d.inputFiles()])


def hidden_copies(df: DataFrame, key: str = "extract_no", stem: str = "stem", options: str = "options", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(copies, singles): copies has first (smallest key) and key of every row in a group, singles the rest's keys.

    Rows are copies if their canonical texts are equal (compared by SHA-256; the filter's short hash decides nothing
    but what is shuffled).  Only possible repeats are shuffled.  Groups are counted before they are joined back, and
    those with very many rows are joined by broadcast, so a group of any size spreads over tasks.  A repeated key (a
    redelivered row) counts once.  An empty table gives two empty results.
    """
    rows = canonical_rows(df.select(key, stem, options), key, stem, options).select(F.col(key).alias("k"), "digest", "hash")
    n = df.count()
    marked = possible_repeats(rows, n, range_rows)
    maybe = marked.where("again").select("k", "digest")
    groups = maybe.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("rows_seen"))
    same = F.col("first") == F.col("last")
    copies = join_groups(maybe, groups.where(~same), ["digest"], "rows_seen", n).select("first", F.col("k").alias(key)).distinct()
    lone = groups.where(same).select(F.col("first").alias(key))
    single = marked.where("NOT again").select(F.col("k").alias(key))
    return copies, single.unionByName(lone)


def collapsed(df: DataFrame, key: str = "extract_no", stem: str = "stem", options: str = "options") -> DataFrame:
    """One row for each distinct record: its smallest key and its number of copies."""
    copies, singles = hidden_copies(df, key, stem, options)
    many = copies.groupBy("first").agg(F.count(F.lit(1)).alias("n_copies")).withColumnRenamed("first", key)
    return many.unionByName(singles.select(key, F.lit(1).cast("long").alias("n_copies")))
