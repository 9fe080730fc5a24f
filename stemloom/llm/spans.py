"""Long exact spans shared between records, by prefix-partitioned suffix trees.

1. Every run of `length` code points holds an anchor: the k-gram with the least hash among those inside it.  Runs with
   the same content have the same anchor, so only anchors whose k-gram stands in two records can lie in a shared run;
   the anchor is the prefix by which suffixes are told apart.
2. The stretches around such anchors - all runs of that anchor - are brought together by prefix and cut into groups that
   fit in memory.
3. A group's suffixes are sorted to depth `length` by prefix doubling, which is the level of the group's suffix tree at
   that depth: suffixes with one rank lie below one node.  Nodes with leaves of two records mark shared runs.
4. A prefix that very many stretches share is lengthened to both sides as far as every run allows, (length + k) / 2 code
   points, and its stretches are grouped anew.  What is still shared by very many is lengthened to the whole run, which
   then is a group of its own: such runs are brought together by the SHA-256 of their text through pre-aggregated counts,
   so no task ever holds them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.codepoints import gather, slices, to_arrow, to_codepoints
from stemloom.llm.icws import mix
from stemloom.session import join_groups, materialize

GRAM = 24
CHUNK = 1 << 19
#: Stretches of one prefix beyond which it is lengthened, and stretches of one group.
HOT = 20_000
GROUP = 8_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k code points from each position."""
    n = len(points)
    if not _POWERS or len(_POWERS[0]) < n + 1:
        _POWERS[:] = _powers(max(n + 1, CHUNK + 1024))
    up, down = _POWERS
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(points: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of about CHUNK code points: (points, starts of parts, rows of parts, offset of each part in its row).

    Rows longer than a chunk come in parts that overlap by length - 1, so that each run lies in exactly one part.
    """
    n = len(offsets) - 1
    row = 0
    while row < n:
        lo = offsets[row]
        if offsets[row + 1] - lo > CHUNK:
            end = offsets[row + 1]
            while True:
                yield points[lo : min(lo + CHUNK, end)], np.array([0]), np.array([row]), np.array([lo - offsets[row]])
                if lo + CHUNK >= end:
                    break
                lo += CHUNK - length + 1
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(offsets, lo + CHUNK, side="right")) - 1)
        yield points[lo : offsets[stop]], offsets[row:stop] - lo, np.arange(row, stop), np.zeros(stop - row, np.int64)
        row = stop


def anchors(points: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The stretches of a chunk: (hash of the anchor's k-gram, part, first run, last run, anchor), positions in the chunk."""
    n = len(points)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    h = gram_hashes(points, gram)
    shift = np.uint64(20)
    tagged = (h >> shift << shift) | np.arange(len(h), dtype=np.uint64)
    at = (window_least(tagged, length - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
    run = np.arange(len(at))
    ends = np.append(starts[1:], n)
    part = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    good = run + length <= ends[part]
    first = good.copy()
    first[1:] &= ~good[:-1] | (at[1:] != at[:-1]) | (part[1:] != part[:-1])
    lo = np.flatnonzero(first)
    last = good.copy()
    last[:-1] &= ~good[1:] | (at[1:] != at[:-1]) | (part[1:] != part[:-1])
    hi = np.flatnonzero(last)
    return h[at[lo]].view(np.int64), part[lo], lo, hi, at[lo]


def stretches(df: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """h, key, lo, hi: the runs that start at lo..hi (from 0) have the anchor with k-gram hash h."""
    schema = f"h bigint, k {df.schema[key].dataType.simpleString()}, lo int, hi int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            points, off = to_codepoints(b.column(1))
            for p, starts, rows, base in pieces(points, off, length):
                h, part, lo, hi, _ = anchors(p, starts, length, gram)
                shift = base[part] - starts[part]
                yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(rows[part])), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32))], names=["h", "k", "lo", "hi"])

    return df.select(key, text).mapInArrow(run, schema)


def lengthened(points: np.ndarray, off: np.ndarray, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches under longer prefixes: (hash, stretch, first run, last run), runs counted from the start of the stretch.

    A run that has enough text from the anchor on is known by the code points there, any other by as many up to the
    anchor's end; since runs of the same content have the anchor at the same place, they fall to the same side.
    """
    wide = (length + gram) // 2
    many = np.diff(off) - length + 1  # runs of each stretch
    row = np.repeat(np.arange(len(h)), np.diff(off))
    place = np.arange(len(points)) - off[row]
    found = gram_hashes(points, gram)
    # the anchor is the first k-gram of that hash which lies in every run of the stretch
    hit = np.flatnonzero((found == h[row[: len(found)]]) & (place[: len(found)] >= many[row[: len(found)]] - 1) & (place[: len(found)] <= length - gram))
    _, first = np.unique(row[hit], return_index=True)
    at = many - 1
    at[row[hit[first]]] = place[hit[first]]
    split = np.clip(at - (length - wide), 0, many)  # runs before it have too little text behind the anchor
    long = gram_hashes(points, wide)
    right, left = split < many, split > 0
    key_right = mix(long[(off[:-1] + at)[right]] ^ np.uint64(0x9E3779B97F4A7C15))
    key_left = mix(long[(off[:-1] + at + gram - wide)[left]] ^ np.uint64(0xD1B54A32D192ED03))
    who = np.arange(len(h))
    return np.concatenate([key_right, key_left]), np.concatenate([who[right], who[left]]), np.concatenate([split[right], np.zeros(left.sum(), np.int64)]), np.concatenate([many[right] - 1, split[left] - 1])


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The rank of each pair among the different pairs (from 0, in order).

    Up to 2^21 pairs of numbers below 2^21 are sorted as one 64-bit number each, pair and place together.
    """
    n = len(first)
    if n > 1 << 21:
        return np.unique(first << np.uint64(32) | second, return_inverse=True)[1].astype(np.uint64)
    packed = np.sort(first << np.uint64(42) | second << np.uint64(21) | np.arange(n, dtype=np.uint64))
    pair = packed >> np.uint64(21)
    rank = np.zeros(n, dtype=np.uint64)
    np.cumsum(pair[1:] != pair[:-1], out=rank[1:])
    out = np.empty(n, dtype=np.uint64)
    out[(packed & np.uint64((1 << 21) - 1)).astype(np.int64)] = rank
    return out


def node_ranks(points: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the suffixes at `starts` among all, by their first `depth` code points (equal ranks: equal prefixes).

    Prefix doubling: ranks at depth 2d come from the ranks of two neighbours at depth d; the last step lets them overlap.
    The first ranks are of as many code points at once as fit 21 bits.
    """
    used = np.zeros(0x110000, dtype=bool)
    used[points] = True
    letters = int(used.sum())
    number = (np.cumsum(used) - 1).astype(np.uint64)
    one = number[points]
    width = max(1, (letters - 1).bit_length())
    d, rank = 1, one
    while (d + 1) * width <= 21 and d < depth:  # a rank of d code points, written as a number
        rank = rank << np.uint64(width)
        rank[:-d] |= one[d:]
        d += 1
    while d * 2 <= depth:
        second = np.zeros(len(rank), dtype=np.uint64)
        second[:-d] = rank[d:]
        rank = _dense(rank, second)
        d *= 2
    return _dense(rank[starts], rank[starts + depth - d]).astype(np.int64)


def shared_runs(points: np.ndarray, starts: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """Which of the runs at `starts` stand below a node that has leaves of two owners."""
    rank = node_ranks(points, starts, depth)
    order = np.argsort(rank, kind="stable")
    r, o = rank[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    mixed = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
    out = np.empty(len(starts), dtype=bool)
    out[order] = np.repeat(mixed, np.diff(np.append(first, len(r))))
    return out


def _runs(flags: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each unbroken sequence of flags within a record."""
    prev = np.concatenate([[False], flags[:-1] & (record[1:] == record[:-1])])
    nxt = np.concatenate([flags[1:] & (record[1:] == record[:-1]), [False]])
    return np.flatnonzero(flags & ~prev), np.flatnonzero(flags & ~nxt)


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = GRAM) -> DataFrame:
    """key, span_start (from 1), span_chars: the longest unbroken stretches of characters that lie in some run of
    `length` characters which also stands in the text of another key.

    Characters are code points of the text as stored.  Null texts and texts shorter than `length` have no spans.  Keys
    are taken as unique; rows that repeat a key are one and the same record, whose runs do not share with themselves.
    An empty table gives no rows; further columns are not read; texts of any length are taken whole.
    """
    docs = df.where(F.length(text) >= length).select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = materialize(stretches(docs, "k", "t", length, gram))
    often = materialize(found.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("h", "n"))
    some = materialize(join_groups(found, often, ["h"], "n", found.count()))
    hot = F.col("n") > HOT
    wanted = some.groupBy("k").agg(F.collect_list(F.struct("lo", "hi", "h", hot.alias("hot"))).alias("x"))
    kind = docs.schema["k"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                points, off = to_codepoints(part.column(1))
                x = part.column(2)
                row = np.repeat(np.arange(len(part)), np.asarray(x.value_lengths()))
                s = x.flatten()
                lo, hi = s.field("lo").to_numpy(), s.field("hi").to_numpy()
                body, at = gather(points, off[row] + lo, (hi - lo).astype(np.int64) + length)
                yield pa.RecordBatch.from_arrays([s.field("h"), part.column(0).take(pa.array(row)), s.field("lo"), s.field("hot"), to_arrow(body, at).cast(pa.string())], names=["h", "k", "lo", "hot", "body"])

    bodies = docs.join(wanted, "k").select("k", "t", "x").mapInArrow(cut, f"h bigint, k {kind}, lo int, hot boolean, body string")
    bodies = materialize(bodies)
    n = bodies.count()

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                points, off = to_codepoints(part.column(3))
                h, row, first, last = lengthened(points, off, part.column(0).to_numpy().view(np.uint64), length, gram)
                body, at = gather(points, off[row] + first, last - first + length)
                lo = part.column(2).to_numpy()[row] + first
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(1).take(pa.array(row)), pa.array(lo.astype(np.int32)), to_arrow(body, at).cast(pa.string())], names=["h", "k", "lo", "body"])

    # stretches of hot prefixes under longer ones; what one record has alone goes, what is still hot is told apart
    again = materialize(bodies.where("hot").select("h", "k", "lo", "body").mapInArrow(longer, f"h bigint, k {kind}, lo int, body string"))
    often = again.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("h", "n")
    again = join_groups(again, often, ["h"], "n", 2 * n).select("k", "lo", "body", "h", (F.col("n") > HOT).alias("hot"))

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        keys, lo = t.column("k").combine_chunks(), t.column("lo").to_numpy()
        owner = keys.dictionary_encode().indices.to_numpy()
        points, off = to_codepoints(t.column("body"))
        many = np.diff(off) - length + 1
        record = np.repeat(np.arange(len(lo)), many)
        step = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
        flags = shared_runs(points, off[record] + step, owner[record], length)
        a, b = _runs(flags, record)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(record[a])), pa.array((lo[record[a]] + step[a]).astype(np.int32)), pa.array((lo[record[a]] + step[b] + length).astype(np.int32))], names=["k", "s", "e"])

    spans_schema = f"k {kind}, s int, e int"
    groups = max(1, -(-n // GROUP))
    cold = bodies.where("NOT hot").select("h", "k", "lo", "body").unionByName(again.where("NOT hot").select("h", "k", "lo", "body"))
    cold = cold.repartition(groups, "h").mapInArrow(tree, spans_schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1 << 19):
                points, off = to_codepoints(part.column(2))
                many = np.diff(off) - length + 1
                record = np.repeat(np.arange(len(part)), many)
                step = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
                text = memoryview(points.astype("<u4", copy=False).tobytes())
                run = [sha256(text[4 * i : 4 * (i + length)]).digest() for i in (off[record] + step).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(run, pa.binary()), part.column(0).take(pa.array(record)), pa.array((part.column(1).to_numpy()[record] + step).astype(np.int32))], names=["run", "k", "s"])

    runs = again.where("hot").select("k", "lo", "body").mapInArrow(expand, f"run binary, k {kind}, s int")
    both = runs.groupBy("run").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("run", "n")
    warm = join_groups(runs, both, ["run"], "n", n * (length - gram + 1)).select("k", "s", (F.col("s") + length).alias("e"))
    return merge_spans(cold.unionByName(warm), key)


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching spans [s, e) of each k as one row: key, span_start (from 1), span_chars."""
    w = Window.partitionBy("k").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach >= F.col("s"), 0).otherwise(1)
    marked = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return out.select(F.col("k").alias(key), (F.col("s") + 1).cast("int").alias("span_start"), (F.col("e") - F.col("s")).cast("int").alias("span_chars"))
