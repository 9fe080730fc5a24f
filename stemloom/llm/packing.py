"""Containers of fixed capacity filled by best-two-fit."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.bpe import count_tokens

#: Equal rows that go to a group together.
COPIES = 1000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin (from 0) of each item; every size is in [1, capacity].

    A bin starts with the largest unpacked item and takes the largest one that still fits, again and again.  Then its
    smallest item is put back if two unpacked items fill the gap that this leaves more tightly, of all such pairs the
    tightest; this is repeated while the gap shrinks.
    """
    left = np.bincount(sizes, minlength=capacity + 1)
    # floor[v]: the largest unpacked size <= v, kept by path halving downward
    floor = np.where(left > 0, np.arange(capacity + 1), -1)
    floor = np.maximum.accumulate(floor)
    floor_list = floor.tolist()
    counts = left.tolist()

    def largest(v: int) -> int:
        """The largest unpacked size <= v, or 0."""
        path = []
        while v > 0 and counts[v] == 0:
            path.append(v)
            v = floor_list[v] if 0 < floor_list[v] < v else v - 1
        for p in path:
            floor_list[p] = v
        return max(v, 0)

    def put_back(s: int) -> None:
        counts[s] += 1
        # entries above s may point below it
        for v in range(s, capacity + 1):
            if floor_list[v] >= s:
                if v > s:
                    break
            floor_list[v] = s

    bins: list[list[int]] = []
    unpacked = int(len(sizes))
    while unpacked:
        first = largest(capacity)
        counts[first] -= 1
        held, gap = [first], capacity - first
        while gap:
            s = largest(gap)
            if not s:
                break
            counts[s] -= 1
            held.append(s)
            gap -= s
        unpacked -= len(held)
        while gap and unpacked >= 2 and len(held) > 1:
            s = held[-1]  # the smallest: items came in falling order
            room = gap + s
            c = np.array(counts[: room + 1])
            have = np.flatnonzero(c)
            have = have[have > 0]
            if not len(have):
                break
            partner = np.searchsorted(have, room - have, side="right") - 1
            ok = partner >= 0
            x, y = have[ok], have[partner[ok]]
            # a pair of equal sizes needs two of them, else the next smaller partner
            twin = (x == y) & (c[x] < 2)
            if twin.any():
                lower = np.searchsorted(have, x[twin]) - 1
                y = y.copy()
                y[twin] = np.where(lower >= 0, have[np.maximum(lower, 0)], -room)
            total = x + y
            if not len(total) or total.max() <= s:
                break
            k = int(total.argmax())
            a, b = int(max(x[k], y[k])), int(min(x[k], y[k]))
            held.pop()
            put_back(s)
            counts[a] -= 1
            counts[b] -= 1
            held = sorted([*held, a, b], reverse=True)
            unpacked -= 1
            gap = room - a - b
        bins.append(held)
    # hand the bins out to the items of each size
    order = np.argsort(sizes, kind="stable")
    flat = np.array([s for b in bins for s in b], dtype=np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = number[np.argsort(flat, kind="stable")]
    return out


def pack(sized: DataFrame, key: str, size: str, capacity: int = 4096, group_items: int = 20_000) -> DataFrame:
    """Items in bins: key, piece (from 1), start, n_tokens, bin_id.

    An item larger than the capacity is split into full pieces and a rest; others stay whole.  Items are spread by a
    hash of their key over ceil(items / group_items) groups of alike sizes, each packed by one task, so a task's work is
    bounded whatever the table holds; a group leaves one or two bins partly filled in its several thousand.
    Items of size null, 0 or less need no container and give no row.  Repeated rows are items of their own.  An empty
    table gives no rows.
    """
    items = sized.where(F.col(size) > 0).select(F.col(key).alias("k"), F.col(size).cast("long").alias("s"))
    n = items.count()
    groups = max(1, -(-n // group_items))
    # equal rows as counts of at most COPIES, so that a key of very many rows spreads over groups too
    counted = items.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
    grouped = counted.select("k", "s", F.least(F.lit(COPIES), F.col("n") - F.col("j") * COPIES).alias("n"), F.pmod(F.xxhash64("k", "s", "j"), F.lit(groups)).cast("int").alias("g"))
    kind = sized.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start bigint, n_tokens bigint, bin_id bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        pdf = pdf.sort_values(["k", "s"])
        k, s = pdf["k"].to_numpy().repeat(pdf["n"]), pdf["s"].to_numpy().repeat(pdf["n"])
        n_pieces = -(-s // capacity)
        owner = np.repeat(np.arange(len(s)), n_pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        length = np.minimum(capacity, s[owner] - piece * capacity)
        bins = best_two_fit(length, capacity)
        return pd.DataFrame({key: k[owner], "piece": (piece + 1).astype(np.int32), "start": piece * capacity, "n_tokens": length, "bin_id": (np.int64(g) << 32) + bins})

    return grouped.groupBy("g").applyInPandas(run, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Documents with text, sized in tokens, in containers of `capacity` tokens.

    Null and empty texts have no tokens and give no row; blank texts do have tokens.
    """
    from stemloom.session import materialize

    sized = materialize(count_tokens(df.where((F.col(text).isNotNull()) & (F.col(text) != "")), key, text, vocabulary))
    return pack(sized, key, "n_tokens", capacity)
