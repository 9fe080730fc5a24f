"""Near-duplicate records: candidates by improved consistent weighted samples over TF-IDF shingles, banded, verified by
weighted Jaccard similarity.

Records are sets of character shingles.  Records with one and the same set form a class; all work runs on classes, and
members are joined back last.  The chance that two classes agree in one sample equals their weighted Jaccard similarity;
classes that agree in all samples of a band are candidates, which weighted Jaccard similarity verifies.  Where plain
similarity is asked for, an exact check of it follows.

TF-IDF weights are scaled to lie between 1 and RATIO.  So the weighted similarity of two sets of plain similarity s is at least
s / (s + (1 - s) * RATIO), whatever the shingles' frequencies: a passage that very many records share cannot push a pair below that.
This bound is the threshold of the weighted check, which so loses no pair, and it bounds what the bands can miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.codepoints import gather, slices, to_arrow, to_codepoints
from stemloom.llm.plain import flat_texts, letters_only
from stemloom.session import HOT_ROWS, hot_limit, join_hot, materialize

GAP = 0x0A  # between the texts of a record; no letter or digit
SKETCH_BITS = 21
#: Greatest weight of a shingle; the least is 1.
RATIO = 1.25
#: Classes of a bucket up to which all its pairs are formed; beyond it, pairs must share a rare shingle too.
BUCKET_LIMIT = 512
#: Classes that one sampling task takes at a time, and those of them in one bucket from which it counts as large at once.
TASK_CLASSES = 10_000
CROWDED = 128
SALTS = 64
#: 64-bit words of a class's bitmap.
WORDS = 4
BITMAP = [f"w{i}" for i in range(WORDS)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_row_and_code(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """An order that brings equal codes of a row together (rows in order, codes in any): one sort of packed numbers.

    Codes are packed as a hash beside their row; should two codes of a row share it, the plain sort is taken.
    """
    bits = max(1, int(row[-1]).bit_length()) if len(row) else 1
    packed = row.astype(np.uint64) << np.uint64(64 - bits) | mix(code) >> np.uint64(bits)
    order = np.argsort(packed)
    packed, code = packed[order], code[order]
    if ((packed[1:] == packed[:-1]) & (code[1:] != code[:-1])).any():
        return order[np.lexsort((code, packed))]
    return order


def shingle_sets(points: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row and their n + 1 offsets.

    A shingle is `width` (at most 3) code points packed in 63 bits, so equal numbers mean equal shingles; none runs over
    a GAP or a row's end.
    """
    n = len(points)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    m = n - width + 1
    code = np.zeros(m, dtype=np.uint64)
    ok = np.ones(m, dtype=bool)
    for j in range(width):
        p = points[j : j + m]
        code = code << np.uint64(21) | p.astype(np.uint64)
        ok &= p != GAP
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok &= row[:m] == row[width - 1 :]
    code, row = code[ok], row[:m][ok]
    order = by_row_and_code(row, code)
    code, row = code[order], row[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(offsets)))


def _text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*to_codepoints(texts))


def bitmaps(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bitmap of each set (sets x WORDS), one bit set for each element by hash.

    Bits in which two bitmaps differ stand for different elements of the symmetric difference, so their number is a
    lower bound of it; a pair whose bound is too high for the threshold can be left out without losing any.
    """
    n = len(at) - 1
    place = (mix(code ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)).astype(np.int64) % (64 * WORDS)
    own = np.repeat(np.arange(n), np.diff(at))
    bits = np.zeros((n, 64 * WORDS), dtype=np.uint8)
    bits[own, place] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def record_classes(df: DataFrame, key: str, texts: str) -> DataFrame:
    """key, c1, c2, body, n, w0.. of each record: body is its texts in letters and digits of lower case, joined by line
    breaks; (c1, c2) is a 128-bit digest of its shingle set, n the set's size, w0.. its bitmap.  Records without any
    shingle are left out: they resemble nothing."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, c1 bigint, c2 bigint, body string, n int, " + ", ".join(f"w{i} bigint" for i in range(WORDS))
    names = [key, "c1", "c2", "body", "n", *BITMAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            empty = pa.nulls(len(b), pa.large_string())
            flat, rows = flat_texts(empty, b.column(1))
            points, off = letters_only(*to_codepoints(flat))
            body = np.insert(points, off[1:], GAP)
            body_off = off[rows] + rows
            code, at = shingle_sets(body, body_off)
            has = np.diff(at) > 0
            sums = []
            for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                total = np.zeros(len(code) + 1, dtype=np.uint64)
                np.cumsum(mix(code ^ np.uint64(seed)), out=total[1:])
                sums.append(mix(total[at[1:]] - total[at[:-1]]).view(np.int64))
            words = bitmaps(code, at)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(sums[0]), pa.array(sums[1]), to_arrow(body, body_off).cast(pa.string()), pa.array(np.diff(at).astype(np.int32)), *(pa.array(words[:, i].copy()) for i in range(WORDS))], names=names)
            yield out.filter(pa.array(has))

    return df.select(key, texts).mapInArrow(run, schema)


def shingle_counts(classes: DataFrame) -> np.ndarray:
    """In how many classes each shingle stands: a table of 2^SKETCH_BITS counters by hash, over all classes.

    Its size is fixed (8 MB as 32-bit counters), so it may be collected and broadcast whatever the corpus holds.
    Shingles that share a counter are taken for commoner than they are, which only changes their weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in (s for x in batches for s in slices(x)):
            code, _ = _text_shingles(b.column(0))
            total += np.bincount(slot(code), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    rows = classes.select("body").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def slot(code: np.ndarray) -> np.ndarray:
    return (mix(code) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def idf(counts: np.ndarray, n: int, ratio: float = RATIO) -> np.ndarray:
    """Weights by inverse document frequency, scaled from 1 (in all n classes) to `ratio` (in one)."""
    log = np.log1p(n / np.clip(counts, 1, max(n, 1)))
    span = np.log1p(n) - np.log(2.0)
    return (1 + (ratio - 1) * (log - np.log(2.0)) / span if span > 0 else np.ones(len(counts))).astype(np.float32)


def least_weighted(threshold: float, ratio: float = RATIO) -> float:
    """The least weighted similarity that sets of plain similarity `threshold` can have: shared shingles of weight 1, the others of weight `ratio`."""
    return threshold / (threshold + (1 - threshold) * ratio)


def weighted_samples(code: np.ndarray, weight: np.ndarray, first: int, many: int, cells: int = 1 << 15) -> np.ndarray:
    """Improved consistent weighted samples `first` to `first + many` (shingles x many): 32 bits that order the shingles
    of a set, above 32 bits that name the sample, so that the least number of a set is its sample.

    Of the shingles x with weight w, sample k is the one with the least c / (y e^r), where y = e^(r (t - beta)),
    t = floor(ln w / r + beta), and r, c ~ Gamma(2, 1), beta ~ U(0, 1) come from a hash of (x, k).  The name stands for
    the pair (x, t).  Work is done in blocks of about `cells` numbers, which stay in the processor's cache.
    """
    k = mix((np.arange(first, first + many, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    log_weight = np.log(weight)
    out = np.empty((len(code), many), dtype=np.uint64)
    unit, half = np.float32(2.0**-21), np.float32(2.0**-22)
    low, s21, s32, s42 = np.uint64(0x1FFFFF), np.uint64(21), np.uint64(32), np.uint64(42)
    uniform = lambda bits: bits.astype(np.int32).astype(np.float32) * unit + half
    rows = max(1, cells // many)
    for i in range(0, len(code), rows):
        h = mix(code[i : i + rows, None] + k[None, :])
        r = -np.log(uniform(h & low) * uniform((h >> s21) & low))
        beta = uniform((h >> s42) & low)
        g = (h ^ (h >> s32)) * np.uint64(0xA0761D6478BD642F)
        g ^= g >> s32
        c = -np.log(uniform(g & low) * uniform((g >> s21) & low))
        t = np.floor(log_weight[i : i + rows, None] / r + beta)
        a = (np.log(c) - r * (t - beta + np.float32(1))).view(np.int32)
        order = (a ^ ((a >> 31) | np.int32(-(2**31)))).view(np.uint32)  # floats in order, as unsigned numbers
        name = ((h ^ (t.view(np.uint32).astype(np.uint64) << s21)) * np.uint64(0x9FB21C651E98DF25)) >> s32
        out[i : i + rows] = (order.astype(np.uint64) << s32) | name
    return out


def band_keys(code: np.ndarray, at: np.ndarray, weights: np.ndarray, bands: int, rows: int, cells: int = 1 << 17) -> Iterator[np.ndarray]:
    """For each band the 64-bit keys of all sets (none of them empty)."""
    distinct, where = np.unique(code, return_inverse=True)
    w = weights[slot(distinct)]
    n = len(at) - 1
    at_once = max(1, min(80, 8_000_000 // max(1, len(distinct))) // rows)  # bounds the table of samples
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + cells // (at_once * rows), side="right")) - 1))
    for band in range(0, bands, at_once):
        now = min(at_once, bands - band)
        table = weighted_samples(distinct, w, band * rows, now * rows)
        least = np.empty((n, now * rows), dtype=np.uint64)
        for lo, hi in zip(cuts, cuts[1:]):
            least[lo:hi] = np.minimum.reduceat(table[where[at[lo] : at[hi]]], at[lo:hi] - at[lo], axis=0)
        least &= np.uint64(0xFFFFFFFF)
        least = np.ascontiguousarray(least.T)
        for j in range(now):
            key = np.full(n, band + j, dtype=np.uint64)
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[j * rows + i])
            yield key


def pair_similarities(left: pa.Array, right: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plain, weighted) Jaccard similarity of the shingle sets of two columns of bodies, row by row.

    Each different body is cut to shingles once; shingles are numbered, and a shingle that stands twice under a pair is common.
    """
    n = len(left)
    bodies = pa.concat_arrays([left, right]).dictionary_encode()
    which = bodies.indices.to_numpy()
    code, at = _text_shingles(bodies.dictionary)
    distinct, number = np.unique(code, return_inverse=True)
    w = weights[slot(distinct)].astype(np.float64)
    size = np.diff(at)
    sums = np.concatenate([[0.0], np.cumsum(w[number])])
    weight = sums[at[1:]] - sums[at[:-1]]
    found, _ = gather(number.astype(np.uint64), at[:-1][which], size[which])
    pair = np.repeat(np.tile(np.arange(n, dtype=np.uint64), 2), size[which])
    packed = np.sort(pair << np.uint64(32) | found)
    common = packed[1:][packed[1:] == packed[:-1]]
    of, what = (common >> np.uint64(32)).astype(np.int64), (common & np.uint64(0xFFFFFFFF)).astype(np.int64)
    both = lambda total, common: common / np.maximum(total[which[:n]] + total[which[n:]] - common, 1e-12)
    return both(size.astype(np.float64), np.bincount(of, minlength=n)), both(weight, np.bincount(of, weights=w[what], minlength=n))


def similar_classes(classes: DataFrame, threshold: float = 0.6, bands: int = 48, rows: int = 3, weighted: bool = False) -> DataFrame:
    """Pairs of classes (a1, a2, b1, b2) whose plain similarity, or with `weighted` their weighted one, is at least `threshold`.

    A pair of weighted similarity v is missed with probability (1 - v^rows)^bands.  v is at least `threshold` with
    `weighted`, else least_weighted(threshold): 0.545 at 0.6, so 2 of 10,000 pairs at the worst and one of 100,000 where
    weights do not matter.
    """
    spark = classes.sparkSession
    counts = shingle_counts(classes)
    n_classes = classes.count()
    shared = spark.sparkContext.broadcast((idf(counts, n_classes), counts.astype(np.int32)))
    lowest = threshold if weighted else least_weighted(threshold)
    # plain similarity below which no pair has a weighted one of `lowest`, by the same bound
    plain = threshold if not weighted else threshold / (threshold + (1 - threshold) * RATIO)
    pairs = candidate_pairs(classes, shared, max(spark.sparkContext.defaultParallelism, -(-n_classes // TASK_CLASSES)), plain, bands, rows)
    one = classes.select(F.col("c1").alias("x"), F.col("c2").alias("a2"), F.col("body").alias("body_a"))
    two = classes.select(F.col("c1").alias("y"), F.col("c2").alias("b2"), F.col("body").alias("body_b"))
    full = pairs.join(one, "x").join(two, "y").select(F.col("x").alias("a1"), "a2", F.col("y").alias("b1"), "b2", "body_a", "body_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value[0]
        for b in (s for x in batches for s in slices(x)):
            plain_one, weighted_one = pair_similarities(b.column(4), b.column(5), w)
            good = weighted_one >= lowest - 1e-6
            if not weighted:  # the exact check of what the weighted one lets pass
                good &= plain_one >= threshold - 1e-12
            s = weighted_one if weighted else plain_one
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(s)], names=["a1", "a2", "b1", "b2", "similarity"]).filter(pa.array(good))

    return full.mapInArrow(verify, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")


def candidate_pairs(classes: DataFrame, shared, n: int, plain: float, bands: int, rows: int) -> DataFrame:
    """Candidates (x < y), the c1 of two classes that agree in all samples of a band and can have similarity `plain`.

    Buckets of more than BUCKET_LIMIT classes are not paired as they are: there a class takes part under its
    len - ceil(plain * len) + 1 rarest shingles (prefix filter), which no pair over the threshold escapes; so a bucket that a
    third of all rows share through a common passage neither emits all its pairs nor loses one.  Of the pairs of a bucket
    only those that the sets' sizes and bitmaps cannot rule out leave the join.  `shared` holds the weights and document counts.
    """

    def keys(code: np.ndarray, at: np.ndarray, c1: np.ndarray) -> Iterator[pa.RecordBatch]:
        salt = 1 + (c1.view(np.uint64) % np.uint64(SALTS)).astype(np.int16)
        for key in band_keys(code, at, shared.value[0], bands, rows):
            found, where, many = np.unique(key, return_inverse=True, return_counts=True)
            crowded = found[many > CROWDED]
            where_to = np.where(many[where] > CROWDED, salt, np.int16(0))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c1), pa.array(where_to)], names=["key", "c1", "salt"])
            if len(crowded):
                yield pa.RecordBatch.from_arrays([pa.array(crowded.view(np.int64)), pa.nulls(len(crowded), pa.int64()), pa.array(np.zeros(len(crowded), np.int16))], names=["key", "c1", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sets of several slices are sampled together, so that a crowded key shows however long the texts are
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sizes = np.concatenate([np.diff(at) for _, at, _ in held])
                yield from keys(np.concatenate([c for c, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([c for _, _, c in held]))
                held.clear()

        for b in (s for x in batches for s in slices(x)):
            if len(b):
                held.append((*_text_shingles(b.column(1)), b.column(0).to_numpy()))
            if sum(len(c) for _, _, c in held) >= TASK_CLASSES or sum(len(c) for c, _, _ in held) >= 4_000_000:
                yield from flush()
        yield from flush()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, df = shared.value
        for b in (s for x in batches for s in slices(x, 1 << 20)):
            code, at = _text_shingles(b.column(1))
            size = np.diff(at)
            own = np.repeat(np.arange(len(b)), size)
            order = np.lexsort((code, df[slot(code)], own))
            first = np.arange(len(code)) - at[own] <= (size - np.ceil(plain * size - 1e-9))[own]
            chosen, who = order[first], own[first]
            buckets = b.column(2)
            per = np.asarray(buckets.value_lengths())
            start = np.concatenate([[0], np.cumsum(per)])[:-1]
            twice = np.repeat(np.arange(len(who)), per[who])  # each rare shingle under each large bucket of its class
            step = np.arange(len(twice)) - np.repeat(np.cumsum(per[who]) - per[who], per[who])
            bucket = buckets.flatten().to_numpy().view(np.uint64)[start[who[twice]] + step]
            key = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + mix(code[chosen[twice]]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(who[twice]))], names=["key", "c1"])

    # Rows of a key that is crowded among the classes sampled together are known to be of a large bucket: they spread over
    # salts, and a row without c1 tells the rest of the key; so a task gets at most CROWDED of TASK_CLASSES of all classes under a key.
    keyed = classes.select("c1", "body").repartition(n).mapInArrow(run, "key bigint, c1 bigint, salt smallint")
    w = Window.partitionBy("key", "salt")
    crowd = keyed.withColumns({"n": F.count("c1").over(w), "told": F.count(F.lit(1)).over(w)})
    is_large = (F.col("salt") > 0) | (F.col("n") > BUCKET_LIMIT) | (F.col("told") > F.col("n"))
    met = materialize(crowd.where("c1 IS NOT NULL").withColumn("large", is_large).where("n > 1 OR large").select("key", "c1", "large"))
    in_large = met.where("large").groupBy("c1").agg(F.collect_set("key").alias("buckets"))  # at most `bands` keys a class
    rare = classes.join(in_large, "c1").select("c1", "body", "buckets").mapInArrow(prefixes, "key bigint, c1 bigint")
    # a shared c1 of two classes only lets more pairs through to the checks
    marks = classes.groupBy("c1").agg(*[F.first(c).alias(c) for c in ("n", *BITMAP)], F.count(F.lit(1)).alias("same"))
    held = materialize(met.where("NOT large").select("key", "c1").unionByName(rare).join(marks, "c1"))
    names = ["c1", "n", "same", *BITMAP]
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "ab")
    col = lambda c, side: F.col(f"{c}_{side}")
    apart = sum((F.bit_count(col(c, "a").bitwiseXOR(col(c, "b"))) for c in BITMAP[1:]), F.bit_count(col("w0", "a").bitwiseXOR(col("w0", "b"))))
    both = col("n", "a") + col("n", "b")
    near = (apart * (1 + plain) <= both * (1 - plain) + 1e-9) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * plain - 1e-9)
    joined = a.join(b, "key").where((F.col("c1_a") < F.col("c1_b")) & (near | (col("same", "a") + col("same", "b") > 2)))
    return joined.select(F.col("c1_a").alias("x"), F.col("c1_b").alias("y")).distinct()


def near_duplicates(df: DataFrame, key: str, texts: str, threshold: float = 0.6, bands: int = 48, rows: int = 3, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members gives each key its class (c1, c2); links the similar pairs of different classes.

    Records are arrays of texts; null texts and arrays count as empty, and records without a shingle belong to no
    class.  Repeated rows give repeated members.  An empty table gives two empty results; further columns are not read.
    What the samples can miss is bounded by `bands` and `rows` (see similar_classes).
    """
    members = materialize(record_classes(df, key, texts))
    classes = materialize(members.groupBy("c1", "c2").agg(*[F.first(c).alias(c) for c in ("body", "n", *BITMAP)]))
    return members.select(key, "c1", "c2"), similar_classes(classes, threshold, bands, rows, weighted)


def near_duplicate_pairs(df: DataFrame, key: str, texts: str, hot: int = HOT_ROWS, **how) -> DataFrame:
    """All pairs of keys (a < b) whose records are similar, members of one class among them.

    Members of classes with more than `hot` records are salted in the joins that form their pairs.
    """
    members, links = near_duplicates(df, key, texts, **how)
    sizes = materialize(members.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")))
    crowded = sizes.where(F.col("n") > hot_limit(members.count(), hot))
    of = lambda name, side: members.select(F.col(key).alias(name), F.col("c1").alias(f"{side}1"), F.col("c2").alias(f"{side}2"))
    hot_of = lambda side: crowded.select(F.col("c1").alias(f"{side}1"), F.col("c2").alias(f"{side}2"))
    with_a = join_hot(of("x", "a"), links.select("a1", "a2", "b1", "b2"), ["a1", "a2"], hot_of("a"))
    across = join_hot(of("y", "b"), with_a, ["b1", "b2"], hot_of("b")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    inside = members.join(sizes.where("lo <> hi").select("c1", "c2"), ["c1", "c2"], "left_semi")
    left, right = (inside.select("c1", "c2", F.col(key).alias(name)) for name in "ab")
    within = join_hot(left, right, ["c1", "c2"], crowded.select("c1", "c2")).where("a < b").select("a", "b")
    return across.unionByName(within).distinct()


def candidate_texts(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """candidate_id and texts: the stem and, where question_bank has the id, the option texts (redelivered rows once)."""
    c = candidates.groupBy("candidate_id").agg(F.collect_set("stem").alias("stems"))
    q = bank.where(F.col("question_id").isNotNull()).groupBy(F.col("question_id").alias("candidate_id")).agg(F.array_distinct(F.flatten(F.collect_set("options.text"))).alias("options"))
    return c.join(q, "candidate_id", "left").select("candidate_id", F.concat("stems", F.coalesce("options", F.array().cast("array<string>"))).alias("texts"))
