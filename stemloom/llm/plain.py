"""Visually identical text brought to one plain form, over flat code-point arrays.

A text's plain form: every code point replaced by its compatibility decomposition, look-alike letters and radicals by
the plain character, any space but tab and line breaks by U+0020, code points that show nothing by none; then marks put
in canonical order and composed with their base.  All steps are table gathers over the code points of a whole batch.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.codepoints import gather, slices, to_arrow, to_codepoints
from stemloom.session import HOT_ROWS, hot_limit, join_groups, join_hot, materialize

# Letters of other alphabets, or special Latin ones, that are shaped like a plain Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ζ": "Z",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ѵ": "v", "Ь": "b",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k", "γ": "y", "σ": "o",
    # Armenian, Cherokee, Lisu
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # phonetic letters and small capitals, dotless letters
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ȷ": "j", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
# Forms of the radicals block without a decomposition of their own, with the ideograph of the same shape.
RADICALS = {
    "⺀": "冫", "⺁": "厂", "⺂": "乛", "⺃": "乚", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺇": "几", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺋": "卩", "⺌": "小", "⺍": "小", "⺎": "尢", "⺏": "尣", "⺐": "尢", "⺑": "尣", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌",
    "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺳": "网", "⺴": "网",
    "⺵": "网", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺼": "月", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶",
    "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻞": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦",
    "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
#: Line breaks and tab stay as they are.
KEPT_SPACES = frozenset("\t\n\x0b\x0c\r\x85\u2028\u2029")
#: Format characters that do show something.
VISIBLE_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD])
#: Characters outside the format category that show nothing: grapheme joiner, Hangul fillers, Khmer and Mongolian marks, variation selectors.
INVISIBLE = frozenset([0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
LIMIT = sys.maxunicode + 1


def _plain_char(c: str) -> str:
    n, cat = ord(c), unicodedata.category(c)
    if n in INVISIBLE or (cat == "Cf" and n not in VISIBLE_FORMATS):
        return ""
    if c in KEPT_SPACES:
        return c
    if cat == "Zs":
        return " "
    return LOOKALIKES.get(c) or RADICALS.get(c) or c


def _expansions(of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, start, length) by code point for the function of one character; table begins with the identity."""
    start, length = np.arange(LIMIT, dtype=np.int32), np.ones(LIMIT, dtype=np.uint8)
    more: list[int] = []
    for n in (*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        c = chr(n)
        out = of(c)
        if out != c:
            start[n], length[n] = LIMIT + len(more), len(out)
            more += map(ord, out)
    return np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(more, dtype=np.uint32)]), start, length


@lru_cache(1)
def _tables():
    table, start, length = _expansions(lambda c: "".join(map(_plain_char, unicodedata.normalize("NFKD", c))))
    marks = np.zeros(LIMIT, dtype=np.uint8)
    pairs: dict[int, int] = {}
    for n in (*range(0x300, 0x3100), *range(0xA000, 0xAC00), *range(0xFB00, 0x1F000)):
        marks[n] = unicodedata.combining(chr(n))
    for n in (*range(0xC0, 0x3100), *range(0xFB1D, 0xFB50), *range(0x11000, 0x12000)):
        d = unicodedata.decomposition(chr(n))
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", chr(n)) == chr(n):
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = n
    keys = np.array(sorted(pairs), dtype=np.int64)
    return table, start, length, marks, keys, np.array([pairs[k] for k in keys], dtype=np.uint32)


def _compose(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of marks (and Hangul letters), rows kept apart."""
    _, _, _, marks, keys, composed = _tables()
    rank = marks[points]
    hangul = (points >= 0x1161) & (points < 0x11C3)
    if not rank.any() and not hangul.any():
        return points, offsets
    points = points.copy()
    first = np.zeros(len(points) + 1, dtype=bool)
    first[offsets] = True
    first = first[:-1]
    base = (rank == 0) | first
    group = np.cumsum(base)
    if ((rank[1:] < rank[:-1]) & (rank[1:] > 0) & ~first[1:]).any():
        # a leading mark of a row heads its group but is ordered with the marks after it
        order = np.lexsort((np.where(rank == 0, 0, rank), np.cumsum((rank == 0) | first)))
        points, rank = points[order], rank[order]
    alive = np.ones(len(points), dtype=bool)
    while True:
        at = np.flatnonzero(alive)
        p, r, g = points[at], rank[at], group[at]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = g[1:] != g[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        inner = np.flatnonzero(~fresh & (r > 0) & (r[head] == 0))
        hit = inner[(inner - 1 == head[inner]) | (r[inner - 1] != r[inner])]  # not blocked
        key = p[head[hit]].astype(np.int64) << 21 | p[hit]
        found = np.searchsorted(keys, key)
        ok = found < len(keys)
        ok[ok] = keys[found[ok]] == key[ok]
        hit, found = hit[ok], found[ok]
        # the first composable mark of each base
        _, one = np.unique(head[hit], return_index=True)
        if not len(one):
            break
        points[at[head[hit[one]]]] = composed[found[one]]
        alive[at[hit[one]]] = False
    # starters that compose with the starter before them: Hangul letters
    if hangul.any():
        for low, high in ((0x1161, 0x1176), (0x11A8, 0x11C3)):
            at = np.flatnonzero(alive)
            p = points[at].astype(np.int64)
            row_start = first[at]
            prev = np.concatenate([[0], p[:-1]])
            if low == 0x1161:
                ok = (p >= low) & (p < high) & (prev >= 0x1100) & (prev < 0x1113)
                new = 0xAC00 + ((prev - 0x1100) * 21 + (p - 0x1161)) * 28
            else:
                ok = (p >= low) & (p < high) & (prev >= 0xAC00) & (prev < 0xD7A4) & ((prev - 0xAC00) % 28 == 0)
                new = prev + (p - 0x11A7)
            ok &= ~row_start
            i = np.flatnonzero(ok)
            points[at[i - 1]] = new[i]
            alive[at[i]] = False
    kept = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(alive, out=kept[1:])
    return points[alive], kept[offsets]


def plain_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of flat code points with row offsets."""
    table, start, length, *_ = _tables()
    size = length[points]
    out, off = gather(table, start[points], size)
    return _compose(out, off[offsets])


def plain_form(texts: pa.Array) -> pa.Array:
    """The plain form of Arrow texts; null stays null, an empty text empty."""
    points, offsets = to_codepoints(texts)
    out, off = plain_points(points, offsets)
    nulls = np.asarray(texts.is_null()) if texts.null_count else None
    return to_arrow(out, off, nulls)


@lru_cache(1)
def _letters():
    table, start, length = _expansions(str.lower)
    keep = np.zeros(LIMIT, dtype=bool)
    for n in range(LIMIT):
        keep[n] = unicodedata.category(chr(n))[0] in "LN"
    return table, start, length, keep


def letters_only(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, then letters and digits (Unicode L and N) only."""
    table, start, length, keep = _letters()
    out, off = gather(table, start[points], length[points])
    offsets = off[offsets]
    good = keep[out]
    kept = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(good, out=kept[1:])
    return out[good], kept[offsets]


def flat_texts(stem: pa.Array, options: pa.Array, field: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Stem and option texts of each row as one flat array of texts, row by row, with n + 1 row offsets.

    A null stem or text counts as ''; null options as none.
    """
    if isinstance(options, pa.ChunkedArray):
        options = options.combine_chunks()
    n = len(stem)
    lengths = np.nan_to_num(np.asarray(options.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
    values = options.flatten()
    inner = (values.field(field) if pa.types.is_struct(values.type) else values).cast(pa.large_string())
    if pa.types.is_struct(values.type) and values.null_count:
        import pyarrow.compute as pc

        inner = pc.if_else(values.is_valid(), inner, pa.scalar(None, inner.type))
    both = pa.concat_arrays([stem.cast(pa.large_string()).fill_null(""), inner.fill_null("")])
    off = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=off[1:])
    take = np.empty(off[-1], dtype=np.int64)
    take[off[:-1]] = np.arange(n)
    rest = np.ones(off[-1], dtype=bool)
    rest[off[:-1]] = False
    take[rest] = n + np.arange(len(inner))
    return both.take(pa.array(take)), off


def with_plain_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the plain form of a text column (nulls stay null, '' stays ''; texts of any length are kept whole)."""

    @F.pandas_udf("string")
    def run(s):
        return plain_form(pa.array(s, type=pa.large_string(), from_pandas=True)).to_pandas()

    return df.withColumn(out, run(F.col(column)))


def lookalike_classes(df: DataFrame, key: str, stem: str, options: str) -> DataFrame:
    """Each row's key with two strings: `plain`, equal for rows that look the same, and `raw`, equal for equal characters.

    Texts are compared position by position, so both strings hold each text with its length in front.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, plain string, raw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            texts, rows = flat_texts(b.column(1), b.column(2))
            raw, raw_off = to_codepoints(texts)
            seen, seen_off = plain_points(raw, raw_off)
            yield pa.RecordBatch.from_arrays([b.column(0), framed(seen, seen_off, rows), framed(raw, raw_off, rows)], names=[key, "plain", "raw"])

    return df.select(key, stem, options).mapInArrow(run, schema)


def framed(points: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> pa.Array:
    """One string a row of its texts, each ended by U+10FFFF (a noncharacter) doubled where a text itself holds it."""
    mark = 0x10FFFF
    n = np.ones(len(points), dtype=np.int64)
    n[points == mark] = 2
    body, off = gather(points, np.arange(len(points)), np.ones(len(points), dtype=np.int64)) if (n == 1).all() else (np.repeat(points, n), None)
    if off is None:
        off = np.concatenate([[0], np.cumsum(n)])
    ends = off[offsets]
    out = np.insert(body, ends[1:], mark)
    row_ends = ends[rows] + rows
    return to_arrow(out, row_ends).cast(pa.string())


def _spellings(df: DataFrame, key: str, stem: str, options: str, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members k, look, raw of looks with more than one spelling; spellings look, raw, n, first; hot ones of them).

    Forms are told apart by their SHA-256.  Rows of a look are counted before they are joined back, and looks with more
    than `hot` rows are joined by broadcast.
    """
    c = lookalike_classes(df.select(key, stem, options), key, stem, options)
    digest = lambda t: F.unhex(F.sha2(t, 256))
    c = materialize(c.select(F.col(key).alias("k"), digest("plain").alias("look"), digest("raw").alias("raw")))
    total = c.count()
    looks = c.groupBy("look").agg(F.min("raw").alias("least"), F.max("raw").alias("most"), F.count(F.lit(1)).alias("rows_seen")).where("least <> most").select("look", "rows_seen")
    members = materialize(join_groups(c, looks, ["look"], "rows_seen", total, hot).select("k", "look", "raw").distinct())
    spellings = materialize(members.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")))
    return members, spellings, spellings.where(F.col("n") > hot_limit(total, hot)).select("raw")


def lookalike_pairs(df: DataFrame, key: str = "extract_no", stem: str = "stem", options: str = "options", hot: int = HOT_ROWS) -> DataFrame:
    """Pairs (extract_a, extract_b) of rows that look the same but differ in a character.

    Rows are first grouped to classes of equal characters; only classes that look the same and differ are joined, and
    their members last, so copies of one text cost one row until the result; members of a class with more than `hot` rows are
    salted there.  A repeated row (same key and texts) counts once.  A null stem or option text counts as an empty one,
    null options as none; option labels and all other columns are left aside.  An empty table gives no pairs.
    """
    members, kinds, crowded = _spellings(df, key, stem, options, hot)
    links = kinds.select("look", F.col("raw").alias("raw_a")).join(kinds.select("look", F.col("raw").alias("raw_b")), "look").where("raw_a < raw_b").select("raw_a", "raw_b")
    of = lambda name, raw: members.select(F.col("k").alias(name), F.col("raw").alias(raw))
    with_x = join_hot(of("x", "raw_a"), links, ["raw_a"], crowded.withColumnRenamed("raw", "raw_a"))
    pairs = join_hot(of("y", "raw_b"), with_x, ["raw_b"], crowded.withColumnRenamed("raw", "raw_b"))
    return pairs.select(F.least("x", "y").alias("extract_a"), F.greatest("x", "y").alias("extract_b")).where("extract_a < extract_b").distinct()


def lookalike_members(df: DataFrame, key: str = "extract_no", stem: str = "stem", options: str = "options", hot: int = HOT_ROWS) -> DataFrame:
    """The same without pairs, whose number grows with the square of a look's rows: key, class_id, first (the smallest
    key of the look), spelling_first (the smallest key with the same characters), n_spellings and n_rows of the look.

    Only looks with more than one spelling are there; two rows of a class are a pair unless their spelling_first is the same.
    """
    members, kinds, crowded = _spellings(df, key, stem, options, hot)
    looks = kinds.groupBy("look").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_rows"))
    told = kinds.select("look", "raw", F.col("first").alias("spelling_first")).join(looks, "look")
    return join_hot(members.select("k", "raw"), told, ["raw"], crowded).select(F.col("k").alias(key), F.hex("look").alias("class_id"), "first", "spelling_first", "n_spellings", "n_rows")
