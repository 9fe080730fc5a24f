"""Nested JSON to related flat tables by Dewey labels.

Every node of a document gets an ordinal path (its Dewey label) and a schema path.  A node's parent is its label with
the last part cut off; nodes of one schema path form one table; labels sort as the nodes stand in the document.

Labels: parts are joined by '.'; a part is the ordinal with a letter for its number of digits in front ('a1', 'b10',
'c100'), which keeps string order equal to document order for any number of siblings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_FIELDS = [
    T.StructField("label", T.StringType()),
    T.StructField("schema_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
]


class _Members(list):
    """The members of an object as (name, value), in written order, repeats kept."""


class _Number(str):
    """A number as written."""


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """A parser without recursion, for documents nested too deeply for the json module."""
    pos, end = 0, len(text.rstrip(" \t\n\r"))
    root: list = []
    stack: list[tuple[list, str]] = [(root, "value")]  # container, what must come next
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError("not JSON")
        pos = m.end()
        mark, string, number, word = m.groups()
        box, want = stack.pop()
        if mark in ("}", "]"):
            closes = isinstance(box, _Members) == (mark == "}") and box is not root
            if not closes or want not in ("first", "comma"):
                raise ValueError("not JSON")
            continue
        if mark == ",":
            if want != "comma" or box is root:
                raise ValueError("not JSON")
            stack.append((box, "name" if isinstance(box, _Members) else "value"))
            continue
        if mark == ":":
            if want != "colon":
                raise ValueError("not JSON")
            stack.append((box, "value"))
            continue
        if isinstance(box, _Members) and want in ("first", "name"):
            if string is None:
                raise ValueError("not JSON")
            box.append((json.loads(string), None))
            stack.append((box, "colon"))
            continue
        if want not in ("value", "first"):
            raise ValueError("not JSON")
        new = _Members() if mark == "{" else [] if mark == "[" else json.loads(string) if string is not None else _Number(number) if number is not None else _WORDS[word]
        if isinstance(box, _Members):
            box[-1] = (box[-1][0], new)
        else:
            box.append(new)
        stack.append((box, "comma"))
        if mark:
            stack.append((new, "first"))
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("not JSON")
    return root[0]


_DECODER = json.JSONDecoder(object_pairs_hook=_Members, parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)


def parse_document(text: str | None):
    """(True, tree) of a valid JSON text, else (False, None)."""
    if text is None or not text.strip(" \t\n\r"):
        return False, None
    try:
        return True, _DECODER.decode(text)
    except RecursionError:
        try:
            return True, _parse_deep(text)
        except ValueError:
            return False, None
    except ValueError:
        return False, None


def _part(n: int) -> str:
    d = str(n)
    return ("." + chr(96 + len(d))) + d


_PARTS = [_part(n) for n in range(4096)]


def _escape(name: str) -> str:
    """A member name as a path part: never '[]', which stands for an element, and without '/'."""
    return name.replace("~", "~0").replace("/", "~1").replace("[", "~2")


class _Table:
    """One schema path: whether its nodes are wanted, whether anything below it is, and the paths below."""

    __slots__ = ("path", "emit", "descend", "members", "elements", "rules")

    def __init__(self, path: str, rules: tuple[re.Pattern, re.Pattern] | None):
        self.path, self.rules, self.members, self.elements = path, rules, {}, None
        self.emit = rules is None or rules[0].fullmatch(path) is not None
        self.descend = rules is None or rules[1].fullmatch(path) is not None

    def member(self, name: str) -> _Table:
        found = self.members.get(name)
        if found is None:
            found = _Table(f"{self.path}/{_escape(name)}", self.rules)
            if len(self.members) < 10_000:  # names that are data would fill the memory
                self.members[name] = found
        return found

    def element(self) -> _Table:
        if self.elements is None:
            self.elements = _Table(self.path + "/[]", self.rules)
        return self.elements


def walk(tree, root: _Table, member_order: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, _Table, str | None, str, str | None]]:
    """(label, table, name, kind, value) of every wanted node, parents before children."""
    stack = [("", root, None, tree, None)]
    while stack:
        label, table, name, node, order = stack.pop()
        if isinstance(node, _Members):
            if table.emit:
                yield label, table, name, "object", None
            if not table.descend:
                continue
            if order:
                rank = {x: i for i, x in enumerate(order)}
                node = sorted(node, key=lambda m: rank.get(m[0], len(rank)))
            below = [(i, table.member(k), k, v) for i, (k, v) in enumerate(node, 1)]
        elif isinstance(node, list):
            if table.emit:
                yield label, table, name, "array", None
            if not table.descend:
                continue
            one = table.element()
            below = [(i, one, None, v) for i, v in enumerate(node, 1)]
        else:
            below = [(None, table, name, node)]
        inner = []
        for i, t, k, v in below:
            if isinstance(v, list):
                if t.emit or t.descend:
                    inner.append((label + (_PARTS[i] if i < 4096 else _part(i)), t, k, v, member_order.get(k, order)))
            elif t.emit:
                at = label if i is None else label + (_PARTS[i] if i < 4096 else _part(i))
                if type(v) is str:
                    yield at, t, k, "string", v
                elif v is None:
                    yield at, t, k, "null", None
                elif v is True or v is False:
                    yield at, t, k, "boolean", "true" if v else "false"
                else:
                    yield at, t, k, "number", str(v)
        inner.reverse()
        stack += inner


def _clean(s: str | None) -> str | None:
    """Half surrogate pairs from \\u escapes have no UTF-8 form."""
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def dewey_nodes(df: DataFrame, key: str, body: str, member_order: dict[str, tuple[str, ...]] | None = None, wanted: tuple[str, str] | None = None) -> DataFrame:
    """All nodes of the JSON documents in `body`: key, label, schema_path, name, kind, value.

    member_order: below a member of that name, objects are numbered with the given members first, in that order.
    wanted: two patterns of schema paths, of the nodes that are given and of those that are searched for such; labels are
    the same as without.
    Null, empty and invalid documents give no rows; an empty table gives none; other columns are left out, so no name
    can clash.  Labels and paths grow with the depth of a node, so a document nested d deep costs d squared characters.  Repeated member names stay separate nodes.  Repeated rows give their nodes repeatedly.  Numbers keep
    their digits as written.  The label of the root is ''.
    """
    order = member_order or {}
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *NODE_FIELDS])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _Table("$", tuple(map(re.compile, wanted)) if wanted else None)
        for b in batches:
            rows: list[tuple] = []
            size = 0

            def batch() -> pa.RecordBatch:
                at, *columns = zip(*rows)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.string()) for c in columns)], names=names)

            for i, text in enumerate(b.column(1).to_pylist()):
                ok, tree = parse_document(text)
                if not ok:
                    continue
                dirty = "\\u" in text
                for label, table, name, kind, value in walk(tree, root, order):
                    path = table.path
                    if dirty:
                        path, name, value = _clean(path), _clean(name), _clean(value)
                    rows.append((i, label, path, name, kind, value))
                    size += 100 + len(label) + len(path) + len(value or "")
                    if size > 8_000_000:  # bounds a batch whatever the documents hold
                        yield batch()
                        rows, size = [], 0
            if rows:
                yield batch()

    return df.select(key, body).mapInArrow(run, schema)


def parent_label(label: Column) -> Column:
    """The label of the parent: the last part cut off."""
    return F.left(label, F.greatest(F.length(label) - F.length(F.substring_index(label, ".", -1)) - 1, F.lit(0)))


def ancestor_label(label: Column, depth: int | Column) -> Column:
    """The label cut to its first `depth` parts."""
    if isinstance(depth, int):
        return F.substring_index(label, ".", depth + 1)
    return F.array_join(F.slice(F.split(label, r"\."), F.lit(1), depth + 1), ".")


def dewey_tables(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes with their table (schema path), own label and parent's label: the flat tables, parent links by truncation."""
    return nodes.select(key, F.col("schema_path").alias("table_path"), "label", F.when(F.col("label") != "", parent_label(F.col("label"))).alias("parent_label"), "name", "kind", "value")


# Schema paths of questions and, below them, of what becomes a child row; and of all that leads there.
_AT = r"\$(?:/sections/\[\])?/questions/\[\]"
_LOCATOR, _NOTE = r"/source_reference(?:/\[\])*/locator(?:/\[\])*", r"/metadata/qbc_extraction_notes(?:/\[\]|/text|/items)*"
CHILDREN = (
    rf"{_AT}(?:|/options/[^/]*|/options/\[\]/label|{_LOCATOR}|{_NOTE})",
    rf"\$|\$/sections|\$/sections/\[\]|\$(?:/sections/\[\])?/questions|{_AT}(?:|/options|/options/\[\]|/source_reference(?:/\[\])*|{_LOCATOR}|/metadata|{_NOTE})",
)
_FLAT, _NESTED = "$/questions/[]", "$/sections/[]/questions/[]"


def question_children(banks: DataFrame, key: str = "file_no", body: str = "body") -> DataFrame:
    """Options, locators and notes of bank documents: key, child_kind, question_pos, child_pos, child_key.

    Questions are the objects in `questions` and in `sections[].questions`, numbered by label over the whole document.
    A repeated row counts once.  One shuffle by document and one sort; the widest group is one document.
    """
    nodes = dewey_nodes(banks, key, body, {"qbc_extraction_notes": ("text", "items")}, CHILDREN)
    path, label, kind, value = (F.col(c) for c in ("schema_path", "label", "kind", "value"))
    nested = path.startswith(_NESTED)
    rest = F.substring(path, F.when(nested, len(_NESTED) + 1).otherwise(len(_FLAT) + 1), F.length(path))
    q = nodes.withColumns({"question": F.when(nested, ancestor_label(label, 4)).otherwise(ancestor_label(label, 2)), "rest": rest})
    leaf = kind.isin("string", "number", "boolean")
    part = (
        F.when((F.col("rest") == "") & (kind == "object"), F.lit("question"))
        .when(F.col("rest") == "/options/[]", F.lit("element"))
        .when((F.col("rest") == "/options/[]/label") & leaf, F.lit("label"))
        .when(F.col("rest").startswith("/options/") & (F.col("rest") != "/options/[]/label"), F.lit("member"))
        .when(F.col("rest").startswith("/source_reference") & leaf, F.lit("locator"))
        .when(F.col("rest").startswith("/metadata") & (kind == "string") & value.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit("note"))
    )
    q = q.withColumn("part", part).where(F.col("part").isNotNull())
    # a label row joins its option element by truncation
    own = F.when(F.col("part") == "label", parent_label(label)).otherwise(label)
    text = F.when(F.col("part") == "member", F.col("name")).when(F.col("part").isin("label", "locator", "note"), value)
    child_kind = F.when(F.col("part").isin("element", "label", "member"), F.lit("option")).otherwise(F.col("part"))
    rows = q.select(key, "question", own.alias("own"), (F.col("part") == "label").cast("int").alias("rank"), child_kind.alias("child_kind"), text.alias("text")).repartition(F.col(key))
    # one order serves all that follows: a label stands right after its element, equal rows of a repeated document together
    by = Window.partitionBy(key).orderBy("question", "own", "rank")
    rows = rows.withColumns({"next_own": F.lead("own").over(by), "next_rank": F.lead("rank").over(by), "next_text": F.lead("text").over(by)})
    again = F.col("next_own").eqNullSafe(F.col("own")) & (F.col("next_rank") == F.col("rank"))
    named = F.when(F.col("next_own") == F.col("own"), F.col("next_text"))
    rows = rows.where((F.col("rank") == 0) & ~F.coalesce(again, F.lit(False))).withColumn("child_key", F.coalesce("text", named, F.lit("")))
    rows = rows.withColumn("question_pos", F.count(F.when(F.col("child_kind") == "question", 1)).over(by))
    within = Window.partitionBy(key, "question").orderBy("own", "rank")
    counts = [F.when(F.col("child_kind") == k, F.count(F.when(F.col("child_kind") == k, 1)).over(within)) for k in ("option", "locator", "note")]
    rows = rows.withColumn("child_pos", F.coalesce(*counts)).where(F.col("child_kind") != "question")
    return rows.select(key, "child_kind", F.col("question_pos").cast("int"), F.col("child_pos").cast("int"), "child_key")
