"""References to records that do not exist, cascaded down the foreign-key graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.session import materialize


@dataclass(frozen=True)
class ForeignKey:
    """child.ref names parent.parent_id; the parent lives from born (inclusive) until died (exclusive)."""

    child: str
    child_id: str
    ref: str
    at: str
    parent: str
    parent_id: str
    born: str
    died: str | None = None


def same_id(c: Column) -> Column:
    """Ids compare in lower case without outer blanks."""
    return F.lower(F.regexp_replace(c, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", ""))


def direct_orphans(tables: dict[str, DataFrame], fk: ForeignKey) -> DataFrame:
    """Each reference of one foreign key that is missing, late or deleted.

    Redelivered rows are dropped from the orphans, which are few, not from all references, which would be a shuffle more.
    """
    child = tables[fk.child]
    refs = child.where(F.col(fk.ref).isNotNull()).select(
        F.col(fk.child_id).alias("child_key"), same_id(F.col(fk.ref)).alias("parent_key"), F.col(fk.at).alias("at")
    )
    died = F.col(fk.died) if fk.died else F.lit(None).cast("timestamp")
    parents = (
        tables[fk.parent].where(F.col(fk.parent_id).isNotNull())
        .groupBy(same_id(F.col(fk.parent_id)).alias("parent_key"))
        .agg(F.min(fk.born).alias("born"), F.when(F.count(died) == F.count(F.lit(1)), F.max(died)).alias("died"), F.lit(1).alias("here"))
    )
    joined = refs.join(parents, "parent_key", "left")
    kinds = F.array_compact(F.array(
        F.when(F.col("here").isNull(), F.lit("missing")),
        F.when(F.col("born") > F.col("at"), F.lit("late")),
        F.when(F.col("died") <= F.col("at"), F.lit("deleted")),
    ))
    return joined.select(
        F.lit(fk.child).alias("child_table"), F.date_format("at", "yyyy-MM").alias("period"), "child_key", "parent_key", F.explode(kinds).alias("kind"), F.lit("direct").alias("origin")
    ).distinct()


def inherited_orphans(tables: dict[str, DataFrame], fk: ForeignKey, orphans: DataFrame) -> DataFrame:
    """Children whose parent record is itself an orphan (a semi-join with the parent table's orphans)."""
    refs = tables[fk.child].where(F.col(fk.ref).isNotNull()).select(
        F.col(fk.child_id).alias("child_key"), same_id(F.col(fk.ref)).alias("parent_key"), F.col(fk.at).alias("at")
    )
    up = orphans.where(F.col("child_table") == fk.parent).select(same_id(F.col("child_key")).alias("parent_key")).distinct()
    return refs.join(up, "parent_key", "left_semi").select(
        F.lit(fk.child).alias("child_table"), F.date_format("at", "yyyy-MM").alias("period"), "child_key", "parent_key", F.lit("inherited").alias("kind"), F.lit("inherited").alias("origin")
    ).distinct()


def _levels(keys: list[ForeignKey]) -> list[list[ForeignKey]] | None:
    """Foreign keys by the longest path above their parent; None if the graph has a cycle."""
    up: dict[str, list[ForeignKey]] = {}
    for k in keys:
        up.setdefault(k.child, []).append(k)

    def depth(table: str, seen: tuple[str, ...]) -> int:
        if table in seen:
            raise ValueError
        return max((1 + depth(k.parent, (*seen, table)) for k in up.get(table, ())), default=0)

    try:
        by = [(depth(k.parent, ()), k) for k in keys]
    except ValueError:
        return None
    return [[k for d, k in by if d == n] for n in range(max((d for d, _ in by), default=-1) + 1)]


def orphan_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """Orphan references: child_table, period, child_key, parent_key, kind, origin ('direct' or 'inherited').

    Direct orphans name a parent that is missing, late or deleted.  Inherited ones name a parent that is itself an
    orphan; that rule is applied until nothing new appears.  In a foreign-key graph without cycles that takes as many
    rounds as the graph is deep, so the whole fixpoint is one lazy plan; with a cycle each round is written to the
    shared folder and the loop ends when a round adds no row.

    Null references are no orphans; a null time gives a null period and only 'missing' can be told; a blank reference
    is a missing one.  Repeated child rows count once; repeated parent rows count as one parent that lives from the
    first birth, and is deleted only if all its rows are.  Empty tables give no rows (an empty parent makes every
    reference missing).  Columns not named by the keys are not read.
    """
    direct = [direct_orphans(tables, k) for k in keys]
    all_direct = reduce(DataFrame.unionByName, direct)
    levels = _levels(keys)
    if levels is not None:
        reached = all_direct
        parts = [all_direct]
        for level in levels[1:]:
            new = [inherited_orphans(tables, k, reached) for k in level]
            parts += new
            reached = reduce(DataFrame.unionByName, [reached, *new])
        return reduce(DataFrame.unionByName, parts)
    found = materialize(all_direct)
    fresh = found
    while True:
        new = reduce(DataFrame.unionByName, [inherited_orphans(tables, k, fresh) for k in keys]).distinct()
        new = materialize(new.join(found.where("origin = 'inherited'").select("child_table", "child_key", "parent_key"), ["child_table", "child_key", "parent_key"], "left_anti"))
        if new.isEmpty():
            return found
        found, fresh = found.unionByName(new), new


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period, kind and origin."""
    return orphans.groupBy("child_table", "period", "origin", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("child_key").alias("n_children"))


QUESTION_BANK_KEYS = [
    ForeignKey("candidates", "candidate_id", "source_id", "created_at", "sources", "source_id", "registered_at", "removed_at"),
    ForeignKey("decisions", "decision_id", "candidate_id", "recorded_at", "candidates", "candidate_id", "created_at", "archived_at"),
    ForeignKey("review_queue", "review_id", "candidate_id", "recorded_at", "candidates", "candidate_id", "created_at", "archived_at"),
]
