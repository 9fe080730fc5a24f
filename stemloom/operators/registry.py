"""Source registry: files of a new scan reconciled with the known sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions.text import stable_id
from stemloom.session import materialize


def reconcile(previous: DataFrame, current: DataFrame, dataset: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """(registry, issues) after a scan.

    previous: source_id, path, history array<string>, hash, revision.  current: path, hash (null for files that could
    not be read, which count as absent).  By path: the same hash keeps the revision, another raises it.  Of the rest,
    one old and one new with the same hash are a rename (path appended to the history).  Other groups that share a hash
    are ambiguous, one issue a hash; their old rows go missing and their new ones start as new.  registry: source_id,
    path, history, hash, revision, presence, change.  Paths and hashes are counted before they are joined, so a hash
    that very many files share is one row in the join.  Empty tables are fine on either side.
    """
    now = current.where(F.col("hash").isNotNull()).groupBy("path").agg(F.first("hash").alias("new_hash"))
    old = previous.select("source_id", "path", "history", "hash", "revision")
    j = old.join(now, "path", "full_outer")
    same = j.where(F.col("source_id").isNotNull() & F.col("new_hash").isNotNull())
    kept = same.select(
        "source_id", "path", "history", F.col("new_hash").alias("hash"), (F.col("revision") + F.when(F.col("hash").eqNullSafe(F.col("new_hash")), 0).otherwise(1)).alias("revision"),
        F.lit("present").alias("presence"), F.when(F.col("hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed").alias("change"),
    )
    lost = j.where(F.col("new_hash").isNull()).select("source_id", "path", "history", "hash", "revision")
    fresh = j.where(F.col("source_id").isNull()).select("path", F.col("new_hash").alias("hash"))
    lost_n = lost.where("hash IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n_old"))
    fresh_n = fresh.groupBy("hash").agg(F.count(F.lit(1)).alias("n_new"), F.min("path").alias("to_path"))
    shared = lost_n.join(fresh_n, "hash")
    moves = shared.where("n_old = 1 AND n_new = 1").select("hash", "to_path")
    renamed = lost.join(moves, "hash").select(
        "source_id", F.col("to_path").alias("path"), F.when(F.element_at("history", -1).eqNullSafe(F.col("to_path")), F.col("history")).otherwise(F.concat("history", F.array("to_path"))).alias("history"),
        "hash", "revision", F.lit("present").alias("presence"), F.lit("renamed").alias("change"),
    )
    missing = lost.join(moves, "hash", "left_anti").select("source_id", "path", "history", "hash", "revision", F.lit("missing").alias("presence"), F.lit("missing").alias("change"))
    new = fresh.join(moves, "hash", "left_anti").select(
        stable_id(F.lit(dataset), F.col("path")).alias("source_id"), "path", F.array("path").alias("history"), "hash", F.lit(1).alias("revision"), F.lit("present").alias("presence"), F.lit("new").alias("change")
    )
    issues = shared.where("n_old > 1 OR n_new > 1").select(F.lit("QB-IDENTITY-AMBIGUOUS").alias("code"), "hash", "n_old", "n_new")
    return kept.unionByName(renamed).unionByName(missing).unionByName(new), issues


def ambiguous_paths(previous: DataFrame, current: DataFrame, issues: DataFrame) -> DataFrame:
    """The paths of each ambiguous hash, one row each (hash, side 'old' or 'new', path): no array holds them all."""
    hashes = issues.select("hash")
    now = current.where(F.col("hash").isNotNull()).select("path", "hash").distinct()
    old = previous.join(now.select("path"), "path", "left_anti").join(hashes, "hash").select("hash", F.lit("old").alias("side"), "path")
    new = now.join(previous.select("path"), "path", "left_anti").join(hashes, "hash").select("hash", F.lit("new").alias("side"), "path")
    return old.unionByName(new)


def duplicate_groups(df: DataFrame, source: str, fingerprint: str) -> DataFrame:
    """duplicate_group: 'content-sha256:<fingerprint>' where it occurs more than once in the same source, else null.

    Rows keep their identity; the count is pre-aggregated and joined, so a hot group is no window in one task.
    """
    many = df.where(F.col(fingerprint).isNotNull()).groupBy(source, fingerprint).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(source, fingerprint, F.concat(F.lit("content-sha256:"), fingerprint).alias("duplicate_group"))
    return df.drop("duplicate_group").join(many, [source, fingerprint], "left")


def supersession(reviews: DataFrame, key: list[str], position: list[str], review: str = "review_id") -> DataFrame:
    """Each review with the nearest earlier one of the same issue, and whether that one is closed."""
    w = Window.partitionBy(*key).orderBy(*position)
    d = reviews.withColumns({"supersedes": F.lag(review).over(w), "before": F.lag("status").over(w)})
    return d.select(review, *key, "supersedes", F.when(F.col("supersedes").isNotNull(), F.col("before") != "open").alias("closed_before"))


def snapshot_diff(parent: DataFrame, child: DataFrame, key: str, fixed: list[str], state: str) -> DataFrame:
    """Rows of two snapshots by key: added, removed, altered (a fixed field differs), moved (state differs) or same."""
    a = parent.select(key, F.struct(*fixed).alias("fa"), F.col(state).alias("from_state"), F.lit(True).alias("ina"))
    b = child.select(key, F.struct(*fixed).alias("fb"), F.col(state).alias("to_state"), F.lit(True).alias("inb"))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~F.col("fa").eqNullSafe(F.col("fb")), "altered").when(~F.col("from_state").eqNullSafe(F.col("to_state")), "moved").otherwise("same")
    return j.select(key, kind.alias("change"), "from_state", "to_state")


def ancestry(snapshots: DataFrame, key: str, parent: str) -> DataFrame:
    """key, ancestor, distance over a parent-linked list, by pointer doubling: log2(length) joins, no recursion in rows.

    A key has one parent; a link given twice counts twice.  Unknown parents end a chain, however long.  Keys that lead
    into a cycle (they have more steps than there are keys) get each ancestor once, at its least distance; those on the
    cycle are their own ancestors.
    """
    step = materialize(snapshots.where(F.col(parent).isNotNull()).select(F.col(key).alias("key"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")))
    n_keys, jumps = step.select("key").distinct().count(), [step]
    while 2 ** (len(jumps) - 1) <= n_keys and not jumps[-1].isEmpty():
        jumps.append(materialize(_further(jumps[-1], jumps[-1])))
    endless = jumps[-1].select("key").distinct()
    cyclic = not endless.isEmpty()
    paths = step.join(endless, "key", "left_anti") if cyclic else step
    for jump in jumps[:-1]:
        paths = paths.unionByName(_further(paths, jump))
    if not cyclic:
        return paths
    once = step.join(endless, "key", "left_semi").groupBy("key", "ancestor").agg(F.min("distance").alias("distance"))
    for jump in jumps:
        far = _further(once, jump).groupBy("key", "ancestor").agg(F.min("distance").alias("distance"))
        new = materialize(far.join(once, ["key", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        once = once.unionByName(new)
    return paths.unionByName(once)


def _further(paths: DataFrame, jump: DataFrame) -> DataFrame:
    """Each path lengthened by the jump from its end."""
    return paths.alias("p").join(jump.alias("j"), F.col("p.ancestor") == F.col("j.key")).select(F.col("p.key"), F.col("j.ancestor"), (F.col("p.distance") + F.col("j.distance")).alias("distance"))


def chain_faults(snapshots: DataFrame, key: str, parent: str, generation: str, digest: str, parent_digest: str) -> DataFrame:
    """(key, fault) of snapshots that do not continue their parent: 'parent' (there is none of that key), 'generation' (not one more
    than the parent's; roots have 1), 'digest' (parent_digest is not the parent's digest).

    Without a fault there is no cycle, since generations rise along every link.  Keys are taken as unique.
    """
    up = snapshots.select(F.col(key).alias(parent), F.col(generation).alias("_g"), F.col(digest).alias("_d"), F.lit(True).alias("_there"))
    j = snapshots.join(up, parent, "left")
    root = F.col(parent).isNull()
    faults = F.array_compact(F.array(
        F.when(~root & F.col("_there").isNull(), F.lit("parent")), F.when(F.col(generation) != F.when(root, F.lit(1)).otherwise(F.col("_g") + 1), F.lit("generation")),
        F.when(~root & F.col("_there") & ~F.col(parent_digest).eqNullSafe(F.col("_d")), F.lit("digest")),
    ))
    return j.select(key, F.explode(faults).alias("fault"))
