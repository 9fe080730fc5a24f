import datetime as dt

from stemloom.operators.orphans import QUESTION_BANK_KEYS, ForeignKey, orphan_cascade, orphan_report

DAY = [dt.datetime(2024, 1, d) for d in range(1, 29)]


def tables(spark):
    src = [("s1", DAY[0], None), ("s1", DAY[0], None), ("s2", DAY[9], None), ("s3", DAY[0], DAY[4]), (None, DAY[0], None)]
    cand = [
        ("c1", " S1 ", DAY[2], None, 1), ("c1", " S1 ", DAY[2], None, 2), ("c2", "s2", DAY[2], None, 1), ("c3", "s3", DAY[4], None, 1),
        ("c4", "s3", DAY[3], DAY[6], 1), ("c5", None, DAY[2], None, 1), ("c6", "", DAY[2], None, 1), ("c7", "nope", None, None, 1),
    ]
    dec = [("d1", "C1", DAY[3]), ("d2", "c2", DAY[3]), ("d3", "c4", DAY[6]), ("d4", "gone", DAY[3]), ("d5", "c1", DAY[1]), ("d6", None, DAY[1])]
    return {
        "sources": spark.createDataFrame(src, "source_id string, registered_at timestamp, removed_at timestamp"),
        "candidates": spark.createDataFrame(cand, "candidate_id string, source_id string, created_at timestamp, archived_at timestamp, period int"),
        "decisions": spark.createDataFrame(dec, "decision_id string, candidate_id string, recorded_at timestamp"),
        "review_queue": spark.createDataFrame([], "review_id string, candidate_id string, recorded_at timestamp"),
    }


def test_kinds_and_cascade(spark):
    rows = sorted((r.child_table, r.child_key, r.parent_key, r.kind, r.period) for r in orphan_cascade(tables(spark), QUESTION_BANK_KEYS).collect())
    assert rows == sorted([
        ("candidates", "c2", "s2", "late", "2024-01"), ("candidates", "c3", "s3", "deleted", "2024-01"), ("candidates", "c6", "", "missing", "2024-01"), ("candidates", "c7", "nope", "missing", None),
        ("decisions", "d3", "c4", "deleted", "2024-01"), ("decisions", "d4", "gone", "missing", "2024-01"), ("decisions", "d5", "c1", "late", "2024-01"), ("decisions", "d2", "c2", "inherited", "2024-01"),
    ], key=lambda r: (r[0], r[1], r[2], r[3]))
    assert orphan_report(orphan_cascade(tables(spark), QUESTION_BANK_KEYS)).where("origin = 'inherited'").collect()[0].n_refs == 1


def test_empty_parents_make_every_reference_missing(spark):
    t = tables(spark)
    t["sources"] = t["sources"].limit(0)
    got = orphan_cascade(t, QUESTION_BANK_KEYS).where("child_table = 'candidates'").collect()
    assert {r.kind for r in got} == {"missing"} and len(got) == 6


def test_cycle_reaches_the_fixpoint(spark):
    rows = [("a", "x"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "e"), ("f", None)]
    t = {"node": spark.createDataFrame([(i, p, DAY[1]) for i, p in rows], "id string, up string, at timestamp")}
    got = orphan_cascade(t, [ForeignKey("node", "id", "up", "at", "node", "id", "at")]).collect()
    assert sorted((r.child_key, r.origin) for r in got) == [("a", "direct"), ("b", "inherited"), ("c", "inherited"), ("d", "inherited")]


def test_p4_found_is_part_of_the_cascade(spark, monkeypatch):
    from stemloom.plans import quality

    folder = "/root/testdata/sf0.001"
    assert quality.p4_found(spark, folder).count() > 0
    real = quality.orphan_cascade
    monkeypatch.setattr(quality, "orphan_cascade", lambda *a: real(*a).where("child_table = 'candidates'"))
    assert {r.child_table for r in quality.p4_found(spark, folder).collect()} <= {"candidates"}
