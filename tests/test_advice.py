"""Checks of entries, paths of missed outcomes and drafts of rules, on rows whose answers are known."""

from pyspark.sql import functions as F

from trailweave.operators import advice

PATHS = "workflow string, number int, path_id string, steps array<string>, covered boolean, truncated boolean"
RULES = "workflow string, rule_id string, when array<array<string>>, without array<array<string>>, bucket string, label string, off boolean"


def test_entries(spark):
    paths = spark.createDataFrame([("w", 1, "p1", ["a", "b"], True, False), ("w", 2, "p2", ["a", "c"], False, False), ("w", 3, "p3", ["x"], False, False), ("v", 1, "q1", ["a"], True, True)], PATHS)
    rules = spark.createDataFrame([("w", "r1", [["a"]], [], "cannot-be-tested", "rule", False), ("w", "r2", [["c"]], [], "cannot-be-tested", "rule", False), ("w", "gone", [["zz"]], [], "cannot-be-tested", "rule", False), ("v", "far", [["zz"]], [], "cannot-be-tested", "rule", False), ("w", "off", [["a"]], [], "cannot-be-tested", "rule", True)], RULES)
    overrides = spark.createDataFrame([("w", "p1", False, ""), ("w", "p3", True, "known-defect"), ("w", "p9", True, "x")], "workflow string, path_id string, untestable boolean, label string")
    marks = spark.createDataFrame([("w", "c")], "workflow string, edge_id string")
    explained = spark.createDataFrame([("w", "t1:a"), ("w", "t1:b")], "workflow string, steps_id string")
    unmatched = spark.createDataFrame([("w", "t1:a", 3), ("w", "t1:c", 1)], "workflow string, steps_id string, runs long")
    entries = advice.checked_entries(paths, rules, overrides, marks, explained, unmatched).cache()
    got = {(r.kind, r.id): (r.hits, r.covered, r.refused, r.stale, r.unsure, r.overlaps) for r in entries.collect()}
    assert got == {
        ("rule", "r1"): (2, 1, 1, False, False, ["comment c", "override p1", "rule r2"]), ("rule", "r2"): (1, 0, 0, False, False, ["comment c", "rule r1"]),
        ("rule", "gone"): (0, 0, 0, True, False, []), ("rule", "far"): (0, 0, 0, False, True, []), ("override", "p1"): (1, 1, 0, False, False, ["rule r1"]),
        ("override", "p3"): (1, 0, 0, False, False, []), ("override", "p9"): (0, 0, 0, True, False, []), ("comment", "c"): (1, 0, 0, False, False, ["rule r1", "rule r2"]),
        ("explained-trace", "t1:a"): (3, 0, 0, False, False, []), ("explained-trace", "t1:b"): (0, 0, 0, True, False, []),
    }
    assert advice.check_code(entries).first().code == 1 and advice.check_code(entries.where("id <> 'r1'")).first().code == 0


def test_paths_of_outcomes(spark):
    fail, ok = "Charge (activity): failure", "Charge (activity): success"
    rows = [(1, ["a", "b"], [ok, "Undo (activity): failure", ok]), (2, ["a", "c", "d"], ["timer"]), (3, ["a", "c"], ["timer"]), (4, ["e", "b"], [fail]), (5, ["f"], [ok])]
    results = spark.createDataFrame([("w", n, s, x, n == 5) for n, s, x in rows], "workflow string, number int, steps array<string>, outside array<string>, covered boolean")
    missed = spark.createDataFrame([("w", "b:b", "if", "true"), ("w", "b:c", "if", "true"), ("w", "b:none", "errcheck", "failure"), ("w", "b:wait", "wait", "timeout"), ("w", "b:sig", "selector", "signal"), ("w", "b:if", "if", "false")], "workflow string, branch_id string, kind string, label string")
    branch = spark.createDataFrame([("w", "b:b", "b"), ("w", "b:c", "c"), ("w", "b:c", "d"), ("w", "b:if", "f")], "workflow string, branch_id string, edge_id string")
    took = spark.createDataFrame([("w", "f"), ("w", "a")], "workflow string, edge_id string")
    got = {r.branch_id: (r.risk, r.number, r.new_exits) for r in advice.outcome_paths(missed, branch, results, took, F.col("outside"), F.lit(False)).collect()}
    assert got == {
        "b:b": ("activity failure", 4, 2), "b:c": ("timers and timeouts", 3, 1), "b:none": ("activity failure", None, None),
        "b:wait": ("timers and timeouts", None, None), "b:sig": ("signals and updates", None, None), "b:if": ("plain logic", None, None),
    }


def test_drafts(spark):
    rows = [
        ("w", 1, "p1", ["a", "b", "c"], False, "needs-review", "history"), ("w", 2, "p2", ["a", "b", "d"], False, "needs-review", "history"), ("w", 3, "p3", ["a", "x"], True, "testable", "default"),
        ("w", 4, "p4", ["e", "f"], False, "needs-review", ""), ("w", 5, "p5", ["e", "g"], False, "testable", "default"), ("w", 6, "p6", ["e", "h"], False, "needs-review", ""), ("w", 7, "p7", ["b"], False, "needs-review", "known-defect"),
        ("a b", 1, "q1", ["m"], False, "needs-review", "odd"), ("a b", 2, "q2", ["n"], False, "needs-review", "odd"), ("w", 8, "p8", ["a", "b"], True, "needs-review", "history"),
    ]
    results = spark.createDataFrame(rows, "workflow string, number int, path_id string, steps array<string>, covered boolean, bucket string, label string")
    got = {r.rule_id: (r.label, r.when, r.path_ids, r.exact) for r in advice.drafted_rules(results.where("path_id <> 'p8'")).collect()}
    assert got == {
        "review-a-b-odd-1": ("odd", ["m"], ["q1"], True), "review-a-b-odd-2": ("odd", ["n"], ["q2"], True), "review-w-history-3": ("history", ["a", "b"], ["p1", "p2"], False),
        "review-w-needs-review-4": ("needs-review", ["e", "f"], ["p4"], True), "review-w-needs-review-5": ("needs-review", ["e", "h"], ["p6"], True),
    }
    # another path takes all of them: a draft a path
    got = {(r.label, r.exact) for r in advice.drafted_rules(results).where("label = 'history'").collect()}
    assert got == {("history", True)}
