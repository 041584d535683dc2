"""Rules of comparisons, doubt, groups, tests, names and grades, on rows whose answers are known."""

from pyspark.sql import functions as F

from trailweave.functions import measures
from trailweave.operators import classify, compare, coverage


def test_baseline(spark):
    columns = "workflow string, path_id string, bucket string, covered boolean"
    was = [("w", "same", "testable", False), ("w", "opened", "cannot-be-tested", False), ("w", "doubted", "testable", False), ("w", "lost", "testable", True), ("w", "both", "testable", True), ("w", "gone", "testable", True), ("w", "reviewed", "needs-review", False), ("w", "kept", "testable", True)]
    now = [("w", "same", "testable", False), ("w", "opened", "testable", False), ("w", "doubted", "needs-review", False), ("w", "lost", "testable", False), ("w", "both", "needs-review", False), ("w", "new", "testable", False), ("w", "new-review", "needs-review", True), ("w", "reviewed", "needs-review", False), ("w", "kept", "testable", True), ("new", "taken", "testable", True), ("new", "none", "cannot-be-tested", False)]
    got = {(r.path_id, r.finding, r.was) for r in compare.baseline_check(spark.createDataFrame(was, columns), spark.createDataFrame(now, columns)).collect()}
    assert got == {("opened", "untested", "cannot-be-tested"), ("doubted", "review", "testable"), ("lost", "lost", "testable"), ("both", "lost", "testable"), ("both", "review", "testable"), ("new", "untested", ""), ("new-review", "review", "")}


def test_doubt(spark):
    """A run left the map of w at its third step; nobody has explained it."""
    rows = [("w", "before", "cannot-be-tested", "x", "rule:r", 2), ("w", "at", "cannot-be-tested", "x", "rule:r", 3), ("w", "after", "cannot-be-tested", "x", "contradictory", 5), ("w", "unknown", "cannot-be-tested", "x", "value-flow", 0), ("w", "person", "cannot-be-tested", "x", "override", 9), ("w", "comment", "cannot-be-tested", "x", "comment", 0), ("w", "other", "needs-special-test", "x", "rule:r", 9), ("v", "calm", "cannot-be-tested", "x", "rule:r", 9)]
    results = spark.createDataFrame(rows, "workflow string, path_id string, bucket string, label string, source string, uses int")
    runs = spark.createDataFrame([("w", ["a", "b", "c", "d"]), ("w", ["a", "b"])], "workflow string, followed array<string>")
    got = {r.path_id: (r.bucket, r.label) for r in classify.distrusted(results, runs).collect()}
    back = ("needs-review", "model-limit")
    assert got == {"before": ("cannot-be-tested", "x"), "at": back, "after": back, "unknown": back, "person": ("cannot-be-tested", "x"), "comment": ("cannot-be-tested", "x"), "other": ("needs-special-test", "x"), "calm": ("cannot-be-tested", "x")}
    assert {r.label for r in classify.distrusted(results.drop("uses"), runs).where("path_id in ('before', 'at')").collect()} == {"model-limit"}


def test_missed_groups_leave_out_what_cannot_be_tested(spark):
    rows = [("w", 1, ["a", "b"], "completed", True, "testable"), ("w", 2, ["a", "c"], "completed", False, "testable"), ("w", 3, ["a", "c", "d"], "failed", False, "testable"), ("w", 4, ["x"], "failed", False, "cannot-be-tested"), ("w", 5, ["y"], "failed", False, "needs-review")]
    results = spark.createDataFrame(rows, "workflow string, number int, steps array<string>, end string, covered boolean, bucket string")
    counted = spark.createDataFrame([("w", ["a", "b"], ["a", "b"], "completed", "counted")], "workflow string, steps array<string>, path array<string>, end string, kind string")
    got = [(r.prefix, r.step, r.missed, r.first_number) for r in coverage.missed_groups(results, counted).collect()]
    assert got == [(["a"], "c", 2, 2)]


def test_what_each_test_adds(spark):
    rows = [("A", "w", ["x", "y"], "s1"), ("B", "w", ["x", "z"], "s1"), ("C", "w", ["x"], "s1"), ("", "w", ["x"], "s1"), (None, "w", ["x"], "s1"), ("D", "w", ["x"], "s2")]
    runs = spark.createDataFrame([(t, w, p, "completed", s) for t, w, p, s in rows], "test string, workflow string, path array<string>, end string, outside string")
    got = {r.test: (r.runs, r.scenarios, r.unique_scenarios, r.branches, r.unique_branches, r.adds_nothing) for r in coverage.test_results(runs, F.col("outside")).collect()}
    assert got == {"A": (1, 1, 0, 2, 1, False), "B": (1, 1, 0, 2, 1, False), "C": (1, 1, 0, 1, 0, True), "D": (1, 1, 1, 1, 0, False), "(test name not recorded)": (2, 1, 0, 1, 0, False)}


def test_hints_for_names(spark):
    flows = spark.createDataFrame([("orders.OrderWorkflow",), ("billing.Sub.Run",), ("xyz",)], "workflow string")
    asked = ["OrderWorkflw", "orders.OrderWorkflw", "ORDERWORKFLOWS", "ab", "xyy", "Sub.Rum", "OrderWorkflow", "Something"]
    got = {r.name: r.hint for r in compare.suggestions(spark.createDataFrame([(a,) for a in asked], "name string"), flows).collect()}
    assert got == {"OrderWorkflw": "OrderWorkflow", "orders.OrderWorkflw": "orders.OrderWorkflow", "ORDERWORKFLOWS": "OrderWorkflow", "xyy": "xyz", "Sub.Rum": "Sub.Run"}


def test_grades(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 59.9, 60.0, 74.9, 75.0, 89.9, 90.0, 100.0)], "p double")
    names = ["needs work"] * 2 + ["acceptable"] * 2 + ["commendable"] * 2 + ["exemplary"] * 2
    assert [r.g for r in rows.select(measures.grade(F.col("p")).alias("g")).collect()] == names


def test_scenarios_of_a_capped_map(spark):
    rows = [("w", 1, ["a"], "cannot-be-tested", "rule", False), ("w", 2, ["b"], "testable", "default", True), ("v", 1, ["a"], "cannot-be-tested", "rule", False)]
    results = spark.createDataFrame(rows, "workflow string, number int, steps array<string>, bucket string, label string, covered boolean")
    ran = spark.createDataFrame([("w", ["b"], 2), ("w", ["far"], 3), ("v", ["far"], 1)], "workflow string, steps array<string>, runs long")
    capped = spark.createDataFrame([("w",)], "workflow string")
    got = sorted((r.workflow, r.path_count, r.main_number or 0, r.bucket, r.label, r.runs) for r in coverage.scenarios(results, ran, F.col("steps"), capped).collect())
    assert got == [("v", 1, 1, "cannot-be-tested", "rule", 0), ("w", 0, 0, "testable", "default", 3), ("w", 1, 1, "needs-review", "model-limit", 0), ("w", 1, 2, "testable", "default", 2)]


def test_numbers_that_fell(spark):
    was = spark.createDataFrame([("a", "path", 80.0), ("b", "path", 80.0), ("c", "path", 80.0), ("d", "path", 80.0), ("gone", "path", 80.0)], "workflow string, kind string, percent double")
    now = spark.createDataFrame([("a", "path", 79.5, True), ("b", "path", 78.9, True), ("c", "branch", 1.0, True), ("d", "path", 0.0, False), ("new", "path", 0.0, True)], "workflow string, kind string, percent double, measured boolean")
    assert {(r.workflow, r.finding, r.percent) for r in compare.main_drops(was, now, 1.0).collect()} == {("b", "drop", 78.9), ("c", "kind changed", 1.0), ("d", "not measured", None)}


def test_what_a_version_adds(spark):
    columns = "workflow string, branch_id string, status string"
    base = spark.createDataFrame([("w", "b:1", "missed"), ("w", "b:2", "covered")], columns)
    now = spark.createDataFrame([("w", "b:1", "covered"), ("w", "b:3", "covered"), ("w", "b:4", "missed"), ("w", "b:5", "impossible"), ("v", "b:2", "blocked")], columns)
    added = compare.new_outcomes(base, now)
    assert {(r.workflow, r.branch_id) for r in added.collect()} == {("w", "b:3"), ("w", "b:4"), ("v", "b:2")}
    assert [(r.covered, r.total, round(r.percent, 2)) for r in compare.new_coverage(added).collect()] == [(1, 3, 33.33)]
    assert compare.new_coverage(compare.new_outcomes(now, now)).count() == 0
    a = spark.createDataFrame([("w", "x", "1"), ("w", "y", "1"), ("w", "gone", "1")], "workflow string, id string, exits string")
    b = spark.createDataFrame([("w", "x", "1", False), ("w", "y", "2", True), ("w", "z", "1", True), ("w", "u", "1", False)], "workflow string, id string, exits string, covered boolean")
    got = {r.id: (r.change, r.tested) for r in compare.tested_changes(a, b, ["workflow", "id"], ["exits"]).collect()}
    assert got == {"y": ("changed", None), "z": ("new", True), "u": ("new", False), "gone": ("removed", None)}
