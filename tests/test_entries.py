"""Entries of rules, saved ids and pruned prefixes on small cases that are known by hand."""

import pytest
from pyspark.sql import functions as F

from trailweave.operators import entries


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [("w", d, label, f"{j}.{label}") for j, d in enumerate(("if more", "if more #2", "if done", "case x #7"), 1) for label in ("true", "false")]
    return spark.createDataFrame(rows, "workflow string, decision string, label string, edge_id string")


CASES = [
    ("if more --false", None, "ambiguous"),
    ("any: if more --false", ["1.false", "2.false"], None),
    ("any:if   more --false", ["1.false", "2.false"], None),
    ("if more #1 --false", ["1.false"], None),
    ("if more #2 --false", ["2.false"], None),
    ("if more #2/2 --false", ["2.false"], None),
    ("if more #2/3 --false", None, "count changed"),
    ("if done  --true", ["3.true"], None),
    ("any: if done --true", ["3.true"], None),
    ("case x #7 --true", ["4.true"], None),  # a text of its own: there is no "case x"
    ("case x --true", None, "unknown"),
    ("if more", None, "unknown"),
    ("", None, "unknown"),
    (None, None, "unknown"),
]


def test_entries(spark, decisions):
    said = spark.createDataFrame([("w", i, e) for i, (e, _, _) in enumerate(CASES)] + [("other", 99, "if done --true")], "workflow string, i int, entry string")
    got = {r.i: r for r in entries.resolved(said, decisions).collect()}
    assert [(CASES[i][0], got[i].edges, got[i].problem) for i in range(len(CASES))] == CASES
    assert got[0].options == ["if more #2 --false", "if more --false"]
    assert got[99].problem == "unknown" and len(got) == len(CASES) + 1


def test_rules_with_a_problem_are_not_applied(spark, decisions):
    rows = [("w", "good", 0, "when", "if done --true"), ("w", "good", 1, "when", "any: if more --true"), ("w", "good", 0, "without", "if more #2 --false"), ("w", "bad", 0, "when", "if done --true"), ("w", "bad", 1, "when", "if more --true")]
    said = spark.createDataFrame(rows, "workflow string, rule_id string, ord int, part string, entry string")
    got = {r.rule_id: r for r in entries.checked_rules(entries.resolved(said, decisions)).collect()}
    assert got["good"].when == [["3.true"], ["1.true", "2.true"]] and got["good"].without == [["2.false"]] and got["good"].problems == []
    assert got["bad"].when is None and got["bad"].problems == ["if more --true: ambiguous"]


def test_pruned_prefixes(spark):
    paths = spark.createDataFrame([("w", "p", ["a", "b", "c"]), ("w", "q", ["a"]), ("w", "r", []), ("v", "p", ["a", "b"]), ("u", "p", [])], "workflow string, path_id string, steps array<string>")
    groups = spark.createDataFrame([("w", 2, ["a"]), ("w", 1, ["a", "b"]), ("w", 0, ["a", "b", "c", "d"]), ("u", 5, [])], "workflow string, `group` int, prefix array<string>")
    got = {(r.workflow, r.path_id): r.group for r in entries.pruned_by(paths, groups).collect()}
    assert got == {("w", "p"): 1, ("w", "q"): 2, ("w", "r"): None, ("v", "p"): None, ("u", "p"): 5}


def test_answers(spark):
    rows = [("w", "s1:0123456789ab", True), ("v", "s1:0123456789ab", False)]
    results = spark.createDataFrame(rows, "workflow string, stable_id string, truncated boolean")
    ids = spark.createDataFrame([("s1:0123456789ab",), ("s1:ffffffffffff",), ("s1:no",), (None,)], "stable_id string")
    got = sorted((str(r.stable_id), r.answer, r.workflows) for r in entries.explained(results, ids).collect())
    assert got == [("None", "malformed", 0), ("s1:0123456789ab", "found", 2), ("s1:0123456789ab", "found", 2), ("s1:ffffffffffff", "beyond the list", 0), ("s1:no", "malformed", 0)]
    whole = results.withColumn("truncated", F.lit(False))
    assert entries.explained(whole, ids).where("answer = 'unknown'").count() == 1


def test_floor_without_workflows(spark):
    w = spark.createDataFrame([], "workflow string, capped boolean, covered long, total long, branches_taken long, branches long")
    s = spark.createDataFrame([], "workflow string, covered long, total long, cannot long, big boolean")
    assert [tuple(r) for r in entries.testable_floor(w, s).collect()] == [("", "path", 0, 0)]
    one = spark.createDataFrame([("w", True, 1, 2, 3, 4)], w.schema)
    assert sorted(tuple(r) for r in entries.testable_floor(one, s).collect()) == [("", "path", 0, 0), ("w", "stage", 0, 0)]
    with pytest.raises(ValueError):
        entries.testable_floor(w, s, "path")


def test_nearest_names_equal_those_of_all_comparisons(spark):
    import random

    from trailweave.operators import compare

    r = random.Random(5)
    known = sorted({"".join(r.choice("abC") for _ in range(r.randint(0, 9))) for _ in range(60)})
    asked = sorted({"".join(r.choice("aBcd") for _ in range(r.randint(0, 11))) for _ in range(80)} - set(known))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for n in asked:
        best = min((edits(n.lower(), w.lower()), w) for w in known if w)
        if best[0] <= min(2, max(1, len(n) // 3)):
            want[n] = best[1]
    got = compare.suggestions(spark.createDataFrame([(n,) for n in asked], "name string"), spark.createDataFrame([(w,) for w in known], "workflow string"), 2)
    assert {x.name: x.hint for x in got.collect()} == want and want
