"""The pilot's known totals, matching rules and measures on small inputs."""

import pytest
from pyspark.sql import functions as F

from trailweave.functions import ids, measures
from trailweave.operators import classify, compare, coverage, graphs, match, paths
from trailweave.plans import pilot
from trailweave.sources.tables import exits, read_traces


@pytest.fixture(scope="module")
def pilot_results(spark):
    e = pilot.pilot_exits(spark).cache()
    m = match.matched(pilot.pilot_traces(spark), e).cache()
    return e, m, coverage.path_results(paths.listed(e), m).cache()


def test_pilot_totals(pilot_results):
    e, m, r = pilot_results
    total = coverage.path_coverage(r).agg(F.sum("paths"), F.sum("covered")).first()
    assert tuple(total) == (38, 20)
    assert tuple(coverage.branch_coverage(e, m).agg(F.sum("branches"), F.sum("taken")).first()) == (50, 39)
    assert tuple(coverage.pair_coverage(e, r, m).agg(F.sum("pairs"), F.sum("covered")).first()) == (42, 28)
    assert m.where("not matched").count() == 0


def test_counts_equal_listing(pilot_results):
    e, _, r = pilot_results
    listed = {x.workflow: str(x["count"]) for x in r.groupBy("workflow").count().collect()}
    assert {x.workflow: x.paths for x in graphs.path_counts(e).collect()} == listed


def test_known_ids(spark):
    row = spark.sql("select array('J1.true') as s, 'completed' as e").select(
        ids.path_id(F.col("s"), F.col("e")).alias("p"), ids.stable_id(F.array(F.lit("if in.AmountCents <= 0\x1ftrue")), F.col("e")).alias("s1"), ids.scenario_id(F.array(F.lit("end: completed"))).alias("sc"),
        ids.branch_id(F.lit("orders/orders.go"), F.lit("OrderWorkflow"), F.lit("if in.AmountCents <= 0"), F.lit("true"), F.lit(1)).alias("b"),
    ).first()
    assert tuple(row) == ("40dbc77a36", "s1:743d711a77b4", "sc:b8399a8d47", "b:8c9ef03309f3")


NESTED = {"w": {"J1": ("loop", {"iterate": "J2", "exit": "=completed", "retry": "J1"}), "J2": ("loop", {"iterate": "J3", "exit": "~J1", "retry": "J2"}), "J3": ("if", {"true": "~J2", "false": "J4!only"}), "J4": ("if", {"only": "!x", "other": "=failed"})}}


@pytest.mark.parametrize(
    ("steps", "path", "bad", "at"),
    [
        ("J1.exit", "J1.exit", None, "E:completed"),
        ("J1.iterate J2.exit J1.retry J1.iterate J2.exit J1.retry J1.exit", "J1.iterate J2.exit J1.retry J1.exit", None, "E:completed"),
        ("J1.iterate J2.iterate J3.true J2.retry J2.iterate J3.true J2.retry J2.exit J1.retry J1.exit", "J1.iterate J2.iterate J3.true J2.retry J2.exit J1.retry J1.exit", None, "E:completed"),
        ("J1.iterate J3.true", "J1.iterate", 2, "J:J2"),
        ("J1.iterate J2.exit J1.exit", "J1.iterate J2.exit", 3, "R:J1.retry"),
        ("J1.exit J1.exit", "J1.exit", 2, "E:completed"),
        ("", "", 0, "J:J1"),
        ("J1.iterate J2.iterate J3.false J4.other", "J1.iterate J2.iterate J3.false", 4, "J:J4!J4.only"),
        ("J1.iterate J2.iterate J3.false J4.only", "J1.iterate J2.iterate J3.false J4.only", 0, "D"),
    ],
)
def test_matching(spark, steps, path, bad, at):
    e = exits(spark, pilot.exit_rows(NESTED))
    t = spark.createDataFrame([("w", "r", steps.split())], "workflow string, run_id string, steps array<string>")
    r = match.matched(t, e).first()
    assert (" ".join(r.path), r.bad_step, r.at) == (path, bad, at)


def test_markers(spark):
    rows = spark.createDataFrame([([">S1", "a", "<S1", "b"],), ([">H1", "x", "<H1", "b"],), ([">S1", "a"],), (["<S1"],), ([],)], "s array<string>")
    got = [tuple(r.u) for r in rows.select(match.unmarked(F.col("s"), ("H1",)).alias("u")).collect()]
    assert got == [(["a", "b"], [], False), (["b"], ["x"], False), (["a"], [], True), ([], [], True), ([], [], False)]


def test_triage_order(spark):
    e = pilot.pilot_exits(spark)
    w = "orders.OrderWorkflow"
    rows = [(w, "1", ["J1.true"], "complete", "h"), (w, "2", ["J1.true"], "running", "old"), (w, "3", ["J1.true"], "complete", "old"), (w, "4", ["J2.true"], "complete", "h"), ("none", "5", ["J1.true"], "running", "h")]
    t = spark.createDataFrame(rows, "workflow string, run_id string, steps array<string>, status string, function_hash string")
    hashes = spark.createDataFrame([(w, "h")], "workflow string, function_hash string")
    got = {r.run_id: r.kind for r in match.triaged(match.matched(t, e), hashes).collect()}
    assert got == {"1": "counted", "2": "incomplete", "3": "stale", "4": "unmatched", "5": "unknown"}
    assert match.triaged(match.matched(t, e), hashes, allow_stale=True).where("run_id = '3'").first().kind == "counted"


def test_trace_files(spark, tmp_path):
    (tmp_path / "a.trace.json").write_text('{"schemaVersion": 2, "workflow": "w", "status": "complete", "steps": ["J1.true"], "recordedAt": "2024-01-02T03:04:05Z"}')
    (tmp_path / "b.trace.json").write_text('{"schemaVersion": 1, "workflow": "w"}')
    (tmp_path / "c.trace.json").write_text("not json")
    (tmp_path / "d.json").write_text("{}")
    got = sorted((r.file.split("/")[-1][0], r.reading) for r in read_traces(spark, str(tmp_path)).select("file", "reading").collect())
    assert got == [("a", "ok"), ("b", "older-format"), ("c", "unreadable")]


def test_cap(spark):
    deep = {"w": {f"J{i}": ("if", {"true": f"J{i + 1}" if i < 6 else "=completed", "false": f"J{i + 1}" if i < 6 else "=failed"}) for i in range(1, 7)}}
    e = exits(spark, pilot.exit_rows(deep))
    assert paths.listed(e, cap=10).where("truncated").count() == 10
    assert graphs.path_counts(e).first().paths == "64"
    assert [r.junction_id for r in graphs.gates(e).orderBy("stage").collect()] == [f"J{i}" for i in range(1, 7)]


def test_bands(spark):
    rows = spark.createDataFrame([(0, 0), (1, 2), (4, 5), (9, 10), (49, 100), (81, 100)], "c int, t int")
    assert [r.p for r in rows.select(measures.priority(F.col("c"), F.col("t")).alias("p")).collect()] == ["", "Medium", "Medium", "Low", "High", "Low"]
    assert [r.p for r in rows.select(measures.percent(F.col("c"), F.col("t")).alias("p")).collect()][:2] == [0.0, 50.0]


def test_outcomes_and_classes(spark):
    results = spark.createDataFrame(
        [("w", 1, "p1", ["a.t", "b.t"], True, False), ("w", 2, "p2", ["a.f", "b.f"], False, False), ("w", 3, "p3", ["a.f", "c.t"], False, False)], "workflow string, number int, path_id string, steps array<string>, covered boolean, truncated boolean"
    )
    facts = spark.createDataFrame([("w", "a.f", "same-value", "x", True), ("w", "b.f", "same-value", "x", False)], "workflow string, edge_id string, kind string, name string, negated boolean")
    rules = spark.createDataFrame([("w", "r", [["c.t"]], [], "needs-special-test", "known-defect", False)], "workflow string, rule_id string, when array<array<string>>, without array<array<string>>, bucket string, label string, off boolean")
    over = spark.createDataFrame([("w", "p1", "cannot-be-tested", "x")], "workflow string, path_id string, bucket string, label string")
    verdicts = classify.contradictions(results, facts).unionByName(classify.by_rules(results, rules)).unionByName(classify.by_overrides(results, over))
    c = classify.classified(results, verdicts).cache()
    assert {r.path_id: r.bucket for r in c.collect()} == {"p1": "testable", "p2": "cannot-be-tested", "p3": "needs-special-test"}
    assert coverage.hidden_covered(c).count() == 0
    branches = spark.createDataFrame([("w", x, x) for x in ("a.t", "a.f", "b.f", "c.t", "d.t")], "workflow string, branch_id string, edge_id string")
    taken = spark.createDataFrame([("w", "a.t")], "workflow string, edge_id string")
    out = coverage.outcome_status(branches, c, taken)
    assert {r.branch_id: r.status for r in out.collect()} == {"a.t": "covered", "a.f": "blocked", "b.f": "impossible", "c.t": "blocked", "d.t": "missed"}
    assert tuple(coverage.outcome_summary(out).select("possible", "covered", "blocked", "impossible").first()) == (4, 1, 2, 1)
    doubt = spark.createDataFrame([("w", ["a.f"])], "workflow string, followed array<string>")
    assert classify.distrusted(c, doubt).where("path_id = 'p2'").first().bucket == "needs-review"


def test_nested_rounds(spark):
    runs = spark.createDataFrame([("w", "r", "o.iterate i.iterate i.iterate i.exit o.retry o.iterate i.exit o.retry o.iterate i.iterate".split())], "workflow string, run_id string, steps array<string>")
    loops = spark.createDataFrame([("w", "i", "i.iterate", "i.exit", ["o.iterate", "o.retry"]), ("w", "o", "o.iterate", "o.exit", [])], "workflow string, junction_id string, iterate string, leave string, closes array<string>")
    got = {(r.junction_id, r.bucket): r.entries for r in coverage.loop_rounds(runs, loops).collect()}
    assert got == {("i", "0"): 1, ("i", "1"): 1, ("i", "2+"): 1, ("o", "0"): 0, ("o", "1"): 0, ("o", "2+"): 1}


def test_gates_and_diff(spark):
    totals = spark.createDataFrame([(40.0, 90.0)], "a double, b double")
    rows = compare.gates(totals, {"a": 50.0, "b": 50.0})
    assert [r.failed for r in rows.orderBy("gate").collect()] == [True, False]
    assert compare.exit_code(rows).first().code == 2
    a = spark.createDataFrame([("w", "1", 1), ("w", "2", 1), ("w", "3", 1)], "workflow string, k string, v int")
    b = spark.createDataFrame([("w", "1", 1), ("w", "2", 2), ("w", "4", 1)], "workflow string, k string, v int")
    assert {r.k: r.change for r in compare.snapshot_diff(a, b, ["workflow", "k"], ["v"]).collect()} == {"2": "changed", "3": "removed", "4": "new"}
    names = spark.createDataFrame([("OrderWorkflo",)], "name string")
    flows = spark.createDataFrame([("OrderWorkflow",), ("Other",)], "workflow string")
    assert compare.suggestions(names, flows).first().hint == "OrderWorkflow"
