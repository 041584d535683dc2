from pyspark.sql import functions as F

from trailweave.operators import coverage, graphs, match, panels, paths
from trailweave.plans import pilot


def test_stages(spark):
    e = pilot.pilot_exits(spark).cache()
    m = match.matched(pilot.pilot_traces(spark), e)
    r = coverage.path_results(paths.listed(e), m)
    got = {(x.workflow.split(".")[1], x.stage): (x.pieces, x.covered) for x in panels.stage_coverage(r, graphs.gates(e), e).where("workflow like 'reports%' or workflow like 'orders%'").collect()}
    assert got == {("DailyReportWorkflow", 0): (2, 2), ("DailyReportWorkflow", 1): (2, 2), ("DailyReportWorkflow", 2): (2, 1), ("OrderWorkflow", 0): (2, 2), ("OrderWorkflow", 1): (2, 2)}
    assert tuple(panels.branch_headline(coverage.branch_coverage(e, m)).select("branches", "taken", "percent", "grade", "at_target").first()) == (50, 39, 78.0, "commendable", 4)


def test_small_panels(spark):
    mutants = spark.createDataFrame([("noticed",), ("noticed",), ("survived",), ("flaky",)], "result string")
    assert round(panels.decision_check(mutants).first().score, 1) == 66.7
    out = spark.createDataFrame([("w", "J1", "t", "covered"), ("w", "J1", "f", "missed"), ("w", "J2", "t", "missed"), ("w", "J1", "x", "impossible")], "workflow string, decision string, outcome string, status string")
    assert [(r.outcome, r.tests_of) for r in panels.forced_decisions(out).collect()] == [("f", ["t"])]
    steps = spark.createDataFrame([(["J1.exit"],), (["J1.iterate", "J2.ok", "J1.retry", "J1.exit"],)], "steps array<string>")
    external = F.create_map(F.lit("J2.ok"), F.array(F.lit("Charge: success")), F.lit("0:J1.exit"), F.array(F.lit("loop: 0 rounds")), F.lit("i:J1.exit"), F.array(F.lit("J1.iterate")))
    assert [r.x for r in steps.select(panels.external_steps(F.col("steps"), external).alias("x")).collect()] == [["loop: 0 rounds"], ["Charge: success"]]
    handlers = spark.createDataFrame([("w", "go", "signal", 2, 1, "yes"), ("w", "ask", "query", 1, 1, "yes"), ("w", "chk", "validator", 2, 0, "not recorded")], "workflow string, handler string, kind string, branches int, branches_taken int, exercised string")
    selector = spark.createDataFrame([("w", "J1.go", 'signal "go"'), ("w", "J1.timer", "timer")], "workflow string, edge_id string, label string")
    taken = spark.createDataFrame([("w", "J1.go")], "workflow string, edge_id string")
    assert tuple(panels.handler_stats(handlers, selector, taken).select("covered", "total", "not_recorded").first()) == (3, 4, 1)
