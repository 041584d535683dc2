from pyspark.sql import functions as F

from trailweave.operators import classify, compare, coverage, graphs, match, panels, paths
from trailweave.plans import pilot
from trailweave.sources.tables import exits

#: Scenarios of each workflow, and how many of them ran (fixed values).
SCENARIOS = {
    "approval.ApprovalWorkflow": (4, 2), "billing.SubscriptionWorkflow": (3, 2), "fulfillment.OrderFulfillmentWorkflow": (4, 2), "fulfillment.PaymentWorkflow": (4, 2),
    "orders.OrderWorkflow": (3, 3), "polling.ReportPollingWorkflow": (4, 2), "reports.DailyReportWorkflow": (3, 2), "shipment.ShipmentWorkflow": (5, 3),
}


def test_scenarios_counted_listed_and_covered(spark):
    e, outside = pilot.pilot_exits(spark).cache(), pilot.pilot_external(spark)
    assert {r.workflow: int(r.scenarios) for r in graphs.scenario_counts(e, outside).collect()} == {w: n for w, (n, _) in SCENARIOS.items()}
    results = coverage.path_results(paths.listed(e), match.matched(pilot.pilot_traces(spark), e)).withColumn("bucket", F.lit("testable"))
    results = results.join(panels.external_maps(outside), "workflow")
    external = F.array_append(panels.external_steps(F.col("steps"), F.col("external")), F.concat(F.lit("end: "), F.col("end")))
    found = coverage.scenarios(results, results.where("covered"), external)
    assert {r.workflow: (r.n, r.c) for r in found.groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("c")).collect()} == SCENARIOS
    # known ids
    ids = {r.scenario_id for r in found.where("workflow = 'orders.OrderWorkflow'").collect()}
    assert {"sc:b8399a8d47", "sc:752834cc39"} <= ids


def test_listing_enters_no_dead_ways(spark):
    dead = {f"D{i}": ("if", {"true": f"D{i + 1}" if i < 11 else "!x", "false": f"D{i + 1}" if i < 11 else "!x"}) for i in range(1, 12)}
    good = {f"G{i}": ("if", {"true": f"G{i + 1}" if i < 14 else "=completed"}) for i in range(1, 15)}
    e = exits(spark, pilot.exit_rows({"w": {"J0": ("if", {"true": "D1", "false": "G1"}), **dead, **good}}))
    assert [(r.number, r.truncated) for r in paths.listed(e, cap=100).collect()] == [(1, False)] and graphs.path_counts(e).first().paths == "1"


def test_long_maps(spark):
    n = 1500
    e = exits(spark, pilot.exit_rows({"w": {f"J{i}": ("if", {"true": f"J{i + 1}" if i < n else "=completed", "false": "=failed"}) for i in range(1, n + 1)}}))
    assert graphs.path_counts(e).first().paths == str(n + 1) and graphs.reachable(e).count() == 2 * n
    assert paths.listed(e, cap=10).where("truncated").count() == 10


def test_risks(spark):
    rows = [
        (["A (activity): success", "B (activity): failure", "Undo (activity): success"], False, "compensation"), (["A (activity): failure", "B (activity): success"], False, "activity failure"),
        (["A (activity): success", "B (activity): failure"], False, "activity failure"), (["end: completed"], True, "compensation"), (["timer", "cancel sent"], False, "cancel"), (["end: continue-as-new", "timer"], False, "continue-as-new"),
        (["select (Selector): timeout"], False, "timers and timeouts"), (['signal "x"'], False, "signals and updates"), (["version v: old"], False, "old version branches"), ([], False, "plain logic"), (["A (wait): failure"], False, "cancel"),
    ]
    df = spark.createDataFrame(rows, "steps array<string>, deferred boolean, want string")
    assert [(r.want, r.got) for r in df.select("want", compare.risk_of(F.col("steps"), F.col("deferred")).alias("got")).collect() if r.want != r.got] == []


def test_detectors(spark):
    results = spark.createDataFrame([("w", f"p{i}", s, False) for i, s in enumerate([["a.t", "b.f"], ["a.f"], ["b.t", "c.x"], ["l.exit"], ["l.iterate", "l.exit"], ["q.t"]])], "workflow string, path_id string, steps array<string>, covered boolean")
    facts = spark.createDataFrame(
        [("w", "a.t", "closed-signal-channel", "", False, True), ("w", "b.f", "closed-signal-channel", "", False, False), ("w", "a.f", "history-limit", "", False, True), ("w", "b.t", "version-gate", "", False, False),
         ("w", "c.x", "constant-condition", "", False, False), ("w", "l.exit", "first-trip-always", "l.iterate", False, False)], "workflow string, edge_id string, kind string, name string, negated boolean, likely boolean"
    )
    claims = spark.createDataFrame([("w", "p5", "unknown-input-type", ""), ("w", "p5", "likely-defect", ""), ("w", "p0", "value-flow", "impossible-nil")], "workflow string, path_id string, detector string, label string")
    verdicts = classify.single_facts(results, facts).unionByName(classify.leaves_before_trip(results, facts)).unionByName(classify.analysed(claims))
    got = {r.path_id: (r.bucket, r.label, r.source, r.extra) for r in classify.classified(results, verdicts).collect()}
    assert got == {
        "p0": ("cannot-be-tested", "closed-signal-channel", "closed-signal-channel", []), "p1": ("needs-review", "needs-review", "history-limit", []),
        "p2": ("cannot-be-tested", "constant-condition", "constant-condition", ["version-gate-old-branch"]), "p3": ("cannot-be-tested", "impossible-loop-exit", "loop-exit-before-first-trip", []),
        "p4": ("testable", "default", "default", []), "p5": ("needs-review", "likely-defect", "likely-defect", []),
    }
    assert classify.enabled(verdicts, ("value-flow",)).where("source = 'value-flow'").count() == 0
