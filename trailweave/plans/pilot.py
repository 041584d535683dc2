"""A small fixed project: eight decision maps and the runs of 21 tests, as rows of sources.tables.

Values here are fixed; results on them are known: 38 paths, 20 covered, 39 of 50 branches, 28 of 42 pairs.
A map is written as {junction: (kind, {label: target})}; a target is a junction, =end, ~retry of a junction or !dead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.sources.tables import START, exits

OK, BAD, AGAIN = "=completed", "=failed", "=continued-as-new"

MAPS: dict[str, dict[str, tuple[str, dict[str, str]]]] = {
    "orders.OrderWorkflow": {"J1": ("if", {"true": OK, "false": "J2"}), "J2": ("errcheck", {"failure": BAD, "success": OK})},
    "approval.ApprovalWorkflow": {"J1": ("errcheck", {"failure": BAD, "success": "J2"}), "J2": ("wait", {"timeout": OK, "signaled": "J3"}), "J3": ("if", {"true": OK, "false": OK})},
    "polling.ReportPollingWorkflow": {
        "J1": ("loop", {"iterate": "J2", "exit": OK, "retry": "J1"}),
        "J2": ("errcheck", {"failure": BAD, "success": "J3"}),
        "J3": ("switch", {'case "complete"': OK, 'case "failed"': OK, "default": "~J1"}),
    },
    "shipment.ShipmentWorkflow": {
        "J1": ("errcheck", {"failure": BAD, "success": "J2"}),
        "J2": ("selector", {'signal "delivery-update"': "J3", "timeout": "J4"}),
        "J3": ("switch", {'case "delivered"': "J4", 'case "returned"': "J4", "default": "J4"}),
        "J4": ("errcheck", {"failure": BAD, "success": OK}),
    },
    "fulfillment.OrderFulfillmentWorkflow": {"J1": ("errcheck", {"failure": BAD, "success": "J2"}), "J2": ("errcheck", {"failure": BAD, "success": "J3"}), "J3": ("errcheck", {"failure": BAD, "success": OK})},
    "fulfillment.PaymentWorkflow": {"J1": ("errcheck", {"failure": BAD, "success": "J2"}), "J2": ("if", {"true": "J3", "false": OK}), "J3": ("errcheck", {"failure": BAD, "success": OK})},
    "billing.SubscriptionWorkflow": {"J1": ("loop", {"iterate": "J2", "exit": AGAIN, "retry": "J1"}), "J2": ("errcheck", {"failure": BAD, "success": "~J1"})},
    "reports.DailyReportWorkflow": {"J1": ("if", {"true": "J2", "false": "J2"}), "J2": ("errcheck", {"failure": BAD, "success": "J3"}), "J3": ("errcheck", {"failure": BAD, "success": OK})},
}

RUNS: list[tuple[str, str, str]] = [
    ("orders.OrderWorkflow", "TestOrderRejected", "J1.true"),
    ("orders.OrderWorkflow", "TestOrderChargeFails", "J1.false,J2.failure"),
    ("orders.OrderWorkflow", "TestOrderCharged", "J1.false,J2.success"),
    ("approval.ApprovalWorkflow", "TestApprovalApproved", "J1.success,J2.signaled,J3.true"),
    ("approval.ApprovalWorkflow", "TestApprovalTimesOut", "J1.success,J2.timeout"),
    ("polling.ReportPollingWorkflow", "TestPollingCompleteFirstTime", 'J1.iterate,J2.success,J3.case "complete"'),
    ("polling.ReportPollingWorkflow", "TestPollingJobFailed", 'J1.iterate,J2.success,J3.case "failed"'),
    ("polling.ReportPollingWorkflow", "TestPollingPendingThenComplete", 'J1.iterate,J2.success,J3.default,J1.retry,J1.iterate,J2.success,J3.case "complete"'),
    ("polling.ReportPollingWorkflow", "TestPollingGivesUp", "J1.iterate,J2.success,J3.default,J1.retry,J1.exit"),
    ("shipment.ShipmentWorkflow", "TestShipmentDelivered", 'J1.success,J2.signal "delivery-update",J3.case "delivered",J4.success'),
    ("shipment.ShipmentWorkflow", "TestShipmentTimerFiresLost", "J1.success,J2.timeout,J4.success"),
    ("shipment.ShipmentWorkflow", "TestShipmentLabelFails", "J1.failure"),
    ("fulfillment.OrderFulfillmentWorkflow", "TestFulfillmentPaymentFailsReleasesStock", "J1.success,J2.failure"),
    ("fulfillment.OrderFulfillmentWorkflow", "TestFulfillmentSucceeds", "J1.success,J2.success,J3.success"),
    ("fulfillment.PaymentWorkflow", "TestPaymentSmallOrder", "J1.success,J2.false"),
    ("fulfillment.PaymentWorkflow", "TestPaymentBigOrderPassesReview", "J1.success,J2.true,J3.success"),
    ("billing.SubscriptionWorkflow", "TestSubscriptionContinuesAsNew", "J1.iterate,J2.success,J1.retry,J1.exit"),
    ("billing.SubscriptionWorkflow", "TestSubscriptionChargeFails", "J1.iterate,J2.failure"),
    ("reports.DailyReportWorkflow", "TestDailyReportLaterRunStartsFromLastReport", "J1.true,J2.success,J3.success"),
    ("reports.DailyReportWorkflow", "TestDailyReportFirstRun", "J1.false,J2.success,J3.success"),
    ("reports.DailyReportWorkflow", "TestDailyReportBuildFails", "J1.false,J2.failure"),
]


#: External steps of exits: what a run does outside itself where it takes them (fixed values).
STEPS: dict[str, dict[str, list[str]]] = {
    "orders.OrderWorkflow": {"J2.failure": ["ChargeCard (activity): failure"], "J2.success": ["ChargeCard (activity): success"]},
    "approval.ApprovalWorkflow": {
        "J1.failure": ["AwaitWithTimeout (wait): failure"], "J1.success": ["AwaitWithTimeout (wait): success"], "J2.timeout": ["if !ok (AwaitWithTimeout): timeout"], "J2.signaled": ["if !ok (AwaitWithTimeout): signaled"],
        "J3.true": ['if decision == "approved": true'], "J3.false": ['if decision == "approved": false'],
    },
    "polling.ReportPollingWorkflow": {
        "J1.iterate": ["loop for attempt <= in.MaxPolls: 1+ rounds"], "J2.failure": ["CheckStatus (activity): failure"], "J2.success": ["CheckStatus (activity): success"], "J3.default": ["timer"],
    },
    "shipment.ShipmentWorkflow": {
        "J1.failure": ["CreateLabel (activity): failure"], "J1.success": ["CreateLabel (activity): success"], 'J2.signal "delivery-update"': ['select (Selector): signal "delivery-update"'], "J2.timeout": ["select (Selector): timeout"],
        "J4.failure": ["NotifyCustomer (activity): failure"], "J4.success": ["NotifyCustomer (activity): success"],
    },
    "fulfillment.OrderFulfillmentWorkflow": {
        "J1.failure": ["ReserveInventory (activity): failure"], "J1.success": ["ReserveInventory (activity): success"], "J2.failure": ["PaymentWorkflow (child workflow): failure"], "J2.success": ["PaymentWorkflow (child workflow): success"],
        "J3.failure": ["ShipOrder (activity): failure"], "J3.success": ["ShipOrder (activity): success"],
    },
    "fulfillment.PaymentWorkflow": {
        "J1.failure": ["AuthorizeCard (activity): failure"], "J1.success": ["AuthorizeCard (activity): success"], "J3.failure": ["FraudReview (activity): failure"], "J3.success": ["FraudReview (activity): success"],
    },
    "billing.SubscriptionWorkflow": {"J1.iterate": ["loop for i < s.CyclesPerRun: 1+ rounds"], "J2.failure": ["ChargeMonthly (activity): failure"], "J2.success": ["ChargeMonthly (activity): success"]},
    "reports.DailyReportWorkflow": {
        "J2.failure": ["BuildReport (activity): failure"], "J2.success": ["BuildReport (activity): success"], "J3.failure": ["EmailReport (activity): failure"], "J3.success": ["EmailReport (activity): success"],
    },
}
#: What the exit of a loop adds if the loop wasn't iterated, and the loop's iterating exit (fixed values).
ZERO_ROUNDS: dict[str, dict[str, tuple[str, str]]] = {
    "polling.ReportPollingWorkflow": {"J1.exit": ("loop for attempt <= in.MaxPolls: 0 rounds", "J1.iterate")},
    "billing.SubscriptionWorkflow": {"J1.exit": ("loop for i < s.CyclesPerRun: 0 rounds", "J1.iterate")},
}


def pilot_external(spark: SparkSession) -> DataFrame:
    """workflow, edge_id, steps, zero (steps of a loop's exit after no round), iterate (the loop's iterating exit, or null)."""
    zero = {(w, e): z for w, of in ZERO_ROUNDS.items() for e, z in of.items()}
    keys = {(w, e) for w, of in STEPS.items() for e in of} | set(zero)
    rows = [(w, e, STEPS[w].get(e, []), [zero[w, e][0]] if (w, e) in zero else [], zero[w, e][1] if (w, e) in zero else None) for w, e in sorted(keys)]
    return spark.createDataFrame(rows, "workflow string, edge_id string, steps array<string>, zero array<string>, iterate string")


def exit_rows(maps: dict = MAPS) -> list[tuple]:
    """maps as rows of sources.tables.EXITS; the first junction is where a run starts."""
    rows: list[tuple] = []
    for workflow, junctions in maps.items():
        rows.append((workflow, START, "", "start", "", 0, False, "junction", next(iter(junctions)), None))
        for junction, (kind, ways) in junctions.items():
            for n, (label, to) in enumerate(ways.items()):
                where = {"=": ("end", to[1:]), "~": ("retry", f"{to[1:]}.retry"), "!": ("dead", "")}.get(to[0], ("junction", to.split("!")[0]))
                only = f"{to.split('!')[0]}.{to.split('!')[1]}" if where[0] == "junction" and "!" in to else None
                rows.append((workflow, f"{junction}.{label}", junction, kind, label, n, kind == "loop" and label == "retry", *where, only))
    return rows


def pilot_exits(spark: SparkSession) -> DataFrame:
    return exits(spark, exit_rows())


def pilot_traces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, t, t, s.split(",")) for w, t, s in RUNS], "workflow string, run_id string, test string, steps array<string>")
