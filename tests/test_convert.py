"""Conversion of runs of old maps, markers, spans of loops, and names, on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from trailweave.operators import convert, match, names, spans
from trailweave.plans import pilot
from trailweave.sources.tables import exits


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_runs_of_an_old_map(spark):
    new = exits(spark, pilot.exit_rows({"w": {"J1": ("if", {"true": "J2", "false": "=failed"}), "J2": ("if", {"true": "=completed", "false": "=failed"})}}))
    of = convert.lookups(
        frame(spark, [("w", "old")], "workflow string, old_hash string"), frame(spark, [("w", "S1", "send"), ("w", "S2", "send"), ("w", "S3", "gone")], "workflow string, site_id string, body string"),
        frame(
            spark, [("w", "J1.true", None, "a", "true"), ("w", "J2.true", "S1", "x", "true"), ("w", "J3.true", "S2", "x", "true"), ("w", "J3.false", "S2", "x", "false"), ("w", "J4.false", None, "b", "false"), ("w", "J5.true", None, "c", "true")],
            "workflow string, edge_id string, site_id string, statement string, label string",
        ),
        frame(spark, [("w", "H1", "send")], "workflow string, unit_id string, body string"),
        frame(spark, [("w", "J1.true", None, "a", "true"), ("w", "J2.false", None, "b", "false"), ("w", "H1.J1.true", "H1", "x", "true"), ("w", "H1.J1.false", "H1", "x", "false")], "workflow string, edge_id string, unit_id string, statement string, label string"),
    )
    both = ["J1.true", ">S1", "J2.true", "<S1", ">S2", "J3.false", "<S2", "J4.false"]
    runs = {
        "both": ("old", "p", both, "counted", ["H1.J1.true", "H1.J1.false"]),
        "no helper": ("old", "p", ["J1.true", "J4.false"], "counted", []),
        "present": ("now", "p", ["J1.true", ">H1", "H1.J1.true", "<H1", "J2.true"], "counted", ["H1.J1.true"]),
        "older": ("older", "p", both, "stale", []),
        "unknown step": ("old", "p", ["J1.true", "J9.true"], "stale", []),
        "statement gone": ("old", "p", ["J1.true", "J5.true"], "stale", []),
        "helper gone": ("old", "p", ["J1.true", ">S3", "<S3", "J4.false"], "stale", []),
        "own step in a helper": ("old", "p", [">S1", "J1.true", "<S1", "J4.false"], "stale", []),
        "helper's step outside": ("old", "p", ["J2.true", "J1.true", "J4.false"], "stale", []),
        "left, not entered": ("old", "p", ["J1.true", "<S1", "J4.false"], "stale", []),
        "never left": ("old", "p", ["J1.true", ">S1", "J2.true", "J4.false"], "stale", []),
        "not left at the end": ("old", "p", ["J1.true", "J4.false", ">S1"], "unmatched", []),
        "unknown place": ("now", "p", ["J1.true", ">H7", "<H7", "J2.true"], "unmatched", []),
        "other package": ("now", "q", ["J1.true", "J2.true"], "unknown", []),
        "no package": ("now", "", ["J1.true", "J2.true"], "counted", []),
        "no steps": ("old", "p", [], "unmatched", []),
        "null": ("old", "p", None, "unmatched", None),
    }
    traces = frame(spark, [("w", k, h, p, "complete", s) for k, (h, p, s, _, _) in runs.items()], "workflow string, run_id string, function_hash string, package string, status string, steps array<string>")
    ready = convert.prepared(traces, of, frame(spark, [], "workflow string, site_id string"))
    hashes = frame(spark, [("w", "now", "p")], "workflow string, function_hash string, package string")
    got = {r.run_id: (r.kind, r.unit_hits) for r in match.triaged(match.matched(ready, new), hashes).collect()}
    assert {k: got[k][0] for k in runs if k != "null"} == {k: x[3] for k, x in runs.items() if k != "null"}
    assert {k: got[k][1] for k in runs if runs[k][3] == "counted"} == {k: x[4] for k, x in runs.items() if x[3] == "counted"}
    unit_exits = frame(spark, [("w", "H1", "H1.J1.true"), ("w", "H1", "H1.J1.false"), ("w", "H2", "H2.J1.true")], "workflow string, unit_id string, edge_id string")
    counted = match.triaged(match.matched(ready, new), hashes).where("kind = 'counted'")
    assert sorted((r.unit_id, r.branches, r.taken) for r in convert.unit_branches(unit_exits, counted).collect()) == [("H1", 2, 2), ("H2", 1, 0)]


def test_spans_of_loops(spark):
    said = {"i1": ["loop a", "x"], "i2": ["loop b"], "w": ["work"], "r1": ["again"], "e": ["late"]}
    cases = [
        (["w"], []),
        (["i1", "w", "r1", "e"], [("a", 1, 3)]),
        # one loop in another; the inner is gone round first
        (["i1", "i2", "w", "r2", "w", "r1", "e"], [("a", 1, 5), ("b", 3, 4)]),
        # left by a break: to the end of the path
        (["i1", "w", "e"], [("a", 1, 4)]),
        (["i1", "i2", "w", "r1", "e"], [("a", 1, 4), ("b", 3, 6)]),
        # entered again: the later one ends first, and the earlier stays open
        (["i1", "r1", "i1", "w", "r1"], [("a", 1, 2), ("a", 4, 6)]),
        (["i1", "i1", "r1", "r1"], [("a", 1, 6), ("a", 3, 4)]),
        (["r1", "w"], []),
        ([], []),
    ]
    rows = frame(spark, [(n, s) for n, (s, _) in enumerate(cases)], "n int, steps array<string>")
    texts = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    external = texts({k: F.array(*map(F.lit, v)) for k, v in said.items()})
    found = spans.loop_spans(F.col("steps"), external, texts({"i1": F.lit("a"), "i2": F.lit("b")}), texts({"r1": F.lit("a"), "r2": F.lit("b")}))
    assert [[tuple(x) for x in r.s] for r in rows.select("n", found.alias("s")).orderBy("n").collect()] == [want for _, want in cases]


def test_names(spark):
    known = ["orders.OrderWorkflow", "a/dup.Work", "b/dup.Work", "pay.Service.Charge", "other.Charge", "v1.2/x.Run"]
    workflows = frame(spark, [(w, f"example.com/{w[0]}", f"/src/{w[0]}") for w in known], "workflow string, module_path string, module_dir string")
    want = {
        "OrderWorkflow": ("orders.OrderWorkflow", None), " orders.OrderWorkflow ": ("orders.OrderWorkflow", None), "dup.Work": (None, "several"), "Work": (None, "several"), "a/dup.Work": ("a/dup.Work", None),
        "pay.(*Service).Charge": ("pay.Service.Charge", None), "Charge": (None, "several"), "orderworkflow": (None, "none"), "Workflow": (None, "none"), "": (None, "none"), "2/x.Run": ("v1.2/x.Run", None), "x.Run": ("v1.2/x.Run", None),
    }
    asked = frame(spark, [(n,) for n in want], "name string")
    got = {r.name: r for r in names.resolved(asked, workflows).collect()}
    assert {n: (r.workflow, r.problem) for n, r in got.items()} == want
    assert got["Work"].matches == ["a/dup.Work", "b/dup.Work"]
    lists = [frame(spark, [(x,) for x in xs], "name string") for xs in (["OrderWorkflow", "Work"], ["orders.OrderWorkflow", "x"])]
    assert sorted(tuple(r) for r in names.scope_problems(*lists, workflows).collect()) == [("exclude", "orders.OrderWorkflow", "in both lists"), ("exclude", "x", "none"), ("include", "OrderWorkflow", "in both lists"), ("include", "Work", "several")]
    traces = frame(spark, [("orders.OrderWorkflow",), ("other.Charge",), ("ghost",)], "workflow string")
    assert sorted((r.workflow, r.other) for r in names.of_function(traces, workflows, "OrderWorkflow").collect()) == [("ghost", False), ("orders.OrderWorkflow", False), ("other.Charge", True)]
    for name in ("Work", "nothing"):
        with pytest.raises(ValueError, match="of the workflows"):
            names.of_function(traces, workflows, name)
    for module, n in (("example.com/a", 1), ("a", 1), ("/src/o", 2), ("src/o", 2), ("./o", 2), ("rc/o", 0)):
        assert names.of_module(workflows, module).count() == n, module
