import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from trailweave.operators import coverage, match, paths
from trailweave.plans import pilot
from trailweave.sources import sinks, tables
from trailweave.streaming import live


def test_snapshot_and_reports(spark, tmp_path):
    e = pilot.pilot_exits(spark)
    r = coverage.path_results(paths.listed(e), match.matched(pilot.pilot_traces(spark), e)).withColumn("bucket", F.lit("testable")).cache()
    sinks.write_snapshot(r, str(tmp_path / "base"))
    assert sinks.read_snapshot(spark, str(tmp_path / "base")).count() == 38
    got = json.loads(sinks.json_report(r).where("workflow = 'orders.OrderWorkflow'").first().value)
    assert got["paths"] == {"total": 3, "covered": 3} and [p["id"] for p in got["pathList"]] == ["40dbc77a36", "b64b1d5b2f", "8b4a38cb9f"]
    numbers = spark.createDataFrame([("a<b", "path", 50.0, True, False), ("c", "path", 0.0, False, False)], "workflow string, kind string, percent double, measured boolean, met boolean")
    assert sorted(x.value for x in sinks.junit(numbers).collect()) == ['<testcase name="a&lt;b"><failure message="path coverage 50.0%, target 80%"/></testcase>', '<testcase name="c"><skipped/></testcase>']
    lines = spark.createDataFrame([("f", 3, True), ("f", 3, False)], "file string, line int, taken boolean")
    assert sinks.cobertura(lines).first().value == '<line number="3" hits="1" branch="true" condition-coverage="50% (1/2)"/>'
    assert "J1 -->|true| End_completed" in sinks.mermaid(e).where("workflow = 'orders.OrderWorkflow'").first().value


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one = {"schemaVersion": 2, "workflow": "orders.OrderWorkflow", "status": "complete", "recordedAt": "2024-01-01T00:00:00Z"}
    (folder / "a.trace.json").write_text(json.dumps(one | {"runId": "1", "steps": ["J1.true"]}))
    (folder / "b.trace.json").write_text(json.dumps(one | {"runId": "2", "steps": ["J1.false", "J2.success"]}))
    (folder / "c.trace.json").write_text(json.dumps(one | {"runId": "3", "steps": ["J2.success"]}))
    rows = live.live_exits(live.read_stream(spark, str(folder)), pilot.pilot_exits(spark))
    q = live.started(rows, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.edge_id: r.taken for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"J1.true": 1, "J1.false": 1, "J2.success": 1}


def test_history_keeps_the_last_runs_and_starts_afresh_when_damaged(spark, tmp_path):
    folder = str(tmp_path / "history")
    assert sinks.read_history(spark, folder)[1].startswith("no history")
    for day in range(1, 8):
        run = spark.sql(f"select 'p' as project, timestamp'2024-01-0{day} 00:00:00' as time, {day}L as covered, 10L as paths, 's' as scope")
        got = sinks.append_history(spark, folder, run)
    rows = sorted((r.covered, r.change) for r in got.collect())
    assert rows == [(3, None), (4, 1), (5, 1), (6, 1), (7, 1)] and sinks.read_history(spark, folder)[0].count() == 5
    bad = spark.sql("select 'p' as project, timestamp'2024-02-01 00:00:00' as time, 11L as covered, 10L as paths, 's' as scope")
    bad.write.parquet(folder + "/state-000000099")
    runs, warning = sinks.read_history(spark, folder)
    assert runs.isEmpty() and "damaged" in warning
    assert sinks.append_history(spark, folder, run).count() == 1
    spark.range(1).write.parquet(folder + "/state-000000999")
    assert "damaged" in sinks.read_history(spark, folder)[1]


def test_documents(spark):
    numbers = spark.createDataFrame([("b", "path", 50.0, True, False), ("a<", "path", 0.0, False, False), ("c", "path", 90.0, True, True)], "workflow string, kind string, percent double, measured boolean, met boolean")
    suite = ElementTree.fromstring(sinks.junit_document(numbers).first().value.encode())[0]
    assert suite.attrib == {"name": "coverage", "tests": "3", "failures": "1", "skipped": "1"} and [c.attrib["name"] for c in suite] == ["a<", "b", "c"]
    lines = spark.createDataFrame([("f", 12, True), ("f", 3, True), ("f", 3, False), ("e", 1, False)], "file string, line int, taken boolean")
    root = ElementTree.fromstring(sinks.cobertura_document(lines).first().value.encode())
    assert root.attrib == {"branches-valid": "4", "branches-covered": "2", "branch-rate": "0.5000"}
    assert [(c.attrib["name"], [x.attrib["number"] for x in c[0]]) for c in root.iter("class")] == [("e", ["1"]), ("f", ["3", "12"])]
    assert ElementTree.fromstring(sinks.cobertura_document(lines.limit(0)).first().value.encode()).attrib["branch-rate"] == "0.0000"
    missed = spark.createDataFrame([(2, "w", "two", "f", 1), (1, "w", 'o"ne', "f", 9), (10, "w", "ten", "f", 2)], "rank int, workflow string, name string, file string, line int")
    unread = spark.createDataFrame([("w", "dark", "g", 4)], "workflow string, name string, file string, line int")
    log = json.loads(sinks.sarif_document(missed, unread).first().value)
    assert [(r["level"], r["message"]["text"]) for r in log["runs"][0]["results"]] == [("warning", 'o"ne'), ("warning", "two"), ("warning", "ten"), ("note", "dark")]
    assert json.loads(sinks.sarif_document(missed.limit(0)).first().value)["runs"][0]["results"] == []


def test_snapshots_of_others_and_folders_without_runs(spark, tmp_path):
    rows = spark.sql("select 'w' as workflow, 'p' as path_id, 'testable' as bucket, true as covered")
    sinks.write_snapshot(rows, str(tmp_path / "a"))
    assert sinks.read_snapshot(spark, str(tmp_path / "a")).count() == 1
    spark.read.parquet(str(tmp_path / "a")).withColumn("version", F.lit(9)).write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="of this version"):
        sinks.read_snapshot(spark, str(tmp_path / "b"))
    none = tables.read_traces(spark, str(tmp_path / "nowhere"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.trace.json").write_text("{")
    some = tables.read_traces(spark, str(tmp_path / "in"))
    assert none.isEmpty() and some.first().reading == "unreadable" and set(none.columns) == set(some.columns)
