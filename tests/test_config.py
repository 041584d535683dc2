"""Configuration files: what is refused and what tables they make."""

import json

import pytest

from trailweave.operators import compare, entries
from trailweave.sources import config

GOOD = {
    "workflows": {"include": ["a", "b"], "exclude": [{"name": "b", "reason": "old"}]},
    "failUnder": 75,
    "classification": {
        "enabled": True,
        "rules": [{"id": "r1", "workflow": "a", "label": "rule", "when": ["if x --true"], "without": ["if y --false"], "reason": "never both"}],
        "paths": {"mark_untestable": [{"workflow": "a", "stable_id": "s1:1", "label": "dead", "reason": "x"}], "mark_testable": [{"workflow": "a", "stable_id": "s1:2", "reason": "y"}]},
        "detectors": {"disable": [{"name": "contradictory", "reason": "noise"}]},
        "ci": {"capped_basis": "branch", "main_floor": 50.5},
    },
}


def test_tables_of_a_file(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_bytes(b"\xef\xbb\xbf" + json.dumps(GOOD).encode())
    t = config.tables(spark, config.read_config(str(file)))
    assert sorted(tuple(r) for r in t["overrides"].collect()) == [("a", "s1:1", "dead", "x", "cannot-be-tested"), ("a", "s1:2", "testable", "y", "testable")]
    status = compare.scope(spark.createDataFrame([("a",), ("b",), ("c",)], "workflow string"), t["include"], t["exclude"])
    assert {r.workflow: (r.status, r.reason) for r in status.collect()} == {"a": ("in scope", ""), "b": ("excluded", "old"), "c": ("not included", "")}
    d = spark.createDataFrame([("a", "if x", "true", "J1.true"), ("a", "if y", "false", "J2.false")], "workflow string, decision string, label string, edge_id string")
    rule = entries.checked_rules(entries.resolved(t["entries"], d)).first()
    assert rule.when == [["J1.true"]] and rule.without == [["J2.false"]] and rule.problems == []
    assert [r.name for r in t["off"].collect()] == ["contradictory"] and t["explained"].isEmpty() and t["force"].isEmpty()


def test_an_empty_file_takes_the_defaults(spark):
    t = config.tables(spark, config.parsed(b"{}"))
    assert t["include"] is None and all(t[n].isEmpty() for n in t if n != "include")


@pytest.mark.parametrize(
    "data, why",
    [
        (b'{"packges": []}', 'did you mean "packages"'),
        (b'{"classification": {"rule": []}}', 'unknown key "rule" in classification; did you mean "rules"'),
        (b'{"workflows": {"include": []}}', "workflows.include"),
        (b'{"workflows": {"exclude": [{"name": "a"}]}}', 'needs a "reason"'),
        (b'{"workflows": {"exclude": [{"name": " ", "reason": "x"}]}}', 'needs a "name"'),
        (b'{"workflows": {"exclude": ["a"]}}', "must be an object"),
        (b'{"workflows": {"exclude": {}}}', "must be a list|needs"),
        (b'{"failUnder": 101}', "from 0 to 100"),
        (b'{"failUnder": true}', "from 0 to 100"),
        (b'{"classification": {"ci": {"capped_basis": "path"}}}', "stage or branch"),
        (b'{"a": 1, "a": 2}', "twice"),
        (b"{} x", "not JSON"),
        (b"[]", "must be an object"),
        ("{}".encode("utf-16"), "UTF-16"),
    ],
)
def test_refused(data, why):
    with pytest.raises(config.ConfigError, match=why):
        config.parsed(data)
