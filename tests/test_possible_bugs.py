"""possible_bugs judges paths by every source of verdicts, not by the analysis of values alone."""

from trailweave.plans import oracles, queries


def test_possible_bugs_are_those_of_every_source(spark):
    sf_dir = "/root/testdata/sf0.001"
    settled = [r for r in queries._every_source(spark, sf_dir).collect() if r.label == "likely-defect"]
    want = {}
    for r in settled:
        place = r.steps[0] if r.steps else ""
        n, least = want.get((r.workflow, place), (0, r.path_id))
        want[r.workflow, place] = (n + 1, min(least, r.path_id))
    got = {(r.workflow, r.place): (r.paths, r.example) for r in queries.QUERIES["possible_bugs"](spark, sf_dir).collect()}
    assert got == want
    assert "settled where label = 'likely-defect'" in oracles.ORACLES["possible_bugs"]
