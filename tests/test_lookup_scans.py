from trailweave.plans import queries


def test_lookups_of_converted_runs_read_lines_once(spark):
    """The lookups come from one written table of exits: their plan reads no lines again."""
    _, of = queries._helper_runs(spark, "/root/testdata/sf0.001")
    assert of.count() == 5 and not any("lineitem" in f for f in of.inputFiles())
