"""Small maps are walked where they lie, large ones worked on by rounds of joins: both give the same; alike maps are worked on once."""

import pytest
from pyspark.sql import functions as F

from tests.test_stages import random_maps, rows
from trailweave.operators import alike, roads, stages
from trailweave.sources import held
from trailweave.sources.tables import exits


def answers(e, pruned_by):
    found = stages.stages(e, 4)
    listed, groups = roads.listing(roads.moves(e), 5, facts=pruned_by)
    of = {
        "counts": roads.path_counts(e), "reach": roads.reachable(e), "gates": stages.gates(e), "moves": roads.moves(e), "roads": stages.roads(e),
        "stages": found, "ways": stages.stage_paths(e, found, 4), "members": stages.members(e, found), "listed": listed, "groups": groups,
    }
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name, df in of.items()}


def test_walks_equal_rounds_of_joins(spark, monkeypatch):
    e = exits(spark, rows(random_maps(5, 5)))
    shows = e.where("label in ('true', 'false') and not is_retry").select("workflow", "edge_id", F.lit("x").alias("name"), F.col("label").alias("value"))
    walked = answers(e, shows)
    monkeypatch.setattr(held, "MOST_ROWS", 0)
    in_rounds = answers(e, shows)
    assert walked["groups"] and walked["listed"]
    for name in walked:
        assert walked[name] == in_rounds[name], name


@pytest.mark.parametrize("name", ["path_counts", "reachable", "gates", "stages"])
def test_small_maps_take_no_rounds(spark, name):
    """The jobs of a map of 60 decisions: each round of doubling took several, seven rounds in all."""
    e = exits(spark, rows({f"w{k}": {f"J{i}": ("if", {"a": f"J{i + 1}" if i < 60 else "=completed", "b": "=failed"}) for i in range(1, 61)} for k in range(3)}))
    spark.sparkContext.setJobGroup(f"jobs-{name}", name)
    try:
        getattr(roads if hasattr(roads, name) and name != "stages" else stages, name)(e).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs-{name}")) <= 10


def test_alike_maps_are_worked_on_once(spark):
    one = {"J1": ("if", {"a": "J2", "b": "=failed"}), "J2": ("if", {"a": "=completed"})}
    other = {"J1": ("if", {"a": "J2", "b": "=failed"}), "J2": ("if", {"b": "=completed"})}
    e = exits(spark, rows({"c": one, "a": one, "b": other, "d": one}))
    said = spark.createDataFrame([("a", "J1.a", ["x"]), ("c", "J1.a", ["x"]), ("d", "J1.a", None), ("gone", "J1.a", ["x"])], "workflow string, edge_id string, steps array<string>")
    names, (maps, of) = alike.alike(e, said)
    assert {r.workflow: r.like for r in names.collect()} == {"a": "a", "c": "a", "b": "b", "d": "d"}
    assert {r.workflow for r in maps.collect()} == {"a", "b", "d"} and {r.workflow for r in of.collect()} == {"a", "d"}
    assert sorted(tuple(r) for r in alike.for_all(roads.path_counts(maps), names).collect()) == [("a", "2"), ("b", "2"), ("c", "2"), ("d", "2")]
    # texts that only run together alike, and lists cut elsewhere, are others
    rows_ = spark.createDataFrame([("p", "ab", "c", ["x"], ["y"]), ("q", "a", "bc", ["x"], ["y"]), ("r", "ab", "c", ["x", "y"], []), ("s", None, "ab", ["x"], ["y"]), ("t", "ab", None, ["x"], ["y"])], "workflow string, u string, v string, l array<string>, m array<string>")
    assert all(r.workflow == r.like for r in alike.alike(rows_)[0].collect())
