"""What a map alone says: its paths and its pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.ids import path_id, path_key
from trailweave.operators import roads
from trailweave.operators.alike import alike, for_all
from trailweave.operators.graphs import first_paths
from trailweave.operators.match import transitions
from trailweave.sources.rounds import kept

CAP = 2000


def _named(ways: DataFrame) -> DataFrame:
    steps, end = F.col("steps"), F.expr("substring(place, 3)")
    return ways.select("workflow", "number", "steps", end.alias("end"), path_id(steps, end).alias("path_id"), path_key(steps, end).alias("path_key"), "truncated")


def listed(exits: DataFrame, cap: int = CAP) -> DataFrame:
    """workflow, number, steps, end, path_id, path_key, truncated: each workflow's first `cap` paths in the order of exits.

    A map is bounded by its code and its list by the cap, so a map is a group; all maps of a project are one job.
    """
    steps, end = F.col("steps"), F.col("end")
    return first_paths(exits, cap).select("workflow", "number", "steps", "end", path_id(steps, end).alias("path_id"), path_key(steps, end).alias("path_key"), "truncated")


def pruned(exits: DataFrame, facts: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The paths of listed but for those that facts show impossible, and the groups of these.

    facts: workflow, edge_id, name, value: what taking an exit shows, such as a condition's truth. Where an exit contradicts
    what a path has shown before, nothing behind it is listed. Groups: workflow, prefix (up to that exit), name (what it
    contradicts), paths (how many it leaves out, a whole number as text). So the list fills with paths that can be taken;
    groups that stand behind its end are not told.
    """
    names, (exits, facts) = alike(exits, facts)
    moves = kept(roads.moves(exits))
    ways, groups = roads.listing(moves, cap, facts=facts)
    below = roads.ways(moves).select("workflow", "place", roads.as_text(F.col("limbs")).alias("paths"))
    groups = groups.join(below, ["workflow", "place"]).select("workflow", "prefix", "name", "paths")
    return for_all(_named(ways), names), for_all(groups, names)


def legal_pairs(exits: DataFrame) -> DataFrame:
    """workflow, first, second: each exit with each exit that may come next; the way round a loop leads to its exit."""
    to = transitions(exits)
    retry = exits.where("is_retry").select("workflow", F.col("edge_id").alias("retry"))
    direct = to.alias("a").join(to.alias("b"), (F.col("a.workflow") == F.col("b.workflow")) & (F.col("a.next") == F.col("b.at"))).select("a.workflow", F.col("a.edge_id").alias("first"), F.col("b.edge_id").alias("second"))
    plain = direct.join(retry, (direct.workflow == retry.workflow) & (direct.second == retry.retry), "left_anti").join(retry, (direct.workflow == retry.workflow) & (direct["first"] == retry.retry), "left_anti")
    # over a retry: from the step before it to the loop's exit
    over = direct.alias("d").join(retry.alias("r"), (F.col("d.workflow") == F.col("r.workflow")) & (F.col("d.second") == F.col("r.retry"))).join(direct.alias("n"), (F.col("n.workflow") == F.col("d.workflow")) & (F.col("n.first") == F.col("r.retry")))
    leave = exits.where("kind = 'loop' and label = 'exit'").select("workflow", F.col("edge_id").alias("second"))
    over = over.select("d.workflow", "d.first", "n.second").join(leave, ["workflow", "second"], "left_semi").select("workflow", "first", "second")
    return plain.unionByName(over).distinct()


def pairs_of(paths: DataFrame, exits: DataFrame) -> DataFrame:
    """Every column of paths but steps, with first, second: neighbouring steps of each path, ways round loops left out."""
    retries = exits.groupBy("workflow").agg(F.collect_set(F.when(F.col("is_retry"), F.col("edge_id"))).alias("_retries"))
    kept = paths.join(retries, "workflow").withColumn("steps", F.array_except("steps", "_retries"))
    n = F.size("steps")
    both = F.when(n > 1, F.arrays_zip(F.slice("steps", F.lit(1), n - 1).alias("first"), F.slice("steps", F.lit(2), n - 1).alias("second")))
    return kept.withColumn("_p", F.explode(both)).select(*[c for c in paths.columns if c != "steps"], "_p.first", "_p.second")
