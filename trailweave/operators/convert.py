"""Runs recorded before helpers were summarised, read as runs of the map that has them as units; unit hits; triage of both.

A map that copies its helpers in gives each copy a site: a run marks where it enters and leaves one (>S1, <S1). The map that
summarises them has one unit a helper body instead. A step of the old map is found again by the statement and the label
that it stems from: in the workflow's own decisions, or in those of the unit that the innermost open site became. A run with
a step that has no counterpart is not converted, and stays stale.

Lookups are a row a workflow; each run is converted by a fold within its row, without a shuffle of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.match import MOST_EXITS

TEXTS = "array<string>"
REST = 1 << 30


def _as_map(rows: DataFrame, name: str) -> DataFrame:
    """workflow, name: a map from the keys of rows (workflow, key, value) to values; of several values the least."""
    one = rows.where("key is not null and value is not null").groupBy("workflow", "key").agg(F.min("value").alias("value"))
    return one.groupBy("workflow").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(name))


def lookups(old_hashes: DataFrame, sites: DataFrame, old_exits: DataFrame, units: DataFrame, exits: DataFrame) -> DataFrame:
    """workflow, old_hash, unit_of (site to unit), own (exit to exit outside helpers), inner (unit|exit to exit), units, sites.

    old_hashes: workflow, old_hash; sites: workflow, site_id, body; units: workflow, unit_id, body, both of helpers' bodies.
    old_exits: workflow, edge_id, site_id, statement, label; exits: workflow, edge_id, unit_id, statement, label: site_id
    and unit_id are null for the workflow's own.
    """
    body = ["workflow", "body"]
    unit_of = sites.join(units, body).select("workflow", F.col("site_id").alias("key"), F.col("unit_id").alias("value"))
    stems = ["workflow", "statement", "label"]
    now = exits.select(*stems, "unit_id", F.col("edge_id").alias("value"))
    own = old_exits.where("site_id is null").join(now.where("unit_id is null"), stems).select("workflow", F.col("edge_id").alias("key"), "value")
    inner = old_exits.where("site_id is not null").join(now.where("unit_id is not null"), stems)
    inner = inner.select("workflow", F.concat_ws("|", "unit_id", "edge_id").alias("key"), "value")
    out = old_hashes.select("workflow", "old_hash")
    for part in (_as_map(unit_of, "unit_of"), _as_map(own, "own"), _as_map(inner, "inner")):
        out = out.join(part, "workflow", "left")
    return out.join(units.groupBy("workflow").agg(F.collect_set("unit_id").alias("units")), "workflow", "left")


def converted(steps: Column, of: Column) -> Column:
    """The steps of the present map, or null if one has no counterpart; of: a row of lookups as a struct."""
    zero = F.struct(F.array().cast(TEXTS).alias("out"), F.array().cast(TEXTS).alias("stack"), F.lit(True).alias("fits"))

    def step(a: Column, s: Column) -> Column:
        is_open = F.size(a["stack"]) > 0
        top = F.when(is_open, F.element_at(a["stack"], -1))
        enters, leaves = s.startswith(">") & (F.length(s) > 1), s.startswith("<") & (F.length(s) > 1)
        unit = F.try_element_at(of["unit_of"], F.substring(s, 2, REST))
        found = F.when(is_open, F.try_element_at(of["inner"], F.concat_ws("|", top, s))).otherwise(F.try_element_at(of["own"], s))
        to = F.when(enters, F.concat(F.lit(">"), unit)).when(leaves, F.concat(F.lit("<"), top)).otherwise(found)
        on = a["fits"] & to.isNotNull()
        stack = F.when(on & enters, F.concat(a["stack"], F.array(unit))).when(on & leaves, F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1))
        return F.struct(
            F.when(on, F.concat(a["out"], F.array(to))).otherwise(a["out"]).alias("out"), F.coalesce(stack, a["stack"]).alias("stack"), on.alias("fits"),
        )

    return F.aggregate(steps, zero, step, lambda a: F.when(a["fits"], a["out"]))


def without_markers(steps: Column, units: Column, known: Column | None = None) -> Column:
    """struct(steps, unit_hits, bad) of a run: its markers taken out, and the steps within a unit, which mark only its branches.

    bad is true where markers don't nest, or name a place that is not among known (units are).
    """
    no_texts = F.array().cast(TEXTS)
    units = F.coalesce(units, no_texts)
    zero = F.struct(no_texts.alias("steps"), no_texts.alias("unit_hits"), no_texts.alias("stack"), F.lit(False).alias("bad"))

    def step(a: Column, s: Column) -> Column:
        top = F.coalesce(F.when(F.size(a["stack"]) > 0, F.element_at(a["stack"], -1)), F.lit(""))
        enters, leaves = s.startswith(">") & (F.length(s) > 1), s.startswith("<") & (F.length(s) > 1)
        name = F.substring(s, 2, REST)
        there = F.lit(True) if known is None else F.array_contains(units, name) | F.coalesce(F.array_contains(known, name), F.lit(False))
        inside, plain = F.array_contains(units, top), ~enters & ~leaves
        wrong = (enters & ~there) | (leaves & (top != name))
        stack = F.when(enters, F.concat(a["stack"], F.array(name))).when(leaves & ~wrong, F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1)).otherwise(a["stack"])
        return F.struct(
            F.when(plain & ~inside, F.concat(a["steps"], F.array(s))).otherwise(a["steps"]).alias("steps"),
            F.when(plain & inside, F.concat(a["unit_hits"], F.array(s))).otherwise(a["unit_hits"]).alias("unit_hits"), stack.alias("stack"), (a["bad"] | wrong).alias("bad"),
        )

    done = lambda a: F.struct(a["steps"].alias("steps"), a["unit_hits"].alias("unit_hits"), (a["bad"] | (F.size(a["stack"]) > 0)).alias("bad"))
    return F.aggregate(steps, zero, step, done)


def prepared(traces: DataFrame, lookups_: DataFrame, sites: DataFrame | None = None, most: int = MOST_EXITS) -> DataFrame:
    """traces, as match.matched reads them: steps without markers; unit_hits, bad_markers; converted: recorded on the old map and read as the new.

    Lookups are sent to all executors if they are of at most `most` workflows. sites: workflow, site_id that the present
    map knows besides its units; any are let pass if it is left out. Runs with bad markers keep their steps, and hit no unit.
    """
    if sites is not None:
        lookups_ = lookups_.join(sites.groupBy("workflow").agg(F.collect_set("site_id").alias("sites")), "workflow", "left")
    of = lookups_.select("workflow", F.struct(*[c for c in lookups_.columns if c != "workflow"]).alias("_of"))
    of = F.broadcast(of) if of.limit(most + 1).count() <= most else of
    rows = traces.join(of, "workflow", "left")
    again = F.when(F.col("function_hash") == F.col("_of.old_hash"), converted(F.col("steps"), F.col("_of")))
    rows = rows.withColumn("_again", again).withColumn("_raw", F.coalesce("_again", "steps"))
    rows = rows.withColumn("_u", without_markers(F.col("_raw"), F.col("_of.units"), None if sites is None else F.col("_of.sites")))
    bad = F.coalesce(F.col("_u.bad"), F.lit(False))
    return rows.select(
        *[traces[c] for c in traces.columns if c != "steps"], F.when(bad, F.col("_raw")).otherwise(F.col("_u.steps")).alias("steps"),
        F.when(bad, F.array().cast(TEXTS)).otherwise(F.col("_u.unit_hits")).alias("unit_hits"), bad.alias("bad_markers"), F.col("_again").isNotNull().alias("converted"),
    )


def unit_branches(unit_exits: DataFrame, counted: DataFrame) -> DataFrame:
    """workflow, unit_id, branches, taken: how many exits of each unit (workflow, unit_id, edge_id) runs took; counted: workflow, unit_hits."""
    hits = counted.select("workflow", F.explode(F.array_distinct("unit_hits")).alias("edge_id")).distinct().withColumn("_hit", F.lit(True))
    rows = unit_exits.select("workflow", "unit_id", "edge_id").distinct().join(hits, ["workflow", "edge_id"], "left")
    return rows.groupBy("workflow", "unit_id").agg(F.count(F.lit(1)).alias("branches"), F.count_if("_hit").alias("taken"))
