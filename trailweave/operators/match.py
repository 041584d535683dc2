"""Matching runs to maps: one fold over a run's steps in Spark's own higher-order functions.

A place on a map is J:<junction>, J:<junction>!<only exit>, R:<retry edge>, E:<end> or D. A step is legal if the
map has a transition from the run's place by it. When a loop is iterated again, everything since its kept
iteration is dropped, nested loops too, so the last trip stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.sources.tables import START

#: Exits of all maps up to which maps are sent to all executors.
MOST_EXITS = 200_000


def place(to_kind: Column, to_id: Column, only: Column) -> Column:
    junction = F.concat(F.lit("J:"), to_id, F.coalesce(F.concat(F.lit("!"), only), F.lit("")))
    return F.when(to_kind == "junction", junction).when(to_kind == "retry", F.concat(F.lit("R:"), to_id)).when(to_kind == "end", F.concat(F.lit("E:"), to_id)).otherwise("D")


def transitions(exits: DataFrame) -> DataFrame:
    """workflow, at, edge_id, next, loops (whether the step iterates a loop)."""
    to = exits.withColumn("next", place(F.col("to_kind"), F.col("to_id"), F.col("only_edge")))
    places = to.select("workflow", F.col("next").alias("at"), "to_kind", "to_id", F.col("only_edge").alias("only")).distinct()
    chosen = to.where(F.col("edge_id") != START).select("workflow", "edge_id", "junction_id", "is_retry", "next", ((F.col("kind") == "loop") & (F.col("label") == "iterate")).alias("loops"))
    at_junction = places.where("to_kind = 'junction'").withColumnRenamed("to_id", "junction_id").join(chosen.where("not is_retry"), ["workflow", "junction_id"]).where("only is null or only = edge_id")
    at_retry = places.where("to_kind = 'retry'").withColumnRenamed("to_id", "edge_id").join(chosen, ["workflow", "edge_id"])
    columns = ["workflow", "at", "edge_id", "next", "loops"]
    return at_junction.select(*columns).union(at_retry.select(*columns))


def maps(exits: DataFrame) -> DataFrame:
    """One row a workflow: start, its place; moves, a map from place|edge to the next place; loops, its iterating edges; edges, all its edges."""
    moves = transitions(exits).groupBy("workflow").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "at", "edge_id"), "next"))).alias("moves"), F.array_distinct(F.collect_list(F.when(F.col("loops"), F.col("edge_id")))).alias("loops")
    )
    start = exits.where(F.col("edge_id") == START).select("workflow", place(F.col("to_kind"), F.col("to_id"), F.col("only_edge")).alias("start"))
    known = exits.where(F.col("edge_id") != START).groupBy("workflow").agg(F.collect_set("edge_id").alias("edges"))
    return start.join(moves, "workflow", "left").join(known, "workflow", "left")


def small_maps(exits: DataFrame, most: int = MOST_EXITS) -> DataFrame:
    """maps(exits), sent to all executors if there are at most `most` exits, so that runs needn't be shuffled; else Spark chooses the join."""
    return F.broadcast(maps(exits)) if exits.limit(most + 1).count() <= most else maps(exits)


def unmarked(steps: Column, units: tuple[str, ...] = ()) -> Column:
    """struct(steps, unit_hits, bad) of a recorded run: its enter and leave markers (>S1, <S1) taken out.

    bad is true where they don't nest. Steps inside a unit only mark the unit's branches.
    """
    zero = F.struct(F.array().cast("array<string>").alias("steps"), F.array().cast("array<string>").alias("unit_hits"), F.array().cast("array<string>").alias("stack"), F.lit(False).alias("bad"))

    def step(a: Column, s: Column) -> Column:
        top = F.element_at(a["stack"], -1)
        inside = (F.size(a["stack"]) > 0) & top.isin(*units) if units else F.lit(False)
        enters, leaves = s.startswith(">") & (F.length(s) > 1), s.startswith("<") & (F.length(s) > 1)
        fits = (F.size(a["stack"]) > 0) & (top == F.substring(s, 2, 1 << 30))
        plain = ~enters & ~leaves
        return F.struct(
            F.when(plain & ~inside, F.concat(a["steps"], F.array(s))).otherwise(a["steps"]).alias("steps"), F.when(plain & inside, F.concat(a["unit_hits"], F.array(s))).otherwise(a["unit_hits"]).alias("unit_hits"),
            F.when(enters, F.concat(a["stack"], F.array(F.substring(s, 2, 1 << 30)))).when(leaves & fits, F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1)).otherwise(a["stack"]).alias("stack"),
            (a["bad"] | (leaves & ~F.coalesce(fits, F.lit(False)))).alias("bad"),
        )

    return F.aggregate(steps, zero, step, lambda a: F.struct(a["steps"].alias("steps"), a["unit_hits"].alias("unit_hits"), (a["bad"] | (F.size(a["stack"]) > 0)).alias("bad")))


def matched(traces: DataFrame, exits: DataFrame) -> DataFrame:
    """traces with known (has a map), matched, path (folded steps, or what was followed), end, bad_step (0: it stopped early), at (the place it came to).

    bad_step is null for a run that matched.
    """
    zero = F.struct(F.col("_m.start").alias("at"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("bad"), F.lit(0).alias("i"))

    def step(a: Column, s: Column) -> Column:
        next_ = F.try_element_at(F.col("_m.moves"), F.concat_ws("|", a["at"], s))
        kept = F.array_position(a["path"], s)
        again = F.array_contains(F.col("_m.loops"), s) & (kept > 0)
        path = F.concat(F.when(again, F.slice(a["path"], F.lit(1), (kept - 1).cast("int"))).otherwise(a["path"]), F.array(s))
        legal = (a["bad"] == 0) & next_.isNotNull()
        return F.struct(F.when(legal, next_).otherwise(a["at"]).alias("at"), F.when(legal, path).otherwise(a["path"]).alias("path"), F.when(a["bad"] > 0, a["bad"]).when(legal, 0).otherwise(a["i"] + 1).alias("bad"), (a["i"] + 1).alias("i"))

    walked = traces.join(small_maps(exits).alias("_m"), "workflow", "left").withColumn("_w", F.when(F.col("_m.start").isNotNull(), F.aggregate("steps", zero, step)))
    ended = (F.col("_w.bad") == 0) & F.col("_w.at").startswith("E:")
    return walked.select(
        *[traces[c] for c in traces.columns if c != "workflow"], F.col("workflow"), F.col("_w").isNotNull().alias("known"), F.coalesce(ended, F.lit(False)).alias("matched"), F.col("_w.path").alias("path"),
        F.when(ended, F.substring(F.col("_w.at"), 3, 1 << 30)).alias("end"), F.when(~ended, F.col("_w.bad")).alias("bad_step"), F.col("_w.at").alias("at"),
    )


def triaged(matches: DataFrame, hashes: DataFrame | None = None, allow_stale: bool = False) -> DataFrame:
    """matches with kind: unreadable, excluded, other, unknown, incomplete, stale, unmatched or counted; the first that holds.

    Reads, where they are there, reading, excluded and other (booleans), status, function_hash, package, and what convert.prepared
    adds: runs that it converted are not stale, those with bad markers are unmatched. hashes: workflow, function_hash of the
    maps, and perhaps package: a run of another package's workflow of that name is unknown.
    """
    has = set(matches.columns)
    kind = F.when(F.col("reading") != "ok", "unreadable") if "reading" in has else F.when(F.lit(False), "")
    if "excluded" in has:
        kind = kind.when(F.col("excluded"), "excluded")
    if "other" in has:
        kind = kind.when(F.col("other"), "other")
    kind = kind.when(~F.col("known"), "unknown")
    if hashes is not None:
        now = [F.col("function_hash").alias("_hash"), *([F.col("package").alias("_package")] if "package" in hashes.columns else [])]
        matches = matches.join(hashes.select("workflow", *now), "workflow", "left")
        if "package" in has and "package" in hashes.columns:
            named = (F.col("package") != "") & (F.col("_package") != "") & (F.col("package") != F.col("_package"))
            kind = kind.when(F.coalesce(named, F.lit(False)), "unknown")
    if "status" in has:
        kind = kind.when(F.col("status") != "complete", "incomplete")
    if hashes is not None and not allow_stale:
        old = ~F.col("function_hash").eqNullSafe(F.col("_hash"))
        kind = kind.when(old & ~F.col("converted") if "converted" in has else old, "stale")
    if "bad_markers" in has:
        kind = kind.when(F.col("bad_markers"), "unmatched")
    return matches.withColumn("kind", kind.when(~F.col("matched"), "unmatched").otherwise("counted")).drop("_hash", "_package")


def mismatch_cause(exits: DataFrame, matches: DataFrame) -> DataFrame:
    """For runs that fit no path: the step that failed, and a likely cause from where the run was."""
    unfit = matches.where(~F.col("matched") & F.col("known")).join(maps(exits).select("workflow", "edges"), "workflow")
    step = F.try_element_at(F.col("steps"), F.when(F.col("bad_step") > 0, F.col("bad_step")).cast("int"))
    cause = (
        F.when(F.col("bad_step") == 0, "stopped before an end").when(F.col("at").startswith("E:"), "went on after an end").when(F.col("at") == "D", "went on after a panic")
        .when(~F.array_contains("edges", step), "not an exit of this map").when(F.col("at").startswith("R:"), "left out the way round a loop").when(F.col("at").contains("!"), "took an exit that was already decided").otherwise("left out or repeated a decision")
    )
    return unfit.select("workflow", "run_id", "bad_step", step.alias("step"), "at", cause.alias("cause"))
