"""Scenarios of maps too large to list: the different sequences of external steps, from an automaton over all maps at once.

A place of a map is a state, an exit with n external steps n arcs in a row, one without a silent arc. Paths that look the
same from outside are one word of this automaton, so it is made deterministic: a state is then the sorted set of all places
that one beginning of a word may have led to, named by its hash. In a round each new set is followed by each of its steps,
for all maps (one of those that are alike); sets that are known already are left out. The result is a table of moves like that of a map, so words are
counted and listed as paths are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators.alike import alike, for_all
from trailweave.operators.roads import as_text, listing, moves, rounds_for, ways
from trailweave.sources.rounds import kept

#: States of a map's automaton beyond which its scenarios are not measured, and words that are listed (fixed values).
MOST_STATES, MOST_LISTED = 100_000, 500


def arcs(exits: DataFrame, external: DataFrame) -> DataFrame:
    """workflow, a, step (null: silent), b. external: workflow, edge_id, steps, zero (what a loop's exit adds if the loop was
    not iterated, that is, if it is not taken behind a retry)."""
    said = external.select("workflow", "edge_id", F.col("steps").alias("_steps"), F.col("zero").alias("_zero"))
    rows = moves(exits).join(said, ["workflow", "edge_id"], "left")
    none = F.array().cast("array<string>")
    own, zero = F.coalesce("_steps", none), F.coalesce("_zero", none)
    rows = rows.withColumn("_say", F.when(F.col("at").contains("!"), own).otherwise(F.concat(own, zero))).withColumn("_n", F.size("_say"))
    between = lambda k: F.concat(F.lit("M:"), "at", F.lit("|"), "edge_id", F.lit("|"), k.cast("string"))
    at = lambda k: F.when(k == 0, F.col("at")).when(k >= F.col("_n"), F.col("next")).otherwise(between(k))
    silent = rows.where("_n = 0").select("workflow", F.col("at").alias("a"), F.lit(None).cast("string").alias("step"), F.col("next").alias("b"))
    spoken = rows.where("_n > 0").select("*", F.posexplode("_say").alias("_k", "step"))
    return silent.unionByName(spoken.select("workflow", at(F.col("_k")).alias("a"), "step", at(F.col("_k") + 1).alias("b")))


def _closure(silent: DataFrame, states: DataFrame) -> DataFrame:
    """workflow, a, b: what each state comes to without a step, itself too; by doubling."""
    own = states.select("workflow", F.col("a"), F.col("a").alias("b"))
    found = kept(own.union(silent.select("workflow", "a", "b")).distinct())
    rounds, before = rounds_for(silent, ["workflow"]), 0
    for _ in range(rounds):
        ahead = found.select("workflow", F.col("a").alias("b"), F.col("b").alias("_c"))
        found = kept(found.join(ahead, ["workflow", "b"]).select("workflow", "a", F.col("_c").alias("b")).distinct())
        if (now := found.count()) == before:
            break
        before = now
    return found


def automaton(exits: DataFrame, external: DataFrame, most_states: int = MOST_STATES) -> tuple[DataFrame, DataFrame]:
    """(moves of the deterministic automaton: workflow, at, edge_id (the step), ord, next; workflows that have too many states)."""
    all_arcs = kept(arcs(exits, external))
    states = all_arcs.select("workflow", "a").union(all_arcs.select("workflow", "b")).distinct()
    closure = _closure(all_arcs.where("step is null"), states)
    spoken = kept(all_arcs.where("step is not null"))

    def named(members: Column) -> Column:
        return F.sha2(F.array_join(members, "\n"), 256)

    first = states.where("a = ''").join(closure, ["workflow", "a"]).groupBy("workflow").agg(F.array_sort(F.collect_set("b")).alias("members"))
    new = kept(first.select("workflow", named(F.col("members")).alias("at"), "members"))
    starts = new.select("workflow", F.lit("").alias("at"), F.lit("").alias("edge_id"), F.col("at").alias("next"))
    seen, found, large = [new], [starts], []
    while not new.isEmpty():
        step = new.select("workflow", "at", F.explode("members").alias("a")).join(spoken, ["workflow", "a"])
        step = step.select("workflow", "at", "step", F.col("b").alias("a")).distinct().join(closure, ["workflow", "a"])
        step = step.groupBy("workflow", "at", "step").agg(F.array_sort(F.collect_set("b")).alias("members"))
        step = kept(step.withColumn("next", named(F.col("members"))))
        found.append(step.select("workflow", "at", F.col("step").alias("edge_id"), "next"))
        known = reduce(DataFrame.unionByName, [x.select("workflow", "at") for x in seen])
        ahead = step.select("workflow", F.col("next").alias("at"), "members").dropDuplicates(["workflow", "at"]).join(known, ["workflow", "at"], "left_anti")
        counts = known.union(ahead.select("workflow", "at")).groupBy("workflow").agg(F.count(F.lit(1)).alias("_n"))
        over = kept(counts.where(F.col("_n") > most_states).select("workflow"))
        large.append(over)
        new = kept(ahead.join(over, "workflow", "left_anti"))
        seen.append(new)
    ends = reduce(DataFrame.unionByName, seen).select("workflow", "at", F.explode("members").alias("next")).where("next like 'E:%'").distinct()
    found.append(ends.select("workflow", "at", F.concat(F.lit("end: "), F.expr("substring(next, 3)")).alias("edge_id"), "next"))
    steps = reduce(DataFrame.unionByName, found).withColumn("ord", F.lit(0))
    none = exits.select("workflow").where("false")
    return kept(steps), reduce(DataFrame.union, large, none).distinct()


def scenario_counts(exits: DataFrame, external: DataFrame, most_states: int = MOST_STATES) -> DataFrame:
    """workflow, scenarios (a whole number as text; null if there are too many states to tell)."""
    names, (exits, external) = alike(exits, external)
    steps, large = automaton(exits, external, most_states)
    counted = ways(steps).where("place = ''").select("workflow", as_text(F.col("limbs")).alias("scenarios"))
    rows = exits.select("workflow").distinct().join(counted, "workflow", "left").join(large.withColumn("_large", F.lit(True)), "workflow", "left")
    return for_all(rows.select("workflow", F.when(F.col("_large").isNull(), F.coalesce("scenarios", F.lit("0"))).alias("scenarios")), names)


def scenario_words(exits: DataFrame, external: DataFrame, most: int = MOST_LISTED, most_states: int = MOST_STATES) -> DataFrame:
    """workflow, number, steps (the last is the end), truncated: the first scenarios of each map in the order of their steps."""
    names, (exits, external) = alike(exits, external)
    steps, large = automaton(exits, external, most_states)
    steps = steps.join(large, "workflow", "left_anti")
    # the order of steps is that of their texts; a step may come again, so each move has a name of its own
    order = steps.select("workflow", "edge_id").distinct()
    order = order.withColumn("ord", F.row_number().over(Window.partitionBy("workflow").orderBy("edge_id")))
    named = steps.drop("ord").join(order, ["workflow", "edge_id"]).withColumn("edge_id", F.concat("at", F.lit("\n"), "edge_id"))
    words, _ = listing(named, most)
    said = F.transform("steps", lambda s: F.substring_index(s, "\n", -1))
    return for_all(words.select("workflow", "number", said.alias("steps"), "truncated"), names)
