"""Stages with too many ways, cut at the regions inside them.

In such a stage no decision is passed by all roads, but a decision may still dominate all that it reaches there: it opens a
region, which no road leaves for another part of the stage. What no region holds is the top, the first part; the regions
follow, and a region that is large itself is cut at its own gates, neighbours merged while they stay small. Parts that are
still too large are cut again, DEPTH times at most, or keep the reason why they can't be.

All large parts of all maps are cut in one round. A part is named by a list of numbers, whose order is that of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators import stages
from trailweave.operators.roads import as_text, listing, more_than, moves, ways
from trailweave.sources.rounds import kept

#: How often a part is cut again.
DEPTH = 4

SINGLE = "a single decision"
UNREACHED = "a part of it is not reached from its first decision"
NO_REGION = "no decision of it dominates what it reaches"
TOO_DEEP = "cut as often as allowed"

BY = ["workflow", "part"]


def _inside(moves_: DataFrame, members: DataFrame) -> DataFrame:
    """The moves within each part; one that leaves it leads to an end named > and the place."""
    own = moves_.join(members, ["workflow", "junction_id"])
    target = F.when(F.col("next").startswith("J:"), F.substring_index(F.expr("substring(next, 3)"), "!", 1))
    own = own.withColumn("_to", target)
    here = members.select(*BY, F.col("junction_id").alias("_to"), F.lit(True).alias("_here"))
    out = F.col("_to").isNotNull() & F.col("_here").isNull()
    return own.join(here, [*BY, "_to"], "left").withColumn("next", F.when(out, F.concat(F.lit("E:>"), "next")).otherwise(F.col("next"))).drop("_to", "_here")


def _counted(moves_: DataFrame, parts: DataFrame, members: DataFrame) -> DataFrame:
    """parts (workflow, part, entry) with limbs: their ways."""
    found = ways(kept(_inside(moves_, members)), tuple(BY)).withColumnRenamed("place", "_place")
    none = F.array(F.lit(0).cast("bigint"))
    return parts.withColumn("_place", F.concat(F.lit("J:"), "entry")).join(found, [*BY, "_place"], "left").withColumn("limbs", F.coalesce("limbs", none)).drop("_place")


def _whole_or_cut(regions: DataFrame, members: DataFrame, gates: DataFrame, doms: DataFrame, moves_: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Regions (workflow, part, entry, split_from, limbs) that are large, cut at their gates: the same columns, and members.

    gates: workflow, part, junction_id, number (from 0, the opener); doms: workflow, part, node, doms, of decisions of regions.
    """
    # a gate that the one before it doesn't dominate begins a new group: what is cut from there on is never reached from before
    before = Window.partitionBy(*BY).orderBy("number")
    chain = gates.join(doms.withColumnRenamed("node", "junction_id"), [*BY, "junction_id"]).withColumn("_before", F.lag("junction_id").over(before))
    breaks = F.col("_before").isNotNull() & ~F.coalesce(F.array_contains("doms", F.col("_before")), F.lit(False))
    cuts = chain.withColumn("group", F.sum(breaks.cast("int")).over(before)).select(*BY, F.concat(F.lit("J:"), "junction_id").alias("place"), "number", "group")
    runs = kept(stages._chain(kept(cuts), _inside(moves_, members), most, tuple(BY)))
    entry = gates.select(*BY, F.col("number").alias("first"), F.col("junction_id").alias("_entry"))
    cut = runs.join(entry, [*BY, "first"]).join(regions.select(*BY, "split_from"), BY)
    # a decision belongs to gate k if that dominates it and gate k + 1 doesn't
    over = members.join(doms.withColumnRenamed("node", "junction_id"), [*BY, "junction_id"]).select(*BY, "junction_id", F.explode("doms").alias("_dom"))
    over = over.join(gates.select(*BY, F.col("junction_id").alias("_dom"), "number"), [*BY, "_dom"]).groupBy(*BY, "junction_id").agg(F.collect_set("number").alias("_all"))
    own = over.select(*BY, "junction_id", F.explode(F.filter("_all", lambda k: ~F.array_contains("_all", k + 1))).alias("number"))
    held = own.join(runs.select(*BY, "first", "last"), BY).where("number between first and last")
    name = F.concat(F.slice("part", F.lit(1), F.size("part") - 1), F.array(F.col("first").cast("int")))
    cut = cut.select("workflow", name.alias("part"), F.col("_entry").alias("entry"), "split_from", "limbs")
    return cut, held.select("workflow", name.alias("part"), "junction_id").distinct()


def _cut_once(parts: DataFrame, members: DataFrame, roads_: DataFrame, moves_: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large parts (workflow, part, entry, split_from, limbs) cut: what they became, the decisions of that, and parts that stay, with why."""
    here = lambda name: members.select(*BY, F.col("junction_id").alias(name))
    inner = kept(roads_.join(here("u"), ["workflow", "u"]).join(here("w"), [*BY, "w"]))
    doms = stages.dominators(inner, parts.select(*BY, F.col("entry").alias("start")), tuple(BY))
    gates = kept(stages.gates_of(inner, doms, tuple(BY)).join(parts.select(*BY, F.col("entry").alias("_entry")), BY))
    inner_gates = gates.where("junction_id <> _entry").select(*BY, "junction_id")
    above = doms.join(inner_gates.withColumnRenamed("junction_id", "node"), [*BY, "node"], "left_semi").select(*BY, "node", "way", F.explode("doms").alias("junction_id"))
    above = above.join(inner_gates, [*BY, "junction_id"]).groupBy(*BY, "node").agg(F.count(F.lit(1)).alias("_n"), F.first("way").alias("way")).where("_n = 1")
    openers = kept(above.select(*BY, F.col("node").alias("opener"), F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("way"))).alias("k")))
    sizes = members.groupBy(*BY).agg(F.count(F.lit(1)).alias("_size")).join(doms.groupBy(*BY).agg(F.count(F.lit(1)).alias("_met")), BY, "left")
    sizes = sizes.join(openers.groupBy(*BY).agg(F.count(F.lit(1)).alias("_regions")), BY, "left")
    why = F.when(F.coalesce("_size", F.lit(0)) < 2, SINGLE).when(F.col("_met") < F.col("_size"), UNREACHED).when(F.col("_regions").isNull(), NO_REGION)
    judged = kept(parts.join(sizes, BY, "left").withColumn("why", why).drop("_size", "_met", "_regions"))
    stay, go = judged.where("why is not null"), judged.where("why is null").drop("why")
    # decisions to the top (0) or the region of the opener that dominates them
    dominated = doms.select(*BY, F.col("node").alias("junction_id"), F.explode("doms").alias("opener")).join(openers, [*BY, "opener"]).select(*BY, "junction_id", "k")
    split = members.join(go.select(*BY), BY, "left_semi").join(dominated, [*BY, "junction_id"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    named = lambda k: F.concat("part", F.array(k.cast("int"), F.lit(0)))
    new_members = kept(split.select("workflow", named(F.col("k")).alias("part"), "junction_id"))
    tops = go.select(*BY, "entry", F.lit(0).alias("k"), as_text(F.col("limbs")).alias("split_from"))
    below = go.join(openers, BY).select(*BY, F.col("opener").alias("entry"), "k", as_text(F.col("limbs")).alias("split_from"))
    fresh = tops.unionByName(below).select("workflow", named(F.col("k")).alias("part"), "entry", "k", "split_from")
    fresh = kept(_counted(moves_, fresh, new_members))
    large = fresh.where((F.col("k") > 0) & more_than(F.col("limbs"), most)).drop("k")
    renamed = lambda of, name: of.join(split.select(*BY, F.col("junction_id").alias(name), "k"), [*BY, name]).where("k > 0").withColumn("part", named(F.col("k"))).drop("k")
    own_gates = renamed(gates.select(*BY, "junction_id", "number"), "junction_id").join(large.select(*BY), BY, "left_semi")
    own_gates = kept(own_gates.withColumn("number", (F.row_number().over(Window.partitionBy(*BY).orderBy("number")) - 1).cast("long")))
    several = own_gates.groupBy(*BY).agg(F.max("number").alias("_last")).where("_last > 0").select(*BY)
    large = kept(large.join(several, BY, "left_semi"))
    if large.isEmpty():
        return fresh.drop("k"), new_members, stay
    in_large = new_members.join(large.select(*BY), BY, "left_semi")
    own_gates = own_gates.join(large.select(*BY), BY, "left_semi")
    own_doms = kept(renamed(doms.select(*BY, "node", "doms"), "node").join(large.select(*BY), BY, "left_semi"))
    cut, held = _whole_or_cut(large, kept(in_large), kept(own_gates), own_doms, moves_, most)
    rest = fresh.drop("k").join(large.select(*BY), BY, "left_anti").unionByName(cut)
    return kept(rest), kept(new_members.join(large.select(*BY), BY, "left_anti").unionByName(held)), stay


def split(exits: DataFrame, stages_: DataFrame, most: int = stages.MOST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Stages (of stages.stages) with the large ones cut, and the decisions of each.

    First: workflow, stage (numbered anew from 0), of_stage (the number before), entry, paths (as text), big, is_part, split_from
    (the ways of what the part was cut from; null: not cut) and why (a large one can't be cut). Second: workflow, stage, junction_id.
    """
    roads_, moves_ = kept(stages.roads(exits)), kept(moves(exits))
    members = stages.members(exits, stages_).select("workflow", F.array(F.col("stage").cast("int")).alias("part"), "junction_id")
    members = kept(members)
    entry = stages_.join(stages.starts(exits), "workflow", "left").select("workflow", F.array(F.col("stage").cast("int")).alias("part"), F.coalesce("entry", "start").alias("entry"), "paths", "big")
    none = lambda t: F.lit(None).cast(t)
    done = entry.where("not big").select(*BY, "entry", "paths", "big", none("string").alias("split_from"), none("string").alias("why"))
    kept_members = members.join(done.select(*BY), BY, "left_semi")
    open_ = kept(_counted(moves_, entry.where("big").select(*BY, "entry").withColumn("split_from", none("string")), members))
    open_members = kept(members.join(open_.select(*BY), BY, "left_semi"))
    row = lambda of, why: of.select(*BY, "entry", as_text(F.col("limbs")).alias("paths"), more_than(F.col("limbs"), most).alias("big"), "split_from", why.alias("why"))
    for _ in range(depth):
        if open_.isEmpty():
            break
        now, now_members, stay = _cut_once(open_, open_members, roads_, moves_, most)
        small = now.where(~more_than(F.col("limbs"), most))
        done = done.unionByName(row(stay, F.col("why"))).unionByName(row(small, none("string")))
        settled = stay.select(*BY).unionByName(small.select(*BY))
        kept_members = kept_members.unionByName(open_members.unionByName(now_members).join(settled, BY, "left_semi"))
        open_ = kept(now.where(more_than(F.col("limbs"), most)))
        open_members = kept(now_members.join(open_.select(*BY), BY, "left_semi"))
    done = kept(done.unionByName(row(open_, F.lit(TOO_DEEP))))
    number = (F.row_number().over(Window.partitionBy("workflow").orderBy("part")) - 1).cast("long")
    numbered = kept(done.withColumn("stage", number))
    held = kept_members.unionByName(open_members).join(numbered.select(*BY, "stage"), BY).select("workflow", "stage", "junction_id")
    out = numbered.select(
        "workflow", "stage", F.element_at("part", 1).cast("long").alias("of_stage"), "entry", "paths", "big",
        (F.size("part") > 1).alias("is_part"), "split_from", "why",
    )
    return out, kept(held.distinct())


def part_paths(exits: DataFrame, parts: DataFrame, members: DataFrame, most: int = stages.MOST) -> DataFrame:
    """workflow, stage, number, steps, end (null: it goes on), key: all ways of each stage or part that isn't big."""
    small = kept(parts.where("not big").select("workflow", "stage", "entry"))
    by = ("workflow", "stage")
    inside = members.join(small.select(*by), list(by), "left_semi").withColumnRenamed("stage", "part")
    moves_ = moves(exits)
    own = _inside(moves_.where("at <> ''"), inside).withColumnRenamed("part", "stage")
    first = moves_.where("at = ''").select("workflow", F.col("next").alias("_first"))
    begin = small.join(first, "workflow").select(*by, F.coalesce(F.concat(F.lit("J:"), "entry"), "_first").alias("place"))
    found, _ = listing(kept(own), most, by, begin)
    end = _end(F.col("place"))
    return found.select(*by, "number", "steps", end.alias("end"), stages.piece_key(F.col("steps"), end).alias("key"))


def _end(place: Column) -> Column:
    return F.when(place.startswith("E:") & ~place.startswith("E:>"), F.expr("substring(place, 3)"))
