"""Decision maps as tables of moves between places, all maps of a project at once, worked on in rounds of joins.

A place is what match.place makes of an exit's target. After a retry only the loop's exit is left, so the place behind
a retry is its loop limited to that exit. Nothing here holds a large map in one task. Counts, reach and dominators
of large maps are found by doubling: a round joins the ways of 2^j moves with each other to those of 2^(j + 1), merged where they begin
and end alike, and is written. So a map of a thousand decisions in a row takes eleven rounds. Only `listing` takes a step
a round. Maps of up to held.MOST_ROWS rows are not worth rounds: they are walked one by one in the task that holds them (`walks`).

Counts have any length: they are arrays of limbs of DIGITS digits, the lowest first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators import walks
from trailweave.operators.match import place
from trailweave.sources.held import by_group, large_of
from trailweave.sources.rounds import kept
from trailweave.sources.tables import START

DIGITS = 6
LIMB = 10**DIGITS


def moves(exits: DataFrame) -> DataFrame:
    """workflow, at, edge_id, junction_id, ord, next: each move from a place, START (at "") among them."""
    exits = kept(exits.select("workflow", *walks.EXIT))
    small, large = held_or_not(exits, ["workflow"])
    found = by_group(small, ["workflow"], walks.all_moves, "at string, edge_id string, junction_id string, ord int, next string")
    return found if large is None else found.unionByName(_moves_by_joins(exits.join(large, "workflow", "left_semi")))


def _moves_by_joins(exits: DataFrame) -> DataFrame:
    leave = exits.where("kind = 'loop' and label = 'exit'").select("workflow", "junction_id", F.concat(F.lit("J:"), "junction_id", F.lit("!"), "edge_id").alias("_leave"))
    ways = exits.withColumn("next", place(F.col("to_kind"), F.col("to_id"), F.col("only_edge"))).join(leave, ["workflow", "junction_id"], "left")
    ways = ways.withColumn("next", F.when(F.col("is_retry"), F.coalesce("_leave", F.lit("D"))).otherwise(F.col("next")))
    ways = ways.select("workflow", "edge_id", "junction_id", "ord", "is_retry", "next")
    start = ways.where(F.col("edge_id") == START).select("workflow", F.lit("").alias("at"), "edge_id", "junction_id", "ord", "next")
    open_ = ways.where(F.col("edge_id") != START)
    retry = open_.where("is_retry").select("workflow", F.concat(F.lit("R:"), "edge_id").alias("at"), "edge_id", "junction_id", "ord", "next")
    plain = open_.where("not is_retry")
    whole = plain.select("workflow", F.concat(F.lit("J:"), "junction_id").alias("at"), "edge_id", "junction_id", "ord", "next")
    limited = ways.select("workflow", "next").where("next like 'J:%!%'").distinct()
    limited = limited.select("workflow", F.col("next").alias("at"), F.substring_index(F.expr("substring(next, 3)"), "!", 1).alias("junction_id"), F.expr("substring(next, instr(next, '!') + 1)").alias("edge_id"))
    limited = limited.join(plain, ["workflow", "junction_id", "edge_id"]).select("workflow", "at", "edge_id", "junction_id", "ord", "next")
    return start.unionByName(whole).unionByName(limited).unionByName(retry).withColumn("ord", F.col("ord").cast("int"))


NO_LIMBS = "array<bigint>"


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("bigint")) + F.coalesce(y, F.lit(0).cast("bigint")))


def _carried(limbs: Column) -> Column:
    start = F.struct(F.array().cast(NO_LIMBS).alias("out"), F.lit(0).cast("bigint").alias("over"))

    def carry(a: Column, limb: Column) -> Column:
        total = a["over"] + limb
        return F.struct(F.concat(a["out"], F.array(total % LIMB)).alias("out"), F.floor(total / LIMB).cast("bigint").alias("over"))

    def whole(a: Column) -> Column:  # what is left over is less than LIMB^2 limbs of one product, so three more hold it
        rest = F.array(*[F.floor(a["over"] / LIMB**k).cast("bigint") % LIMB for k in range(3)])
        return F.when(a["over"] > 0, F.concat(a["out"], rest)).otherwise(a["out"])

    return F.aggregate(limbs, start, carry, whole)


def _summed(lists: Column) -> Column:
    """The sum of arrays of limbs."""
    return _carried(F.aggregate(lists, F.array().cast(NO_LIMBS), _added))


def _product(a: Column, b: Column) -> Column:
    """The product of two arrays of limbs."""
    zeros = lambda i: F.array_repeat(F.lit(0).cast("bigint"), i)
    places = F.sequence(F.lit(0), F.size(a) - 1)
    return _carried(F.aggregate(places, F.array().cast(NO_LIMBS), lambda out, i: _added(out, F.concat(zeros(i), F.transform(b, lambda y: y * F.get(a, i))))))


def rounds_for(pairs: DataFrame, key: list[str]) -> int:
    """The rounds of doubling after which ways through the largest map are found: pairs has a row for each two neighbours."""
    most = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 1
    return math.ceil(math.log2(most + 1)) + 1


def held_or_not(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that a task may hold, and the keys of those that it may not (None: there are none)."""
    large = large_of(rows, key)
    return (rows, None) if large is None else (rows.join(large, key, "left_anti"), large)


def spread(pairs: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """by, place: all that can be come to from seeds (by, place) along pairs (by, a, b), seeds among them."""
    rows = pairs.select(*key, "a", "b").unionByName(seeds.select(*key, F.col("place").alias("a"), F.lit(None).cast("string").alias("b")))
    small, large = held_or_not(rows, key)
    found = by_group(small, key, walks.spread, "place string")
    return found if large is None else found.unionByName(_spread_in_rounds(pairs.join(large, key, "left_semi"), seeds.join(large, key, "left_semi"), key))


def _spread_in_rounds(pairs: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    seen = kept(seeds.select(*key, "place").distinct())
    far = kept(pairs.select(*key, "a", "b").distinct())
    for _ in range(rounds_for(far, key)):
        ahead = seen.join(far.withColumnRenamed("a", "place"), [*key, "place"]).select(*key, F.col("b").alias("place"))
        seen = kept(seen.union(ahead).distinct())
        far = kept(far.alias("x").join(far.select(*key, F.col("a").alias("b"), F.col("b").alias("_c")), [*key, "b"]).select(*key, "a", F.col("_c").alias("b")).distinct())
        if far.isEmpty():
            break
    return seen


def as_text(limbs: Column) -> Column:
    """A count in decimal digits."""
    digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), DIGITS, "0")), "")
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def more_than(limbs: Column, most: int) -> Column:
    """Whether a count is over most, which is less than a limb."""
    high = F.exists(F.slice(limbs, F.lit(2), F.greatest(F.size(limbs) - 1, F.lit(0))), lambda x: x > 0)
    return high | (F.element_at(limbs, 1) > most)


def ways(moves_: DataFrame, by: tuple[str, ...] = ("workflow",), stops: DataFrame | None = None) -> DataFrame:
    """by, place, limbs: in how many ways each place goes on to an end; places that don't have no row.

    moves_: by, at, next and more. stops (by, place): places at which a way counts as one that has ended; moves from them
    are not used. In a map with a way back that is no retry the counts of places before it have no meaning.
    """
    key = list(by)
    rows = moves_.select(*key, "at", "next")
    if stops is not None:
        rows = rows.unionByName(stops.select(*key, F.col("place").alias("at"), F.lit(None).cast("string").alias("next")))
    small, large = held_or_not(rows, key)
    found = by_group(small, key, walks.ways, "place string, limbs array<bigint>")
    if large is None:
        return found
    return found.unionByName(_ways_in_rounds(moves_.join(large, key, "left_semi"), by, None if stops is None else stops.join(large, key, "left_semi")))


def _ways_in_rounds(moves_: DataFrame, by: tuple[str, ...], stops: DataFrame | None) -> DataFrame:
    """Of ways of up to 2^j moves `ended` has how many from each place have come to an end, and `far` how many of exactly 2^j
    there are from each place to each other.
    """
    key = list(by)
    used = moves_.select(*key, "at", "next")
    ends = used.where("next like 'E:%'").select(*key, F.col("next").alias("place"))
    if stops is not None:
        used = used.join(stops.select(*key, F.col("place").alias("at")), [*key, "at"], "left_anti")
        ends = ends.union(stops.select(*key, "place"))
    one = F.array(F.lit(1).cast("bigint"))
    ended = kept(ends.distinct().withColumn("limbs", one))
    far = kept(used.where("next <> 'D'").groupBy(*key, "at", "next").agg(F.array(F.count(F.lit(1))).alias("limbs")))
    for _ in range(rounds_for(far, key)):
        came = far.join(ended.select(*key, F.col("place").alias("next"), F.col("limbs").alias("_more")), [*key, "next"])
        came = came.select(*key, F.col("at").alias("place"), _product(F.col("limbs"), F.col("_more")).alias("limbs"))
        ended = kept(ended.unionByName(came).groupBy(*key, "place").agg(_summed(F.collect_list("limbs")).alias("limbs")))
        twice = far.join(far.select(*key, F.col("at").alias("next"), F.col("next").alias("_to"), F.col("limbs").alias("_more")), [*key, "next"])
        twice = twice.select(*key, "at", F.col("_to").alias("next"), _product(F.col("limbs"), F.col("_more")).alias("limbs"))
        far = kept(twice.groupBy(*key, "at", "next").agg(_summed(F.collect_list("limbs")).alias("limbs")))
        if far.isEmpty():
            break
    return ended


def path_counts(exits: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """workflow, paths (a whole number as text): all paths of each map that take no exit of skip (workflow, edge_id)."""
    if skip is not None:
        return _path_counts(exits, moves(exits).join(skip.select("workflow", "edge_id").distinct(), ["workflow", "edge_id"], "left_anti"))
    exits = kept(exits.select("workflow", *walks.EXIT))
    small, large = held_or_not(exits, ["workflow"])
    found = by_group(small, ["workflow"], walks.path_count, "paths string")
    if large is None:
        return found
    exits = exits.join(large, "workflow", "left_semi")
    return found.unionByName(_path_counts(exits, moves(exits)))


def _path_counts(exits: DataFrame, used: DataFrame) -> DataFrame:
    found = ways(used).where(F.col("place") == "").select("workflow", as_text(F.col("limbs")).alias("paths"))
    return exits.select("workflow").distinct().join(found, "workflow", "left").withColumn("paths", F.coalesce("paths", F.lit("0")))


def reachable(exits: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """workflow, edge_id: the exits and ways round loops that a way from the start, or from the places of start (workflow, place), takes."""
    if start is not None:
        return _reachable(exits, start)
    exits = kept(exits.select("workflow", *walks.EXIT))
    small, large = held_or_not(exits, ["workflow"])
    found = by_group(small, ["workflow"], walks.reachable, "edge_id string")
    return found if large is None else found.unionByName(_reachable(exits.join(large, "workflow", "left_semi"), None))


def _reachable(exits: DataFrame, start: DataFrame | None) -> DataFrame:
    used = kept(moves(exits))
    begin = used.where("at = ''").select("workflow", F.col("next").alias("place")) if start is None else start.select("workflow", "place")
    at = spread(used.where("at <> ''").select("workflow", F.col("at").alias("a"), F.col("next").alias("b")), begin, ["workflow"])
    return used.join(at.withColumnRenamed("place", "at"), ["workflow", "at"]).where(F.col("edge_id") != START).select("workflow", "edge_id").distinct()


def listing(
    moves_: DataFrame, cap: int, by: tuple[str, ...] = ("workflow",), starts: DataFrame | None = None, stops: DataFrame | None = None, facts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The first cap ways of each map in the order of exits, and the groups left out.

    Ways: by, number (from 1), steps, place (where it stopped), truncated (more ways exist). An exit is taken once at most.
    starts (by, place): where ways begin, else the start; stops (by, place): where they end besides the ends.

    facts (workflow, edge_id, name, value): what taking an exit shows. An exit that contradicts what a way has shown before
    is impossible: nothing behind it is listed. Groups: by, prefix (its last step is the exit), name, place (behind it);
    those that come before the list was full.

    """
    key = list(by)
    none = lambda t: F.lit(None).cast(t)
    texts = "array<string>"
    used = moves_.select(*key, "at", "edge_id", F.col("ord").cast("int").alias("ord"), "next")
    if facts is not None:
        shows = F.collect_set(F.struct("name", "value"))
        known = facts.groupBy("workflow", "edge_id").agg(shows.alias("_shows")).select("workflow", "edge_id", F.col("_shows.name").alias("names"), F.col("_shows.value").alias("values"))
        used = used.join(known, ["workflow", "edge_id"], "left").select(*key, "at", "edge_id", "ord", "next", "names", "values")
    else:
        used = used.select("*", none(texts).alias("names"), none(texts).alias("values"))
    rows = used.select(*key, F.lit("move").alias("kind"), "at", "edge_id", "ord", "next", "names", "values")
    for kind, places in (("stop", stops), ("start", starts)):
        if places is not None:
            bare = [none("string").alias("edge_id"), none("int").alias("ord"), none("string").alias("next"), none(texts).alias("names"), none(texts).alias("values")]
            rows = rows.unionByName(places.select(*key, F.lit(kind).alias("kind"), F.col("place").alias("at"), *bare))
    small, large = held_or_not(rows, key)
    begin = starts is not None
    found = by_group(small, key, lambda r: walks.listing(r, cap, begin), "number int, steps array<string>, place string, name string, truncated boolean")
    found = found if facts is None else kept(found)  # both parts are read from it
    listed = found.where("number is not null").select(*key, "number", "steps", "place", "truncated")
    groups = found.where("number is null").select(*key, F.col("steps").alias("prefix"), "name", "place")
    if large is None:
        return listed, groups
    of = lambda df: None if df is None else df.join(large, key, "left_semi")
    more, more_groups = _listing_in_rounds(of(moves_), cap, by, of(starts), of(stops), facts)
    return listed.unionByName(more), groups.unionByName(more_groups)


def _listing_in_rounds(
    moves_: DataFrame, cap: int, by: tuple[str, ...], starts: DataFrame | None, stops: DataFrame | None, facts: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """In a round the first cap + 1 open ways of a map take one step each. Moves that lead to no end are not entered, so
    without facts an open way has an end, and what stands behind cap + 1 ways is dropped; with facts only what stands
    behind cap + 1 whole ones is.
    """
    key = list(by)
    used = moves_.select(*key, "at", "edge_id", "ord", "next")
    ends = used.where("next like 'E:%'").select(*key, F.col("next").alias("place"))
    ends = ends if stops is None else ends.union(stops.select(*key, "place"))
    alive = spread(used.select(*key, F.col("next").alias("a"), F.col("at").alias("b")), ends, key)
    used = used.join(alive.withColumnRenamed("place", "next"), [*key, "next"], "left_semi")
    if stops is not None:
        used = used.join(stops.select(*key, F.col("place").alias("at")), [*key, "at"], "left_anti")
    shown = F.array().cast("array<struct<name:string,value:string>>")
    if facts is not None:
        known = facts.groupBy("workflow", "edge_id").agg(F.collect_set(F.struct("name", "value")).alias("_shows"))
        used = used.join(known, ["workflow", "edge_id"], "left").withColumn("_shows", F.coalesce("_shows", shown))
    else:
        used = used.withColumn("_shows", shown)
    used = kept(used)
    if starts is None:
        starts = used.where("at = ''").select(*key, F.col("next").alias("place"))
        used = used.where("at <> ''")
    else:
        starts = starts.join(alive, [*key, "place"], "left_semi")
    ends = used.select(*key, F.col("at").alias("place")).distinct().withColumn("_on", F.lit(True))

    def with_end(rows: DataFrame) -> DataFrame:
        return rows.join(ends, [*key, "place"], "left").withColumn("open", F.coalesce("_on", F.lit(False))).drop("_on")

    none, order = F.array().cast("array<string>"), F.array().cast("array<int>")
    fresh = starts.select(*key, "place", none.alias("steps"), order.alias("order"), shown.alias("shown"), F.lit(None).cast("string").alias("pruned"))
    all_ways = kept(with_end(fresh))
    before = Window.partitionBy(*key).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    while not all_ways.where("open").isEmpty():
        ranked = all_ways.withColumn("_before", F.coalesce(F.sum(F.col("open").cast("int")).over(before), F.lit(0)))
        now, later = ranked.where(F.col("open") & (F.col("_before") <= cap)), ranked.where(~F.col("open") | (F.col("_before") > cap))
        step = now.drop("open", "_before").join(used.withColumnRenamed("at", "place"), [*key, "place"])
        step = step.where(~F.array_contains("steps", F.col("edge_id")))
        clash = F.filter("_shows", lambda s: F.exists("shown", lambda k: (k["name"] == s["name"]) & (k["value"] != s["value"])))
        step = step.select(
            *key, F.col("next").alias("place"), F.concat("steps", F.array("edge_id")).alias("steps"), F.concat("order", F.array(F.col("ord").cast("int"))).alias("order"),
            F.array_union("shown", "_shows").alias("shown"), F.array_min(F.transform(clash, lambda c: c["name"])).alias("pruned"),
        )
        grown = with_end(step).withColumn("open", F.col("open") & F.col("pruned").isNull())
        both = later.drop("_before").unionByName(grown)
        counted = F.col("pruned").isNull() if facts is None else F.col("pruned").isNull() & ~F.col("open")
        full = F.coalesce(F.sum(counted.cast("int")).over(before), F.lit(0))
        all_ways = kept(both.withColumn("_full", full).where(F.col("_full") <= cap).drop("_full"))
    whole = F.col("pruned").isNull()
    full = F.coalesce(F.sum(whole.cast("int")).over(before), F.lit(0))
    numbered = all_ways.withColumn("_full", full)
    truncated = numbered.groupBy(*key).agg((F.sum(whole.cast("int")) > cap).alias("truncated"))
    listed = numbered.where(whole & (F.col("_full") < cap)).join(truncated, key)
    listed = listed.select(*key, (F.col("_full") + 1).cast("int").alias("number"), "steps", "place", "truncated")
    groups = numbered.where(~whole & (F.col("_full") <= cap)).select(*key, F.col("steps").alias("prefix"), F.col("pruned").alias("name"), "place")
    return listed, groups
