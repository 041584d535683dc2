"""Measures of large maps by stage, headlines over all workflows, and panels of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.measures import grade, percent


def stage_pieces(paths: DataFrame, gates: DataFrame, exits: DataFrame) -> DataFrame:
    """paths' columns with stage and piece: each path (steps) cut at its map's gates; gates: workflow, junction_id, stage."""
    of = exits.select("workflow", "edge_id", "junction_id").join(gates, ["workflow", "junction_id"], "left").select("workflow", "edge_id", F.col("stage").alias("_begins"))
    steps = paths.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode("steps").alias("_at", "edge_id")).join(of, ["workflow", "edge_id"], "left")
    along = Window.partitionBy("_row").orderBy("_at")
    placed = steps.withColumn("stage", F.coalesce(F.last("_begins", ignorenulls=True).over(along), F.lit(0)))
    keep = [c for c in paths.columns if c != "steps"]
    piece = F.transform(F.array_sort(F.collect_list(F.struct("_at", "edge_id"))), lambda s: s["edge_id"])
    return placed.groupBy("_row", "stage", *keep).agg(piece.alias("piece")).drop("_row")


def stage_coverage(results: DataFrame, gates: DataFrame, exits: DataFrame, most: int = 256) -> DataFrame:
    """workflow, stage, pieces, covered, big: distinct ways through each stage, but for impossible paths; big stages count apart."""
    possible = results.where("covered or bucket <> 'cannot-be-tested'") if "bucket" in results.columns else results
    pieces = stage_pieces(possible.select("workflow", "steps", "covered"), gates, exits).groupBy("workflow", "stage", "piece").agg(F.bool_or("covered").alias("covered"))
    return pieces.groupBy("workflow", "stage").agg(F.count(F.lit(1)).alias("pieces"), F.count_if("covered").alias("covered")).withColumn("big", F.col("pieces") > most)


def branch_headline(branches: DataFrame, target: float = 75.0) -> DataFrame:
    """branches, taken, percent, grade, at_target (workflows): all workflows' branches; branches: workflow, branches, taken."""
    share = F.when(F.col("branches") == 0, 0.0).otherwise(F.col("taken") * 100.0 / F.col("branches"))
    out = branches.agg(F.sum("branches").alias("branches"), F.sum("taken").alias("taken"), F.count_if((F.col("branches") > 0) & (share >= target)).alias("at_target"))
    return out.withColumn("percent", percent(F.col("taken"), F.col("branches"))).withColumn("grade", grade(F.col("percent")))


def worst_first(rows: DataFrame) -> DataFrame:
    """Workflows by what they lack: unmet targets first, then the lowest share, then the most missing, then the name; rows: workflow, covered, total, percent, met."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("met"), F.col("percent"), F.desc(F.col("total") - F.col("covered")), "workflow")))


def capped_headline(paths: DataFrame, stages: DataFrame, branches: DataFrame) -> DataFrame:
    """kind, covered, total: paths of workflows under the cap, stage ways of those over it, branches of all; paths: workflow, paths, covered, capped."""
    row = lambda df, kind, total, covered: df.agg(F.lit(kind).alias("kind"), F.coalesce(F.sum(covered), F.lit(0)).alias("covered"), F.coalesce(F.sum(total), F.lit(0)).alias("total"))
    over = stages.where("not big").join(paths.where("capped").select("workflow"), "workflow", "left_semi")
    return row(paths.where("not capped"), "path", "paths", "covered").unionByName(row(over, "stage", "pieces", "covered")).unionByName(row(branches, "branch", "branches", "taken"))


def handler_stats(handlers: DataFrame, selector_exits: DataFrame, taken: DataFrame) -> DataFrame:
    """workflow, covered, total, not_recorded: exits of selectors, and of each other handler itself and its branches.

    A signal that is a selector's exit counts there; handlers that runs can't record leave both sides.
    """
    key = ["workflow", "edge_id"]
    exits = selector_exits.join(taken.select(*key).distinct().withColumn("_t", F.lit(1)), key, "left").groupBy("workflow").agg(F.count(F.lit(1)).alias("_e"), F.count("_t").alias("_et"))
    twice = handlers.join(selector_exits.select("workflow", F.regexp_extract("label", 'signal "(.*)"', 1).alias("handler")).distinct().withColumn("kind", F.lit("signal")), ["workflow", "handler", "kind"], "left_anti")
    can = F.col("exercised") != "not recorded"
    own = twice.groupBy("workflow").agg(F.sum(F.when(can, 1 + F.col("branches")).otherwise(0)).alias("_h"), F.sum(F.when(can, F.col("branches_taken") + (F.col("exercised") == "yes").cast("int")).otherwise(0)).alias("_ht"), F.count_if(~can).alias("not_recorded"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return exits.join(own, "workflow", "full").select("workflow", (z("_et") + z("_ht")).alias("covered"), (z("_e") + z("_h")).alias("total"), z("not_recorded").alias("not_recorded"))


def helper_regions(branches: DataFrame) -> DataFrame:
    """workflow, helper, decisions, sites, score: helpers by decisions times copies, largest first; branches: workflow, helper, decision, site."""
    out = branches.where("helper is not null").groupBy("workflow", "helper").agg(F.count_distinct("decision").alias("decisions"), F.count_distinct("site").alias("sites"))
    return out.withColumn("score", F.col("decisions") * F.col("sites"))


def possible_bugs(results: DataFrame) -> DataFrame:
    """workflow, place, paths, example: paths that a likely defect explains, by place; results: with label, suspect, number."""
    return results.where("label = 'likely-defect'").groupBy("workflow", F.col("suspect").alias("place")).agg(F.count(F.lit(1)).alias("paths"), F.min("number").alias("example"))


def decision_check(mutants: DataFrame) -> DataFrame:
    """noticed, survived, no_visible_effect, flaky, score: noticed of noticed and survived; mutants: result."""
    is_ = lambda r: F.count_if(F.col("result") == r)
    out = mutants.agg(is_("noticed").alias("noticed"), is_("survived").alias("survived"), is_("no visible effect").alias("no_visible_effect"), is_("flaky").alias("flaky"))
    return out.withColumn("score", percent(F.col("noticed"), F.col("noticed") + F.col("survived")))


def forced_decisions(outcomes: DataFrame) -> DataFrame:
    """workflow, decision, outcome, tests_of: each other possible outcome of decisions of which one was covered; outcomes: workflow, decision, outcome, status."""
    ran = outcomes.where("status = 'covered'").groupBy("workflow", "decision").agg(F.array_sort(F.collect_set("outcome")).alias("tests_of"))
    return outcomes.where("status <> 'impossible'").join(ran, ["workflow", "decision"]).withColumn("tests_of", F.array_remove("tests_of", F.col("outcome"))).where(F.size("tests_of") > 0).select("workflow", "decision", "outcome", "tests_of")


def assumptions(results: DataFrame) -> DataFrame:
    """assumption, paths, workflows: what claims rest on; results: with assumptions (array)."""
    return results.select("workflow", F.explode("assumptions").alias("assumption")).groupBy("assumption").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("workflow").alias("workflows"))


def anchor_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """rule_id, entry, was, is: entries of rules that now name another decision; rows: rule_id, entry, decision."""
    both = before.select("rule_id", "entry", F.col("decision").alias("was")).join(now.select("rule_id", "entry", F.col("decision").alias("is")), ["rule_id", "entry"])
    return both.where(~F.col("was").eqNullSafe(F.col("is")))


def unread(model: DataFrame, results: DataFrame, cap: int) -> DataFrame:
    """workflow, what, where: places that could not be read, and workflows with more paths than the list holds."""
    capped = results.where("truncated").select("workflow").distinct().select("workflow", F.lit("path cap").alias("what"), F.lit(f"more than {cap} paths").alias("where"))
    return model.select("workflow", "what", "where").unionByName(capped)


def external_maps(external: DataFrame) -> DataFrame:
    """workflow, external: the map that external_steps reads; external: workflow, edge_id, steps, zero, iterate."""
    entry = lambda key, value: F.struct(key.alias("k"), value.alias("v"))
    own = entry(F.col("edge_id"), F.col("steps"))
    loop = F.array(entry(F.concat(F.lit("0:"), "edge_id"), F.col("zero")), entry(F.concat(F.lit("i:"), "edge_id"), F.array("iterate")))
    rows = external.select("workflow", F.explode(F.when(F.col("iterate").isNull(), F.array(own)).otherwise(F.concat(F.array(own), loop))).alias("e"))
    return rows.groupBy("workflow").agg(F.map_from_entries(F.collect_list("e")).alias("external"))


def external_steps(steps: Column, external: Column) -> Column:
    """A path's external steps: external is a map from an exit to its steps; a loop's exit adds its "0 rounds" step only if it wasn't iterated before.

    The zero-rounds step of a loop's exit stands in the map under "0:" and the exit; under "i:" and the exit stands the loop's iterating exit.
    """
    none = F.array().cast("array<string>")
    own = lambda e: F.coalesce(F.try_element_at(external, e), none)

    def step(a: Column, e: Column) -> Column:
        iterates = F.try_element_at(own(F.concat(F.lit("i:"), e)), F.lit(1))
        zero = F.when(F.coalesce(F.array_contains(a["seen"], iterates), F.lit(False)), none).otherwise(own(F.concat(F.lit("0:"), e)))
        return F.struct(F.concat(a["seen"], F.array(e)).alias("seen"), F.concat(a["out"], own(e), zero).alias("out"))

    return F.aggregate(steps, F.struct(none.alias("seen"), none.alias("out")), step, lambda a: a["out"])
