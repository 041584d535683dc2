"""Measures over runs that matched (matches of operators.match) and the paths of their maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.ids import path_key, scenario_id, unexplained_id
from trailweave.functions.measures import percent, priority
from trailweave.operators.paths import legal_pairs, pairs_of
from trailweave.sources.tables import START


def run_paths(counted: DataFrame) -> DataFrame:
    """workflow, path_key, steps, end, runs: the distinct folded paths of counted runs. Runs are summed before they are shuffled."""
    rows = counted.select("workflow", F.col("path").alias("steps"), "end", path_key(F.col("path"), F.col("end")).alias("path_key"))
    return rows.groupBy("workflow", "path_key").agg(F.first("steps").alias("steps"), F.first("end").alias("end"), F.count(F.lit(1)).alias("runs"))


def path_results(listed: DataFrame, counted: DataFrame) -> DataFrame:
    """listed with runs and covered: whether a counted run took the path."""
    ran = run_paths(counted).select("workflow", "path_key", "runs")
    return listed.join(ran, ["workflow", "path_key"], "left").withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("covered", F.col("runs") > 0)


def beyond_list(listed: DataFrame, counted: DataFrame) -> DataFrame:
    """Paths that runs took and the list lacks (it was cut at its cap); they count as taken all the same."""
    return run_paths(counted).join(listed.select("workflow", "path_key"), ["workflow", "path_key"], "left_anti")


def path_coverage(results: DataFrame) -> DataFrame:
    """workflow, paths, covered, percent, priority."""
    out = results.groupBy("workflow").agg(F.count(F.lit(1)).alias("paths"), F.count_if("covered").alias("covered"))
    return out.withColumn("percent", percent(F.col("covered"), F.col("paths"))).withColumn("priority", priority(F.col("covered"), F.col("paths")))


def taken_exits(counted: DataFrame) -> DataFrame:
    """workflow, edge_id, taken_raw, taken_folded: runs' steps by exit, before and after folding; counted in each task first."""
    raw = counted.select("workflow", F.explode("steps").alias("edge_id")).groupBy("workflow", "edge_id").agg(F.count(F.lit(1)).alias("taken_raw"))
    folded = counted.select("workflow", F.explode("path").alias("edge_id")).groupBy("workflow", "edge_id").agg(F.count(F.lit(1)).alias("taken_folded"))
    both = raw.join(folded, ["workflow", "edge_id"], "left")
    return both.select("workflow", "edge_id", "taken_raw", F.coalesce("taken_folded", F.lit(0)).alias("taken_folded"))


def branch_coverage(exits: DataFrame, counted: DataFrame) -> DataFrame:
    """workflow, branches, taken, percent; ways round loops count as branches."""
    all_ = exits.where(F.col("edge_id") != START).select("workflow", "edge_id")
    out = all_.join(taken_exits(counted), ["workflow", "edge_id"], "left").groupBy("workflow").agg(F.count(F.lit(1)).alias("branches"), F.count("taken_raw").alias("taken"))
    return out.withColumn("percent", percent(F.col("taken"), F.col("branches")))


def pair_coverage(exits: DataFrame, results: DataFrame, counted: DataFrame, impossible: Column | None = None) -> DataFrame:
    """workflow, pairs, covered: pairs that ran, and others that lie on a path which is possible (or beyond the list)."""
    possible = results if impossible is None else results.where(~impossible | F.col("covered"))
    on_path = pairs_of(possible.select("workflow", "steps"), exits).distinct().withColumn("possible", F.lit(True))
    ran = pairs_of(run_paths(counted).select("workflow", "steps"), exits).distinct().withColumn("ran", F.lit(True))
    capped = results.groupBy("workflow").agg(F.bool_or("truncated").alias("capped"))
    key = ["workflow", "first", "second"]
    rows = legal_pairs(exits).join(ran, key, "left").join(on_path, key, "left").join(capped, "workflow", "left")
    counts = rows.where("ran or possible or capped").groupBy("workflow").agg(F.count(F.lit(1)).alias("pairs"), F.count("ran").alias("covered"))
    return counts


def prefixes(paths: DataFrame) -> DataFrame:
    """workflow, prefix, runs: every prefix of every path that runs took (steps, runs)."""
    every = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda n: F.slice("steps", F.lit(1), n))
    return paths.where(F.size("steps") > 0).select("workflow", F.explode(every).alias("prefix"), "runs").groupBy("workflow", "prefix").agg(F.sum("runs").alias("runs"))


def missed_groups(results: DataFrame, counted: DataFrame) -> DataFrame:
    """workflow, prefix, step, missed, first_number, rank: missed paths that can be tested (where results has a bucket) by the
    first step that no run took; the largest group first."""
    taken = prefixes(run_paths(counted).select("workflow", "steps", "runs")).select("workflow", F.array_join("prefix", "\n").alias("_p"))
    missed = results.where("not covered")
    missed = missed.where("bucket = 'testable'") if "bucket" in results.columns else missed
    cut = missed.select("workflow", "number", "steps", "end", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("n")).withColumn("_p", F.array_join(F.slice("steps", F.lit(1), F.col("n")), "\n"))
    known = cut.where("n = 0").unionByName(cut.where("n > 0").join(taken, ["workflow", "_p"], "left_semi").select(*cut.columns))
    left = known.groupBy("workflow", "number").agg(F.max("n").alias("n"), F.first("steps").alias("steps"), F.first("end").alias("end"))
    step = F.when(F.col("n") < F.size("steps"), F.try_element_at("steps", F.col("n") + 1)).otherwise(F.concat(F.lit("end:"), F.col("end")))
    groups = left.select("workflow", F.slice("steps", F.lit(1), F.col("n")).alias("prefix"), step.alias("step"), "number").groupBy("workflow", "prefix", "step").agg(F.count(F.lit(1)).alias("missed"), F.min("number").alias("first_number"))
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("missed"), "first_number")))


def unmatched_groups(triaged: DataFrame) -> DataFrame:
    """workflow, steps_id, steps, runs, bad_step: runs that fit no path, by their steps; counted in each task first."""
    rows = triaged.where("kind = 'unmatched'").select("workflow", unexplained_id(F.col("steps")).alias("steps_id"), "steps", "bad_step")
    return rows.groupBy("workflow", "steps_id").agg(F.first("steps").alias("steps"), F.count(F.lit(1)).alias("runs"), F.min("bad_step").alias("bad_step"))


def acknowledged(groups: DataFrame, explained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with `explained`, the entries of explained (workflow, steps_id, reason) that no group uses)."""
    key = ["workflow", "steps_id"]
    return groups.join(explained.withColumn("explained", F.lit(True)), key, "left").withColumn("explained", F.coalesce("explained", F.lit(False))), explained.join(groups, key, "left_anti")


#: The name of the row of runs without a test (a fixed value).
NO_TEST = "(test name not recorded)"


def test_results(counted: DataFrame, scenario: Column | None = None) -> DataFrame:
    """test, runs, workflows, scenarios, unique_scenarios, branches, unique_branches, adds_nothing: what each test takes, and
    what it alone takes.

    scenario: what a run does outside itself; its path, if not given. A named test without a scenario or a branch of its own
    adds nothing; the row of runs without a name never does.
    """
    named = F.when(F.coalesce("test", F.lit("")) == "", NO_TEST).otherwise(F.col("test"))
    runs = counted.withColumn("test", named).withColumn("_scenario", path_key(F.col("path"), F.col("end")) if scenario is None else scenario)
    base = runs.groupBy("test").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("workflow").alias("workflows"))
    # scenarios and branches of a run in one pass
    item = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("what"))
    items = F.concat(F.array(item("scenario", F.col("_scenario"))), F.transform("path", lambda e: item("branch", e)))
    once = runs.select("test", "workflow", F.explode(items).alias("item")).select("test", "workflow", "item.*").distinct()
    tests_of = once.groupBy("workflow", "kind", "what").agg(F.count(F.lit(1)).alias("_n"), F.min("test").alias("test"))
    is_ = lambda kind, alias: F.count_if(F.col("kind") == kind).alias(alias)
    all_ = once.groupBy("test").agg(is_("scenario", "scenarios"), is_("branch", "branches"))
    alone = tests_of.where("_n = 1").groupBy("test").agg(is_("scenario", "unique_scenarios"), is_("branch", "unique_branches"))
    out = base.join(all_, "test").join(alone, "test", "left").na.fill(0, ["unique_scenarios", "unique_branches"])
    nothing = (F.col("test") != NO_TEST) & (F.col("unique_scenarios") == 0) & (F.col("unique_branches") == 0)
    return out.withColumn("adds_nothing", nothing)


def loop_rounds(counted: DataFrame, loops: DataFrame) -> DataFrame:
    """workflow, junction_id, bucket, entries, seen: how many rounds runs' entries into each loop ran (0, 1, 2+).

    loops: workflow, junction_id, iterate, leave (edges), closes (edges of loops around it that start it afresh).
    Reads the raw steps. A loop that a run left by a break, or was in at its end, closes there.
    """
    steps = counted.select("workflow", "run_id", F.posexplode("steps").alias("at", "edge_id"))
    l = loops
    events = steps.join(l, "workflow").where((F.col("edge_id") == F.col("iterate")) | (F.col("edge_id") == F.col("leave")) | F.array_contains("closes", F.col("edge_id")))
    w = Window.partitionBy("workflow", "run_id", "junction_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("edge_id") == F.col("iterate")
    entry = events.withColumn("_entry", F.coalesce(F.sum(F.when(turns, 0).otherwise(1)).over(w), F.lit(0)))
    entries = entry.groupBy("workflow", "run_id", "junction_id", "_entry").agg(F.count_if(turns).alias("rounds"), F.max(F.col("edge_id") == F.col("leave")).alias("_left")).where("rounds > 0 or _left")
    bucket = F.when(F.col("rounds") == 0, "0").when(F.col("rounds") == 1, "1").otherwise("2+")
    seen = entries.groupBy("workflow", "junction_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("entries"))
    every = loops.select("workflow", "junction_id", F.explode(F.array(*map(F.lit, ("0", "1", "2+")))).alias("bucket"))
    return every.join(seen, ["workflow", "junction_id", "bucket"], "left").withColumn("entries", F.coalesce("entries", F.lit(0))).withColumn("seen", F.col("entries") > 0)


def condition_coverage(conditions: DataFrame, recorded: DataFrame, least_recorder: int = 4) -> DataFrame:
    """workflow, atoms, seen, total, status: each atom of a condition needs true and false; recorded: workflow, recorder, conditions (c:<id>:t or :f).

    A workflow none of whose runs could record conditions is "not recorded".
    """
    able = recorded.where(F.col("recorder") >= least_recorder)
    seen = able.select("workflow", F.explode("conditions").alias("c")).distinct()
    parts = seen.select("workflow", F.regexp_extract("c", "^(.*):[tf]$", 1).alias("condition_id"), F.substring("c", -1, 1).alias("value"))
    found = conditions.select("workflow", "condition_id").join(parts, ["workflow", "condition_id"], "left").groupBy("workflow").agg(F.count_distinct("condition_id").alias("atoms"), F.count("value").alias("seen"))
    out = found.join(able.select("workflow").distinct().withColumn("_any", F.lit(True)), "workflow", "left")
    return out.select("workflow", "atoms", "seen", (F.col("atoms") * 2).alias("total"), F.when(F.col("_any"), "recorded").otherwise("not recorded").alias("status"))


def outcome_status(branches: DataFrame, results: DataFrame, taken: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """workflow, branch_id, sites, sites_taken, missed_paths, status of each outcome.

    branches: workflow, branch_id, edge_id (an outcome has an exit in each copy of a helper); results: path results
    with bucket and label; taken: workflow, edge_id; touched: the same, of runs that didn't count.
    covered, else missed (the list was cut, no path or a path of another kind goes through it, or a run that didn't
    count touched it), else blocked (by a known bug), else impossible.
    """
    through = results.select("workflow", F.explode(F.array_distinct("steps")).alias("edge_id"), "bucket", "label", "covered", "truncated")
    known = (F.col("bucket") != "cannot-be-tested") & (F.col("label") == "known-defect")
    other = (F.col("bucket") != "cannot-be-tested") & (F.col("label") != "known-defect")
    tally = through.groupBy("workflow", "edge_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known"), F.count_if(other).alias("other"), F.count_if(~F.col("covered")).alias("missed"))
    capped = results.groupBy("workflow").agg(F.bool_or("truncated").alias("capped"))
    key = ["workflow", "edge_id"]
    rows = branches.join(tally, key, "left").join(taken.select(*key).distinct().withColumn("_taken", F.lit(1)), key, "left")
    rows = rows.join(touched.select(*key).distinct().withColumn("_touched", F.lit(1)), key, "left") if touched is not None else rows.withColumn("_touched", F.lit(None).cast("int"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = rows.groupBy("workflow", "branch_id").agg(F.count(F.lit(1)).alias("sites"), total("_taken").alias("sites_taken"), total("missed").alias("missed_paths"), total("n").alias("_n"), total("known").alias("_known"), total("other").alias("_other"), total("_touched").alias("_t"))
    by = by.join(capped, "workflow", "left")
    status = F.when(F.col("sites_taken") > 0, "covered").when(F.coalesce("capped", F.lit(False)) | (F.col("_n") == 0) | (F.col("_other") > 0) | (F.col("_t") > 0), "missed").when(F.col("_known") > 0, "blocked").otherwise("impossible")
    return by.select("workflow", "branch_id", "sites", "sites_taken", "missed_paths", status.alias("status"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """workflow, possible, covered, blocked, impossible, percent: impossible outcomes leave the whole, blocked ones stay."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = outcomes.groupBy("workflow").agg(F.count_if(F.col("status") != "impossible").alias("possible"), is_("covered").alias("covered"), is_("blocked").alias("blocked"), is_("impossible").alias("impossible"))
    return out.withColumn("percent", percent(F.col("covered"), F.col("possible")))


RANKS = {"testable": 0, "needs-review": 1, "needs-special-test": 2, "cannot-be-tested": 3}


def scenarios(results: DataFrame, ran: DataFrame, external: Column, capped: DataFrame | None = None) -> DataFrame:
    """workflow, scenario_id, path_count, main_number, bucket, label, runs, covered: paths with the same external steps are one scenario.

    external: the external steps of a row of results and of ran (run_paths). The best bucket of its paths is the
    scenario's; a run makes it testable. capped (workflow): maps with more paths than are listed. Of these a scenario that
    only runs beyond the list took is added, with no path, and one whose listed paths are all impossible needs review
    (label model-limit), as others of its paths may be possible.
    """
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    rows = results.withColumn("scenario_id", scenario_id(external)).withColumn("_rank", rank[F.col("bucket")])
    rows = rows if "label" in rows.columns else rows.withColumn("label", F.lit(""))
    groups = rows.groupBy("workflow", "scenario_id").agg(
        F.count(F.lit(1)).alias("path_count"), F.coalesce(F.min(F.when(F.col("covered"), F.col("number"))), F.min("number")).alias("main_number"),
        F.min_by(F.struct("bucket", "label"), F.struct("_rank", "number")).alias("_best"),
    )
    runs = ran.withColumn("scenario_id", scenario_id(external)).groupBy("workflow", "scenario_id").agg(F.sum("runs").alias("runs"))
    if capped is None:
        out = groups.join(runs, ["workflow", "scenario_id"], "left").withColumn("_capped", F.lit(False))
    else:
        out = groups.join(runs, ["workflow", "scenario_id"], "full").join(capped.select("workflow").distinct().withColumn("_capped", F.lit(True)), "workflow", "left")
        out = out.withColumn("_capped", F.coalesce("_capped", F.lit(False))).where("_capped or path_count is not null")
    out = out.withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("covered", F.col("runs") > 0)
    limit = F.col("_capped") & (F.col("_best.bucket") == "cannot-be-tested")
    bucket = F.when(F.col("covered"), "testable").when(limit, "needs-review").otherwise(F.col("_best.bucket"))
    own = F.coalesce("_best.label", F.lit("default"))
    label = F.when(F.col("covered") & (F.coalesce("_best.bucket", F.lit("")) != "testable"), "default").when(limit & ~F.col("covered"), "model-limit").otherwise(own)
    return out.select("workflow", "scenario_id", F.coalesce("path_count", F.lit(0)).alias("path_count"), "main_number", bucket.alias("bucket"), label.alias("label"), "runs", "covered")


def breakdown(results: DataFrame, policy: str = "count_as_testable") -> DataFrame:
    """workflow, a count and a covered count of each bucket, and counted_paths, counted_covered, counted_percent: what the policy counts as testable.

    count_as_testable adds the paths that need review; exclude leaves them out but for those nothing explains
    (label unexplained).
    """
    counts = []
    for b in RANKS:
        name = b.replace("-", "_")
        counts += [F.count_if(F.col("bucket") == b).alias(name), F.count_if((F.col("bucket") == b) & F.col("covered")).alias(f"{name}_covered")]
    counts_in = (F.col("bucket") == "testable") | ((F.col("bucket") == "needs-review") & (F.lit(policy == "count_as_testable") | (F.col("label") == "unexplained")))
    out = results.groupBy("workflow").agg(*counts, F.count_if(counts_in).alias("counted_paths"), F.count_if(counts_in & F.col("covered")).alias("counted_covered"))
    return out.withColumn("counted_percent", percent(F.col("counted_covered"), F.col("counted_paths")))


def call_outcomes(sites: DataFrame, taken: DataFrame) -> DataFrame:
    """workflow, call, outcome, seen: each call's outcomes, success first, then failure, then kinds of failure; sites: workflow, call, outcome, edge_id."""
    rows = sites.join(taken.select("workflow", "edge_id").distinct().withColumn("_t", F.lit(True)), ["workflow", "edge_id"], "left")
    order = F.when(F.col("outcome") == "success", 0).when(F.col("outcome") == "failure", 1).otherwise(2)
    by = rows.groupBy("workflow", "call", "outcome").agg(F.coalesce(F.bool_or("_t"), F.lit(False)).alias("seen"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("workflow", "call").orderBy(order, "outcome")))


def handlers(registered: DataFrame, ran: DataFrame, least_recorder: int = 0) -> DataFrame:
    """workflow, handler, kind, branches, branches_taken, exercised (yes, no, not recorded); registered: workflow, handler, kind, branches, recordable; ran: workflow, handler, branches_taken."""
    rows = registered.join(ran.groupBy("workflow", "handler").agg(F.max("branches_taken").alias("branches_taken"), F.count(F.lit(1)).alias("_n")), ["workflow", "handler"], "left")
    exercised = F.when(F.col("_n") > 0, "yes").when(~F.col("recordable"), "not recorded").otherwise("no")
    return rows.select("workflow", "handler", "kind", "branches", F.coalesce("branches_taken", F.lit(0)).alias("branches_taken"), exercised.alias("exercised"))


def main_numbers(rows: DataFrame, most_scenarios: int = 500, target: float = 80.0) -> DataFrame:
    """rows with kind, covered, total, percent, met: the one number of each workflow.

    rows: workflow, event_loop, capped, scenarios_measured, forced (or null), and <kind>_covered, <kind>_total of
    handler, path, scenario, branch. Forced first (if it can be used), then by handlers in an event loop, by paths
    if they are all listed, by scenarios if they are few, by branches.
    """
    usable = {"handler": F.lit(True), "path": ~F.col("capped"), "scenario": F.col("scenarios_measured"), "branch": F.lit(True)}
    kind = F.when(F.lit(False), "")
    for k, can in usable.items():
        kind = kind.when((F.col("forced") == k) & can, k)
    kind = kind.when(F.col("event_loop") & (F.col("handler_total") > 0), "handler").when(~F.col("capped"), "path").when(F.col("scenarios_measured") & (F.col("scenario_total") <= most_scenarios), "scenario").otherwise("branch")
    out = rows.withColumn("kind", kind)
    pick = lambda what: F.coalesce(*[F.when(F.col("kind") == k, F.col(f"{k}_{what}")) for k in usable])
    out = out.withColumn("covered", pick("covered")).withColumn("total", pick("total"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.floor(F.col("covered") * 1000.0 / F.col("total") + 0.5) / 10.0)
    return out.withColumn("percent", share).withColumn("measured", F.col("total") > 0).withColumn("met", (F.col("total") > 0) & (share >= target))


def hidden_covered(results: DataFrame) -> DataFrame:
    """Covered paths that a classification takes out of the testable ones: always empty, or the result is wrong."""
    return results.where(F.col("covered") & (F.col("bucket") != "testable"))
