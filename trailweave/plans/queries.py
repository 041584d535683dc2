"""The registered queries of the coverage operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import measures
from trailweave.functions.ids import branch_id, path_id, stable_id
from trailweave.operators import advice, alike, classify, compare, convert, coverage, entries, graphs, match, names, panels, paths, regions, roads, spans, stages, words
from trailweave.plans import pilot
from trailweave.plans.adapters import customer_exits, customer_runs, flag_exits, flag_facts, order_exits, order_external, order_paths, order_runs, shopper_exits, table, user_day
from trailweave.shipping import ship
from trailweave.sources import sinks
from trailweave.sources.rounds import kept
from trailweave.sources.tables import START

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Rules over the paths of orders: every set of `when` is met, none of `without` (fixed values).
RULES = [("many-returns", [["R"], ["A"]], [["N"]], "cannot-be-tested", "rule"), ("no-return", [["N"]], [["R", "A"]], "needs-review", "unexplained"), ("known", [["R", "A"], ["N"]], [], "needs-special-test", "known-defect")]


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def joined(steps: str | Column) -> Column:
    return F.array_join(steps, " ")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matched(user_day(spark, sf_dir), shopper_exits(spark))


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = spark.createDataFrame([("shopper", "now")], "workflow string, function_hash string")
    return match.triaged(_matches(spark, sf_dir), hashes)


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir).where("kind = 'counted'")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.path_results(paths.listed(shopper_exits(spark)), _counted(spark, sf_dir))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RULES, "rule_id string, when array<array<string>>, without array<array<string>>, bucket string, label string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workflow")).distinct().crossJoin(F.broadcast(rows)).withColumn("off", F.lit(False))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_paths(spark, sf_dir)
    return classify.classified(found, classify.by_rules(found, _rules(spark, sf_dir)))


@query
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_runs(spark, sf_dir)
    return rows.select("workflow", "order_id", joined("steps").alias("steps"), path_id(F.col("steps"), F.col("end")).alias("path_id"))


@query
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("workflow", "run_id", "known", "matched", F.coalesce("bad_step", F.lit(-1)).alias("bad_step"), "end", F.when(F.col("matched"), joined("path")).alias("path"))


@query
def mismatch_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.mismatch_cause(shopper_exits(spark), _matches(spark, sf_dir)).groupBy("cause").agg(F.count(F.lit(1)).alias("runs"))


@query
def trace_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir).groupBy("workflow", "kind").agg(F.count(F.lit(1)).alias("runs"))


@query
def unmatched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.unmatched_groups(_triaged(spark, sf_dir)).select("workflow", "steps_id", joined("steps").alias("steps"), "runs", "bad_step")


@query
def path_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.listed(pilot.pilot_exits(spark)).select("workflow", "number", joined("steps").alias("steps"), "end", "path_id")


@query
def legal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.legal_pairs(pilot.pilot_exits(spark))


@query
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.path_counts(pilot.pilot_exits(spark))


@query
def reachable_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reachable(pilot.pilot_exits(spark))


@query
def stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.gates(customer_exits(spark, sf_dir))


@query
def pilot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    exits, runs = pilot.pilot_exits(spark), pilot.pilot_traces(spark)
    matches = match.matched(runs, exits)
    found = coverage.path_results(paths.listed(exits), matches)
    branches = coverage.branch_coverage(exits, matches).select("workflow", "branches", "taken")
    return coverage.path_coverage(found).join(branches, "workflow").join(coverage.pair_coverage(exits, found, matches).withColumnRenamed("covered", "pairs_covered"), "workflow")


@query
def path_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("workflow", "path_id", joined("steps").alias("steps"), "end", "runs", "covered")


@query
def exits_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.taken_exits(_counted(spark, sf_dir))


@query
def decision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = coverage.run_paths(_counted(spark, sf_dir)).select("workflow", "steps", "runs")
    return paths.pairs_of(runs, shopper_exits(spark)).groupBy("workflow", "first", "second").agg(F.sum("runs").alias("runs"))


@query
def prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.prefixes(order_paths(spark, sf_dir)).select("workflow", joined("prefix").alias("prefix"), "runs")


@query
def missed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _results(spark, sf_dir).withColumn("bucket", F.when(F.col("number") == 2, "cannot-be-tested").otherwise("testable"))
    return coverage.missed_groups(found, _counted(spark, sf_dir)).select("workflow", joined("prefix").alias("prefix"), "step", "missed", "rank")


@query
def test_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run does outside itself are its steps but those of the last decision."""
    outside = F.array_join(F.filter("path", lambda s: ~s.startswith("J3")), " ")
    return coverage.test_results(_counted(spark, sf_dir), outside)


@query
def loop_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    loops = spark.createDataFrame([("shopper", "J1", "J1.iterate", "J1.exit", [])], "workflow string, junction_id string, iterate string, leave string, closes array<string>")
    return coverage.loop_rounds(_counted(spark, sf_dir), loops)


@query
def condition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = spark.createDataFrame([(w, f"c:{i}") for w in ("shopper", "ghost") for i in range(9)], "workflow string, condition_id string")
    return coverage.condition_coverage(atoms, user_day(spark, sf_dir))


@query
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_rules(order_paths(spark, sf_dir), _rules(spark, sf_dir)).select("workflow", "path_id", "source")


@query
def classified_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("workflow", "path_id", "bucket", "label", "source", F.size("extra").alias("extra"))


@query
def bucket_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.breakdown(_classified(spark, sf_dir))


@query
def contradictory_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = [("R", "same-value", "v", False), ("A", "same-value", "v", True)]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workflow")).distinct().crossJoin(F.broadcast(spark.createDataFrame(facts, "edge_id string, kind string, name string, negated boolean")))
    return classify.contradictions(order_paths(spark, sf_dir), rows).select("workflow", "path_id", "label")


@query
def rule_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.suggested_rules(_classified(spark, sf_dir)).select("workflow", "paths", joined("decisions").alias("decisions"), "hits_only")


@query
def outcome_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _classified(spark, sf_dir).withColumn("truncated", F.lit(False))
    every = found.select("workflow", F.explode("steps").alias("edge_id")).distinct()
    branches = every.withColumn("branch_id", branch_id(F.lit("orders"), F.col("workflow"), F.lit("flag"), F.col("edge_id"), F.lit(1)))
    taken = found.where("covered and runs > 40").select("workflow", F.explode("steps").alias("edge_id"))
    return coverage.outcome_status(branches, found, taken)


@query
def scenario_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _classified(spark, sf_dir).withColumn("number", F.conv(F.substring("path_id", 1, 8), 16, 10).cast("long"))
    external = F.array_append(F.array_compact(F.transform(F.col("steps"), lambda s: F.when(s != "N", s))), F.concat(F.lit("end: "), F.col("end")))
    listed = found.where("workflow <> '5-LOW' or size(steps) <= 4")  # one map has more paths than its list
    capped = found.where("workflow = '5-LOW'").select("workflow")
    groups = coverage.scenarios(listed, found.where("covered"), external, capped)
    return groups.withColumn("main_number", F.coalesce("main_number", F.lit(-1).cast("long")))


@query
def baseline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _classified(spark, sf_dir)
    was = F.when(F.col("runs") % 2 == 0, "cannot-be-tested").otherwise(F.col("bucket"))
    return compare.baseline_check(now.where("had").withColumn("bucket", was).withColumn("covered", F.col("runs") % 3 != 0), now)


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = order_runs(spark, sf_dir).withColumn("path_id", path_id(F.col("steps"), F.col("end")))
    side = lambda part: runs.where(part).groupBy("workflow", "path_id").agg(F.count(F.lit(1)).alias("runs"))
    return compare.snapshot_diff(side("order_id % 2 = 0"), side("order_id % 2 = 1"), ["workflow", "path_id"], ["runs"])


@query
def missed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = F.array(*map(F.lit, compare.RISKS))
    rows = order_paths(spark, sf_dir).where("not covered").groupBy("workflow", "steps").agg(F.count(F.lit(1)).alias("missed_paths"))
    rows = rows.select("workflow", F.sha2(F.concat_ws("|", "workflow", joined("steps")), 256).alias("branch_id"), F.element_at(risks, (F.size("steps") % 8 + 1).cast("int")).alias("risk"), "missed_paths", F.lit(0).alias("missed_scenarios"), F.lit("orders").alias("file"), F.size("steps").alias("line"), F.concat(F.lit("Test"), F.size("steps").cast("string")).alias("name"))
    return compare.missed_ranking(rows).select("workflow", "branch_id", "risk", "missed_paths", "rank", "name")


@query
def tests_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_paths(spark, sf_dir).where("not covered").select("workflow", F.coalesce(F.try_element_at("steps", F.lit(1)), F.lit("")).alias("hint"), F.lit(1).alias("missed"))
    return compare.tests_first(rows)


@query
def priority_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.path_coverage(order_paths(spark, sf_dir))
    return rows.withColumn("main", measures.main_percent(F.col("covered"), F.col("paths"))).withColumn("grade", measures.grade(F.col("percent")))


@query
def main_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = coverage.breakdown(_classified(spark, sf_dir))
    rows = b.select(
        "workflow", (F.col("workflow") == "1-URGENT").alias("event_loop"), (F.col("counted_paths") > 100).alias("capped"), F.lit(True).alias("scenarios_measured"), F.when(F.col("workflow") == "5-LOW", "branch").alias("forced"),
        F.lit(3).alias("handler_covered"), F.lit(4).alias("handler_total"), F.col("counted_covered").alias("path_covered"), F.col("counted_paths").alias("path_total"), F.col("counted_covered").alias("scenario_covered"),
        F.col("counted_paths").alias("scenario_total"), F.lit(2).alias("branch_covered"), F.lit(3).alias("branch_total"),
    )
    return coverage.main_numbers(rows).select("workflow", "kind", "covered", "total", "percent", "met")


@query
def ci_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = coverage.path_coverage(order_paths(spark, sf_dir)).agg((F.sum("covered") * 100 / F.sum("paths")).alias("paths"), F.min("percent").alias("worst"))
    return compare.gates(totals, {"paths": 50.0, "worst": 10.0})


@query
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("project"), F.date_trunc("month", "o_orderdate").cast("date").alias("time")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("covered"), F.count(F.lit(1)).alias("paths"))
    return compare.history(runs.withColumn("scope", F.quarter("time").cast("string"))).select("project", F.col("time").cast("string").alias("time"), "covered", "paths", F.coalesce("change", F.lit(0)).alias("change"), "new_scope")


@query
def branch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the 20 customers of the smallest salted hashes."""
    return compare.sampled(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("branch_id")), 20)


@query
def scope_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("workflow")).distinct()
    include = names.where("workflow >= 'M'").select(F.col("workflow").alias("name"))
    exclude = names.where(F.length("workflow") % 2 == 0).select(F.col("workflow").alias("name"), F.lit("even").alias("reason"))
    return compare.scope(names, include, exclude)


@query
def handler_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    registered = spark.createDataFrame([("app", "view", "signal", 2, True), ("app", "click", "update", 1, True), ("app", "refund", "query", 0, True), ("app", "audit", "validator", 3, False)], "workflow string, handler string, kind string, branches int, recordable boolean")
    ran = events.where("value > 30").select(F.lit("app").alias("workflow"), F.col("event_type").alias("handler"), (F.col("user_id") % 3).alias("branches_taken"))
    return coverage.handlers(registered, ran)


@query
def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "lineitem").select(F.lit("ship").alias("workflow"), F.concat("l_returnflag", "l_linestatus").alias("edge_id"))
    sites = [("ship", "Send", "success", "NO"), ("ship", "Send", "failure", "RF"), ("ship", "Send", "timeout", "XX"), ("ship", "Bill", "failure", "AF"), ("ship", "Bill", "success", "ZZ")]
    return coverage.call_outcomes(spark.createDataFrame(sites, "workflow string, call string, outcome string, edge_id string"), taken)


@query
def covered_stay_testable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.hidden_covered(_classified(spark, sf_dir)).select("workflow", "path_id")


#: Facts on the flags of orders: exit, kind, name, negated, likely (fixed values).
FACTS = [
    ("R", "same-value", "v", False, False), ("A", "same-value", "v", True, False), ("N", "version-gate", "", False, False), ("A", "closed-signal-channel", "", False, True),
    ("R", "history-limit", "", False, True), ("N", "history-limit", "", False, False), ("R", "first-trip-always", "N", False, False),
]


def _claims(found: DataFrame) -> DataFrame:
    """What an analysis of values has claimed of paths, by the first letters of their ids."""
    starts = F.substring("path_id", 1, 1)
    claim = lambda where, detector, label: found.where(where).select("workflow", "path_id", F.lit(detector).alias("detector"), F.lit(label).alias("label"))
    return claim(starts.isin("1", "2"), "value-flow", "impossible-nil").union(claim(starts.isin("2", "3", "4"), "likely-defect", "")).union(claim(starts.isin("4", "5"), "unknown-input-type", ""))


def _all_verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths of orders, and verdicts of every kind of source on them."""
    found = order_paths(spark, sf_dir)
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workflow")).distinct()
    facts = names.withColumn("f", F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("edge_id", "kind", "name", "negated", "likely"), f)]) for f in FACTS]))).select("workflow", "f.*")
    starts = F.substring("path_id", 1, 1)
    overrides = found.where(starts == "0").select("workflow", "path_id", F.lit("needs-special-test").alias("bucket"), F.lit("known-defect").alias("label"))
    marks = names.where("workflow = '1-URGENT'").select("workflow", F.lit("R").alias("edge_id"), F.lit("comment").alias("label"))
    claims = _claims(found)
    parts = (classify.by_overrides(found, overrides), classify.by_marks(found, marks), classify.by_rules(found, _rules(spark, sf_dir)), classify.single_facts(found, facts), classify.contradictions(found, facts), classify.leaves_before_trip(found, facts), classify.analysed(claims))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return found, out


def _every_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(*_all_verdicts(spark, sf_dir))


@query
def every_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_source(spark, sf_dir).select("workflow", "path_id", "bucket", "label", "source", F.array_join("extra", " ").alias("extra"))


@query
def detectors_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, verdicts = _all_verdicts(spark, sf_dir)
    return classify.classified(found, classify.enabled(verdicts, ("contradictory", "history-limit"))).groupBy("workflow", "source").agg(F.count(F.lit(1)).alias("paths"))


@query
def possible_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _every_source(spark, sf_dir).withColumn("suspect", F.coalesce(F.try_element_at("steps", F.lit(1)), F.lit(""))).withColumn("number", F.col("path_id"))
    return panels.possible_bugs(rows)


@query
def unused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _rules(spark, sf_dir).select("workflow", "rule_id")
    entries = entries.union(entries.where("rule_id = 'known'").select("workflow", F.lit("old")))
    return classify.unused(entries, classify.by_rules(order_paths(spark, sf_dir), _rules(spark, sf_dir))).select("workflow", "rule_id")


@query
def distrusted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that came as far as R, or A R, and then fitted no path."""
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workflow")).distinct()
    unmatched = names.select("workflow", F.when(F.col("workflow") < "3", F.array(F.lit("R"))).otherwise(F.array(F.lit("A"), F.lit("R"))).alias("followed"))
    claims = _every_source(spark, sf_dir).withColumn("uses", F.array_position("steps", "N"))
    return classify.distrusted(claims, unmatched).select("workflow", "path_id", "bucket", "label")


@query
def risk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.create_map(F.lit("N"), F.lit("ShipOrder (activity): success"), F.lit("R"), F.lit("ChargeCard (activity): failure"), F.lit("A"), F.lit("timer"))
    rows = order_paths(spark, sf_dir)
    external = F.concat(F.transform(F.col("steps"), lambda s: said[s]), F.when(F.col("end") == "P", F.array(F.lit('signal "pay"'))).otherwise(F.array().cast("array<string>")))
    return rows.select("workflow", "path_id", compare.risk_of(external, F.lit(False)).alias("risk"))


@query
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.outcome_summary(QUERIES["outcome_status"](spark, sf_dir))


@query
def acknowledged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = coverage.unmatched_groups(_triaged(spark, sf_dir))
    explained = groups.where(F.substring("steps_id", -1, 1).isin(*"02468ace")).select("workflow", "steps_id", F.lit("known").alias("reason"))
    return coverage.acknowledged(groups, explained)[0].select("workflow", "steps_id", "runs", "explained")


@query
def beyond_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.beyond_list(paths.listed(shopper_exits(spark), cap=2), _counted(spark, sf_dir)).select("workflow", joined("steps").alias("steps"), "end", "runs")


@query
def coverage_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_paths(spark, sf_dir)
    return compare.drops(coverage.path_coverage(found.withColumn("covered", F.col("had"))), coverage.path_coverage(found), 0.5)


@query
def gate_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.exit_code(QUERIES["ci_gates"](spark, sf_dir))


@query
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.path_coverage(order_paths(spark, sf_dir)).select("workflow", "covered", F.col("paths").alias("total"), "percent", (F.col("percent") >= 40).alias("met"))
    return panels.worst_first(rows)


@query
def branch_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = order_paths(spark, sf_dir).select("workflow", F.explode("steps").alias("edge_id"), (F.col("covered") & (F.col("runs") > 40)).alias("took"))
    of = every.groupBy("workflow", "edge_id").agg(F.bool_or("took").alias("took")).groupBy("workflow").agg(F.count(F.lit(1)).alias("branches"), F.count_if("took").alias("taken"))
    return panels.branch_headline(of)


@query
def forced_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are the first flags of orders, outcomes the second ones."""
    rows = order_paths(spark, sf_dir).where(F.size("steps") > 1).select("workflow", F.element_at("steps", 1).alias("decision"), F.element_at("steps", 2).alias("outcome"), (F.col("covered") & (F.col("runs") > 20)).alias("ran"))
    status = rows.groupBy("workflow", "decision", "outcome").agg(F.when(F.bool_or("ran"), "covered").otherwise("missed").alias("status"))
    return panels.forced_decisions(status).select("workflow", "decision", "outcome", F.array_join("tests_of", " ").alias("tests_of"))


@query
def decision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("l_returnflag") == "R", "noticed").when(F.col("l_returnflag") == "A", "survived").when(F.col("l_quantity") > 40, "flaky").otherwise("no visible effect")
    return panels.decision_check(table(spark, sf_dir, "lineitem").select(result.alias("result")))


@query
def anchor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    before = part.select(F.col("p_partkey").cast("string").alias("rule_id"), F.lit(1).alias("entry"), F.col("p_type").alias("decision"))
    now = part.select(F.col("p_partkey").cast("string").alias("rule_id"), F.lit(1).alias("entry"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("decision"))
    return panels.anchor_changes(before, now)


@query
def unmarked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of orders inside the markers of a helper; some runs lack the last one."""
    marked = F.concat(F.array(F.lit(">S1")), F.col("steps"), F.when(F.col("order_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("<S1"))))
    rows = order_runs(spark, sf_dir).select("order_id", match.unmarked(marked).alias("u"))
    return rows.select("order_id", joined("u.steps").alias("steps"), F.col("u.bad").alias("bad"))


@query
def stated_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.assumptions(order_paths(spark, sf_dir).select("workflow", F.array_distinct("steps").alias("assumptions")))


@query
def pilot_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of the pilot, counted from the maps alone."""
    return words.scenario_counts(pilot.pilot_exits(spark), pilot.pilot_external(spark))


@query
def order_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of maps made from the parts that orders hold: a decision a line, which leads to the next line or ends."""
    return graphs.path_counts(order_exits(spark, sf_dir))


@query
def order_map_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.listed(order_exits(spark, sf_dir)).select("workflow", "number", joined("steps").alias("steps"), "end")


#: Forms of an entry of a decision's text t (fixed values).
FORMS = (
    "{t} --true", "any: {t} --false", "{t} #1 --true", "{t} #2 --true", "{t} #2/2 --false", "{t} #1/3 --true",
    "{t}  #9 --false", "{t} --maybe",
)


def _part_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions whose texts are the types of parts, one for each remainder of their size, and entries of every form."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("workflow"), F.concat(F.lit("if "), "p_type").alias("t"), (F.col("p_size") % 3).alias("k")
    )
    place = Window.partitionBy("workflow", "t").orderBy("k")
    numbered = part.distinct().withColumn("n", F.row_number().over(place))
    text = F.when(F.col("n") == 1, F.col("t")).otherwise(F.concat("t", F.lit(" #"), F.col("n").cast("string")))
    rows = numbered.select("workflow", text.alias("decision"), F.explode(F.array(F.lit("true"), F.lit("false"))).alias("label"))
    decisions = rows.withColumn("edge_id", F.concat_ws(".", "decision", "label"))
    forms = F.posexplode(F.array(*[F.replace(F.lit(f), F.lit("{t}"), F.col("t")) for f in FORMS]))
    return decisions, part.select("workflow", "t").distinct().select("workflow", "t", forms.alias("ord", "entry"))


@query
def rule_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, said = _part_entries(spark, sf_dir)
    rows = entries.resolved(said, decisions)
    return rows.select(
        "workflow", "entry", F.array_join("edges", "|").alias("edges"), F.array_join("options", "|").alias("options"), "problem"
    )


@query
def checked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules for each text of a decision, of two entries each: one to meet and one to avoid."""
    decisions, said = _part_entries(spark, sf_dir)
    rule = F.concat("t", F.lit("/"), F.floor(F.col("ord") / 2).cast("string"))
    said = said.select("workflow", rule.alias("rule_id"), "ord", "entry", F.when(F.col("ord") % 2 == 0, "when").otherwise("without").alias("part"))
    sets = lambda c: F.array_join(F.transform(c, lambda s: F.array_join(s, "|")), ";")
    rows = entries.checked_rules(entries.resolved(said, decisions))
    return rows.select(
        "workflow", "rule_id", sets("when").alias("when"), sets("without").alias("without"), F.array_join("problems", ";").alias("problems")
    )


@query
def pruned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of orders held against the first two and the first three steps of paths that no order of a kind took."""
    found = order_paths(spark, sf_dir)
    missed = found.where("not covered and size(steps) > 3")
    heads = missed.where("had").select("workflow", F.slice("steps", 1, 2).alias("prefix"), F.lit(2).alias("group"))
    longer = missed.where("not had").select("workflow", F.slice("steps", 1, 3).alias("prefix"), F.lit(1).alias("group"))
    rows = entries.pruned_by(found, heads.unionByName(longer).distinct())
    return rows.select("workflow", "path_id", F.coalesce("group", F.lit(-1)).alias("group"))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of orders in words: the decision is "flag", steps N lie in a helper."""
    word = lambda s: F.struct(F.lit("flag").alias("decision"), s.alias("label"), (s == "N").alias("helper"))
    rows = order_paths(spark, sf_dir).withColumn("words", F.transform("steps", word))
    parts = F.transform("steps", lambda s: F.concat(F.lit("flag\x1f"), s))
    return rows.withColumn("stable_id", stable_id(parts, F.col("end"))).withColumn("truncated", F.lit(False))


@query
def legacy_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.legacy_ids(_worded(spark, sf_dir))


@query
def moved_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by the ids of today, by ids of before, and one that no path ever had."""
    found = _worded(spark, sf_dir)
    today = found.where("had").select("workflow", "stable_id")
    before = entries.legacy_ids(found).select("workflow", F.col("legacy_id").alias("stable_id"))
    gone = found.select("workflow", F.lit("s1:000000000000").alias("stable_id"))
    rows = entries.moved_overrides(today.union(before).union(gone).distinct(), found)
    return rows.select("workflow", "stable_id", F.array_join("path_ids", " ").alias("path_ids"), "found")


@query
def explained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every path of the workflow 1-URGENT, and answers to two ids that no path has."""
    found = _worded(spark, sf_dir).select("workflow", "stable_id", "path_id", "covered", "runs", "truncated")
    ids = found.where("workflow = '1-URGENT'").select("stable_id")
    ids = ids.union(spark.createDataFrame([("s1:000000000000",), ("s1:xyz",)], "stable_id string"))
    return entries.explained(found, ids).drop("truncated").na.fill(False, ["covered"]).na.fill(0, ["runs"])


@query
def floor_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows of orders, two of them capped; a path's length is its stage, and the longest ones are too big."""
    found = _classified(spark, sf_dir).withColumn("testable", F.col("bucket") == "testable")
    numbers = found.groupBy("workflow").agg(
        F.count_if(F.col("testable") & F.col("covered")).alias("covered"), F.count_if("testable").alias("total"),
        F.count_if("covered").alias("branches_taken"), F.count(F.lit(1)).alias("branches"),
    ).withColumn("capped", F.col("workflow") < "3")
    stages = found.groupBy("workflow", F.size("steps").alias("stage")).agg(
        F.count_if("covered").alias("covered"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("bucket") == "cannot-be-tested").alias("cannot"),
    ).withColumn("big", F.col("stage") > 5)
    return entries.testable_floor(numbers, stages).unionByName(entries.testable_floor(numbers, stages, "branch").where("basis = 'branch'"))


def _by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways through two stages of the flags of orders: what comes before the first N, and what follows from it on."""
    found = _classified(spark, sf_dir)
    names = found.select("workflow").distinct()
    exits = names.select("workflow", F.explode(F.array(*map(F.lit, "RAN"))).alias("edge_id")).withColumn("junction_id", F.col("edge_id"))
    gates = names.select("workflow", F.lit("N").alias("junction_id"), F.lit(1).alias("stage"))
    return panels.stage_coverage(found, gates, exits, most=100)


@query
def stage_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_stage(spark, sf_dir)


@query
def capped_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = coverage.path_coverage(order_paths(spark, sf_dir)).withColumn("capped", F.col("workflow") < "3")
    branches = order_paths(spark, sf_dir).select("workflow", F.explode("steps").alias("edge_id"), "covered").distinct()
    branches = branches.groupBy("workflow", "edge_id").agg(F.bool_or("covered").alias("took")).groupBy("workflow").agg(F.count(F.lit(1)).alias("branches"), F.count_if("took").alias("taken"))
    return panels.capped_headline(numbers, _by_stage(spark, sf_dir), branches)


@query
def handler_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handlers of handler_table; view is an exit of a selector as well and counts there alone."""
    selector = spark.createDataFrame([("app", "J9.view", 'signal "view"'), ("app", "J9.timer", "timer")], "workflow string, edge_id string, label string")
    taken = table(spark, sf_dir, "events").where("value > 30").select(F.lit("app").alias("workflow"), F.concat(F.lit("J9."), "event_type").alias("edge_id"))
    return panels.handler_stats(QUERIES["handler_table"](spark, sf_dir), selector, taken)


@query
def helper_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    helper = F.when(F.col("p_size") % 4 > 0, F.col("p_type"))
    return panels.helper_regions(table(spark, sf_dir, "part").select(F.col("p_brand").alias("workflow"), helper.alias("helper"), F.col("p_size").alias("decision"), (F.col("p_partkey") % 5).alias("site")))


@query
def same_list_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R runs the loop over a list and N skips another one over it."""
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workflow")).distinct()
    fact = lambda e, negated: names.select("workflow", F.lit(e).alias("edge_id"), F.lit("same-list").alias("kind"), F.lit("items").alias("name"), F.lit(negated).alias("negated"))
    return classify.skipped_and_ran(order_paths(spark, sf_dir), fact("R", False).unionByName(fact("N", True)))


@query
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and last parts of names, some with a letter or two too few, some like none of any workflow's."""
    names = table(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit(".")).alias("workflow")).distinct()
    last = F.substring_index("workflow", ".", -1)
    ways = [F.expr("substr(workflow, 2)"), F.col("workflow"), F.repeat("workflow", F.lit(3)), F.substr(last, F.lit(2)), last, F.concat(F.lit("x"), F.substr(last, F.lit(3), F.lit(2)))]
    wrong = names.select(F.explode(F.array(*ways)).alias("name"))
    return compare.suggestions(wrong.distinct(), names)


@query
def targets_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.headline(QUERIES["main_numbers"](spark, sf_dir).withColumn("measured", F.col("workflow") != "5-LOW"))


@query
def unread_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of orders, cut at three paths (each of their ends is one path's), and lines that no map could hold."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").cast("string").alias("workflow"), F.lit("unknown call").alias("what"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("where"))
    ends = order_exits(spark, sf_dir).where("to_kind = 'end'").groupBy("workflow").agg((F.count(F.lit(1)) > 3).alias("truncated"))
    return panels.unread(lines, ends, 3)


@query
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.junit(QUERIES["main_numbers"](spark, sf_dir).withColumn("measured", F.col("workflow") != "5-LOW"))


@query
def cobertura_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_quantity") > 25).alias("taken"))
    return sinks.cobertura(branches)


@query
def map_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.mermaid(order_exits(spark, sf_dir))


#: Ways up to which the stages of orders' maps are merged.
PART_MOST = 8

#: Ways up to which the stages of customers' maps are merged, so that most maps have several.
STAGE_MOST = 64


@query
def map_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.path_counts(customer_exits(spark, sf_dir))


@query
def map_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.reachable(customer_exits(spark, sf_dir))


@query
def map_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stages(customer_exits(spark, sf_dir), STAGE_MOST).select("workflow", "stage", "entry", "next", "paths", "big")


def _customer_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' exits, written once; which of their maps are alike, and the exits of one of each (see alike)."""
    exits = kept(customer_exits(spark, sf_dir))
    names, (maps,) = alike.alike(exits)
    return exits, names, maps


def _runs_by_path(runs: DataFrame, exits: DataFrame) -> DataFrame:
    """workflow, steps, end, runs of the runs that match."""
    return match.matched(runs, exits).where("matched").groupBy("workflow", F.col("path").alias("steps"), "end").agg(F.count(F.lit(1)).alias("runs"))


def _stage_maps(maps: DataFrame, cut: DataFrame, names: DataFrame) -> DataFrame:
    return alike.for_all(kept(stages.stage_map(maps, stages.members(maps, cut))), names)


@query
def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways of stages that runs took, wherever their whole path stands. A piece of a path that matched is a way of its stage,
    so the ways that no run took are not listed."""
    exits, names, maps = _customer_maps(spark, sf_dir)
    cut = stages.stages(maps, STAGE_MOST)
    hits = stages.stage_hits(_runs_by_path(customer_runs(spark, sf_dir), exits), _stage_maps(maps, cut, names))
    small = alike.for_all(cut.where("not big").select("workflow", "stage"), names)
    return hits.join(small.hint("merge"), ["workflow", "stage"]).select("workflow", "stage", "key", "runs")


@query
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of the maps with more paths than a list holds; no other map's stages are looked for."""
    exits, names, maps = _customer_maps(spark, sf_dir)
    capped = kept(roads.path_counts(maps).where(F.col("paths").cast("decimal(38,0)") > paths.CAP).select("workflow"))
    names = kept(names.join(capped.withColumnRenamed("workflow", "like"), "like", "left_semi"))
    maps = kept(maps.join(capped, "workflow", "left_semi"))
    cut = stages.stages(maps, STAGE_MOST)
    own = names.select("workflow")
    runs = _runs_by_path(customer_runs(spark, sf_dir).join(own, "workflow", "left_semi"), exits.join(own, "workflow", "left_semi"))
    found = alike.for_all(stages.stage_paths(maps, cut, STAGE_MOST), names)
    results = stages.stage_results(found, runs, _stage_maps(maps, cut, names))
    return stages.stage_totals(alike.for_all(cut, names), results, names)


@query
def pruned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed of maps whose questions have known answers, and the groups that are not."""
    listed, groups = paths.pruned(flag_exits(spark, sf_dir), flag_facts(spark, sf_dir))
    rows = listed.select("workflow", joined("steps").alias("steps"), F.lit("listed").alias("what"), F.lit("1").alias("paths"))
    return rows.unionByName(groups.select("workflow", joined("prefix").alias("steps"), F.col("name").alias("what"), "paths"))


def _own_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Overrides by the first letters of path ids, and one of a path that is no more; a mark on R in one workflow."""
    starts = F.substring("path_id", 1, 1)
    overrides = order_paths(spark, sf_dir).where(starts.isin("0", "1")).select("workflow", "path_id", (starts == "0").alias("untestable"), F.lit("known-defect").alias("label"))
    gone = spark.createDataFrame([("5-LOW", "gone", True, "known-defect")], overrides.schema)
    marks = spark.createDataFrame([("1-URGENT", "R")], "workflow string, edge_id string")
    return overrides.unionByName(gone), marks


@query
def entry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries held against the paths of orders; runs disprove those that say a path is impossible."""
    entries_ = advice.checked_entries(order_paths(spark, sf_dir), _rules(spark, sf_dir), *_own_entries(spark, sf_dir))
    return entries_.select("workflow", "kind", "id", "label", "hits", "covered", "refused", "stale", F.sha2(F.array_join("overlaps", ","), 256).alias("overlaps_sha256"))


@query
def outcome_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag at its place in an order is an exit; paths of which over 40 runs are known are covered."""
    said = F.create_map(F.lit("N"), F.lit("ShipOrder (activity): success"), F.lit("R"), F.lit("ChargeCard (activity): failure"), F.lit("A"), F.lit("timer"))
    found = order_paths(spark, sf_dir).withColumn("covered", F.col("covered") & (F.col("runs") > 40))
    found = found.withColumn("outside", F.transform("steps", lambda x: said[x])).withColumn("number", F.col("path_id"))
    found = found.withColumn("steps", F.transform("steps", lambda x, i: F.concat((i + 1).cast("string"), x)))
    took = found.where("covered").select("workflow", F.explode("steps").alias("edge_id")).distinct()
    exits = found.select("workflow", F.explode("steps").alias("edge_id")).distinct().join(took, ["workflow", "edge_id"], "left_anti")
    missed = exits.select("workflow", F.col("edge_id").alias("branch_id"), F.lit("if").alias("kind"), F.lit("true").alias("label"))
    return advice.outcome_paths(missed, exits.withColumn("branch_id", F.col("edge_id")), found, took, F.col("outside"), F.lit(False)).select("workflow", "branch_id", "risk", "number", "new_exits")


@query
def rule_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _every_source(spark, sf_dir).withColumn("number", F.col("path_id"))
    drafts = advice.drafted_rules(found)
    return drafts.select("workflow", "label", "rule_id", joined("when").alias("when"), F.sha2(F.array_join("path_ids", ","), 256).alias("paths_sha256"), "paths", "exact")


@query
def map_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.scenario_counts(order_exits(spark, sf_dir), order_external(spark, sf_dir))


@query
def map_scenario_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.scenario_words(order_exits(spark, sf_dir), order_external(spark, sf_dir))
    return found.select("workflow", "number", joined("steps").alias("steps"), "truncated")


@query
def main_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main numbers of two versions; one workflow has none any more, and one counts something else."""
    found = order_paths(spark, sf_dir)
    kind = F.when(F.col("workflow") == "4-NOT SPECIFIED", "scenario").otherwise("path")
    was = coverage.path_coverage(found.withColumn("covered", F.col("had"))).withColumn("kind", F.lit("path"))
    now = coverage.path_coverage(found).withColumn("kind", kind).withColumn("measured", F.col("workflow") != "5-LOW")
    return compare.main_drops(was.where("workflow <> '1-URGENT'"), now, 0.5)


def _outcomes_of(found: DataFrame) -> DataFrame:
    """A flag at its place in an order is an outcome."""
    rows = found.select("workflow", "covered", "bucket", F.explode(F.transform("steps", lambda x, i: F.concat((i + 1).cast("string"), x))).alias("branch_id"))
    rows = rows.groupBy("workflow", "branch_id").agg(F.bool_or("covered").alias("_c"), F.bool_and(F.col("bucket") == "cannot-be-tested").alias("_i"))
    return rows.select("workflow", "branch_id", F.when(F.col("_c"), "covered").when(F.col("_i"), "impossible").otherwise("missed").alias("status"))


@query
def new_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the paths that many orders take are the old version's."""
    found = _classified(spark, sf_dir)
    return compare.new_outcomes(_outcomes_of(found.where("runs > 2")), _outcomes_of(found))


@query
def new_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.new_coverage(QUERIES["new_outcomes"](spark, sf_dir))


@query
def tested_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of even orders against those of all, and whether an order divisible by 3 takes the new ones."""
    found = order_paths(spark, sf_dir)
    return compare.tested_changes(found.where("had"), found, ["workflow", "path_id"], ["end"])


def _helper_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as runs of an old map, and the lookups of the new one.

    A line of flag N is a decision of the order's own; one of another flag is taken in that flag's helper, entered and left
    around it. An order divisible by 7 has its last marker lost. The new map has no decision for seventh lines, and its unit of R
    none for suppliers of remainder 3.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    own, flag = F.col("l_returnflag") == "N", F.col("l_returnflag")
    kind = F.concat(F.lit("K"), (F.col("l_suppkey") % 4).cast("string"))
    lines = lines.select(
        F.col("o_orderpriority").alias("workflow"), F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_partkey", "l_suppkey", flag.alias("flag"),
        F.when(own, F.concat(F.lit("J"), F.col("l_linenumber"))).otherwise(F.concat(F.lit("S"), flag, F.lit("."), kind)).alias("old"),
        F.when(own, F.concat(F.lit("line "), F.col("l_linenumber"))).otherwise(F.concat(flag, F.lit(" "), kind)).alias("statement"),
    )
    steps = F.when(F.col("flag") == "N", F.array("old")).otherwise(F.array(F.concat(F.lit(">S"), "flag"), F.col("old"), F.concat(F.lit("<S"), "flag")))
    runs = lines.withColumn("s", steps).groupBy("workflow", "order_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "flag", "s"))).alias("l"))
    all_ = F.flatten(F.transform("l", lambda x: x["s"]))
    cut = F.when((F.col("order_id") % 7 == 0) & (F.element_at("l", -1)["flag"] != "N"), F.slice(all_, F.lit(1), F.size(all_) - 1)).otherwise(all_)
    runs = runs.select("workflow", "order_id", F.when(F.col("order_id") % 5 == 0, "now").otherwise("old").alias("function_hash"), cut.alias("steps"))
    site = F.when(F.col("flag") != "N", F.concat(F.lit("S"), "flag"))
    # written, since all lookups are made of these few rows: lines are joined with orders once for them, not for each
    old_exits = kept(lines.select("workflow", F.col("old").alias("edge_id"), site.alias("site_id"), "statement", F.lit("on").alias("label"), "flag", "l_linenumber").distinct())
    helpers = old_exits.where("site_id is not null").select("workflow", "site_id", F.concat(F.lit("H"), "flag").alias("unit_id"), F.col("flag").alias("body")).distinct()
    lost = ((F.col("flag") == "N") & (F.col("l_linenumber") == 7)) | (F.col("edge_id") == "SR.K3")
    new = F.when(F.col("flag") == "N", F.concat(F.lit("D"), F.expr("substring(edge_id, 2)"))).otherwise(F.concat(F.lit("H"), F.expr("substring(edge_id, 2)")))
    exits = old_exits.where(~lost).select("workflow", new.alias("edge_id"), F.when(F.col("flag") != "N", F.concat(F.lit("H"), "flag")).alias("unit_id"), "statement", "label").distinct()
    hashes = old_exits.select("workflow").distinct().withColumn("old_hash", F.lit("old"))
    of = convert.lookups(hashes, helpers.select("workflow", "site_id", "body"), old_exits.select("workflow", "edge_id", "site_id", "statement", "label").distinct(), helpers.select("workflow", "unit_id", "body"), exits)
    return runs, of


@query
def converted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = convert.prepared(*_helper_runs(spark, sf_dir))
    return rows.select("order_id", joined("steps").alias("steps"), joined("unit_hits").alias("unit_hits"), "bad_markers", "converted")


@query
def loop_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as steps: R goes into the loop of the supplier's remainder, A goes round it, N does something."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", (F.col("l_suppkey") % 2).cast("string")).alias("e")).alias("s"))
    runs = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["e"]).alias("steps"))
    texts = lambda pairs: F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    said = {k: F.array(*map(F.lit, v)) for k, v in {"N0": ["work"], "N1": ["work"], "R0": ["loop 0: 1+ rounds", "begin"], "R1": ["loop 1: 1+ rounds"], "A0": ["again"]}.items()}
    found = spans.loop_spans(F.col("steps"), texts(said), texts({"R0": F.lit("0"), "R1": F.lit("1")}), texts({"A0": F.lit("0"), "A1": F.lit("1")}))
    rows = runs.select(F.col("l_orderkey").alias("order_id"), F.posexplode(found).alias("number", "s"))
    return rows.select("order_id", "number", "s.loop", F.col("s.from").alias("from_step"), F.col("s.to").alias("to_step"))


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as workflows in folders, and names as parts are called, with and without what comes before."""
    part = table(spark, sf_dir, "part")
    own = F.replace("p_name", F.lit(" "), F.lit("."))
    full = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string"), F.lit("/"))).otherwise(""), "p_brand", F.lit("."), own)
    asked = F.array(own, F.concat("p_brand", F.lit("."), own), F.concat(F.lit("(*"), "p_type", F.lit(")")), full)
    return part.select(F.explode(asked).alias("name")).distinct(), part.select(full.alias("workflow")).distinct()


@query
def named_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names.resolved(*_named(spark, sf_dir))
    return rows.select("name", "workflow", F.array_join("matches", " ").alias("matches"), "problem")


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each order: J1 goes into its lines or around them; a line of flag R may fail, all others go on either way."""
    by = Window.partitionBy("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = lines.select(F.col("l_orderkey").cast("string").alias("workflow"), F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("i"), F.count(F.lit(1)).over(by).alias("n"), F.col("l_returnflag").alias("flag"))
    way = lambda at, label, ord_, kind, to: F.struct(F.concat(at, F.lit(f".{label}")).alias("edge_id"), at.alias("junction_id"), F.lit("if").alias("kind"), F.lit(label).alias("label"), F.lit(ord_).alias("ord"), kind.alias("to_kind"), to.alias("to_id"))
    name = lambda i: F.concat(F.lit("J"), i)
    j, end, last = F.lit("junction"), F.lit("end"), name(F.col("n") + 2)
    here, on, fails = name(F.col("i") + 1), name(F.col("i") + 2), F.col("flag") == "R"
    own = [way(here, "true", 0, j, on), way(here, "false", 1, F.when(fails, "end").otherwise("junction"), F.when(fails, "failed").otherwise(on))]
    start = F.struct(F.lit(START).alias("edge_id"), F.lit("").alias("junction_id"), F.lit("start").alias("kind"), F.lit("").alias("label"), F.lit(0).alias("ord"), j.alias("to_kind"), F.lit("J1").alias("to_id"))
    first = [start, way(F.lit("J1"), "true", 0, j, F.lit("J2")), way(F.lit("J1"), "false", 1, j, last), way(last, "true", 0, end, F.lit("completed")), way(last, "false", 1, end, F.lit("failed"))]
    rows = lines.select("workflow", F.explode(F.when(F.col("i") == 1, F.array(*first, *own)).otherwise(F.array(*own))).alias("e"))
    return rows.select("workflow", "e.edge_id", "e.junction_id", "e.kind", "e.label", "e.ord", F.lit(False).alias("is_retry"), "e.to_kind", "e.to_id", F.lit(None).cast("string").alias("only_edge"))


@query
def stage_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large stages of the maps of orders, cut at the region of their lines."""
    names, (exits,) = alike.alike(_around(spark, sf_dir))
    parts = regions.split(exits, stages.stages(exits, PART_MOST), PART_MOST)[0]
    return alike.for_all(parts, names).select("workflow", "stage", "of_stage", "entry", "paths", "big", "is_part", "split_from", "why")
