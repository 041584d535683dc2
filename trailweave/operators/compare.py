"""Comparing results: a baseline, another version, gates, history, and what to do first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Risks of a missed outcome, the gravest first (fixed values).
RISKS = ("cancel", "compensation", "activity failure", "continue-as-new", "timers and timeouts", "signals and updates", "plain logic", "old version branches")
#: What a step of a call holds (fixed values).
CALLS = ("(activity)", "(local activity)", "(child workflow)", "(nexus operation)", "(helper)")
#: What a step of a cancelled run holds (fixed values).
CANCELS = ("cancel context", "cancel sent", "failure kind: cancelled", "canceled", "cancelled", "(timer): failure", "(wait): failure")


def risk_of(steps: Column, deferred: Column) -> Column:
    """The gravest risk of a list of external steps; deferred: whether the path's end undoes what was done.

    Compensation is a call after a failed call that followed a successful one.
    """
    any_of = lambda x, parts: F.greatest(*[x.contains(p) for p in parts]) if len(parts) > 1 else x.contains(parts[0])
    has = lambda *parts: F.exists(steps, lambda s: any_of(s, parts))
    none = F.struct(F.lit(False).alias("done"), F.lit(False).alias("failed"), F.lit(False).alias("undone"))

    def step(a: Column, s: Column) -> Column:
        call = any_of(s, CALLS)
        undone = call & a["failed"]
        return F.struct((a["done"] | (call & s.endswith(": success"))).alias("done"), (a["failed"] | (call & s.endswith(": failure") & a["done"])).alias("failed"), (a["undone"] | undone).alias("undone"))

    undone = F.aggregate(steps, none, step, lambda a: a["undone"])
    failed = F.exists(steps, lambda s: any_of(s, CALLS) & s.endswith(": failure"))
    cancel, compensation, failure, again, timer, signal, logic, old = map(F.lit, RISKS)
    return (
        F.when(has(*CANCELS), cancel).when(undone | deferred, compensation).when(failed | has("failure kind"), failure).when(has("continue-as-new"), again)
        .when(has("timer", "timeout", "wait with timeout"), timer).when(has("signal", "update"), signal).when(has("version") & has(": old"), old).otherwise(logic)
    )


def baseline_check(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """workflow, path_id, finding, was, bucket: lost: a run took it then and none does now; untested: testable, not covered and
    not testable then; review: needs review and did not then. A path may be lost and need review; one that the baseline
    doesn't know was nothing then, and one that is gone is no finding."""
    key = ["workflow", "path_id"]
    both = now.select(*key, "bucket", "covered").join(baseline.select(*key, F.col("bucket").alias("was"), F.col("covered").alias("had")), key, "left")
    is_new = lambda bucket: (F.col("bucket") == bucket) & ~F.col("was").eqNullSafe(F.lit(bucket))
    found = F.array_compact(F.array(
        F.when(F.col("had") & ~F.col("covered"), "lost"), F.when(is_new("testable") & ~F.col("covered"), "untested"), F.when(is_new("needs-review"), "review"),
    ))
    return both.select(*key, F.explode(found).alias("finding"), F.coalesce("was", F.lit("")).alias("was"), "bucket")


def snapshot_diff(base: DataFrame, now: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key, change: new, removed or changed rows of two snapshots, by one full outer join."""
    b, n = base.withColumn("_b", F.lit(True)).alias("b"), now.withColumn("_n", F.lit(True)).alias("n")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}"))
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"b.{v}").eqNullSafe(F.col(f"n.{v}"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "removed").when(differ, "changed")
    return b.join(n, on, "full").select(*[F.coalesce(f"n.{k}", f"b.{k}").alias(k) for k in key], change.alias("change")).where("change is not null")


def drops(base: DataFrame, now: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """workflow, was, percent: numbers that fell by more than tolerance."""
    return now.select("workflow", "percent").join(base.select("workflow", F.col("percent").alias("was")), "workflow").where(F.col("was") - F.col("percent") > tolerance)


def main_drops(base: DataFrame, now: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """workflow, finding, was, percent: workflows whose main number fell by more than tolerance (drop), that have none any more
    (not measured), or whose number is of another kind (kind changed, and so not compared).

    Rows: workflow, kind, percent; now has measured, too. Only workflows that the baseline has a number of are compared.
    """
    both = now.select("workflow", "kind", "percent", "measured").join(base.select("workflow", F.col("kind").alias("_kind"), F.col("percent").alias("was")), "workflow")
    fell = F.when(F.col("percent") < F.col("was") - tolerance, "drop")
    finding = F.when(~F.col("measured"), "not measured").when(~F.col("kind").eqNullSafe(F.col("_kind")), "kind changed").otherwise(fell)
    return both.select("workflow", finding.alias("finding"), "was", F.when(F.col("measured"), F.col("percent")).alias("percent")).where("finding is not null")


def new_outcomes(base: DataFrame, now: DataFrame) -> DataFrame:
    """workflow, branch_id, status: the outcomes that a version adds, but for those that can't happen; rows: the same columns."""
    added = now.join(base.select("workflow", "branch_id").distinct(), ["workflow", "branch_id"], "left_anti")
    return added.where("status <> 'impossible'").select("workflow", "branch_id", "status")


def new_coverage(outcomes: DataFrame) -> DataFrame:
    """covered, total, percent of new_outcomes; no row if there are none."""
    counts = outcomes.agg(F.count_if(F.col("status") == "covered").alias("covered"), F.count(F.lit(1)).alias("total")).where("total > 0")
    return counts.withColumn("percent", F.col("covered") * 100.0 / F.col("total"))


def tested_changes(base: DataFrame, now: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """snapshot_diff with tested: of what is new, whether a run covers it; now has covered, too."""
    change = snapshot_diff(base, now, key, values)
    on = [change[k].eqNullSafe(F.col(f"_{k}")) for k in key]
    known = now.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("covered").alias("_covered"))
    out = change.join(known, on, "left")
    return out.select(*key, "change", F.when(F.col("change") == "new", F.coalesce("_covered", F.lit(False))).alias("tested"))


def gates(totals: DataFrame, floors: dict[str, float]) -> DataFrame:
    """gate, value, floor, failed: one row a gate; totals is one row with a column for each."""
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(float(x)).alias("floor")) for g, x in floors.items()]))
    return totals.select(rows.alias("g")).select("g.*", (F.col("g.value") < F.col("g.floor")).alias("failed"))


def exit_code(gate_rows: DataFrame) -> DataFrame:
    """code: 2 if a gate failed, else 0."""
    return gate_rows.agg(F.when(F.coalesce(F.bool_or("failed"), F.lit(False)), 2).otherwise(0).alias("code"))


def history(runs: DataFrame, run: DataFrame | None = None, keep: int = 5) -> DataFrame:
    """The last `keep` runs (by time) of each project with the change since the run before, and whether the scope changed; runs: project, time, covered, paths, scope."""
    all_ = runs if run is None else runs.unionByName(run)
    w = Window.partitionBy("project").orderBy("time")
    last = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("time")))
    kept = all_.withColumn("_n", last).where(F.col("_n") <= keep).drop("_n")
    return kept.withColumn("change", F.col("covered") - F.lag("covered").over(w)).withColumn("new_scope", F.coalesce(F.col("scope") != F.lag("scope").over(w), F.lit(False)))


def missed_ranking(outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """outcomes (risk, missed_paths, missed_scenarios, file, line, branch_id, name) with rank and a name of its own: gravest first, then most paths, then place.

    Ranks count over the whole project: within a risk, after the outcomes of graver ones. Later outcomes of one name get a number, before the list is cut.
    """
    graver = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk")), F.lit(0)), F.lit(len(RISKS) + 1))
    rows = outcomes.withColumn("_risk", graver)
    within = Window.partitionBy("_risk").orderBy(F.desc(F.col("missed_paths") + F.col("missed_scenarios")), "file", "line", "branch_id")
    counts = rows.groupBy("_risk").agg(F.count(F.lit(1)).alias("_n"))  # a row a risk
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_risk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = rows.withColumn("_row", F.row_number().over(within)).join(F.broadcast(before), "_risk").withColumn("rank", (F.col("_before") + F.col("_row")).cast("int"))
    twin = F.row_number().over(Window.partitionBy("name").orderBy("rank"))
    named = ranked.withColumn("_n", twin).withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("name")))
    named = named.drop("_n", "_risk", "_row", "_before")
    return named.where(F.col("rank") <= limit) if limit else named


def tests_first(missed: DataFrame, limit: int | None = None) -> DataFrame:
    """workflow, hint, paths, variants: missed paths merged by what covers them; merged before they are cut."""
    out = missed.groupBy("workflow", "hint").agg(F.sum("missed").alias("paths"), F.count(F.lit(1)).alias("variants")).orderBy(F.desc("paths"), "workflow", "hint")
    return out.limit(limit) if limit else out


def sampled(branches: DataFrame, n: int, salt: str = "decision-sample") -> DataFrame:
    """n branches by the order of a salted hash of branch_id: the same ones each time."""
    return branches.orderBy(F.sha2(F.concat(F.lit(salt + "\n"), F.col("branch_id")), 256), "branch_id").limit(n)


def scope(workflows: DataFrame, include: DataFrame | None, exclude: DataFrame) -> DataFrame:
    """workflow, status (in scope, excluded, not included), reason; excluded beats not included. include, exclude: name (and reason)."""
    rows = workflows.select("workflow").join(exclude.select(F.col("name").alias("workflow"), F.col("reason").alias("_why")), "workflow", "left")
    rows = rows.join(include.select(F.col("name").alias("workflow"), F.lit(True).alias("_in")), "workflow", "left") if include is not None else rows.withColumn("_in", F.lit(True))
    return rows.select("workflow", F.when(F.col("_why").isNotNull(), "excluded").when(F.col("_in").isNull(), "not included").otherwise("in scope").alias("status"), F.coalesce("_why", F.lit("")).alias("reason"))


def suggestions(names: DataFrame, workflows: DataFrame, most: int = 3) -> DataFrame:
    """name, hint: for names that no workflow has, the nearest way to write one of theirs, case aside.

    A dotted name can be written whole or from any of its later parts on. Near is at most a third of the name's letters in
    edits, one at least and `most` at most; ties go to the lesser hint.

    What is written is cut into most + 1 pieces. Whatever is within `most` edits holds one of them unchanged and at
    most so many places away, so names meet by length, piece and its text, and only such pairs are compared.
    """
    parts = F.split("workflow", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    forms = workflows.select(F.explode(tails).alias("hint")).where("hint <> ''").distinct()
    unknown = names.select("name").distinct().join(forms.withColumnRenamed("hint", "name"), "name", "left_anti")
    cut = lambda i: F.floor(i * F.col("_length") / (most + 1)).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("_piece")
    size = cut(F.col("_piece") + 1) - cut(F.col("_piece"))
    known = forms.select("hint", F.lower("hint").alias("_w")).withColumn("_length", F.length("_w"))
    known = known.select("*", number).withColumn("_text", F.substr("_w", cut(F.col("_piece")) + 1, size))
    n = F.length("name")
    lengths = F.explode(F.sequence(F.greatest(n - most, F.lit(0)), n + most)).alias("_length")
    away = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("_away")
    asked = unknown.select("name", lengths).select("*", number).select("*", away)
    asked = asked.withColumn("_at", cut(F.col("_piece")) + F.col("_away")).where((F.col("_at") >= 0) & (F.col("_at") <= n))
    asked = asked.withColumn("_text", F.substr(F.lower("name"), F.col("_at") + 1, size))
    key = ["_length", "_piece", "_text"]
    met = asked.select("name", *key).distinct().join(known.select("hint", *key), key).select("name", "hint").distinct()
    limit = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / 3)))
    near = met.withColumn("_d", F.levenshtein(F.lower("name"), F.lower("hint"))).where(F.col("_d") <= limit)
    return near.groupBy("name").agg(F.min_by("hint", F.struct("_d", "hint")).alias("hint"))


def headline(numbers: DataFrame) -> DataFrame:
    """met, total, not_measured over all workflows' main numbers."""
    return numbers.agg(F.count_if("met").alias("met"), F.count_if("measured").alias("total"), F.count_if(~F.col("measured")).alias("not_measured"))
