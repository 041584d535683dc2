"""What to do with results: entries of a configuration held against paths, the path that a test of an outcome would run,
and drafts of rules for paths that need review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators.classify import rule_matches
from trailweave.operators.compare import RISKS, risk_of
from trailweave.sources.rounds import kept

#: A label that says a bug blocks a path, not that the path is impossible (a fixed value).
DEFECT = "known-defect"


def entry_hits(paths: DataFrame, rules: DataFrame, overrides: DataFrame, marks: DataFrame) -> DataFrame:
    """workflow, kind, id, path_id, covered: which paths each entry hits."""
    key = ["workflow", "path_id", "covered"]
    entry = lambda rows, kind, id_: rows.select("workflow", F.lit(kind).alias("kind"), id_.alias("id"), "path_id", "covered")
    on = rules.where("not off").select("workflow", "rule_id", "when", "without")
    ruled = paths.join(on, "workflow").where(rule_matches(F.col("steps"), F.col("when"), F.col("without")))
    single = paths.select(*key).join(overrides.select("workflow", "path_id"), ["workflow", "path_id"])
    marked = paths.join(marks.select("workflow", "edge_id"), "workflow").where(F.array_contains("steps", F.col("edge_id")))
    return entry(ruled, "rule", F.col("rule_id")).unionByName(entry(single, "override", F.col("path_id"))).unionByName(entry(marked, "comment", F.col("edge_id"))).distinct()


def checked_entries(paths: DataFrame, rules: DataFrame, overrides: DataFrame, marks: DataFrame, explained: DataFrame | None = None, unmatched: DataFrame | None = None) -> DataFrame:
    """workflow, kind, id, label, hits, covered, refused, stale, unsure, overlaps: each entry of a configuration.

    paths: workflow, path_id, steps, covered, and maybe truncated; rules: as for classify.by_rules; overrides: workflow,
    path_id, untestable, label; marks: workflow, edge_id; explained and unmatched (workflow, steps_id, and runs): runs that
    fit no path, of which an entry has `hits`. refused: paths that a run took although the entry says none can or a bug
    stops it. stale: it hits nothing; unsure: nothing of a list that is not whole. overlaps: other entries that hit a path
    that it hits.

    Two entries meet on many paths, so the sets of entries that hit a path are first made distinct, and pairs come from these.
    """
    rule = rules.where("not off").select("workflow", F.lit("rule").alias("kind"), F.col("rule_id").alias("id"), "label", F.lit(True).alias("_claims"))
    single = overrides.select("workflow", F.lit("override").alias("kind"), F.col("path_id").alias("id"), F.when(F.col("untestable"), F.col("label")).otherwise("").alias("label"), F.col("untestable").alias("_claims"))
    mark = marks.select("workflow", F.lit("comment").alias("kind"), F.col("edge_id").alias("id"), F.lit("manual").alias("label"), F.lit(True).alias("_claims")).distinct()
    entries = rule.unionByName(single).unionByName(mark)
    key = ["workflow", "kind", "id"]
    hits = kept(entry_hits(paths, rules, overrides, marks))
    counts = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("hits"), F.count_if("covered").alias("covered"))
    met = hits.groupBy("workflow", "path_id").agg(F.array_sort(F.collect_set(F.struct("kind", "id"))).alias("met"))
    met = met.where(F.size("met") > 1).select("workflow", "met").distinct()
    pairs = met.select("workflow", "met", F.explode("met").alias("one")).select("workflow", "one", F.explode("met").alias("other")).where("one <> other")
    name = F.concat_ws(" ", "other.kind", "other.id")
    overlaps = pairs.groupBy("workflow", F.col("one.kind").alias("kind"), F.col("one.id").alias("id")).agg(F.array_sort(F.collect_set(name)).alias("overlaps"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = entries.join(counts, key, "left").join(overlaps, key, "left")
    if "truncated" in paths.columns:
        rows = rows.join(paths.groupBy("workflow").agg(F.bool_or("truncated").alias("_part")), "workflow", "left")
    else:
        rows = rows.withColumn("_part", F.lit(False))
    part, none = F.coalesce("_part", F.lit(False)), F.col("hits").isNull()
    out = rows.select(
        *key, "label", zero("hits").alias("hits"), zero("covered").alias("covered"), F.when(F.col("_claims"), zero("covered")).otherwise(F.lit(0).cast("long")).alias("refused"),
        (none & ~part).alias("stale"), (none & part).alias("unsure"), F.coalesce("overlaps", F.array().cast("array<string>")).alias("overlaps"),
    )
    if explained is None:
        return out
    left = unmatched.groupBy("workflow", "steps_id").agg(F.sum("runs").alias("hits"))
    runs = explained.select("workflow", "steps_id").distinct().join(left, ["workflow", "steps_id"], "left")
    none_long, no = F.lit(0).cast("long"), F.lit(False)
    return out.unionByName(runs.select(
        "workflow", F.lit("explained-trace").alias("kind"), F.col("steps_id").alias("id"), F.lit("").alias("label"), zero("hits").alias("hits"), none_long.alias("covered"), none_long.alias("refused"),
        F.col("hits").isNull().alias("stale"), no.alias("unsure"), F.array().cast("array<string>").alias("overlaps"),
    ))


def check_code(entries: DataFrame) -> DataFrame:
    """code: 1 if a run disproves an entry, else 0."""
    return entries.agg(F.when(F.count_if(F.col("refused") > 0) > 0, 1).otherwise(0).alias("code"))


def outcome_risk(kind: Column, label: Column, old: Column) -> Column:
    """The risk of an outcome through which no listed path leads; old: it is the old side of a version check."""
    waits = kind.isin("selector", "wait")
    risk = F.when(old, RISKS[7]).when((kind == "errcheck") & (label == "failure"), RISKS[2])
    return risk.when(waits & label.contains("timeout"), RISKS[4]).when(waits, RISKS[5]).otherwise(RISKS[6])


def outcome_paths(missed: DataFrame, branch_exits: DataFrame, results: DataFrame, took: DataFrame, external: Column, deferred: Column, old: Column | None = None) -> DataFrame:
    """missed with risk, number, new_exits: the path that a test of each missed outcome would run, and what it risks.

    missed: workflow, branch_id, kind, label; branch_exits: workflow, branch_id, edge_id; results: listed paths with
    workflow, number, steps, covered; took: workflow, edge_id of the exits that some run took. external: the external steps
    of a row of results; deferred: whether its end undoes what was done; old: whether it is the old side of a version
    check, the least risk. The least risky path through an exit of the outcome that no run took is its path; ties go to the
    one with the fewest exits that no run took, then to the first. An outcome without one has the risk of its own kind and
    no number.
    """
    old = F.lit(False) if old is None else old
    tag = F.when(old, RISKS[7]).otherwise(risk_of(external, deferred))
    open_ = results.where("not covered").select("workflow", "number", "steps", tag.alias("_risk"))
    steps = kept(open_.select("workflow", "number", "_risk", F.explode("steps").alias("edge_id")).distinct())
    seen = took.select("workflow", "edge_id").distinct().withColumn("_seen", F.lit(1))
    new = steps.join(seen, ["workflow", "edge_id"], "left").groupBy("workflow", "number").agg(F.count_if(F.col("_seen").isNull()).alias("_new"))
    through = steps.join(new, ["workflow", "number"]).join(branch_exits.select("workflow", "branch_id", "edge_id"), ["workflow", "edge_id"])
    place = F.array_position(F.array(*map(F.lit, RISKS)), F.col("_risk"))
    best = through.groupBy("workflow", "branch_id").agg(F.min_by(F.struct("_risk", "number", "_new"), F.struct(-place, F.col("_new"), F.col("number"))).alias("_best"))
    own = outcome_risk(F.col("kind"), F.col("label"), F.coalesce("old", F.lit(False)) if "old" in missed.columns else F.lit(False))
    out = missed.join(best, ["workflow", "branch_id"], "left")
    return out.select(*missed.columns, F.coalesce("_best._risk", own).alias("risk"), F.col("_best.number").alias("number"), F.col("_best._new").alias("new_exits"))


def drafted_rules(results: DataFrame) -> DataFrame:
    """workflow, label, rule_id, when, path_ids, paths, exact: drafts of rules for the paths that need review and no run took.

    results: workflow, number, path_id, steps, covered, bucket, label. The paths of one workflow and label are one draft, of the
    exits that all of them take in the order of the first, if no other path takes all of these; else each path is a draft of
    its own, of all its exits (exact). Known defects are left out. Drafts are numbered over all workflows.
    """
    results = kept(results.select("workflow", "number", "path_id", "steps", "covered", "bucket", "label"))
    label = F.when(F.coalesce("label", F.lit("")) == "", "needs-review").otherwise(F.col("label"))
    review = results.where("not covered and bucket = 'needs-review'").withColumn("_label", label).where(F.col("_label") != DEFECT)
    key = ["workflow", "_label"]
    first = review.groupBy(*key).agg(F.count(F.lit(1)).alias("paths"), F.min_by("steps", "number").alias("_first"))
    shared = review.select(*key, F.explode(F.array_distinct("steps")).alias("_e")).groupBy(*key, "_e").agg(F.count(F.lit(1)).alias("_n"))
    shared = shared.join(first.select(*key, "paths"), key).where("_n = paths").groupBy(*key).agg(F.collect_set("_e").alias("_shared"))
    groups = first.join(shared, key, "left").withColumn("_shared", F.coalesce("_shared", F.array().cast("array<string>")))
    groups = groups.withColumn("when", F.filter("_first", lambda s: F.array_contains("_shared", s))).select(*key, "paths", "when")
    mine = review.select(*key, "path_id").withColumn("_mine", F.lit(True))
    every = results.select("workflow", "path_id", "steps").join(groups, "workflow").where((F.size("when") > 0) & (F.size(F.array_except("when", "steps")) == 0))
    strangers = every.join(mine, [*key, "path_id"], "left").where("_mine is null").select(*key).distinct().withColumn("_others", F.lit(True))
    groups = groups.join(strangers, key, "left").withColumn("_one", F.col("_others").isNull() & (F.size("when") > 0))
    rows = review.select(*key, "number", "path_id", "steps").join(groups.select(*key, F.col("when").alias("_when"), "_one"), key)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("number", "path_id"))), lambda x: x["path_id"])
    whole = rows.where("_one").groupBy(*key).agg(F.min("number").alias("number"), F.first("_when").alias("when"), ids.alias("path_ids"))
    each = rows.where("not _one").select(*key, "number", F.col("steps").alias("when"), F.array("path_id").alias("path_ids"))
    drafts = kept(whole.withColumn("exact", F.lit(False)).unionByName(each.withColumn("exact", F.lit(True))))
    # numbers: those of the workflows before, a row a workflow, and the place in one's own
    counts = drafts.groupBy("workflow").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("workflow").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("workflow").orderBy("_label", "number"))
    base = F.regexp_replace(F.concat_ws("-", F.lit("review"), "workflow", "_label"), "[^A-Za-z0-9_-]+", "-")
    named = drafts.join(before, "workflow").withColumn("rule_id", F.concat(base, F.lit("-"), place.cast("string")))
    return named.select("workflow", F.col("_label").alias("label"), "rule_id", "when", "path_ids", F.size("path_ids").cast("long").alias("paths"), "exact")
