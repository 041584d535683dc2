"""Which missed paths can be tested: rules, overrides, marks and detectors over paths, as joins.

Facts say what an exit implies: workflow, edge_id, kind, name, negated. A verdict is workflow, path_id, source,
rank, bucket, label; of a path's verdicts the one of the lowest rank decides, the others are further reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the sources of verdicts; detectors follow in the order of DETECTORS.
OVERRIDE, MARK, RULE, DETECTOR = 0, 1, 2, 3
#: Detectors in the order in which they are tried (fixed values).
DETECTORS = (
    "closed-signal-channel",
    "constant-condition",
    "version-gate-old-branch",
    "history-limit",
    "contradictory",
    "same-list-loops",
    "list-built-from-list",
    "loop-exit-before-first-trip",
    "contradictory-get-result",
    "value-flow",
    "possible-correlation",
    "unknown-input-type",
    "likely-defect",
)
#: Kinds of facts that decide alone: kind of fact, detector, bucket if it is certain (fixed values).
ALONE = (
    ("closed-signal-channel", "closed-signal-channel", "cannot-be-tested"),
    ("constant-condition", "constant-condition", "cannot-be-tested"),
    ("version-gate", "version-gate-old-branch", "needs-special-test"),
    ("history-limit", "history-limit", "needs-special-test"),
)
#: Detectors whose answers an analysis of values gives, the one that counts first; label of its own or the detector's name (fixed values).
ANALYSED = ("value-flow", "likely-defect", "possible-correlation", "unknown-input-type")


def rule_matches(steps: Column, when: Column, without: Column) -> Column:
    """Whether steps take one exit at least of every set in when, and none of any set in without; order does not count."""
    return F.forall(when, lambda s: F.arrays_overlap(s, steps)) & ~F.exists(without, lambda s: F.arrays_overlap(s, steps))


def by_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts of rules: workflow, rule_id, when, without (arrays of arrays of exits), bucket, label, off."""
    r = rules.where("not off").select("workflow", "rule_id", "when", "without", "bucket", "label")
    return paths.join(r, "workflow").where(rule_matches(F.col("steps"), F.col("when"), F.col("without"))).select("workflow", "path_id", F.concat(F.lit("rule:"), "rule_id").alias("source"), F.lit(RULE).alias("rank"), "bucket", "label")


def by_overrides(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """Verdicts of single paths: overrides of workflow, path_id, bucket, label."""
    return paths.select("workflow", "path_id").join(overrides, ["workflow", "path_id"]).select("workflow", "path_id", F.lit("override").alias("source"), F.lit(OVERRIDE).alias("rank"), "bucket", "label")


def by_marks(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """Verdicts of comments on exits: marks of workflow, edge_id, label."""
    return paths.join(marks, "workflow").where(F.array_contains("steps", F.col("edge_id"))).select("workflow", "path_id", F.lit("comment").alias("source"), F.lit(MARK).alias("rank"), F.lit("cannot-be-tested").alias("bucket"), "label").distinct()


def _on_paths(paths: DataFrame, facts: DataFrame, *kinds: str) -> DataFrame:
    steps = paths.select("workflow", "path_id", F.posexplode("steps").alias("at", "edge_id"))
    return steps.join(facts.where(F.col("kind").isin(*kinds)), ["workflow", "edge_id"])


def _verdict(rows: DataFrame, detector: str, bucket: str = "cannot-be-tested", label: str | None = None) -> DataFrame:
    return rows.select("workflow", "path_id").distinct().select("workflow", "path_id", F.lit(detector).alias("source"), F.lit(DETECTOR + DETECTORS.index(detector)).alias("rank"), F.lit(bucket).alias("bucket"), F.lit(label or detector).alias("label"))


def contradictions(paths: DataFrame, facts: DataFrame, kind: str = "same-value", detector: str = "contradictory") -> DataFrame:
    """Paths that need one value to be true at one decision and false at another; for results of one call: kind same-result, detector contradictory-get-result."""
    rows = _on_paths(paths, facts, kind).groupBy("workflow", "path_id", "name").agg(F.min("negated").alias("_a"), F.max("negated").alias("_b"), F.count_distinct(F.regexp_extract("edge_id", r"^([^.]*)", 1)).alias("_n"))
    return _verdict(rows.where("_a <> _b and _n > 1"), detector, label="contradictory")


def single_facts(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdicts of detectors that one exit decides (ALONE). Facts may have a column likely: what is not certain needs review, unless another exit of the path is certain."""
    if "likely" not in facts.columns:
        facts = facts.withColumn("likely", F.lit(False))
    out = None
    for kind, detector, bucket in ALONE:
        found = _on_paths(paths, facts, kind).groupBy("workflow", "path_id").agg(F.bool_and(F.coalesce("likely", F.lit(False))).alias("_likely"))
        sure, unsure = _verdict(found.where("not _likely"), detector, bucket), _verdict(found.where("_likely"), detector, "needs-review", "needs-review")
        out = sure.unionByName(unsure) if out is None else out.unionByName(sure).unionByName(unsure)
    return out


def skipped_and_ran(paths: DataFrame, facts: DataFrame, kind: str = "same-list", detector: str = "same-list-loops") -> DataFrame:
    """Paths on which one loop over a list runs and another over the same list does not (negated marks the exit without a trip); for a list built from another: kind built-list, detector list-built-from-list."""
    rows = _on_paths(paths, facts, kind).groupBy("workflow", "path_id", "name").agg(F.min("negated").alias("_a"), F.max("negated").alias("_b"))
    return _verdict(rows.where("_a <> _b"), detector, label="same-list-loops")


def leaves_before_trip(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """Paths that leave a loop which always makes a first trip without one; name is the loop's iterating exit."""
    rows = paths.join(facts.where("kind = 'first-trip-always'"), "workflow").where(F.array_contains("steps", F.col("edge_id")) & ~F.array_contains("steps", F.col("name")))
    return _verdict(rows, "loop-exit-before-first-trip", label="impossible-loop-exit")


def analysed(claims: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts of an analysis of values; claims: workflow, path_id, detector (of ANALYSED), label (a claim's kind). Of a path's claims the first in the order of ANALYSED that is not off counts.

    Only a value-flow claim says that a path cannot be tested; the others ask for a review.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in ANALYSED if d not in off]), F.col("detector"))
    one = claims.withColumn("_p", place).where("_p > 0").groupBy("workflow", "path_id").agg(F.min_by(F.struct("detector", "label"), F.struct("_p", "label")).alias("c"))
    flow = F.col("c.detector") == "value-flow"
    rank = F.array_position(F.array(*map(F.lit, DETECTORS)), F.col("c.detector")).cast("int") + DETECTOR - 1
    return one.select("workflow", "path_id", F.col("c.detector").alias("source"), rank.alias("rank"), F.when(flow, "cannot-be-tested").otherwise("needs-review").alias("bucket"), F.when(flow, F.col("c.label")).otherwise(F.col("c.detector")).alias("label"))


def enabled(verdicts: DataFrame, off: tuple[str, ...]) -> DataFrame:
    """verdicts without those of detectors that are off; a name that no detector has is an error."""
    unknown = sorted(set(off) - set(DETECTORS))
    if unknown:
        raise ValueError(f"no such detectors: {', '.join(unknown)}")
    return verdicts.where(~F.col("source").isin(*off)) if off else verdicts


def classified(results: DataFrame, verdicts: DataFrame, sure: bool = True) -> DataFrame:
    """results (with covered) with bucket, label, source, extra (further reasons). A covered path is testable whatever is said; the default is testable too.

    sure=False lets claims that something cannot be tested count as needs-review. What the analysis of values claims
    counts only where nothing else hit.
    """
    by_values = F.col("source").isin(*ANALYSED)
    others = verdicts.where(~by_values).select("workflow", "path_id").distinct()
    verdicts = verdicts.where(~by_values).unionByName(verdicts.where(by_values).join(others, ["workflow", "path_id"], "left_anti"))
    order = Window.partitionBy("workflow", "path_id").orderBy("rank", "source", "label")
    best = verdicts.withColumn("_n", F.row_number().over(order))
    top = best.groupBy("workflow", "path_id").agg(F.min_by(F.struct("bucket", "label", "source"), "_n").alias("v"), F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col("source")))).alias("extra"))
    out = results.join(top, ["workflow", "path_id"], "left")
    bucket = F.when(F.col("covered") | F.col("v").isNull(), "testable").otherwise(F.col("v.bucket"))
    if not sure:
        bucket = F.when(bucket == "cannot-be-tested", "needs-review").otherwise(bucket)
    said = ~F.col("covered") & F.col("v").isNotNull()
    return out.select(*results.columns, bucket.alias("bucket"), F.when(said, F.col("v.label")).otherwise("default").alias("label"), F.when(said, F.col("v.source")).otherwise("default").alias("source"), F.coalesce("extra", F.array().cast("array<string>")).alias("extra"))


def distrusted(results: DataFrame, unmatched: DataFrame) -> DataFrame:
    """results, in which claims of detectors and rules that a path cannot be tested are taken back (needs-review, label
    model-limit) where a run of the workflow that fits no path puts the map itself in doubt.

    unmatched: workflow, followed (the steps that fitted) of runs that nobody has explained. A claim is in doubt if it rests
    on the step at which one of them leaves the map or on a later one; `uses`, if results has it, is the last step that a
    claim rests on, from 1; 0 or null: not known, which any such run puts in doubt. What a person has said stays.
    """
    leaves = unmatched.groupBy("workflow").agg(F.min(F.size("followed") + 1).alias("_leaves"))
    uses = F.coalesce(F.col("uses"), F.lit(0)) if "uses" in results.columns else F.lit(0)
    reached = F.col("_leaves").isNotNull() & ((uses == 0) | (uses >= F.col("_leaves")))
    doubt = reached & (F.col("bucket") == "cannot-be-tested") & ~F.col("source").isin("override", "comment")
    said = {"bucket": "needs-review", "label": "model-limit"}
    out = results.join(leaves, "workflow", "left")
    return out.select(*[F.when(doubt, said[c]).otherwise(F.col(c)).alias(c) if c in said else F.col(c) for c in results.columns])


def unused(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rules that no path met: stale entries of a configuration."""
    return entries.join(verdicts.select("workflow", F.regexp_replace("source", "^rule:", "").alias("rule_id")).distinct(), ["workflow", "rule_id"], "left_anti")


def suggested_rules(results: DataFrame) -> DataFrame:
    """workflow, paths, decisions, hits_only: for the paths of a workflow that need review, the exits that all of them take, and whether no other path takes them all."""
    review = results.where("bucket = 'needs-review'")
    n = review.groupBy("workflow").agg(F.count(F.lit(1)).alias("paths"))
    common = review.select("workflow", F.explode(F.array_distinct("steps")).alias("e")).groupBy("workflow", "e").agg(F.count(F.lit(1)).alias("_n")).join(n, "workflow").where("_n = paths").groupBy("workflow").agg(F.array_sort(F.collect_list("e")).alias("decisions"))
    drafts = n.join(common, "workflow", "left").withColumn("decisions", F.coalesce("decisions", F.array().cast("array<string>")))
    others = results.where("bucket <> 'needs-review'").join(drafts, "workflow").where(F.size(F.array_except("decisions", "steps")) == 0).select("workflow").distinct().withColumn("_other", F.lit(True))
    return drafts.join(others, "workflow", "left").select("workflow", "paths", "decisions", (F.col("_other").isNull() & (F.size("decisions") > 0)).alias("hits_only"))
