"""What a configuration says of decisions in words: entries of rules, saved ids of paths, prefixes of pruned paths.

An entry is the text of a decision and the outcome taken, "if more --false". Where a workflow has several decisions
of one text, these are "if more", "if more #2", "if more #3", and an entry says which one it means: "if more #2
--false", "if more #2/3 --false" (the second of three: it no longer holds once there are more or fewer), "if more #1
--false" (the first one) or "any: if more --false" (each of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions.ids import UNIT, stable_id

#: The kinds of ends that a saved id may stand for (fixed values; the last one is an unknown end).
ENDS = ("completed", "failed", "continued-as-new", "")


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decision_table(decisions: DataFrame) -> DataFrame:
    """workflow, plain, full, edge_id: each outcome with its text without and with the decision's number.

    decisions: workflow, decision (its text, with " #2" and so on from the second one of a text), label, edge_id.
    A number is only left out of plain if the workflow has a decision of that text, too.
    """
    bare = F.regexp_replace("decision", r" #\d+$", "")
    known = decisions.select("workflow", F.col("decision").alias("_bare")).distinct().withColumn("_is", F.lit(True))
    rows = decisions.withColumn("_bare", bare).join(known, ["workflow", "_bare"], "left")
    exit_ = F.concat(F.lit(" --"), one_spaced(F.col("label")))
    base = F.when(F.col("_is"), F.col("_bare")).otherwise(F.col("decision"))
    return rows.select(
        "workflow", F.concat(base, exit_).alias("plain"), F.concat("decision", exit_).alias("full"), "edge_id"
    )


def resolved(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """entries (workflow, entry and others) with edges, options, problem: the exits that an entry stands for.

    edges is null where problem (unknown, ambiguous, count changed) is not; options are the texts that an ambiguous
    entry may mean. Each entry meets at most one row of each side, so nothing multiplies. A null entry is unknown.
    """
    every = decision_table(decisions)
    plain = every.groupBy("workflow", F.col("plain").alias("_text")).agg(
        F.array_sort(F.collect_set("full")).alias("_fulls"), F.array_sort(F.collect_set("edge_id")).alias("_of_plain")
    )
    full = every.groupBy("workflow", F.col("full").alias("_full")).agg(
        F.array_sort(F.collect_set("edge_id")).alias("_of_full")
    )
    said = one_spaced(F.regexp_replace(one_spaced(F.col("entry")), "^any:", ""))
    counted = r" #(\d+)/(\d+) --"
    rows = entries.withColumn("_any", F.coalesce(one_spaced(F.col("entry")).startswith("any:"), F.lit(False)))
    rows = rows.withColumn("_want", F.nullif(F.regexp_extract(said, counted, 2), F.lit("")).try_cast("int"))
    rows = rows.withColumn("_text", F.regexp_replace(said, counted, " #$1 --"))
    rows = rows.withColumn("_counted", F.when(F.col("_want").isNotNull(), F.regexp_replace("_text", r" #\d+ --", " --")))
    rows = rows.withColumn("_first", F.coalesce(F.col("_text").rlike(" #1 --"), F.lit(False)))
    rows = rows.withColumn("_full", F.regexp_replace("_text", " #1 --", " --"))
    now = plain.select("workflow", F.col("_text").alias("_counted"), F.size("_fulls").alias("_now"))
    rows = rows.join(now, ["workflow", "_counted"], "left").join(plain, ["workflow", "_text"], "left")
    rows = rows.join(full, ["workflow", "_full"], "left")
    n = F.when(F.col("_first"), 0).otherwise(F.coalesce(F.size("_fulls"), F.lit(0)))
    changed = F.col("_want").isNotNull() & (F.coalesce("_now", F.lit(0)) != F.col("_want"))
    one = F.when(n == 1, F.col("_of_plain")).when((n > 1) & F.col("_any"), F.col("_of_plain"))
    edges = one.when(n == 0, F.col("_of_full"))
    problem = F.when(changed, "count changed").when((n > 1) & ~F.col("_any"), "ambiguous").when(edges.isNull(), "unknown")
    return rows.select(
        *entries.columns,
        F.when(problem.isNull(), edges).alias("edges"),
        F.when(problem == "ambiguous", F.col("_fulls")).alias("options"),
        problem.alias("problem"),
    )


def checked_rules(resolved_entries: DataFrame) -> DataFrame:
    """workflow, rule_id, when, without, problems: rules whose entries are sets of exits, ready for classify.by_rules.

    resolved_entries: what resolved gives of entries with rule_id, ord and part (when or without). A rule with a
    problem in any entry is not to be applied: it comes with its problems and null sets.
    """
    sets = lambda part: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("ord", "edges")))), lambda x: x["edges"]
    )
    problems = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.concat_ws(": ", "entry", "problem"))))
    rows = resolved_entries.groupBy("workflow", "rule_id").agg(
        sets("when").alias("when"), sets("without").alias("without"), problems.alias("problems")
    )
    fine = F.size("problems") == 0
    return rows.select(
        "workflow", "rule_id", F.when(fine, F.col("when")).alias("when"),
        F.when(fine, F.col("without")).alias("without"), "problems",
    )


def pruned_by(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """paths with group: the first pruned group (of the least group number) whose prefix a path begins with, or null.

    groups: workflow, group, prefix (exits). A path's beginnings that are as long as some prefix of its workflow are
    looked up by their text: an equi-join instead of a comparison of each path with each prefix. The empty prefix
    prunes every path of its workflow.
    """
    text = lambda steps: F.array_join(steps, "\n")
    keys = groups.select("workflow", F.size("prefix").alias("_n"), text(F.col("prefix")).alias("_p"), "group")
    keys = keys.groupBy("workflow", "_n", "_p").agg(F.min("group").alias("group"))
    sizes = keys.groupBy("workflow").agg(F.collect_set("_n").alias("_sizes"))
    heads = paths.select("workflow", "path_id", "steps").join(sizes, "workflow")
    heads = heads.withColumn("_n", F.explode(F.filter("_sizes", lambda n: n <= F.size("steps"))))
    heads = heads.withColumn("_p", text(F.slice("steps", F.lit(1), F.col("_n"))))
    hit = heads.join(keys, ["workflow", "_n", "_p"]).groupBy("workflow", "path_id").agg(F.min("group").alias("group"))
    return paths.join(hit, ["workflow", "path_id"], "left").select(*paths.columns, "group")


def legacy_ids(paths: DataFrame) -> DataFrame:
    """workflow, path_id, legacy_id: the ids that a path had when helpers were not followed, one for each kind of end.

    paths: workflow, path_id, words (array of struct: decision, label, helper, which says that the step is in a helper
    or only there because one is followed).
    """
    own = F.filter("words", lambda w: ~w["helper"])
    parts = F.transform(own, lambda w: F.concat(w["decision"], F.lit(UNIT), one_spaced(w["label"])))
    ends = F.explode(F.array(*map(F.lit, ENDS))).alias("_end")
    rows = paths.select("workflow", "path_id", parts.alias("_parts"), ends)
    return rows.select("workflow", "path_id", stable_id(F.col("_parts"), F.col("_end")).alias("legacy_id")).distinct()


def moved_overrides(overrides: DataFrame, paths: DataFrame) -> DataFrame:
    """overrides (workflow, stable_id and others) with path_ids, found: the paths that each stands for now.

    An id that a path has now is "own"; one that vanished is looked up in the paths' legacy ids: one path is "moved",
    several are "ambiguous", none is "gone". paths: workflow, path_id, stable_id, words.
    """
    ids = lambda rows, name: rows.groupBy("workflow", "stable_id").agg(
        F.array_sort(F.collect_set("path_id")).alias(name)
    )
    now = ids(paths, "_own")
    before = ids(legacy_ids(paths).withColumnRenamed("legacy_id", "stable_id"), "_before")
    rows = overrides.join(now, ["workflow", "stable_id"], "left").join(before, ["workflow", "stable_id"], "left")
    several = F.size("_before") > 1
    found = F.when(F.col("_own").isNotNull(), "own").when(several, "ambiguous")
    found = found.when(F.col("_before").isNotNull(), "moved").otherwise("gone")
    return rows.select(*overrides.columns, F.coalesce("_own", "_before").alias("path_ids"), found.alias("found"))


def explained(results: DataFrame, ids: DataFrame) -> DataFrame:
    """stable_id, answer, workflows, and every other column of results: what is known of the paths that are asked for.

    ids: stable_id. An id fits paths of several workflows at times, as it is unique in one only; workflows says of how
    many. answer is found, unknown, beyond the list (unknown, and some list is truncated) or malformed.
    """
    asked = ids.select("stable_id").distinct()
    cut = results.agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("_cut"))  # one row
    of = results.groupBy("stable_id").agg(F.count_distinct("workflow").alias("workflows"))
    rows = asked.join(results, "stable_id", "left").join(of, "stable_id", "left").crossJoin(cut)
    answer = F.when(~F.coalesce(F.col("stable_id").rlike("^s1:[0-9a-f]{12}$"), F.lit(False)), "malformed")
    answer = answer.when(F.col("workflows").isNotNull(), "found").when(F.col("_cut"), "beyond the list").otherwise("unknown")
    rest = [c for c in results.columns if c != "stable_id"]
    return rows.select("stable_id", answer.alias("answer"), F.coalesce("workflows", F.lit(0)).alias("workflows"), *rest)


def testable_floor(workflows: DataFrame, stages: DataFrame, basis: str = "stage") -> DataFrame:
    """workflow, basis, covered, total: the parts of the number that a floor of testable coverage is held against.

    All workflows whose lists are whole are one part ("path", workflow empty). A capped one is a part of its own:
    by its stages' testable paths (stages that are too big to list left out), or by the exits taken in its whole map.
    workflows: workflow, capped, covered, total (testable paths), branches_taken, branches; stages: workflow, covered,
    total, cannot, big.
    """
    if basis not in ("stage", "branch"):
        raise ValueError(f"basis is stage or branch, not {basis}")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    under = workflows.where("not capped").agg(some("covered").alias("covered"), some("total").alias("total"))
    under = under.select(F.lit("").alias("workflow"), F.lit("path").alias("basis"), "covered", "total")
    capped = workflows.where("capped")
    if basis == "branch":
        parts = capped.select(
            "workflow", F.lit(basis).alias("basis"), F.col("branches_taken").cast("long").alias("covered"),
            F.col("branches").cast("long").alias("total"),
        )
        return under.unionByName(parts)
    listed = stages.where("not big").groupBy("workflow").agg(
        some("covered").alias("_covered"), some(F.col("total") - F.col("cannot")).alias("_total")
    )
    parts = capped.select("workflow").join(listed, "workflow", "left").select(
        "workflow", F.lit(basis).alias("basis"), F.coalesce("_covered", F.lit(0)).cast("long").alias("covered"),
        F.coalesce("_total", F.lit(0)).cast("long").alias("total"),
    )
    return under.unionByName(parts)
