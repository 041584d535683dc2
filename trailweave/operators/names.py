"""Names as users write them, resolved to workflows; filters by function and by module.

A workflow is package.Function or package.Type.Method, and may have folders before the package. It may be written from any
of its dotted parts on, and without its folders; a method's type also as (*Type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(name: Column) -> Column:
    """A name without the marks of a pointer type and outer white space."""
    return F.replace(F.replace(F.trim(name), F.lit("(*"), F.lit("")), F.lit(")"), F.lit(""))


def forms(workflow: Column) -> Column:
    """All ways to write a workflow."""
    rest = lambda text: F.filter(
        F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(F.substr(text, i, F.lit(1)) == ".", F.substr(text, i + 1, F.length(text)))), lambda x: x.isNotNull(),
    )
    plain = F.substring_index(workflow, "/", -1)
    return F.array_distinct(F.concat(F.array(workflow), rest(workflow), F.array(plain), rest(plain)))


def resolved(names: DataFrame, workflows: DataFrame) -> DataFrame:
    """name, workflow, matches, problem: each distinct name (names: name) with the one workflow that it means.

    Where none or several match, workflow is null and problem says none or several; matches holds those that match, in order.
    """
    asked = names.select("name", written(F.col("name")).alias("_form")).distinct()
    known = workflows.select("workflow").where("workflow <> ''").distinct().select("workflow", F.explode(forms(F.col("workflow"))).alias("_form"))
    met = asked.join(known, "_form", "left").groupBy("name").agg(F.array_sort(F.collect_set("workflow")).alias("matches"))
    n = F.size("matches")
    return met.select("name", F.when(n == 1, F.element_at("matches", 1)).alias("workflow"), "matches", F.when(n == 0, "none").when(n > 1, "several").alias("problem"))


def scope_problems(include: DataFrame, exclude: DataFrame, workflows: DataFrame) -> DataFrame:
    """list, name, problem: names of the lists (name) that mean no workflow or several, and those whose workflow stands in both lists."""
    of = lambda names, label: resolved(names, workflows).withColumn("list", F.lit(label))
    rows = of(include, "include").unionByName(of(exclude, "exclude"))
    both = rows.where("workflow is not null").groupBy("workflow").agg(F.count_distinct("list").alias("_lists")).where("_lists = 2")
    twice = rows.join(both, "workflow").select("list", "name", F.lit("in both lists").alias("problem"))
    return rows.where("problem is not null").select("list", "name", "problem").unionByName(twice)


def of_function(traces: DataFrame, workflows: DataFrame, name: str) -> DataFrame:
    """traces with other: whether their workflow is one of workflows but not the one that name means (triage tells them apart).

    A name that means none or several is an error.
    """
    found = resolved(workflows.sparkSession.createDataFrame([(name,)], "name string"), workflows).first()
    if found.problem:
        raise ValueError(f"{name!r} means {found.problem} of the workflows" + (f": {', '.join(found.matches[:5])}" if found.matches else ""))
    others = workflows.select("workflow").distinct().where(F.col("workflow") != found.workflow).withColumn("_other", F.lit(True))
    return traces.join(others, "workflow", "left").withColumn("other", F.coalesce("_other", F.lit(False))).drop("_other")


def of_module(workflows: DataFrame, want: str) -> DataFrame:
    """The workflows (with module_path, module_dir) of the module that want names: its path, its folder, or the last parts of its folder."""
    tail = "/" + want.removeprefix("./")
    return workflows.where((F.col("module_path") == want) | (F.col("module_dir") == want) | F.concat(F.lit("/"), "module_dir").endswith(tail))
