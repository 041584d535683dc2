"""Results written out: snapshots, run history, and report formats, as rows of text that Spark writes."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.compare import history

SNAPSHOT = "workflow string, path_id string, bucket string, covered boolean"
TOOL, SNAPSHOT_VERSION = "trailweave", 1
HISTORY = "project string, time timestamp, covered long, paths long, scope string"


def write_snapshot(results: DataFrame, folder: str) -> None:
    """A baseline: every path with its bucket and whether it was covered, and who wrote it in which version."""
    made_by = F.lit(TOOL).alias("tool"), F.lit(SNAPSHOT_VERSION).alias("version")
    results.select("workflow", "path_id", "bucket", "covered", *made_by).write.mode("overwrite").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A baseline; columns that it lacks, another tool's rows and those of another version are an error."""
    rows = spark.read.parquet(folder)
    if missing := {"tool", "version", *(f.split()[0] for f in SNAPSHOT.split(", "))} - set(rows.columns):
        raise ValueError(f"not a baseline: {folder} lacks {sorted(missing)}")
    other = rows.where(~F.col("tool").eqNullSafe(TOOL) | ~F.col("version").eqNullSafe(SNAPSHOT_VERSION)).head()
    if other:
        raise ValueError(f"not a baseline of this version: {folder} is of {other.tool} {other.version}")
    return rows.select(*[F.col(n).cast(t) for n, t in (f.split() for f in SNAPSHOT.split(", "))])


def _states(spark: SparkSession, folder: str) -> list[str]:
    """The states of a history, the newest last."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    whole = [n for n in names if n.startswith("state-") and fs.exists(place.suffix(f"/{n}/_SUCCESS"))]
    return sorted(whole)


def read_history(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The runs of a history folder and a warning: one that is missing or damaged starts afresh and never fails."""
    none = spark.createDataFrame([], HISTORY)
    states = _states(spark, folder)
    if not states:
        return none, f"no history at {folder} yet"
    try:
        runs = spark.read.parquet(f"{folder}/{states[-1]}").select(none.columns).to(none.schema)
        wrong = runs.where("covered < 0 or paths < covered or covered is null or paths is null").head()
    except PySparkException as e:
        return none, f"the history at {folder} is damaged: {str(e).splitlines()[0]}"
    return (none, f"the history at {folder} is damaged: {wrong}") if wrong else (runs, "")


def append_history(spark: SparkSession, folder: str, run: DataFrame, keep: int = 5) -> DataFrame:
    """Adds one run a project to a history folder and gives the last `keep` runs with their changes.

    Only these are written, as a new state beside those before, so a failed job leaves the last one whole.
    """
    runs, _ = read_history(spark, folder)
    now = run.select(runs.columns).to(runs.schema)
    kept = history(runs, now, keep)
    states = _states(spark, folder)
    number = int(states[-1].removeprefix("state-")) + 1 if states else 1
    state = f"{folder}/state-{number:09d}"
    kept.select(runs.columns).write.mode("overwrite").parquet(state)
    return history(spark.read.parquet(state), keep=keep)


def json_report(results: DataFrame) -> DataFrame:
    """One JSON text a workflow: totals and the list of its paths, in order. A path list is bounded by its cap."""
    path = F.struct("number", F.col("path_id").alias("id"), "steps", "end", "covered", "runs")
    totals = F.struct(F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("covered")).alias("paths")
    by = results.groupBy("workflow").agg(totals, F.array_sort(F.collect_list(path)).alias("pathList"))
    return by.select("workflow", F.to_json(F.struct(F.col("workflow").alias("name"), "paths", "pathList")).alias("value"))


def xml_text(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def junit(numbers: DataFrame, target: float = 80.0) -> DataFrame:
    """value: one test case a workflow; not measured is skipped, a missed target is a failure."""
    name = xml_text(F.col("workflow"))
    inside = F.when(~F.col("measured"), "<skipped/>").when(~F.col("met"), F.format_string('<failure message="%s coverage %.1f%%, target %.0f%%"/>', "kind", "percent", F.lit(target))).otherwise("")
    return numbers.select("workflow", F.concat(F.lit('<testcase name="'), name, F.lit('">'), inside, F.lit("</testcase>")).alias("value"))


def cobertura(branches: DataFrame) -> DataFrame:
    """value: one line element a decision's line, with its branch rate; branches: file, line, taken (boolean)."""
    rate = branches.groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if("taken").alias("t"))
    text = F.format_string('<line number="%d" hits="%d" branch="true" condition-coverage="%d%% (%d/%d)"/>', "line", "t", F.floor(F.col("t") * 100 / F.col("n")), "t", "n")
    return rate.select("file", "line", text.alias("value"))


def sarif(missed: DataFrame, unread: DataFrame | None = None, top: int = 20) -> DataFrame:
    """value: one result a row; the top missed outcomes are warnings, places that couldn't be read are notes (a top-k report)."""
    row = lambda level: F.to_json(F.struct(F.lit(level).alias("level"), F.struct(F.col("name").alias("text")).alias("message"), "file", "line")).alias("value")
    out = missed.orderBy("rank", "workflow", "name").limit(top).select(row("warning"))
    return out if unread is None else out.unionByName(unread.select(row("note")))


def mermaid(exits: DataFrame) -> DataFrame:
    """workflow, value: a map as a flow chart."""
    edge = F.concat(F.lit("  "), F.when(F.col("edge_id") == "START", "Start").otherwise(F.col("junction_id")), F.lit(" -->|"), "label", F.lit("| "), F.when(F.col("to_kind") == "end", F.concat(F.lit("End_"), "to_id")).when(F.col("to_kind") == "retry", F.split_part("to_id", F.lit("."), F.lit(1))).otherwise(F.col("to_id")))
    return exits.where("not is_retry").groupBy("workflow").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.array_sort(F.collect_list(edge)), "\n")).alias("value"))


def _document(rows: DataFrame, order: list[str], head: Column, tail: str, between: str = "\n") -> DataFrame:
    """value: one text of all rows in order, between a head and a tail. rows: reports, one a workflow, file or place."""
    key = F.struct(*order, "value")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["value"]), between)
    return rows.agg(F.concat(head, F.lit(between if between == "\n" else ""), body, F.lit(tail)).alias("value"))


def junit_document(numbers: DataFrame, target: float = 80.0) -> DataFrame:
    """value: a whole JUnit file as one text; its length is bounded by the number of workflows."""
    cases = junit(numbers, target).join(numbers.select("workflow", "measured", "met"), "workflow")
    failed, skipped = F.count_if(F.col("measured") & ~F.col("met")), F.count_if(~F.col("measured"))
    head = F.format_string(
        '<?xml version="1.0" encoding="UTF-8"?>\n<testsuites>\n<testsuite name="coverage" tests="%d" failures="%d" skipped="%d">',
        F.count(F.lit(1)), failed, skipped,
    )
    return _document(cases, ["workflow"], head, "\n</testsuite>\n</testsuites>\n")


def cobertura_document(branches: DataFrame) -> DataFrame:
    """value: a whole Cobertura file as one text, a class a source file; bounded by the number of decisions."""
    lines = cobertura(branches).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    of = branches.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("taken").alias("t"))
    body = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    name, rate = xml_text(F.col("file")), F.format_string("%.4f", F.col("t") / F.col("n"))
    head = F.concat(F.lit('<class name="'), name, F.lit('" filename="'), name, F.lit('" branch-rate="'), rate, F.lit('">\n<lines>\n'))
    classes = lines.join(of, "file").select("file", "n", "t", F.concat(head, body, F.lit("\n</lines>\n</class>")).alias("value"))
    n, t = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))
    top = F.format_string(
        '<?xml version="1.0" encoding="UTF-8"?>\n<coverage branches-valid="%d" branches-covered="%d" branch-rate="%.4f">\n'
        '<packages>\n<package name="workflows">\n<classes>',
        n, t, F.when(n > 0, t / n).otherwise(0.0),
    )
    return _document(classes, ["file"], top, "\n</classes>\n</package>\n</packages>\n</coverage>\n")


def sarif_document(missed: DataFrame, unread: DataFrame | None = None, top: int = 20) -> DataFrame:
    """value: a whole SARIF 2.1.0 log as one text: the top missed outcomes, the gravest first, then unread places."""

    def result(level: str, rule: str, order: Column) -> list[Column]:
        place = F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region"))
        locations = F.array(F.struct(place.alias("physicalLocation"))).alias("locations")
        text = F.struct(F.lit(rule).alias("ruleId"), F.lit(level).alias("level"), F.struct(F.col("name").alias("text")).alias("message"), locations)
        return [F.lit(level == "note").alias("later"), order.cast("long").alias("place"), F.to_json(text).alias("value")]

    rows = missed.orderBy("rank", "workflow", "name").limit(top).select(*result("warning", "missed-outcome", F.col("rank")))
    if unread is not None:
        rows = rows.unionByName(unread.select(*result("note", "unread-place", F.col("line"))))
    head = F.lit(f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}"}}}},"results":[')
    return _document(rows, ["later", "place"], head, "]}]}", ",")
