"""Runs made from the driver's tables, since these hold no decision maps: what is a run here is a choice, not given data.

user_day: a user's events of a day, in order, as a run of the map SHOPPER.
order_lines: an order's return flags, in the order of its lines, as a path of the workflow of its priority.
customer_exits: a customer's orders as the decisions of a map; customer_runs: runs of it, by the flags of lines.
flag_exits: an order's lines as questions, of which those on one flag have one answer (flag_facts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions.ids import path_id, path_key
from trailweave.plans.pilot import exit_rows
from trailweave.sources.tables import START, exits

SHOPPER = {"shopper": {"J1": ("loop", {"iterate": "J2", "exit": "J3"}), "J2": ("switch", {"click": "J1", "error": "=failed"}), "J3": ("if", {"true": "=completed", "false": "=completed"})}}
STEPS = {"view": "J1.iterate", "signup": "J1.exit", "click": "J2.click", "error": "J2.error", "purchase": "J3.true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shopper_exits(spark: SparkSession) -> DataFrame:
    return exits(spark, exit_rows(SHOPPER))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow, run_id, test, status, function_hash, recorder, steps, conditions."""
    names = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", names[F.col("event_type")].alias("step"), F.concat(F.lit("c:"), F.col("event_id") % 7, F.when(F.col("value") > 20, ":t").otherwise(":f")).alias("c"))
    runs = events.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "step"))).alias("s"), F.array_sort(F.collect_set("c")).alias("conditions"))
    return runs.select(
        F.when(F.col("user_id") % 17 == 0, "ghost").otherwise("shopper").alias("workflow"), F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("run_id"),
        F.when(F.col("user_id") % 10 == 9, "").otherwise(F.concat(F.lit("Segment"), F.col("user_id") % 10)).alias("test"), F.when((F.col("user_id") + F.day("day")) % 9 == 0, "running").otherwise("complete").alias("status"),
        F.when(F.col("user_id") % 13 == 0, "old").otherwise("now").alias("function_hash"), (F.col("user_id") % 5 + 1).cast("int").alias("recorder"), F.transform("s", lambda x: x["step"]).alias("steps"), "conditions",
    )


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow, order_id, steps, end of each order; an order without lines has no step."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    none = F.array().cast("array<string>")
    steps = F.coalesce(F.transform("s", lambda x: x["l_returnflag"]), none)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderpriority").alias("workflow"), F.col("o_orderkey").alias("order_id"), steps.alias("steps"), F.col("o_orderstatus").alias("end"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow, path_id, path_key, steps, end, runs, covered (by orders whose key is divisible by 3), had (by 2): the distinct paths of all orders."""
    rows = order_runs(spark, sf_dir).withColumn("path_key", path_key(F.col("steps"), F.col("end")))
    out = rows.groupBy("workflow", "path_key").agg(F.first("steps").alias("steps"), F.first("end").alias("end"), F.count(F.lit(1)).alias("runs"), F.bool_or(F.col("order_id") % 3 == 0).alias("covered"), F.bool_or(F.col("order_id") % 2 == 0).alias("had"))
    return out.withColumn("path_id", path_id(F.col("steps"), F.col("end")))


def order_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each order: line n is the decision Jn, whose exit "next" leads to the following line (the last one: completed), and "back" ends as failed if the line was returned, else leads nowhere."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("s"))
    at = lines.select(F.col("l_orderkey").cast("string").alias("workflow"), F.size("s").alias("n"), F.posexplode(F.transform("s", lambda x: x["l_returnflag"])).alias("i", "flag"))
    junction, last = F.concat(F.lit("J"), F.col("i") + 1), F.col("i") + 1 == F.col("n")
    way = lambda label, ord_, kind, to: F.struct(F.concat(junction, F.lit(f".{label}")).alias("edge_id"), junction.alias("junction_id"), F.lit("if").alias("kind"), F.lit(label).alias("label"), F.lit(ord_).alias("ord"), kind.alias("to_kind"), to.alias("to_id"))
    on = way("next", 0, F.when(last, "end").otherwise("junction"), F.when(last, "completed").otherwise(F.concat(F.lit("J"), F.col("i") + 2)))
    back = way("back", 1, F.when(F.col("flag") == "R", "end").otherwise("dead"), F.when(F.col("flag") == "R", "failed").otherwise(""))
    start = F.struct(F.lit(START).alias("edge_id"), F.lit("").alias("junction_id"), F.lit("start").alias("kind"), F.lit("").alias("label"), F.lit(0).alias("ord"), F.lit("junction").alias("to_kind"), F.lit("J1").alias("to_id"))
    rows = at.select("workflow", F.explode(F.when(F.col("i") == 0, F.array(start, on, back)).otherwise(F.array(on, back))).alias("e"))
    return rows.select("workflow", "e.edge_id", "e.junction_id", "e.kind", "e.label", "e.ord", F.lit(False).alias("is_retry"), "e.to_kind", "e.to_id", F.lit(None).cast("string").alias("only_edge"))


def _exit(edge: Column, junction: Column, label: str, ord_: int, kind: Column, to: Column) -> Column:
    return F.struct(
        edge.alias("edge_id"), junction.alias("junction_id"), F.lit("if").alias("kind"), F.lit(label).alias("label"),
        F.lit(ord_).alias("ord"), F.lit(False).alias("is_retry"), kind.alias("to_kind"), to.alias("to_id"), F.lit(None).cast("string").alias("only_edge"),
    )


def _decision(labels: dict[str, tuple[Column, Column]]) -> Column:
    """The exits of the decision of place i (from 1), and START before the first."""
    junction = F.concat(F.lit("J"), F.col("i"))
    ways = [_exit(F.concat(junction, F.lit(f".{label}")), junction, label, n, *to) for n, (label, to) in enumerate(labels.items())]
    start = _exit(F.lit(START), F.lit(""), "", 0, F.lit("junction"), F.lit("J1"))
    return F.when(F.col("i") == 1, F.array(start, *ways)).otherwise(F.array(*ways))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow (the customer), i (from 1), n, sort and order_id of each order.

    sort: skip (low priority: goes on to the next order or the one after it), early (open: goes on or fails), else both
    (goes on either way).
    """
    by = Window.partitionBy("o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    sort = F.when(F.col("o_orderpriority") == "5-LOW", "skip").when(F.col("o_orderstatus") == "O", "early").otherwise("both")
    return orders.select(
        F.col("o_custkey").cast("string").alias("workflow"), F.row_number().over(by.orderBy("o_orderkey")).alias("i"),
        F.count(F.lit(1)).over(by).alias("n"), sort.alias("sort"), F.col("o_orderkey").alias("order_id"),
    )


def _ahead(by: int) -> tuple[Column, Column]:
    over = F.col("i") + by > F.col("n")
    return F.when(over, "end").otherwise("junction"), F.when(over, "completed").otherwise(F.concat(F.lit("J"), F.col("i") + by))


def customer_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each customer, its decisions the orders; the exits of each are first and second."""
    failed = (F.lit("end"), F.lit("failed"))
    second = [F.when(F.col("sort") == "skip", a).when(F.col("sort") == "early", b).otherwise(c) for a, b, c in zip(_ahead(2), failed, _ahead(1))]
    rows = customer_orders(spark, sf_dir).select("workflow", F.explode(_decision({"first": _ahead(1), "second": tuple(second)})).alias("e"))
    return rows.select("workflow", "e.*")


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow, run_id (1 to 7), steps: run r takes the second exit of an order whose line r was returned (flag R), else the first."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("returned"))
    orders = customer_orders(spark, sf_dir).join(lines.hint("merge"), F.col("order_id") == F.col("l_orderkey"), "left")
    orders = orders.groupBy("workflow").agg(F.array_sort(F.collect_list(F.struct("i", "sort", F.coalesce("returned", F.array().cast("array<int>")).alias("returned")))).alias("orders"))
    runs = orders.select("workflow", "orders", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("run"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("steps"))

    def step(a: Column, o: Column) -> Column:
        second = F.array_contains(o["returned"], F.col("run"))
        to = F.when(second & (o["sort"] == "early"), -1).when(second & (o["sort"] == "skip"), o["i"] + 2).otherwise(o["i"] + 1)
        taken = F.concat(F.lit("J"), o["i"], F.when(second, ".second").otherwise(".first"))
        here = a["at"] == o["i"]
        return F.struct(F.when(here, to).otherwise(a["at"]).alias("at"), F.when(here, F.concat(a["steps"], F.array(taken))).otherwise(a["steps"]).alias("steps"))

    return runs.select("workflow", F.col("run").cast("string").alias("run_id"), F.aggregate("orders", start, step, lambda a: a["steps"]).alias("steps"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    place = F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("l_orderkey").cast("string").alias("workflow"), place.alias("i"), F.count(F.lit(1)).over(by).alias("n"), F.col("l_returnflag").alias("flag"))


def flag_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each order: each line asks yes or no, and goes on either way."""
    rows = _flags(spark, sf_dir).select("workflow", F.explode(_decision({"yes": _ahead(1), "no": _ahead(1)})).alias("e"))
    return rows.select("workflow", "e.*")


def flag_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow, edge_id, name, value: all lines of one flag ask the same."""
    answer = F.explode(F.array(F.lit("yes"), F.lit("no"))).alias("value")
    rows = _flags(spark, sf_dir).select("workflow", "i", F.col("flag").alias("name"), answer)
    return rows.select("workflow", F.concat(F.lit("J"), "i", F.lit("."), "value").alias("edge_id"), "name", "value")


def order_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow, edge_id, steps, zero of the maps of order_exits: going on from a line of flag N ships, going back returns."""
    lines = _lines_of_orders(spark, sf_dir)
    next_ = F.when(F.col("flag") == "N", F.array(F.lit("shipped"))).otherwise(F.array().cast("array<string>"))
    each = F.explode(F.array(F.struct(F.lit("next").alias("way"), next_.alias("steps")), F.struct(F.lit("back").alias("way"), F.array(F.lit("returned")).alias("steps"))))
    rows = lines.select("workflow", "i", each.alias("e"))
    return rows.select("workflow", F.concat(F.lit("J"), F.col("i") + 1, F.lit("."), "e.way").alias("edge_id"), "e.steps", F.array().cast("array<string>").alias("zero"))


def _lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("s"))
    return lines.select(F.col("l_orderkey").cast("string").alias("workflow"), F.posexplode(F.transform("s", lambda x: x["l_returnflag"])).alias("i", "flag"))
