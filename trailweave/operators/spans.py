"""Which external steps of a path stand in the body of a loop: intervals over its steps, by a fold in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loop_spans(steps: Column, external: Column, enters: Column, ends: Column) -> Column:
    """array of struct(loop, from, to) in the order in which loops are entered: the places [from, to) among the external steps.

    external: a map from an exit to its external steps; enters and ends: maps from an exit that goes into a loop's body, or
    round the loop, to the loop. The first step of an exit that enters is the loop's own; the body begins behind it. A body
    ends before the steps of the exit that goes round, or with the path where the loop is left another way (a break or a
    return). The round of a loop that was entered last ends first; an earlier one of the same loop runs to the path's end.
    """
    span = "array<struct<loop:string,from:int,to:int>>"
    zero = F.struct(F.lit(0).alias("n"), F.array().cast(span).alias("spans"))
    loops = lambda which, e: F.try_element_at(which, e)

    def step(a: Column, e: Column) -> Column:
        said = F.coalesce(F.try_element_at(external, e), F.array().cast("array<string>"))
        ended, entered = loops(ends, e), loops(enters, e)
        last = F.size(a["spans"]) - F.array_position(F.reverse(F.transform(a["spans"], lambda s: s["loop"])), ended)
        closes = lambda s, i: ended.isNotNull() & (s["loop"] == ended) & (i == last) & s["to"].isNull()
        closed = F.transform(a["spans"], lambda s, i: F.struct(s["loop"].alias("loop"), s["from"].alias("from"), F.when(closes(s, i), a["n"]).otherwise(s["to"]).alias("to")))
        own = F.struct(entered.alias("loop"), (a["n"] + F.least(F.size(said), F.lit(1))).alias("from"), F.lit(None).cast("int").alias("to"))
        return F.struct((a["n"] + F.size(said)).alias("n"), F.when(entered.isNotNull(), F.concat(closed, F.array(own))).otherwise(closed).cast(span).alias("spans"))

    whole = lambda a: F.transform(a["spans"], lambda s: F.struct(s["loop"].alias("loop"), s["from"].alias("from"), F.coalesce(s["to"], a["n"]).alias("to")))
    return F.aggregate(steps, zero, step, whole)
