"""Maps that are alike: those with the same rows under another workflow's name have the same answers, so one of each is worked on.

Rows are compared by sums of their hashes: 160 bits and the number of rows of each table, whatever their order. No map is held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.sources.rounds import kept

#: Bits of a hash that are summed: a sum of up to 2^23 rows fits a long.
BITS = 40


def alike(first: DataFrame, *more: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(workflow, like: the least workflow of those with the same rows in all tables; the tables' rows of these alone).

    Tables have a workflow each; only workflows of the first count.
    """
    rows = None
    for n, table in enumerate((first, *more)):
        fields = [f for f in table.schema.fields if f.name != "workflow"]
        columns = [x for f in fields for x in (F.col(f.name), F.col(f.name).isNull(), *([F.size(f.name)] if isinstance(f.dataType, T.ArrayType) else []))]
        hashes = [F.xxhash64(F.lit(f"{n}:{seed}"), *columns) for seed in "ab"]
        of = table.select("workflow", F.lit(n).alias("_n"), *[h.alias(f"_{k}") for k, h in enumerate(hashes)])
        rows = of if rows is None else rows.unionByName(of)
    low = lambda c: F.col(c).bitwiseAND((1 << BITS) - 1)
    high = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    sums = [F.sum(of(f"_{k}")).alias(f"_s{k}{name}") for k in (0, 1) for name, of in (("l", low), ("h", high))]
    counts = [F.count_if(F.col("_n") == n).alias(f"_c{n}") for n in range(len(more) + 1)]
    marks = kept(rows.groupBy("workflow").agg(*sums, *counts).where("_c0 > 0"))
    same = [c for c in marks.columns if c != "workflow"]
    least = kept(marks.groupBy(*same).agg(F.min("workflow").alias("like")))
    names = kept(marks.join(least, same).select("workflow", "like"))
    one = least.select(F.col("like").alias("workflow"))
    return names, [kept(table.join(one, "workflow", "left_semi")) for table in (first, *more)]


def for_all(found: DataFrame, names: DataFrame) -> DataFrame:
    """found (workflow and more, of maps that others are like) for every workflow of names. Neither is sent to the driver: both grow with the maps."""
    return names.join(found.withColumnRenamed("workflow", "like").hint("merge"), "like").select(*found.columns)
