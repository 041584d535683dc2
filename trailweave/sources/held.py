"""Groups of rows that are small enough to be worked on where they lie: one shuffle, many groups a task, no group a job.

A group of more than MOST_ROWS rows is never held in one row; the caller works on it by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trailweave.shipping import ship
from trailweave.sources.rounds import kept

#: Rows of a group up to which it is held in one row, and rows that a task gives back at once.
MOST_ROWS, OUT_ROWS = 1000, 5000


def large_of(rows: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys of groups with more than MOST_ROWS rows; None if there are none."""
    large = kept(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_ROWS).select(*key))
    return None if large.isEmpty() else large


def by_group(rows: DataFrame, key: list[str], solve: Callable[[Iterable[tuple]], Iterator[tuple]], out: str) -> DataFrame:
    """key and out (columns of a schema text): what solve yields for the rows of each group, which come as tuples without key."""
    ship(rows.sparkSession)
    schema = T._parse_datatype_string(out)
    fields = [c for c in rows.columns if c not in key]
    held = rows.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names = [*key, *schema.names]

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, lists = [part.column(k) for k in key], part.column("_rows")
            ends, values = lists.offsets.to_pylist(), lists.flatten()
            columns = [values.field(n).to_pylist() for n in range(len(fields))]
            base, of, found = ends[0], [], [[] for _ in types]

            def whole() -> pa.RecordBatch:
                taken = [k.take(pa.array(of, pa.int32())) for k in keys]
                return pa.RecordBatch.from_arrays([*taken, *[pa.array(v, t) for v, t in zip(found, types)]], names)

            for n in range(part.num_rows):
                start, end = ends[n] - base, ends[n + 1] - base
                for row in solve(list(zip(*[c[start:end] for c in columns]))):
                    of.append(n)
                    for column, value in zip(found, row):
                        column.append(value)
                    if len(of) >= OUT_ROWS:
                        yield whole()
                        of, found = [], [[] for _ in types]
            if of:
                yield whole()

    return held.mapInArrow(batches, T.StructType([*[rows.schema[k] for k in key], *schema.fields]))
