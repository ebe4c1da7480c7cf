"""Plain programs over the rows of a key, many keys in a call."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clusterlake.plans.scratch import small_batches

#: Rows that go back to Spark at a time.
ROWS = 10_000


def each_group(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], each: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """What each() makes of the rows of a key, sorted by order and then by the other columns, as rows of schema.

    Keys of few rows are the rule here, so that a call for each of them would cost more than the work: their rows travel as arrays, a
    batch of keys at a time. A key's rows are in memory together, as each() needs.
    """
    cols = [*order, *(c for c in df.columns if c not in (*order, *keys))]
    rows = F.array_sort(F.collect_list(F.struct(*cols))).alias("rows")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                key = {k: row[k] for k in keys}
                held.extend(each([key | r for r in row["rows"]]))
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    small_batches(df.sparkSession)
    return df.groupBy(*keys).agg(rows).mapInArrow(run, schema)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
