"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.plans.model import spread
from clusterlake.plans.scratch import released, shared_dir, small_batches, written  # noqa: F401

#: Ids that are broadcast at most (8 MB of them), and bits of a filter sent in their place beyond that (32 MB).
BROADCAST_IDS, FILTER_BITS = 1_000_000, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any store that Spark can read."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table, to be broadcast if it has no more than so many rows; the others' keys are left to adaptive joins, which split hot ones."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of df, all columns as they are, for whose batch of values in a column keep() is true: one pass without a shuffle, whatever is null in other columns."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(b.column(at)).astype(bool)))

    return df.mapInArrow(run, df.schema)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose key (a long) is in gone, a written table of distinct keys named like it. Rows with a null key stay.

    Few keys are broadcast, their number checked. Of many, a Bloom filter of fixed size is sent: it tells most rows that stay where they
    are read; what it holds for rejected is checked by a join of keys alone, and only the few rows it was wrong about move.
    """
    if gone.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(gone), key, "left_anti").select(*df.columns)
    place = lambda i: F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS))
    bits = gone.select(F.explode(F.array(*map(place, range(4)))).alias("at"))
    words = bits.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table_ = np.zeros(FILTER_BITS >> 6, np.int64)
    table_[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(table_)

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        found = np.ones(len(a), bool)
        for x in (a, b, c, d):
            at = x.to_numpy(np.int64)
            found &= (sent.value[at >> 6] >> (at & 63) & 1).astype(bool)
        return pd.Series(found)

    marked = df.withColumn("_held", F.col(key).isNotNull() & held(*map(place, range(4))))
    wrong = written(df.select(key).withColumn("_held", held(*map(place, range(4)))).where(F.col("_held") & F.col(key).isNotNull()).select(key).distinct().join(gone, key, "left_anti"), "kept")
    some = F.broadcast(wrong) if wrong.count() <= BROADCAST_IDS else wrong
    return marked.where("NOT _held").select(*df.columns).unionByName(marked.where("_held").join(some, key, "left_semi").select(*df.columns))
