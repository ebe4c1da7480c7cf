"""A stream of new files into a run's tables: an extension, built on the incremental rules of operators.state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clusterlake.operators.pairs import missing_pairs, pairs_with


def stream_tokens(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).parquet(folder)


def keep_scoring(tokens: DataFrame, store: str, score: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Appends each batch's tokens to store/tokens and the scores of pairs that are new to store/edges.

    tokens: (bin, record_id, container_id, token). A batch's records meet each other and all before; score is given (bin, a, b)
    of pairs with a common token; only the batch's tokens are joined with the stored ones. A batch that is run again after
    a failure finds its own tokens and edges there, so that nothing is written twice.
    """
    spark = tokens.sparkSession

    def stored(name: str, schema) -> DataFrame:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema(schema).parquet(f"{store}/{name}") if there else spark.createDataFrame([], schema)

    def batch(rows: DataFrame, nth: int) -> None:
        old = stored("tokens", tokens.schema)
        new = rows.dropDuplicates(["record_id", "token"]).join(old.select("record_id").distinct(), "record_id", "left_anti")
        new.write.mode("append").parquet(f"{store}/tokens")
        every = stored("tokens", tokens.schema)
        pairs = pairs_with(rows.dropDuplicates(["record_id", "token"]), every)
        edges = stored("edges", score(pairs.limit(0)).schema)
        score(missing_pairs(pairs, edges)).write.mode("append").parquet(f"{store}/edges")

    return tokens.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
