"""The record model, and the adapter that gives the driver's relational tables that shape.

A *record* belongs to a *container* (a source file) and a *bin*; its *genes* are ordered and carry *domains*. In the driver's tables a
record is an order, its container the customer, its bin the day, its genes the line items and a gene's domain the brand of the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of Jaccard, adjacency and sequence similarity, and the anchor boost, by class.
WEIGHTS = {
    "PKSI": (0.22, 0.02, 0.76, 1.0),
    "PKSother": (0.0, 0.68, 0.32, 4.0),
    "NRPS": (0.0, 0.0, 1.0, 4.0),
    "RiPP": (0.28, 0.01, 0.71, 1.0),
    "saccharide": (0.0, 1.0, 0.0, 1.0),
    "terpene": (0.2, 0.05, 0.75, 2.0),
    "PKS-NRP_Hybrids": (0.0, 0.22, 0.78, 1.0),
    "other": (0.01, 0.02, 0.97, 4.0),
    "mix": (0.2, 0.05, 0.75, 2.0),
}
#: Domains that count for more in the adapter's sequence similarity.
ANCHORS = ("Brand#1", "Brand#2", "Brand#3")
CUTOFFS = (0.3, 0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files up to which a table may be dealt out anew.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of a few small files, dealt out to all cores: a file of one row group is read by one task, however costly what follows. Larger tables are left as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= SMALL_INPUT and len(df.inputFiles()) < n else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("container_id"),
        F.to_date("o_orderdate").alias("bin"),
        F.col("c_mktsegment").alias("product"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("record_type"),
        F.col("o_totalprice").alias("size"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes in order; line numbers are not unique, so that the order goes on by the other columns.

    The window's key is named before it, so that what is then grouped or joined by record stays where it is.
    """
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    g = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("record_id"), *columns, "p_brand", "p_size", "l_returnflag", "l_linestatus")
    return g.select(
        "record_id",
        F.row_number().over(W.partitionBy("record_id").orderBy(*columns)).alias("orf"),
        F.col("p_brand").alias("domain"),
        F.col("l_quantity").alias("score"),
        F.col("p_size").alias("width"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"),
        (F.col("l_linestatus") == "F").alias("is_core"),
    )


def placed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, orf, domain) of genes() where only the order of domains counts: orf is what they are sorted by, not a number.

    Genes of one line number and part have one domain, so that nothing else need be sorted by. They move once, as narrow rows, to where
    a record's are put together; a window would move all that genes() sorts by.
    """
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    g = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("record_id"), "l_linenumber", "l_partkey", F.col("p_brand").alias("domain"))
    return g.repartition("record_id").select("record_id", F.struct("l_linenumber", "l_partkey").alias("orf"), "domain")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as source files: path, organism by nation, taxonomy by region and nation, description by segment."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    of = c.join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey)
    path = F.concat(F.lit("/in/"), "c_name", F.lit(".region001.gbk"))
    return of.select(F.col("c_custkey").alias("container_id"), path.alias("path"), F.col("n_name").alias("organism"), F.concat_ws(";", "r_name", "n_name").alias("taxonomy"), F.col("c_mktsegment").alias("description"))


SQL_CONTAINERS = """con AS (
  SELECT c_custkey AS container_id, c_name || '.region001.gbk' AS file, c_name || '.region001' AS gbk, n_name AS organism, r_name || ';' || n_name AS taxonomy, c_mktsegment AS description
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_RECORDS = """rec AS (
  SELECT o_orderkey AS record_id, o_custkey AS container_id, CAST(o_orderdate AS DATE) AS bin, c_mktsegment AS product,
    o_orderpriority AS category, o_orderstatus AS record_type, o_totalprice AS size
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_GENES = """gene AS (
  SELECT l_orderkey AS record_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS orf,
    p_brand AS domain, l_quantity AS score, p_size AS width, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand, l_linestatus = 'F' AS is_core
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
