"""Evaluation of computed labels against curated ones: (item, curated, computed) rows, all from contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.plans.scratch import written


def paired(curated: DataFrame, computed: DataFrame) -> DataFrame:
    """Items that have both labels."""
    return curated.select("item", F.col("label").alias("curated")).join(computed.select("item", F.col("label").alias("computed")), "item")


def contingency(labels: DataFrame) -> DataFrame:
    """(curated, computed, n, n_curated, n_computed): counts of cells, and of their row and column."""
    cell = labels.groupBy("curated", "computed").agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: cell.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    return cell.join(total("curated"), "curated").join(total("computed"), "computed").select("curated", "computed", "n", "n_curated", "n_computed")


def purity_and_entropy(labels: DataFrame) -> DataFrame:
    """(computed, size, purity, entropy): share of the most frequent curated label, and entropy in bits."""
    p = F.col("n") / F.col("n_computed")
    return contingency(labels).groupBy("computed").agg(F.max("n_computed").alias("size"), F.max(p).alias("purity"), F.round(F.abs(F.sum(-p * F.log2(p))), 6).alias("entropy"))


def v_measure(labels: DataFrame) -> DataFrame:
    """One row: homogeneity, completeness and their harmonic mean; 1 where a side has no entropy."""
    c = contingency(labels)
    n = labels.agg(F.count(F.lit(1)).alias("all"))
    side = lambda name: c.groupBy(name).agg(F.max(f"n_{name}").alias("k")).crossJoin(F.broadcast(n)).agg(F.sum(-F.col("k") / F.col("all") * F.log(F.col("k") / F.col("all"))).alias(f"h_{name}"))
    q = F.col("n") / F.col("all")
    within = c.crossJoin(F.broadcast(n)).agg(F.sum(-q * F.log(F.col("n") / F.col("n_computed"))).alias("in_computed"), F.sum(-q * F.log(F.col("n") / F.col("n_curated"))).alias("in_curated"))
    one = within.crossJoin(side("curated")).crossJoin(side("computed"))  # four one-row tables
    share = lambda h, inside: F.when(F.col(h) == 0, F.lit(1.0)).otherwise(1 - F.col(inside) / F.col(h))
    s = one.select(share("h_curated", "in_computed").alias("h"), share("h_computed", "in_curated").alias("c"))
    return s.select(F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"), F.round(F.when(F.col("h") + F.col("c") == 0, 0.0).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))), 6).alias("v_measure"))


def associations(labels: DataFrame) -> DataFrame:
    """One row: averages over items of the shares of their companions by computed label that are right or wrong, and by curated label that are present or missing; items without companions don't count."""
    c = contingency(labels)
    mean = lambda of, wrong: F.round(F.sum(F.when(F.col(of) > 1, F.col("n") * ((F.col(of) - F.col("n")) if wrong else (F.col("n") - 1)) / (F.col(of) - 1))) / F.sum(F.when(F.col(of) > 1, F.col("n"))), 6)
    return c.agg(mean("n_computed", False).alias("correct"), mean("n_computed", True).alias("wrong"), mean("n_curated", False).alias("present"), mean("n_curated", True).alias("missing"))


def confusion(labels: DataFrame) -> DataFrame:
    """(row, curated, computed, n) in long form, zero cells left out; curated labels are ordered by the first computed label, in the labels' order, at which they have the greatest count."""
    c = contingency(labels)
    top = c.groupBy("computed").agg(F.max("n").alias("top"))
    # Every curated label comes up at some column, or at none: those come last, unlike in a table that leaves them out.
    first = c.join(top, "computed").where("n = top").groupBy("curated").agg(F.min("computed").alias("first"))
    order = numbered(c.select("curated").distinct().join(first, "curated", "left"), [F.col("first").asc_nulls_last(), F.col("curated")], "row")
    return c.join(order.select("curated", "row"), "curated").select("row", "curated", "computed", "n")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their number from 1 in an order, as an int. Ranges are sorted apart; only their sizes, one for each partition, meet in one task."""
    nth = F.monotonically_increasing_id()
    parts = written(rows.orderBy(*order).withColumns({"_part": F.shiftright(nth, 33), "_nth": nth.bitwiseAND((1 << 33) - 1)}), "sorted")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return parts.join(F.broadcast(sizes), "_part").select(*rows.columns, (F.col("_before") + F.col("_nth") + 1).cast("int").alias(name))


def by_cutoff(labels: DataFrame) -> DataFrame:
    """(cutoff, families, purity, entropy): of rows (cutoff, curated, computed), the means over each cutoff's computed labels."""
    cell = labels.groupBy("cutoff", "curated", "computed").agg(F.count(F.lit(1)).alias("n"))
    total = cell.groupBy("cutoff", "computed").agg(F.sum("n").alias("k"))
    p = F.col("n") / F.col("k")
    each = cell.join(total, ["cutoff", "computed"]).groupBy("cutoff", "computed").agg(F.max(p).alias("purity"), F.abs(F.sum(-p * F.log2(p))).alias("entropy"))
    return each.groupBy("cutoff").agg(F.count(F.lit(1)).alias("families"), F.round(F.avg("purity"), 6).alias("purity"), F.round(F.avg("entropy"), 6).alias("entropy"))


def summary(labels: DataFrame) -> DataFrame:
    """One row: families, their average size and singletons, on both sides."""
    c = contingency(labels)

    def side(name: str) -> DataFrame:
        f = c.groupBy(name).agg(F.max(f"n_{name}").alias("k"))
        return f.agg(F.count(F.lit(1)).alias(f"{name}_families"), F.round(F.avg("k"), 6).alias(f"{name}_size"), F.count_if(F.col("k") == 1).alias(f"{name}_singletons"))

    return side("curated").crossJoin(side("computed"))
