"""Bins of records that are compared with each other, and the weights of their comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlake.plans.config import LEGACY_CLASSES


def mix_bin(records: DataFrame) -> DataFrame:
    return records.withColumn("bin", F.lit("mix"))


def label_bins(records: DataFrame, column: str, hybrids_off: bool = False) -> DataFrame:
    """A bin for each value of a dot-joined column or, with hybrids_off, for each of its parts. Records without a value are left out."""
    r = records.where(F.col(column).isNotNull())
    bin_ = F.explode(F.array_distinct(F.split(column, r"\."))) if hybrids_off else F.col(column)
    return r.select("*", bin_.alias("bin"))


def legacy_class(product: Column, classes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The legacy class of a dot-joined product: of its name as a whole, or of what all its parts have in common."""
    c = classes or LEGACY_CLASSES
    names = {k: F.array(*map(F.lit, v)) for k, v in c.items()}
    parts = F.transform(F.split(product, r"\."), F.trim)
    within = lambda *kinds: F.size(F.array_except(parts, F.array(*(F.lit(x) for k in kinds for x in c[k])))) == 0
    hybrid = (
        F.when(within("NRPS"), "NRPS")
        .when(within("PKSI", "PKSother"), "PKSother")
        .when(within("PKSI", "PKSother", "NRPS"), "PKS-NRP_Hybrids")
        .when(within("RiPP"), "RiPP")
        .when(within("saccharide"), "saccharide")
        .otherwise("other")
    )
    out = F.when(product == "terpene", "terpene")
    for k, v in names.items():
        out = out.when(F.array_contains(v, product), k)
    return out.when(F.contains(product, F.lit(".")), hybrid).otherwise("other")


def legacy_bins(records: DataFrame, hybrids_off: bool = False, classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A bin for each legacy class of a record's product or, with hybrids_off, of each part of it."""
    r = records.where("product IS NOT NULL")
    products = F.split("product", r"\.") if hybrids_off else F.array("product")
    return r.select("*", F.explode(F.array_distinct(F.transform(products, lambda p: legacy_class(p, classes)))).alias("bin"))


def category_weights(category: Column) -> Column:
    """The name of the weights of a dot-joined category."""
    parts = F.array_distinct(F.split(category, r"\."))
    one = F.element_at(parts, 1)
    single = F.when(one == "PKS", "PKSother").when(one == "Categoryless", "other").otherwise(one)
    hybrid = F.when(F.size(F.array_except(parts, F.array(F.lit("NRPS"), F.lit("PKS")))) == 0, "PKS-NRP_Hybrids").otherwise("other")
    return F.when(F.size(parts) == 1, single).otherwise(hybrid)


def bin_weights(binned: DataFrame) -> DataFrame:
    """(bin, weights): of category bins; a PKS bin whose records are all of type I has the weights of those."""
    one = F.bool_and(F.col("product").isin(*LEGACY_CLASSES["PKSI"]))
    return binned.groupBy("bin").agg(F.when((F.col("bin") == "PKS") & one, "PKSI").otherwise(category_weights(F.col("bin"))).alias("weights"))


def merged(records: DataFrame, *keys: str) -> DataFrame:
    """Records of one group as one: least start, greatest stop, on an edge if any is, distinct products and categories sorted and joined by dots, the least number."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, r"\."))))), ".")
    return records.groupBy(*keys).agg(
        F.min("nt_start").alias("nt_start"), F.max("nt_stop").alias("nt_stop"), F.bool_or("contig_edge").alias("contig_edge"), labels("product").alias("product"), labels("category").alias("category"), F.min("number").alias("number"), F.count(F.lit(1)).alias("members")
    )
