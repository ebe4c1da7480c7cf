"""Filters of records, files and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_name_filter(name: Column, include: Sequence[str] = ("cluster", "region"), exclude: Sequence[str] = ("final",)) -> Column:
    """Substring tests of a file name: "*" as the first to include keeps all; else what holds a string to exclude goes, and what holds one to include stays."""
    if include and include[0] == "*":
        return F.lit(True)
    any_of = lambda words: F.coalesce(F.greatest(F.lit(False), *(F.contains(name, F.lit(w)) for w in words), F.lit(False)), F.lit(False))
    return ~any_of(exclude) & any_of(include)


def within_length(size: Column, least: float = 0, most: float = 500_000) -> Column:
    """Strictly between both."""
    return (size > least) & (size < most)


def by_labels(labels: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Dot-joined labels: any of exclude rejects; else, where there is a list to include, any of it is needed. Null labels count as none."""
    parts = F.split(F.coalesce(labels, F.lit("")), r"\.")
    some = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words))) if words else F.lit(False)
    return ~some(exclude) & (some(include) if include else F.lit(True))


def with_any_domain(records: DataFrame, domains: DataFrame, wanted: DataFrame, key: str = "record_id") -> DataFrame:
    """Records with at least one wanted domain; both sides have a column domain."""
    return records.join(domains.join(F.broadcast(wanted.select("domain").distinct()), "domain", "left_semi").select(key).distinct(), key, "left_semi")


def with_all_domains(records: DataFrame, domains: DataFrame, wanted: Sequence[str], key: str = "record_id") -> DataFrame:
    """Records with every wanted domain (relational division); all records if none is wanted."""
    names = sorted(set(wanted))
    if not names:
        return records
    has = domains.where(F.col("domain").isin(names)).groupBy(key).agg(F.countDistinct("domain").alias("n")).where(F.col("n") == len(names))
    return records.join(has.select(key), key, "left_semi")


def level_with_fallback(records: DataFrame, levels: Sequence[str], key: str = "container_id", level: str = "record_type") -> DataFrame:
    """Of each container, the records of the first of levels that it has any of."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    best = records.where(rank > 0).groupBy(key).agg(F.min(rank).alias("_rank"))
    return records.join(best, key).where(rank == F.col("_rank")).drop("_rank")


def contained(genes: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Genes whose interval lies within that of their record: an equi-join on the key with the range as residual condition."""
    r = records.select(key, F.col("nt_start").alias("_start"), F.col("nt_stop").alias("_stop"))
    return genes.join(r, key).where("nt_start >= _start AND nt_stop <= _stop").drop("_start", "_stop")


def overlap(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0), F.least(stop_a, stop_b) - F.greatest(start_a, start_b))


def without_version(accession: Column) -> Column:
    """PF00000.1 becomes PF00000, and so does one of more than five digits."""
    long = F.regexp_extract(accession, r"^(PF\d{6,})\.", 1)
    return F.when(long != "", long).when(F.substring(accession, 8, 1) == ".", F.substring(accession, 1, 7)).otherwise(accession)


def accession(name: Column) -> Column:
    """without_version() of a name that may not be longer than a versioned accession: of ten letters, or as many more as it has digits beyond five."""
    return F.when((F.length(name) > 10) & ~name.rlike(r"^PF\d{6,}(\.\d{1,2})?$"), F.raise_error(F.concat(F.lit("no accession: "), name))).otherwise(without_version(name))


def aligned_columns(row: Column) -> Column:
    """A row of an alignment without its insertions, which are in lower case or dots: as long as the profile."""
    return F.regexp_replace(row, "[a-z.]", "")


def envelope(protein: Column, start: Column, stop: Column) -> Column:
    """The part of a protein from start to before stop, counted from 0."""
    return F.substring(protein, start + 1, stop - start)


def same_translation(given: Column, made: Column) -> Column:
    """Whether a translation is the one made from the sequence, but for the first residue, which may stand for another start codon."""
    rest = lambda x: F.substring(x, F.lit(2), F.length(x))
    return (given == made) | (rest(given) == rest(made))


def valid_hits(hits: DataFrame, score: str = "score", trusted: str = "trusted") -> DataFrame:
    """Hits that reach their profile's trusted cutoff; where it has none, those of no negative score."""
    return hits.where(F.col(score) >= F.coalesce(trusted, F.lit(0.0)))


def with_number(records: DataFrame, number: int | None) -> DataFrame:
    """Records of a number; all if none is asked for."""
    return records if number is None else records.where(F.col("number") == number)


def by_position(domains: DataFrame, key: str, *order: str) -> DataFrame:
    """Domains with their place, from 1, among those of a key by absolute position."""
    return domains.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


def family_name(number: Column) -> Column:
    """FAM_ and at least five digits."""
    digits = number.cast("string")
    return F.concat(F.lit("FAM_"), F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0")))


def edges_below(edges: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """One row for each edge and each cutoff that its distance is strictly below."""
    cut = F.explode(F.filter(F.array(*map(F.lit, sorted(cutoffs))), lambda c: c > F.col("distance"))).alias("cutoff")
    return edges.select("*", cut)
