"""Text sources: labels, sketch comparisons, profile databases and domain lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.operators.filters import without_version


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(item, label) of a tab-separated file with a header, short (item, label) or long (record, file, type, number, component, family)."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    if len(raw.columns) == 2:
        item, label = raw.columns
        return raw.select(F.col(f"`{item}`").alias("item"), F.col(f"`{label}`").alias("label"))
    if len(raw.columns) < 6:
        raise ValueError(f"{path}: two or six columns are needed")
    named = {c.lower(): c for c in raw.columns}
    known = [named.get(c) for c in ("record", "record_type", "record_number", "family")]
    record, kind, number, family = known if None not in known else (raw.columns[i] for i in (0, 2, 3, 5))
    name = F.when(F.col(kind) == "region", F.col(record)).otherwise(F.concat_ws("_", F.col(record), F.col(kind), F.col(number)))
    return raw.select(name.alias("item"), F.regexp_replace(F.col(family), r"^FAM_0*(?=\d)", "").alias("label"))


def read_sketch_comparison(spark: SparkSession, path: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(edges, items) of a comparison's rows: columns 0, 2 and 6 are both names and their Jaccard index; rows of an item with itself only name it."""
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns
    rows = raw.select(F.col(c[0]).alias("a"), F.col(c[2]).alias("b"), F.col(c[6]).cast("double").alias("jaccard"))
    items = rows.select(F.col("a").alias("item")).unionByName(rows.select(F.col("b").alias("item"))).distinct()
    edges = rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").where(F.col("jaccard") >= least)
    return edges.distinct(), items


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(accession, name, description, length, trusted_sequence, trusted_domain, body) of a profile file, one row for each profile."""
    raw = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").rlike(r"(?m)^NAME\s"))
    field = lambda k, g=r"(.*)": F.nullif(F.regexp_extract("value", rf"(?m)^{k}\s+{g}$", 1), F.lit(""))
    trusted = lambda i: F.regexp_extract("value", r"(?m)^TC\s+([-\d.]+)\s+([-\d.]+)", i).try_cast("double")
    return raw.select(without_version(field("ACC", r"(\S+)")).alias("accession"), field("NAME", r"(\S+)").alias("name"), field("DESC").alias("description"), field("LENG", r"(\d+)").cast("int").alias("length"), trusted(1).alias("trusted_sequence"), trusted(2).alias("trusted_domain"), F.col("value").alias("body"))


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain): the first tab-separated field of each line, without version; lines that are empty or begin with # are skipped, and any other that isn't an accession is an error."""
    first = F.trim(F.element_at(F.split("value", "\t"), 1))
    lines = spark.read.text(path).select(first.alias("x")).where("x <> '' AND NOT startswith(x, '#')")
    bad = F.raise_error(F.concat(F.lit("no accession: "), F.col("x")))
    return lines.select(F.when(F.col("x").rlike(r"^PF\d{5,}(\.\d+)?$"), without_version(F.col("x"))).otherwise(bad).alias("domain")).distinct()


def newest(lines: DataFrame, pattern: str = r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})") -> DataFrame:
    """Rows (path, ...) of the newest run, by the last time in their path."""
    times = F.regexp_extract_all("path", F.lit(pattern), 1)
    stamped = lines.withColumn("started", F.try_to_timestamp(F.element_at(F.when(F.size(times) > 0, times).otherwise(F.array(F.lit(""))), -1), F.lit("yyyy-MM-dd_HH-mm-ss")))
    return stamped.join(F.broadcast(stamped.agg(F.max("started").alias("started"))), "started")


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files of the newest run below a folder, by the time in their path, each with its path."""
    return newest(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv").text(path).select("value", F.col("_metadata.file_path").alias("path")))


def labels_of_lines(lines: DataFrame) -> DataFrame:
    """(cutoff, item, label) of lines (path, value) of clustering files, whose names end in the cutoff: long ones of six columns, or short ones of two. Their headers are left out."""
    part = F.split("value", "\t")
    at = lambda i: F.element_at(part, i)
    long = F.size(part) >= 6
    item = F.when(~long | (at(3) == "region"), at(1)).otherwise(F.concat_ws("_", at(1), at(3), at(4)))
    label = F.when(long, F.regexp_replace(at(6), r"^FAM_0*(?=\d)", "")).otherwise(at(2))
    rows = lines.where((F.size(part) >= 2) & ~at(1).isin("Record", "#BGC Name", "BGC"))
    return rows.select(F.regexp_extract("path", r"_c([0-9.]+)\.tsv$", 1).try_cast("double").alias("cutoff"), item.alias("item"), label.alias("label")).where("cutoff IS NOT NULL")


def read_run_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cutoff, item, label) of the newest run's clustering files of the bin mix below a folder."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*clustering_*.tsv").text(path)
    found = labels_of_lines(newest(lines.select("value", F.col("_metadata.file_path").alias("path")).where(F.col("path").contains("/mix/"))))
    if found.isEmpty():
        raise ValueError(f"{path}: no clustering file of the bin mix, by the time and the cutoff in its path, has a label")
    return found


def membership_labels(bgc: DataFrame, membership: DataFrame, gcf: DataFrame, clustering: DataFrame) -> DataFrame:
    """(cutoff, item, label) of a result database's tables bgc (id, orig_filename), gcf_membership (bgc_id, gcf_id), gcf (id, clustering_id) and clustering (id, threshold): of clusterings with one threshold, the last."""
    last = clustering.groupBy("threshold").agg(F.max("id").alias("clustering_id"))
    name = F.regexp_replace(F.element_at(F.split("orig_filename", "/"), -1), r"(?<=.)\.[^.]*$", "")
    rows = membership.join(gcf.select(F.col("id").alias("gcf_id"), "clustering_id").join(last, "clustering_id"), "gcf_id")
    return rows.join(bgc.select(F.col("id").alias("bgc_id"), name.alias("item")), "bgc_id").select(F.col("threshold").alias("cutoff"), "item", F.col("gcf_id").cast("string").alias("label"))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows: int = 100_000) -> DataFrame:
    """A table of an SQLite file with row ids, in ranges of so many of them: each task opens its own copy of the file, which Spark sends out."""
    import sqlite3

    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    names = [x.split()[0] for x in schema.split(", ")]
    quoted = ", ".join(f'"{n}"' for n in names)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        least, most = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()

    def run(frames):
        import pandas as pd
        from pyspark import SparkFiles

        con = sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True)
        for f in frames:
            for i in f["id"].tolist():
                yield pd.DataFrame(con.execute(f'SELECT {quoted} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (least + i * rows, least + (i + 1) * rows)).fetchall(), columns=names)

    return spark.range(-(-(most - least + 1) // rows)).mapInPandas(run, schema)


def read_sqlite_labels(spark: SparkSession, path: str) -> DataFrame:
    """membership_labels() of an SQLite result database."""
    of = lambda table, schema: read_sqlite(spark, path, table, schema)
    return membership_labels(of("bgc", "id long, orig_filename string"), of("gcf_membership", "bgc_id long, gcf_id long"), of("gcf", "id long, clustering_id long"), of("clustering", "id long, threshold double"))


#: How the archive of a release of the reference set is named, before and after its version.
RELEASE = ("mibig_antismash_", r"_gbk.*?\.tar\.bz2")


def release_link(page: DataFrame, version: str) -> DataFrame:
    """(link): the archive of a version of the reference set, on a page of downloads (value); the first by name. Getting it is left to the caller, as nothing here opens connections."""
    link = F.explode(F.regexp_extract_all("value", F.lit(f"({RELEASE[0]}{re.escape(version)}{RELEASE[1]})"), 1))
    return page.select(link.alias("link")).agg(F.min("link").alias("link"))
