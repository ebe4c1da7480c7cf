"""python -m clusterlake cluster | query | dereplicate | benchmark: the four commands; results are written as tab-separated folders."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from clusterlake.plans import outputs, workflows
from clusterlake.plans.config import Settings
from clusterlake.plans.outputs import write_tsv
from clusterlake.plans.ship import ship_package
from clusterlake.plans.store import RunStore
from clusterlake.sources.tables import read_domain_list, read_profiles, read_sqlite_labels

#: What a command makes to go on from, and doesn't write out.
INNER = ("features", "hits", "genes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clusterlake")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("cluster", "query", "dereplicate", "benchmark"):
        c = commands.add_parser(name)
        c.add_argument("-o", "--output", required=True)
        if name == "benchmark":
            c.add_argument("-g", "--curated", required=True)
            c.add_argument("-b", "--computed", required=True, help="a clustering file, a folder of runs, or an SQLite result database (*.db)")
            continue
        c.add_argument("-i", "--input", required=True)
        c.add_argument("--config", help="YAML: settings by name")
        if name == "dereplicate":
            c.add_argument("--cutoff", type=float, default=0.8)
            c.add_argument("--fasta", action="store_true", help="write the proteins too")
            continue
        c.add_argument("--hits", help="Parquet: hash, orf, accession, env_start, env_stop, bit_score, alignment")
        c.add_argument("--profiles", help="a profile file to search with, in place of hits")
        c.add_argument("--cutoffs", default="0.3")
        c.add_argument("--record-type", default="region", choices=workflows.LEVELS)
        c.add_argument("--alignment-mode", default="glocal", choices=("global", "glocal", "local", "auto"))
        c.add_argument("--extend-strategy", default="legacy", choices=("legacy", "greedy", "simple_match"))
        c.add_argument("--classify", default="mix", choices=("mix", "class", "category", "legacy"))
        c.add_argument("--legacy-weights", action="store_true")
        c.add_argument("--hybrids-off", action="store_true")
        c.add_argument("--bad-files", default="raise", choices=("raise", "report"))
        c.add_argument("--force-gbk", action="store_true", help="files without a region are one")
        c.add_argument("--include-gbk", default="cluster,region")
        c.add_argument("--exclude-gbk", default="final")
        c.add_argument("--cull-singletons", action="store_true")
        c.add_argument("--trees", action="store_true")
        for x in ("include-any", "include-all", "include-categories", "exclude-categories", "include-classes", "exclude-classes"):
            c.add_argument(f"--{x}", default="", help="a list with commas" + ", or @file, a domain list" * x.startswith("include-a"))
        c.add_argument("--store", help="a folder to go on from and add to")
        if name == "query":
            c.add_argument("--query-hash", required=True)
            c.add_argument("--record-number", type=int)
            c.add_argument("--propagate", action="store_true")
    return p


def settings(a: argparse.Namespace) -> Settings:
    if not getattr(a, "config", None):
        return Settings()
    with open(a.config) as f:
        return Settings.from_yaml(f.read())


def options(a: argparse.Namespace, spark: SparkSession | None = None) -> workflows.Options:
    def some(x: str) -> tuple[str, ...]:
        text = getattr(a, x)
        if text.startswith("@"):  # a list given with the command, of accessions
            return tuple(sorted(r["domain"] for r in read_domain_list(spark, text[1:]).collect()))
        return tuple(y for y in text.split(",") if y)

    lists = {x: some(x) for x in ("include_any", "include_all", "include_categories", "exclude_categories", "include_classes", "exclude_classes")}
    cutoffs = tuple(sorted(map(float, a.cutoffs.split(",")), reverse=True))
    more = {x: getattr(a, x) for x in ("classify", "hybrids_off", "propagate", "legacy_weights", "record_number", "bad_files") if hasattr(a, x)}
    return workflows.Options(
        cutoffs=cutoffs, record_type=a.record_type, alignment_mode=a.alignment_mode, extend_strategy=a.extend_strategy, cull=a.cull_singletons, force=a.force_gbk,
        include_files=tuple(a.include_gbk.split(",")), exclude_files=some("exclude_gbk"), settings=settings(a), **lists, **more,
    )


def given_hits(spark: SparkSession, a: argparse.Namespace, o: workflows.Options):
    if bool(a.hits) == bool(a.profiles):
        raise ValueError("either hits or profiles are needed")
    if a.hits:
        return spark.read.parquet(a.hits)
    files = workflows.read_files(spark, a.input, o.include_files, o.exclude_files, force=o.force)
    return workflows.scanned(spark, files.where("error IS NULL"), read_profiles(spark, a.profiles), o)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("clusterlake").getOrCreate()
    ship_package(spark)
    if a.command == "dereplicate":
        c = workflows.dereplicate(spark, a.input, a.cutoff, settings(a))
        out = {"clustering": c, "representatives": outputs.representatives(c)}
        if a.fasta:
            items = workflows.protein_items(spark, a.input, settings(a))
            outputs.write_text(outputs.fasta(items, "item", "protein"), f"{a.output}/proteins", "fasta")
            out["manifest"] = outputs.manifest(items, "item", f"{a.output}/proteins")
    elif a.command == "benchmark":
        if a.computed.endswith(".db"):
            out = workflows.benchmark_labels(spark, a.curated, read_sqlite_labels(spark, a.computed))
        elif a.computed.endswith(".tsv"):
            out = workflows.benchmark(spark, a.curated, a.computed)
        else:
            out = workflows.benchmark_run(spark, a.curated, a.computed)
    else:
        o = options(a, spark)
        if a.store:
            found = read_profiles(spark, a.profiles) if a.profiles else None
            some = {"hits": None if found is not None else given_hits(spark, a, o), "found": found, "options": o}
            store = RunStore(spark, a.store)
            out = workflows.stored_cluster(spark, a.input, store, **some) if a.command == "cluster" else workflows.stored_query(spark, a.input, store, a.query_hash, **some)
        elif a.command == "query":
            out = workflows.query(spark, a.input, given_hits(spark, a, o), a.query_hash, o)
        else:
            out = workflows.cluster(spark, a.input, given_hits(spark, a, o), o)
        if a.trees:
            out["trees"] = workflows.trees(out, o)
        outputs.write_run(out, f"{a.output}/output_files", o.cutoffs)
    for name, df in out.items():
        if name not in INNER and not name.startswith("network_c"):
            write_tsv(df, f"{a.output}/{name}")


if __name__ == "__main__":
    main()
