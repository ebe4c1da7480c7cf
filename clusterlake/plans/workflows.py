"""The four commands as functions of tables: cluster, query, dereplicate and benchmark."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.operators import alignment, bins, evaluate, families, filters, pairs, sketches, state
from clusterlake.plans import outputs
from clusterlake.plans.config import Settings
from clusterlake.plans.model import WEIGHTS
from clusterlake.plans.scratch import written
from clusterlake.plans.store import RunStore, identity
from clusterlake.sources.genbank import found_files, listed, parsed, read_files, tables
from clusterlake.sources.tables import read_labels, read_run_labels

LEVELS = ("region", "cand_cluster", "protocluster", "proto_core")


@dataclass(frozen=True)
class Options:
    """Choices of a run. classify: mix, class, category or legacy. Cutoffs are in [0, 1]; a pair has an edge if its distance is below.

    legacy_weights: a class or category is compared with the weights of the legacy class it resembles, not those of mix.
    record_number: of a query file, the record of this number, below the level of regions.
    bad_files: raise, or report: then files that can't be read are left out and listed in the result.
    cull: leave records that are in no component out of the result tables.
    """

    cutoffs: tuple[float, ...] = (0.3,)
    record_type: str = "region"
    classify: str = "mix"
    hybrids_off: bool = False
    alignment_mode: str = "glocal"
    extend_strategy: str = "legacy"
    include_any: tuple[str, ...] = ()
    include_all: tuple[str, ...] = ()
    include_categories: tuple[str, ...] = ()
    exclude_categories: tuple[str, ...] = ()
    include_classes: tuple[str, ...] = ()
    exclude_classes: tuple[str, ...] = ()
    propagate: bool = False
    legacy_weights: bool = False
    record_number: int | None = None
    bad_files: str = "raise"
    cull: bool = False
    force: bool = False
    include_files: tuple[str, ...] = ("cluster", "region")
    exclude_files: tuple[str, ...] = ("final",)
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self):
        if not self.cutoffs or any(not 0 <= c <= 1 for c in self.cutoffs):
            raise ValueError("cutoffs lie between 0 and 1")
        if self.record_type not in LEVELS or self.classify not in ("mix", "class", "category", "legacy"):
            raise ValueError("no such record type or classification")
        if self.alignment_mode not in ("global", "glocal", "local", "auto") or self.extend_strategy not in ("legacy", "greedy", "simple_match"):
            raise ValueError("no such alignment mode or extend strategy")
        if self.include_any and self.include_all:
            raise ValueError("domains to include are either any or all")
        if self.hybrids_off and self.classify == "mix":
            raise ValueError("hybrids can only be split into classes or categories")
        if self.legacy_weights and self.classify not in ("class", "category"):
            raise ValueError("legacy weights go with classes or categories; mix has its own, legacy bins have theirs")
        if self.bad_files not in ("raise", "report"):
            raise ValueError("bad files are raised or reported")
        if self.record_number is not None and self.record_type == "region":
            raise ValueError("a file has one region; numbers tell records below it apart")


    def identity(self) -> dict:
        """All choices, by name: what a run's results depend on besides its input."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "settings"}
        return own | {"settings": self.settings.digest()}


def record_genes(records: DataFrame, genes: DataFrame, hits: DataFrame, every: DataFrame) -> DataFrame:
    """(record_id, orf, strand, is_core, in_protocore, hsps): genes within each record, of a region all of its file, with their hits in order.

    every: all records; the core of a protocluster is its child there.

    hits: (container_id, orf, accession, env_start, env_stop, bit_score, alignment).
    """
    order = F.struct("env_start", -F.col("bit_score"), "accession", "alignment")
    h = hits.groupBy("container_id", "orf").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "accession", "alignment"))), lambda x: F.struct(filters.accession(x["accession"]).alias("accession"), x["alignment"].alias("alignment"))).alias("hsps"))
    g = genes.join(h, ["container_id", "orf"], "left").withColumn("is_core", F.coalesce(F.col("gene_kind").isin("biosynthetic", "catabolic"), F.lit(False)))
    core = every.where("record_type = 'proto_core'").groupBy(F.col("parent_id").alias("record_id")).agg(F.min("nt_start").alias("_c"), F.max("nt_stop").alias("_d"))  # a protocluster has one
    r = records.join(core, "record_id", "left").select("record_id", "container_id", "record_type", F.col("nt_start").alias("_a"), F.col("nt_stop").alias("_b"), F.coalesce("_c", "nt_start").alias("_c"), F.coalesce("_d", "nt_stop").alias("_d"))
    inner = (F.col("nt_start") >= F.col("_c")) & (F.col("nt_stop") <= F.col("_d"))
    inside = (F.col("record_type") == "region") | ((F.col("nt_start") >= F.col("_a")) & (F.col("nt_stop") <= F.col("_b")))
    return g.join(r, "container_id").where(inside).select("record_id", "orf", "strand", "is_core", inner.alias("in_protocore"), F.coalesce("hsps", F.array().cast("array<struct<accession:string,alignment:string>>")).alias("hsps"))


def chosen_records(t: dict[str, DataFrame], o: Options) -> DataFrame:
    """Records of the chosen level or, where a file has none, of the nearest above it, after the filters of lengths and labels."""
    levels = LEVELS[: LEVELS.index(o.record_type) + 1][::-1]
    c = t["containers"].where(filters.within_length(F.col("nt_len"), o.settings.min_length, o.settings.max_length))
    r = filters.level_with_fallback(t["records"].join(c.select("container_id"), "container_id", "left_semi"), levels)
    r = r.dropDuplicates(["container_id", "record_type", "number"])
    return r.where(filters.by_labels(F.col("category"), o.include_categories, o.exclude_categories) & filters.by_labels(F.col("product"), o.include_classes, o.exclude_classes))


def binned(records: DataFrame, o: Options) -> DataFrame:
    """Records with their bin and the name of its weights."""
    if o.classify == "mix":
        return bins.mix_bin(records).withColumn("weights", F.lit("mix"))
    if o.classify == "legacy":
        return bins.legacy_bins(records, o.hybrids_off).withColumn("weights", F.col("bin"))
    b = bins.label_bins(records, "product" if o.classify == "class" else "category", o.hybrids_off)
    if not o.legacy_weights:
        return b.withColumn("weights", F.lit("mix"))
    return b.withColumn("weights", bins.legacy_class(F.col("bin"))) if o.classify == "class" else b.join(bins.bin_weights(b), "bin")


def tokens_of(feats: DataFrame) -> DataFrame:
    """(record_id, token): the distinct domains of records."""
    domains = F.array_distinct(F.flatten(F.transform("genes", lambda g: F.transform(g["hsps"], lambda h: h["accession"]))))
    return feats.select("record_id", F.explode(domains).alias("token"))


def scored(binned_records: DataFrame, feats: DataFrame, o: Options, stored: DataFrame | None = None) -> DataFrame:
    """(bin, weights, ...) scores of all pairs with a common domain that aren't stored yet, all bins in one job, each with its weights."""
    p = pairs.candidate_pairs(binned_records.select("bin", "record_id", "container_id").join(tokens_of(feats), "record_id")).select("bin", "a", "b")
    if stored is not None:
        p = pairs.normalised(p).join(pairs.normalised(stored).select("bin", "a", "b").distinct(), ["bin", "a", "b"], "left_anti")
    return scored_in_bins(p, binned_records, feats, o)


def scored_in_bins(p: DataFrame, binned_records: DataFrame, feats: DataFrame, o: Options) -> DataFrame:
    """Scores of pairs (bin, a, b). A pair that several bins of the same weights have is scored once."""
    weights = binned_records.select("bin", "weights").distinct()
    p = written(p.join(weights, "bin"), "pairs")
    s = alignment.score_pairs(p.groupBy("a", "b", "weights").agg(F.min("bin").alias("bin")), feats, None, o.alignment_mode, o.extend_strategy, o.settings)
    return p.join(s, ["a", "b", "weights"])


def genes_that_stay(genes: DataFrame, share: float, again: bool = False) -> DataFrame:
    """Genes without those that overlap another of their file; see alignment.without_overlapping_genes for again."""
    size = F.length(F.coalesce("aa_seq", F.lit("")))
    g = genes.select("container_id", "orf", F.col("nt_start").alias("start"), F.col("nt_stop").alias("stop"), "strand", size.alias("length"))
    return genes.join(alignment.without_overlapping_genes(g, share, again).select("container_id", "orf").distinct(), ["container_id", "orf"], "left_semi")


def hits_that_stay(hits: DataFrame, share: float) -> DataFrame:
    """Hits (container_id, orf, accession, env_start, env_stop, bit_score, ...) without those that overlap another of their gene."""
    h = hits.withColumn("gene_id", F.xxhash64("container_id", "orf")).withColumn("score", F.col("bit_score").cast("double")).withColumn("start", F.col("env_start")).withColumn("stop", F.col("env_stop"))
    keys = ["gene_id", "accession", "start", "stop", "score"]
    return h.join(alignment.without_overlaps(h.select(*keys), share), keys, "left_semi").select(*hits.columns)


def loaded(spark: SparkSession, folder: str, hits: DataFrame, o: Options) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a folder, and the hits of its files, both without overlaps. errors lists files that can't be read; by default they end the run."""
    return of_files(written(read_files(spark, folder, o.include_files, o.exclude_files, force=o.force), "files"), hits, o)


def of_files(files: DataFrame, hits: DataFrame, o: Options) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same of parsed files."""
    bad = files.where("error IS NOT NULL").select("path", "error")
    if o.bad_files == "raise" and (some := bad.orderBy("path").limit(10).collect()):
        raise ValueError(f"{bad.count()} files can't be read, among them: " + "; ".join(f"{r['path']}: {r['error']}" for r in some))
    t = {k: written(v, k) for k, v in tables(files).items()} | {"errors": bad}
    t["genes"] = written(genes_that_stay(t["genes"], o.settings.cds_overlap), "genes")
    return t, written(hits_that_stay(hits.join(t["containers"].select("hash", "container_id"), "hash"), o.settings.domain_overlap), "hits")


def prepared(t: dict[str, DataFrame], hits: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Chosen records, and their features, after the filters of domains."""
    r = chosen_records(t, o)
    g = written(record_genes(r, t["genes"], hits, t["records"]), "genes")
    domains = g.select("record_id", F.explode("hsps").alias("h")).select("record_id", F.col("h.accession").alias("domain"))
    if o.include_any:
        r = filters.with_any_domain(r, domains, r.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, o.include_any))).alias("domain")))
    if o.include_all:
        r = filters.with_all_domains(r, domains, o.include_all)
    r = written(r, "records")
    feats = alignment.features(r.select("record_id", F.col("record_type").alias("kind"), "product", "contig_edge"), g.join(r.select("record_id"), "record_id", "left_semi"))
    return r, written(feats, "features")


def network(b: DataFrame, edges: DataFrame, o: Options) -> dict[str, DataFrame]:
    c = written(families.components_by_cutoff(edges, o.cutoffs), "components")
    f = written(families.families(edges, c, o.cutoffs, o.settings), "families")
    return {"edges": edges, "components": c, "families": f, "singletons": families.singletons(b, c, o.cutoffs)}


def results(out: dict[str, DataFrame], r: DataFrame, t: dict[str, DataFrame], o: Options) -> dict[str, DataFrame]:
    """out, and the tables that a run writes."""
    names = written(outputs.named(r, t["containers"]), "names")
    f = out["families"].drop("component")
    alone = out["singletons"].select("cutoff", "bin", "record_id", F.col("record_id").alias("component"))
    c = out["components"] if o.cull else out["components"].unionByName(alone)
    f = f if o.cull else f.unionByName(alone.withColumnRenamed("component", "family"))
    show = lambda cutoff: outputs.network(out["edges"], names, cutoff, o.alignment_mode, o.extend_strategy)
    tables_ = {"clustering": outputs.clustering(c, f, names), "annotations": outputs.record_annotations(names, c), "network": show(max(o.cutoffs)), "full_network": show(None), "topology": outputs.topology(r)} | {f"network_c{c}": show(c) for c in o.cutoffs}
    return out | tables_ | {"records": r, "containers": t["containers"], "errors": t["errors"]}


#: Edges of a run that are there already, and what to do with those that a run has scored: given bins, features and options.
Known = Callable[[DataFrame, DataFrame, Options], DataFrame]
Keep = Callable[[DataFrame, DataFrame, Options], None]


def within(edges: DataFrame, b: DataFrame) -> DataFrame:
    """Edges both ends of which are records of their bin."""
    ends = b.select("bin", "record_id").distinct()
    return edges.join(ends.withColumnRenamed("record_id", "a"), ["bin", "a"], "left_semi").join(ends.withColumnRenamed("record_id", "b"), ["bin", "b"], "left_semi")


def cluster(spark: SparkSession, folder: str, hits: DataFrame, options: Options | None = None, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """All records against all of their bin: edges, components, families, singletons and the result tables.

    stored: edges of an earlier run with the same options, of records of the same features. Those of records that are in this run, too,
    are not computed again; matches they lack are filled in. stored_cluster() sees to all that by itself.
    """
    o = options or Options()
    t, h = loaded(spark, folder, hits, o)
    return clustered(t, h, o, None if stored is None else lambda b, feats, o: within(stored, b))


def clustered(t: dict[str, DataFrame], h: DataFrame, o: Options, known: Known | None = None, keep: Keep | None = None) -> dict[str, DataFrame]:
    """cluster() of tables."""
    r, feats = prepared(t, h, o)
    b = written(binned(r, o), "bins")
    e, stored = None, None
    if known is not None and (found := known(b, feats, o)) is not None:
        stored = written(found, "stored")
        filled = alignment.lacking_matches(stored, feats)
        if filled is not None:
            if keep is not None:
                keep(filled, feats, o)
            stored = written(alignment.with_matches(stored, filled), "stored")
    e = written(scored(b, feats, o, stored), "edges")
    if keep is not None:
        keep(e, feats, o)
    e = e if stored is None else written(stored.unionByName(e, allowMissingColumns=True), "edges")
    return results(network(b, e, o) | {"bins": b, "features": feats, "hits": h, "genes": t["genes"]}, r, t, o)


def query_bin(r: DataFrame, start: DataFrame, o: Options) -> DataFrame:
    """Records to compare a query with: all, or those of its class or category, as (bin, weights, ...). One that shares neither with any other is an error."""
    if o.classify == "mix":
        return bins.mix_bin(r).withColumn("weights", F.lit("mix"))
    b = binned(r, o)
    own = b.join(start, "record_id", "left_semi").select("bin").distinct()
    b = written(b.join(own, "bin", "left_semi"), "bins")
    if b.join(start, "record_id", "left_anti").isEmpty():
        raise ValueError("no other record has the class or category of the query")
    return b


def query(spark: SparkSession, folder: str, hits: DataFrame, query_hash: str, options: Options | None = None, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """One record against all of its bin: with propagate, records that are found are queries of the next round, until none is new. Then all pairs within the component are scored, so that each cutoff's families see them.

    A round joins the tokens of the newly found records alone with all tokens, and scores what isn't scored yet; what it found is written
    before the next one starts.
    """
    o = options or Options()
    t, h = loaded(spark, folder, hits, o)
    return queried(t, h, query_hash, o, None if stored is None else lambda b, feats, o: within(stored, b))


def queried(t: dict[str, DataFrame], h: DataFrame, query_hash: str, o: Options, known: Known | None = None, keep: Keep | None = None) -> dict[str, DataFrame]:
    """query() of tables."""
    r, feats = prepared(t, h, o)
    start = r.join(t["containers"].where(F.col("hash") == query_hash).select("container_id"), "container_id", "left_semi")
    start = written(filters.with_number(start, o.record_number).select("record_id"), "start")
    if start.isEmpty():
        raise ValueError("the query file has no such record")
    b = query_bin(r, start, o)
    tokens = written(b.select("bin", "record_id", "container_id").join(tokens_of(feats), "record_id"), "tokens")
    done = known(b, feats, o) if known is not None else None
    done = None if done is None else written(done, "stored")
    first, seen, front = done, start, start
    while True:
        asked = pairs.pairs_with(tokens.join(front, "record_id", "left_semi"), tokens)
        new = written(scored_in_bins(asked if done is None else pairs.missing_pairs(asked, done), b, feats, o), "edges")
        done = new if done is None else written(done.unionByName(new, allowMissingColumns=True), "edges")
        near = done.where(F.col("distance") < max(o.cutoffs))
        reach = lambda x, y: near.join(front.withColumnRenamed("record_id", x), x, "left_semi").select(F.col(y).alias("record_id"))  # noqa: E731, B023
        found = reach("a", "b").unionByName(reach("b", "a")).distinct()
        front = written(found.join(seen, "record_id", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
        if not o.propagate:
            break
    inside = tokens.join(seen, "record_id", "left_semi")
    edges = written(done.unionByName(scored_in_bins(pairs.missing_pairs(pairs.pairs_with(inside, inside), done), b, feats, o), allowMissingColumns=True), "edges")
    if keep is not None:
        keep(edges if first is None else pairs.missing_edges(edges, first), feats, o)
    edges = written(within(edges, b.join(seen, "record_id", "left_semi")), "edges") if first is not None else edges
    return results(network(b.join(seen, "record_id", "left_semi"), edges, o) | {"features": feats}, r.join(seen, "record_id", "left_semi"), t, o) | {"reached": seen}


def scanned(spark: SparkSession, files: DataFrame, found: DataFrame, o: Options) -> DataFrame:
    """Hits (hash, orf, accession, env_start, env_stop, bit_score, alignment) of the genes of parsed files, by search with profiles (see sources.tables.read_profiles)."""
    from clusterlake.operators import profiles

    genes = files.select("hash", F.explode("cds").alias("g")).select("hash", F.col("g.orf").alias("orf"), F.col("g.aa_seq").alias("aa_seq"), F.xxhash64("hash", "g.orf").alias("gene_id"))
    genes = written(genes, "proteins")
    hits = profiles.search(genes, found, o.settings.domain_overlap).join(genes.select("gene_id", "hash", "orf"), "gene_id")
    return hits.select("hash", "orf", "accession", F.col("start").alias("env_start"), F.col("stop").alias("env_stop"), F.col("score").alias("bit_score"), "alignment")


def profile_set(profiles: DataFrame) -> str:
    """The id of a set of profiles by its contents, whatever their order."""
    each = F.xxhash64("accession", "trusted_domain", "body").cast("decimal(38,0)")
    n = profiles.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("a"), F.sum(F.xxhash64(F.lit(1), "accession", "body").cast("decimal(38,0)")).alias("b")).first()
    return identity({"profiles": n["n"], "a": str(n["a"]), "b": str(n["b"])})


def edge_parameters(store: RunStore, names: Iterable[str], o: Options) -> dict[str, str]:
    """The id of the parameters that pairs of each set of weights are scored with."""
    return {w: store.parameters("edges", {"weights": WEIGHTS.get(w, WEIGHTS["mix"]), "alignment_mode": o.alignment_mode, "extend_strategy": o.extend_strategy, **o.settings.scoring()}) for w in names}


def digests(feats: DataFrame) -> DataFrame:
    """(record_id, features): what a record's scores depend on, as a number of 60 bits."""
    text = F.to_json(F.struct("kind", "product", "contig_edge", "genes"), {"ignoreNullFields": "false"})
    return feats.select("record_id", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("features"))


def _named(df: DataFrame, ids: dict[str, str], source: str, target: str) -> DataFrame:
    """With a column of names for ids, or of ids for names: a few sets of weights."""
    pairs_ = [(v, k) if source == "param_id" else (k, v) for k, v in sorted(ids.items())]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(pairs_, f"{source} string, {target} string")), source)


#: Records that are broadcast to their stored edges at most.
FEW_RECORDS = 1_000_000


def stored_edges(store: RunStore, b: DataFrame, feats: DataFrame, o: Options) -> DataFrame | None:
    """Edges of the records of bins (bin, record_id, weights), as they are now, that are stored with the parameters of the options: none of other records, of others' features or parameters."""
    e = store.load("edges")
    if e is None:
        return None
    ids = edge_parameters(store, [r["weights"] for r in b.select("weights").distinct().collect()], o)
    e = _named(e, ids, "param_id", "weights").drop("param_id")
    r = written(b.select("bin", "weights", "record_id").distinct().join(digests(feats), "record_id"), "now")
    a = r.select("bin", "weights", F.col("record_id").alias("a"), F.col("features").alias("a_features"))
    other = r.select("bin", F.col("record_id").alias("b"), F.col("features").alias("b_features")).distinct()
    if r.limit(FEW_RECORDS + 1).count() <= FEW_RECORDS:
        a, other = F.broadcast(a), F.broadcast(other)
    return e.join(a, ["weights", "a", "a_features"]).join(other, ["bin", "b", "b_features"], "left_semi").drop("a_features", "b_features")


def store_edges(store: RunStore, e: DataFrame, feats: DataFrame, o: Options, weights: Iterable[str] | None = None) -> None:
    """Stores edges (weights, a, b, ...) with their parameters and the digests of both ends; one that is there is replaced, as it has got its match since. Edges that bring the digests, as a_features and b_features, are each there once."""
    ids = edge_parameters(store, [r["weights"] for r in e.select("weights").distinct().collect()] if weights is None else weights, o)
    if not ids:
        return
    key = ("param_id", "a", "b", "a_features", "b_features")
    if "a_features" in e.columns:
        rows = _named(e.drop("bin"), ids, "weights", "param_id").drop("weights")
    else:
        d = written(digests(feats), "digests")
        side = lambda s: d.select(F.col("record_id").alias(s), F.col("features").alias(f"{s}_features"))
        rows = _named(e.drop("bin").dropDuplicates(["weights", "a", "b"]), ids, "weights", "param_id").drop("weights").join(side("a"), "a").join(side("b"), "b")
    rows = rows.select(*key, *(c for c in rows.columns if c not in key))
    with store.transaction() as t:
        old = t.load("edges")
        old = None if old is None else old.where(F.col("param_id").isin(*ids.values()))
        if old is None or old.isEmpty():  # none of these parameters, so that none can be there
            t.append("edges", rows)
            return
        rows = written(rows, "edges")
        again = not rows.join(old.select(*key), list(key), "left_semi").isEmpty()
        t.add("edges", rows, replace=True) if again else t.append("edges", rows)


class StoredRun:
    """A run whose tables are in a store: it does the first task that isn't done, until none is left. A run that was killed goes on with that one when it is called again with the same options and input."""

    def __init__(self, spark: SparkSession, folder: str, store: RunStore, hits: DataFrame | None, found: DataFrame | None, o: Options, query_hash: str | None = None):
        if (hits is None) == (found is None):
            raise ValueError("either hits or profiles are needed")
        self.spark, self.store, self.o, self.query_hash = spark, store, o, query_hash
        self.files = found_files(spark, folder, o.include_files, o.exclude_files)
        self.listed = written(listed(self.files), "listed")
        self.profiles, self.given = found, hits
        self.profile_set = profile_set(found) if found is not None else None
        inputs = self.listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("x")).first()
        self.run_id = store.begin(identity({"options": o.identity(), "files": [inputs["n"], str(inputs["x"])], "profile_set": self.profile_set, "query": query_hash}), repr(o))
        self.out: dict[str, DataFrame] | None = None

    def run(self) -> dict[str, DataFrame]:
        steps = {"SAVE_FILES": self.save_files, "SCAN": self.scan, "ALIGN": self.align}
        while (task := self.store.task(self.listed, self.profile_set, self.o.force)) in steps:
            self.note(task)
            steps[task]()
        self.note("COMPARE")
        self.compare()
        return self.out

    def note(self, task: str) -> None:
        change = self.spark.createDataFrame([(self.run_id, task)], "run_id string, task string")
        with self.store.transaction() as t:
            t.save("runs", state.update(t.load("runs"), change, "run_id"))

    def save_files(self) -> None:
        """Parses the files whose contents aren't stored."""
        old = self.store.load("files")
        new = self.listed if old is None else state.missing(self.listed, old.where(F.col("force") == self.o.force), "hash")
        rows = parsed(self.files, self.o.force, new).drop("path").withColumn("force", F.lit(self.o.force))
        with self.store.transaction() as t:
            t.add("files", rows)

    def own_files(self) -> DataFrame:
        """Stored files of this run, by the paths they have in it."""
        return self.store.load("files").where(F.col("force") == self.o.force).drop("force").join(self.listed, "hash")

    def scan(self, files: DataFrame | None = None) -> None:
        """Searches the files that these profiles haven't been searched for in; hits, and that the file was scanned, are noted together."""
        with self.store.transaction() as t:
            old = t.load("scanned")
            new = files if files is not None else self.own_files() if old is None else state.missing(self.own_files(), old.where(F.col("profile_set") == self.profile_set), "hash")
            new = written(new, "files")
            t.add("hits", scanned(self.spark, new.where("error IS NULL"), self.profiles, self.o).withColumn("profile_set", F.lit(self.profile_set)), replace=files is not None)
            t.add("scanned", new.select(F.lit(self.profile_set).alias("profile_set"), "hash"))

    def align(self) -> None:
        """Searches files again that have hits without an alignment; these hits go."""
        lacking = self.store.load("hits").where((F.col("profile_set") == self.profile_set) & F.col("alignment").isNull()).select("hash").distinct()
        again = written(self.own_files().join(lacking, "hash", "left_semi"), "files")
        with self.store.transaction() as t:
            t.save("hits", t.load("hits").where(~((F.col("profile_set") == self.profile_set) & F.col("alignment").isNull())))
        self.scan(again)

    def compare(self) -> None:
        """Scores the pairs that have no edge yet; then notes the records of the run, and that it is done."""
        hits = self.given if self.given is not None else self.store.load("hits").where(F.col("profile_set") == self.profile_set).drop("profile_set")
        t, h = of_files(written(self.own_files(), "files"), hits, self.o)
        known = lambda b, feats, o: stored_edges(self.store, b, feats, o)
        keep = lambda e, feats, o: store_edges(self.store, e, feats, o)
        self.out = clustered(t, h, self.o, known, keep) if self.query_hash is None else queried(t, h, self.query_hash, self.o, known, keep)
        bins_ = self.out["bins"] if "bins" in self.out else self.out["reached"].withColumn("bin", F.lit(self.query_hash))
        with self.store.transaction() as x:
            for name in ("containers", "records", "genes"):
                if name in self.out:
                    x.add(name, self.out[name])
            x.add("members", bins_.select(F.lit(self.run_id).alias("run_id"), F.col("bin").cast("string").alias("bin"), "record_id"))
            done = self.spark.createDataFrame([(self.run_id, "DONE")], "run_id string, task string")
            x.save("runs", state.update(x.load("runs"), done, "run_id"))


def stored_cluster(spark: SparkSession, folder: str, store: RunStore, hits: DataFrame | None = None, found: DataFrame | None = None, options: Options | None = None) -> dict[str, DataFrame]:
    """cluster(), going on from what is in the store and adding to it as it gets done: only files whose contents aren't there are parsed, only those that the profiles found haven't been searched for in are scanned, only pairs without an edge of these parameters and features are scored."""
    return StoredRun(spark, folder, store, hits, found, options or Options()).run()


def stored_query(spark: SparkSession, folder: str, store: RunStore, query_hash: str, hits: DataFrame | None = None, found: DataFrame | None = None, options: Options | None = None) -> dict[str, DataFrame]:
    """query() in the same way."""
    return StoredRun(spark, folder, store, hits, found, options or Options(), query_hash).run()


def trees(out: dict[str, DataFrame], o: Options) -> DataFrame:
    """(cutoff, bin, centre, newick, fasta) of the families of a run that have more than one member, by the most common domains of their centres."""
    m = out["families"].withColumn("centre", F.col("family")).withColumn("family", F.xxhash64("cutoff", "bin", "centre"))
    large = m.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family")
    m = written(m.join(large, "family", "left_semi"), "members")
    domains = out["features"].select("record_id", F.explode("genes").alias("g")).select("record_id", F.explode("g.hsps").alias("h")).select("record_id", F.col("h.accession").alias("domain"), F.col("h.alignment").alias("alignment"))
    of = m.select("family", "centre", "record_id").join(domains, "record_id").where("alignment IS NOT NULL")
    centres = m.select("family", "centre").distinct()
    often = alignment.tree_domains(m.select(F.col("family"), "record_id"), of.select("record_id", "domain").unionByName(of.where("record_id = centre").select(F.col("family").alias("record_id"), "domain")), o.settings.top_frequencies)
    t = alignment.trees(m.select("family", "centre", "record_id"), of.join(often.select("family", "domain"), ["family", "domain"], "left_semi").select("family", "record_id", "domain", "alignment"))
    return t.join(m.select("family", "cutoff", "bin").distinct(), "family").join(centres, "family").select("cutoff", "bin", "centre", "newick", "fasta")


def protein_items(spark: SparkSession, folder: str, settings: Settings | None = None) -> DataFrame:
    """(item, hash, protein): files by their path below the folder, in dots, and their hash, with their proteins joined in gene order. Records don't matter here; files whose genes can't be read are an error."""
    c = settings or Settings()
    every = written(read_files(spark, folder), "files")
    if some := every.where("error IS NOT NULL AND size(cds) = 0").select("path", "error").orderBy("path").limit(10).collect():
        raise ValueError("files can't be read, among them: " + "; ".join(f"{r['path']}: {r['error']}" for r in some))
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_replace(F.expr(f"substring(path, locate('/{name}/', path) + {len(name) + 2})"), "/", ".")
    return joined_proteins(every.withColumn("item", F.concat_ws("_", below, "hash")), c)


def joined_proteins(files: DataFrame, settings: Settings) -> DataFrame:
    """(item, hash, protein) of parsed files (item, ...) within the limits of length: proteins in gene order, without genes that overlap another."""
    some = files.where(F.size("cds") > 0).where(filters.within_length(F.col("nt_len"), settings.min_length, settings.max_length))
    genes = written(some.select(F.col("item").alias("container_id"), "hash", F.explode("cds").alias("g")).select("container_id", "hash", "g.*"), "genes")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("orf", "aa_seq"))), lambda g: g["aa_seq"]), "")
    return genes_that_stay(genes, settings.cds_overlap, again=True).groupBy(F.col("container_id").alias("item"), "hash").agg(text.alias("protein"))


def dereplicate(spark: SparkSession, folder: str, least: float = 0.8, settings: Settings | None = None) -> DataFrame:
    """(item, component, representative): files by sketches of their proteins, joined in gene order."""
    c = settings or Settings()
    items = written(protein_items(spark, folder, c), "proteins")
    hashed = items.select("item", F.explode(sketches.kmers(F.col("protein"), c.kmer)).alias("k")).select("item", F.xxhash64("k").alias("token"))
    # The least of 2**64 values over the scale; signed numbers are moved up by half the range.
    scaled = hashed.where(F.col("token").cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)") < F.lit(str(2**64 // c.scaled)).cast("decimal(38,0)")).distinct()
    return sketches.dereplicate(items, scaled, least)


def benchmark(spark: SparkSession, curated: str, computed: str) -> dict[str, DataFrame]:
    """Measures of a computed clustering file against a curated one."""
    labels = written(evaluate.paired(read_labels(spark, curated), read_labels(spark, computed)), "labels")
    return {f.__name__: f(labels) for f in (evaluate.purity_and_entropy, evaluate.v_measure, evaluate.associations, evaluate.confusion, evaluate.summary)}


def benchmark_run(spark: SparkSession, curated: str, run: str) -> dict[str, DataFrame]:
    """Measures for each cutoff of a run, of the newest clustering files in its folder, against a curated file."""
    return benchmark_labels(spark, curated, read_run_labels(spark, run))


def benchmark_labels(spark: SparkSession, curated: str, computed: DataFrame) -> dict[str, DataFrame]:
    """Measures for each cutoff of labels (cutoff, item, label) against a curated file."""
    labels = written(computed.withColumnRenamed("label", "computed").join(read_labels(spark, curated).withColumnRenamed("label", "curated"), "item"), "labels")
    out = {"by_cutoff": evaluate.by_cutoff(labels)}
    for c in sorted(r["cutoff"] for r in labels.select("cutoff").distinct().collect()):  # cutoffs are options of a run, a result each
        own = labels.where(F.col("cutoff") == c).drop("cutoff")
        out |= {f"{f.__name__}_c{c}": f(own) for f in (evaluate.purity_and_entropy, evaluate.v_measure, evaluate.associations, evaluate.confusion, evaluate.summary)}
    return out


__all__ = ["Options", "benchmark", "benchmark_run", "cluster", "dereplicate", "protein_items", "query", "scanned", "stored_cluster", "stored_query", "trees"]
