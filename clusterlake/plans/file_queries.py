"""Registered queries of the sources: the driver's tables are put into the formats that the sources read, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.operators import filters
from clusterlake.plans import workflows
from clusterlake.plans.model import table
from clusterlake.plans.queries import query
from clusterlake.plans.scratch import released, shared_dir, written
from clusterlake.sources import genbank
from clusterlake.sources import tables as sources


def scratch_folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Flat files: a customer is a file, an order a protocluster of 1000 bases with a core, and a line item a gene of it.

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
SQL_FLAT = f"""o AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderstatus AS product, o_orderpriority AS category FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
size_ AS (SELECT k, max(n) AS n FROM o GROUP BY 1),
g AS (SELECT k, o.n, row_number() OVER (PARTITION BY o.k, o.n ORDER BY {ORDER}) AS j, l_returnflag = 'R' AS back, l_linestatus = 'F' AS core, p_size, p_brand, l_quantity FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
gene AS (SELECT k, n, j, row_number() OVER (PARTITION BY k ORDER BY n, j) AS orf, (n - 1) * 1000 + (j - 1) * 90 AS a, (n - 1) * 1000 + (j - 1) * 90 + 3 * (p_size + 1) AS b, back, core, 'M' || repeat('A', p_size) AS aa, p_brand, l_quantity FROM g),
file_ AS (SELECT k, c_name || '.region001.gbk' AS file, n, c_mktsegment, n_name, r_name, k % 5 = 0 AND n > 1 AS merged FROM size_ JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def flat_files(spark, sf) -> DataFrame:
    """(path, content): each customer with orders as a file; of every fifth, the protoclusters are to be merged."""
    c, n, r, o, li, p = (table(spark, sf, x) for x in ("customer", "nation", "region", "orders", "lineitem", "part"))
    feature = lambda kind, where, *q: F.concat(F.lit(f"     {kind:<16}"), where, F.lit("\n"), *(F.concat(F.lit(f"                     /{k}=\""), v.cast("string"), F.lit("\"\n")) for k, v in q))
    span = lambda a, b: F.concat(a.cast("string"), F.lit(".."), b.cast("string"))
    o = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    g = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    g = g.withColumn("j", F.row_number().over(W.partitionBy("o_custkey", "n").orderBy(*ORDER.split(", "))))
    a = (F.col("n") - 1) * 1000 + (F.col("j") - 1) * 90
    where = span(a + 1, a + 3 * (F.col("p_size") + 1))
    where = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("complement("), where, F.lit(")"))).otherwise(where)
    cds = feature("CDS", where, ("gene_kind", F.when(F.col("l_linestatus") == "F", "biosynthetic").otherwise("other")), ("translation", F.concat(F.lit("M"), F.expr("repeat('A', p_size)"))))
    genes = g.groupBy("o_custkey", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", cds.alias("t")))), lambda x: x["t"]), "").alias("cds"))
    at = (F.col("n") - 1) * 1000
    proto = F.concat(
        feature("protocluster", span(at + 1, at + 1000), ("protocluster_number", F.col("n")), ("category", F.col("o_orderpriority")), ("product", F.col("o_orderstatus")), ("contig_edge", F.when(F.col("o_orderstatus") == "P", "True").otherwise("False"))),
        feature("proto_core", span(at + 101, at + 200), ("protocluster_number", F.col("n")), ("product", F.col("o_orderstatus"))),
    )
    each = o.join(genes, ["o_custkey", "n"], "left").select(F.col("o_custkey").alias("k"), "n", F.concat(proto, F.coalesce("cds", F.lit(""))).alias("t"), feature_list("protoclusters", F.col("n")).alias("m"))
    in_order = lambda x: F.array_join(F.array_sort(F.collect_list(F.struct("n", F.col(x).alias("x"))))["x"], "").alias(x)
    body = each.groupBy("k").agg(F.max("n").alias("n"), in_order("t"), in_order("m"))
    f = body.join(c.withColumnRenamed("c_custkey", "k"), "k").join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).withColumnRenamed("n_nationkey", "c_nationkey")), "c_nationkey")
    whole = span(F.lit(1), F.col("n") * 1000)
    kind = F.when((F.col("k") % 5 == 0) & (F.col("n") > 1), "interleaved").otherwise("neighbouring")
    head = F.concat(
        F.lit("LOCUS       "), "c_name", F.lit(" "), (F.col("n") * 1000).cast("string"), F.lit(" bp    DNA     linear   UNK 01-JAN-2020\nDEFINITION  Orders of\n            "), "c_mktsegment", F.lit(".\nSOURCE      .\n  ORGANISM  "), "n_name", F.lit("\n            "), "r_name", F.lit(";\n            "), "n_name",
        F.lit(".\nCOMMENT     ##antiSMASH-Data-START##\n            Version      :: 7.0.0\n            ##antiSMASH-Data-END##\nFEATURES             Location/Qualifiers\n"),
    )
    text = F.concat(head, feature("region", whole, ("region_number", F.lit(1)), ("product", F.col("c_mktsegment")), ("contig_edge", F.lit("False")), ("candidate_cluster_numbers", F.lit(1))), feature("cand_cluster", whole, ("candidate_cluster_number", F.lit(1)), ("kind", kind), ("product", F.col("c_mktsegment")), ("contig_edge", F.lit("False"))), F.col("m"), F.col("t"), F.lit("ORIGIN\n//\n"))
    return f.select(F.concat(F.lit("/in/"), "c_name", F.lit(".region001.gbk")).alias("path"), text.alias("content"))


def parsed_files(spark, sf) -> DataFrame:
    """flat_files() parsed, written. Their texts are made once, as hashing and parsing each read them."""
    f = written(flat_files(spark, sf), "contents")
    out = written(genbank.parsed(f), "files")
    released(f)
    return out


def feature_list(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"                     /{name}=\""), value.cast("string"), F.lit("\"\n"))


def file() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("file")


@query(f"WITH {SQL_FLAT} SELECT file, CAST(n * 1000 AS INTEGER) AS nt_len, n_name AS organism, r_name || ';' || n_name AS taxonomy, 'Orders of ' || c_mktsegment || '.' AS description, '7.0.0' AS version FROM file_")
def flat_file_containers(spark, sf):
    """Every file twice, under two paths: of equal contents, the least path."""
    f = written(flat_files(spark, sf), "contents")
    twice = f.unionByName(f.withColumn("path", F.concat(F.lit("/more"), "path")))
    return genbank.tables(genbank.parsed(twice))["containers"].where("path LIKE '/in/%'").select(file(), "nt_len", "organism", "taxonomy", "description", "version")


@query(f"""WITH {SQL_FLAT}, label AS (SELECT k, string_agg(DISTINCT product, '.' ORDER BY product) AS product, string_agg(DISTINCT category, '.' ORDER BY category) AS category, bool_or(product = 'P') AS edge FROM o GROUP BY 1),
core AS (SELECT k, n, (n - 1) * 1000 + 100 AS a, (n - 1) * 1000 + 200 AS b FROM o)
SELECT file, 'region' AS record_type, 1 AS number, CAST(NULL AS VARCHAR) AS parent, 0 AS nt_start, CAST(f.n * 1000 AS INTEGER) AS nt_stop, c_mktsegment AS product, category, false AS contig_edge FROM file_ f JOIN label USING (k)
UNION ALL SELECT file, 'cand_cluster', 1, 'region 1', 0, CAST(f.n * 1000 AS INTEGER), c_mktsegment, category, false FROM file_ f JOIN label USING (k)
UNION ALL SELECT file, 'protocluster', CAST(o.n AS INTEGER), 'cand_cluster 1', CAST((o.n - 1) * 1000 AS INTEGER), CAST(o.n * 1000 AS INTEGER), product, category, product = 'P' FROM file_ f JOIN o USING (k) WHERE NOT merged
UNION ALL SELECT file, 'protocluster', 1, 'cand_cluster 1', 0, CAST(f.n * 1000 AS INTEGER), product, category, edge FROM file_ f JOIN label USING (k) WHERE merged
UNION ALL SELECT file, 'proto_core', CAST(o.n AS INTEGER), 'protocluster ' || o.n, CAST(a AS INTEGER), CAST(b AS INTEGER), product, category, false FROM file_ f JOIN o USING (k) JOIN core USING (k) WHERE core.n = o.n AND NOT merged
UNION ALL SELECT file, 'proto_core', 1, 'protocluster 1', 100, CAST((f.n - 1) * 1000 + 200 AS INTEGER), product, category, false FROM file_ f JOIN label USING (k) WHERE merged""")
def flat_file_records(spark, sf):
    """Records of all levels with the parent that each names; protoclusters of interleaved candidate clusters are merged."""
    t = genbank.tables(parsed_files(spark, sf))
    r = t["records"].join(t["containers"].select("container_id", file()), "container_id")
    up = r.select(F.col("record_id").alias("parent_id"), F.concat_ws(" ", "record_type", F.col("number").cast("string")).alias("parent"))
    return r.join(up, "parent_id", "left").select("file", "record_type", "number", "parent", "nt_start", "nt_stop", "product", "category", "contig_edge")


@query(f"WITH {SQL_FLAT} SELECT file, CAST(orf AS INTEGER) AS orf, CAST(a AS INTEGER) AS nt_start, CAST(b AS INTEGER) AS nt_stop, CASE WHEN back THEN -1 ELSE 1 END AS strand, CASE WHEN core THEN 'biosynthetic' ELSE 'other' END AS gene_kind, aa AS aa_seq FROM gene JOIN file_ USING (k)")
def flat_file_genes(spark, sf):
    t = genbank.tables(parsed_files(spark, sf))
    return t["genes"].join(t["containers"].select("container_id", file()), "container_id").select("file", "orf", "nt_start", "nt_stop", "strand", "gene_kind", "aa_seq")


@query(f"""WITH {SQL_FLAT}, p AS (SELECT k, n, (n - 1) * 1000 AS a, n * 1000 AS b, (n - 1) * 1000 + 100 AS c, (n - 1) * 1000 + 200 AS d FROM o JOIN file_ USING (k) WHERE NOT merged AND file_.n > 0)
SELECT file, CAST(p.n AS INTEGER) AS number, CAST(orf AS INTEGER) AS orf, core AS is_core, gene.a >= c AND gene.b <= d AS in_protocore, CASE WHEN l_quantity > 25 THEN 'PF' || lpad(CAST(p_size AS VARCHAR), 5, '0') ELSE '' END AS domains
FROM (SELECT o.k, o.n, (o.n - 1) * 1000 AS a, o.n * 1000 AS b, (o.n - 1) * 1000 + 100 AS c, (o.n - 1) * 1000 + 200 AS d FROM o JOIN file_ USING (k) WHERE NOT merged) p JOIN (SELECT gene.*, length(aa) - 1 AS p_size FROM gene) gene ON gene.k = p.k AND gene.a >= p.a AND gene.b <= p.b JOIN file_ ON file_.k = p.k""")
def record_gene_hits(spark, sf):
    """Genes within each protocluster, whether they are core genes and lie within the core, and their hits, whose accessions lose their version."""
    t = genbank.tables(parsed_files(spark, sf))
    single = t["records"].where("record_type = 'cand_cluster' AND kind = 'neighbouring'").select("container_id")
    r = t["records"].where("record_type = 'protocluster'").join(single, "container_id", "left_semi")
    quantity = gene_quantities(spark, sf).join(t["containers"].select("container_id", file()), "file")
    hits = quantity.where("l_quantity > 25").select("container_id", "orf", F.format_string("PF%05d.2", "p_size").alias("accession"), F.lit(1).alias("env_start"), F.lit(9).alias("env_stop"), F.lit(1.0).alias("bit_score"), F.lit("A").alias("alignment"))
    g = workflows.record_genes(r, t["genes"], hits, t["records"]).join(r.select("record_id", "container_id", "number"), "record_id").join(t["containers"].select("container_id", file()), "container_id")
    return g.select("file", "number", "orf", "is_core", "in_protocore", F.array_join("hsps.accession", ",").alias("domains"))


def gene_quantities(spark, sf) -> DataFrame:
    """(file, orf, l_quantity, p_size) of the genes of flat_files()."""
    c, o, li, p = (table(spark, sf, x) for x in ("customer", "orders", "lineitem", "part"))
    o = o.join(c, o.o_custkey == c.c_custkey).withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    g = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    orf = F.row_number().over(W.partitionBy("o_custkey").orderBy("n", *ORDER.split(", ")))
    return g.select(F.concat("c_name", F.lit(".region001.gbk")).alias("file"), orf.alias("orf"), "l_quantity", "p_size")


@query(f"WITH {SQL_FLAT} SELECT file AS item, string_agg(aa, '' ORDER BY orf) AS protein FROM gene JOIN file_ USING (k) GROUP BY 1")
def joined_proteins(spark, sf):
    """Proteins of each file in gene order, as dereplication sketches them; overlaps of any size are let pass here."""
    from dataclasses import replace

    from clusterlake.plans.config import Settings

    files = parsed_files(spark, sf).withColumn("item", file())
    return workflows.joined_proteins(files, replace(Settings(), cds_overlap=10.0)).select("item", "protein")


@query("SELECT 'p' || p_partkey || '.region1.gbk' AS file, 'M' || repeat('A', p_size) || CASE WHEN p_size % 4 = 1 THEN 'X' ELSE '' END AS aa_seq, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END AS strand FROM part")
def translated_genes(spark, sf):
    """Genes without a translation get one, on both strands, up to the stop; an ambiguous codon is X, and a fuzzy start is trimmed to whole codons."""
    p = table(spark, sf, "part")
    coding = F.concat(F.when(F.col("p_size") % 3 == 0, F.lit("C")).otherwise(""), F.lit("ATG"), F.expr("repeat('GCT', p_size)"), F.when(F.col("p_size") % 4 == 1, "NNN").otherwise(""), F.lit("TAAGGG"))
    back = F.col("p_partkey") % 2 == 0
    nt = F.when(back, F.translate(F.reverse(coding), "ACGT", "TGCA")).otherwise(coding)
    fuzzy = F.col("p_size") % 3 == 0
    where = F.when(back, F.concat(F.lit("complement(1.."), F.when(fuzzy, ">").otherwise(""), F.length(coding).cast("string"), F.lit(")"))).otherwise(F.concat(F.when(fuzzy, "<").otherwise(""), F.lit("1.."), F.length(coding).cast("string")))
    head = "\nCOMMENT     ##antiSMASH-Data-START##\n            Version      :: 7.0.0\n            ##antiSMASH-Data-END##\nFEATURES             Location/Qualifiers\n     region          1..9\n                     /region_number=\"1\"\n     CDS             "
    text = F.concat(F.lit("LOCUS       p "), F.length(coding).cast("string"), F.lit(" bp    DNA" + head), where, F.lit("\nORIGIN\n        1 "), F.lower(nt), F.lit("\n//\n"))
    files = p.select(F.concat(F.lit("/in/p"), F.col("p_partkey").cast("string"), F.lit(".region1.gbk")).alias("path"), F.concat(text, F.lit("# "), F.col("p_partkey").cast("string")).alias("content"))
    t = genbank.tables(written(genbank.parsed(files), "files"))
    return t["genes"].join(t["containers"].select("container_id", file()), "container_id").select("file", "aa_seq", "strand")


def old_files(spark, sf) -> DataFrame:
    """Suppliers as files of the old layout; every fourth lacks its cluster, every ninth its number."""
    s = table(spark, sf, "supplier")
    cluster = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("     cluster         1..500\n                     /note=\""), F.when(F.col("s_suppkey") % 9 == 0, "No number").otherwise(F.concat(F.lit("Cluster number: "), F.col("s_suppkey").cast("string"))), F.lit("\"\n                     /product=\"nrps-t1pks\"\n")))
    text = F.concat(F.lit("LOCUS       "), "s_name", F.lit(" 500 bp    DNA\nFEATURES             Location/Qualifiers\n"), cluster, F.lit("ORIGIN\n//\n"))
    return s.select(F.concat(F.lit("/in/"), "s_name", F.lit(".cluster001.gbk")).alias("path"), text.alias("content"))


@query("SELECT s_name || '.cluster001.gbk' AS file, CAST(s_suppkey AS INTEGER) AS number, 'nrps.t1pks' AS product, '4' AS version FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 0")
def old_layout_records(spark, sf):
    t = genbank.tables(written(genbank.parsed(old_files(spark, sf)), "files"))
    return t["records"].join(t["containers"].select("container_id", "version", file()), "container_id").select("file", "number", "product", "version")


@query("SELECT s_name || '.cluster001.gbk' AS file, CASE WHEN s_suppkey % 4 = 0 THEN 'BadFile: no cluster feature' ELSE 'BadFile: a cluster without number' END AS error FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 9 = 0")
def files_with_errors(spark, sf):
    return genbank.parsed(old_files(spark, sf)).where("error IS NOT NULL").select(file(), "error")


@query("SELECT s_name || '.cluster001.gbk' AS file, 'other' AS product, 500 AS nt_stop FROM supplier WHERE s_suppkey % 4 = 0")
def forced_files(spark, sf):
    """Files without a cluster, taken as one region by force."""
    t = genbank.tables(written(genbank.parsed(old_files(spark, sf), force=True), "files"))
    return t["records"].where("product = 'other'").join(t["containers"].select("container_id", file()), "container_id").select("file", "product", "nt_stop")


@query("SELECT name FROM (SELECT p_name || '_' || p_type || '.gbk' AS name FROM part) WHERE NOT contains(name, 'STEEL') AND (contains(name, 'ECONOMY') OR contains(name, 'PROMO') OR contains(name, 'ring')) GROUP BY 1")
def file_names(spark, sf):
    names = table(spark, sf, "part").select(F.concat("p_name", F.lit("_"), "p_type", F.lit(".gbk")).alias("name"))
    return names.where(filters.file_name_filter(F.col("name"), ("ECONOMY", "PROMO", "ring"), ("STEEL",))).distinct()


# Text files.


@query("SELECT CAST(doc_id AS VARCHAR) AS item, lang AS label FROM documents WHERE lang IS NOT NULL")
def labels_short(spark, sf):
    path = scratch_folder(spark, "labels")
    table(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("BGC"), F.col("lang").alias("family")).write.option("sep", "\t").option("header", True).csv(path)
    return sources.read_labels(spark, path)


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'r' || o_orderkey ELSE 'r' || o_orderkey || '_' || o_orderstatus || '_' || o_custkey END AS item, CAST(o_custkey AS VARCHAR) AS label FROM orders")
def labels_long(spark, sf):
    path = scratch_folder(spark, "labels")
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "region").otherwise(F.col("o_orderstatus"))
    o.select(F.concat(F.lit("r"), "o_orderkey").alias("Record"), F.lit("g").alias("GBK"), kind.alias("Record_Type"), F.col("o_custkey").alias("Record_Number"), F.lit(1).alias("CC"), filters.family_name(F.col("o_custkey")).alias("Family")).write.option("sep", "\t").option("header", True).csv(path)
    return sources.read_labels(spark, path)


@query("SELECT CAST(o_custkey % 3 AS DOUBLE) / 10 AS cutoff, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey WHEN o_orderstatus = 'F' THEN 'r' || o_orderkey ELSE 'r' || o_orderkey || '_' || o_orderstatus || '_7' END AS item, CAST(o_custkey AS VARCHAR) AS label FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders)")
def run_labels(spark, sf):
    """Lines of the newest run's clustering files, in both layouts; the runs are named by time."""
    o = table(spark, sf, "orders")
    day = F.concat(F.lit("/runs/a_2024-01-0"), F.substring("o_orderpriority", 1, 1), F.lit("_10-00-00_c0/mix/mix_clustering_c0."), (F.col("o_custkey") % 3).cast("string"), F.lit(".tsv"))
    kind = F.when(F.col("o_orderstatus") == "F", "region").otherwise(F.col("o_orderstatus"))
    long = F.concat_ws("\t", F.concat(F.lit("r"), "o_orderkey"), F.lit("g"), kind, F.lit("7"), F.lit("1"), filters.family_name(F.col("o_custkey")))
    short = F.concat_ws("\t", F.concat(F.lit("s"), "o_orderkey"), F.col("o_custkey").cast("string"))
    lines = o.select(day.alias("path"), F.when(F.col("o_orderkey") % 2 == 0, short).otherwise(long).alias("value"))
    heads = lines.select("path").distinct().withColumn("value", F.lit("Record\tGBK\tRecord_Type\tRecord_Number\tCC\tFamily"))
    return sources.labels_of_lines(sources.newest(lines.unionByName(heads)))


@query("""SELECT c_nationkey / 10 AS cutoff, c_name AS item, CAST(o_orderkey AS VARCHAR) AS label FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = (SELECT max(n_nationkey) FROM nation n WHERE n.n_nationkey // 5 = c_nationkey // 5)""")
def membership_labels(spark, sf):
    """Tables of a result database: customers are its items, orders its families, nations its clusterings, five of which share a threshold."""
    c, o, n = (table(spark, sf, x) for x in ("customer", "orders", "nation"))
    last = n.groupBy(F.floor(F.col("n_nationkey") / 5).alias("t")).agg(F.max("n_nationkey").alias("m"))
    clustering = n.withColumn("t", F.floor(F.col("n_nationkey") / 5)).join(last, "t").select(F.col("n_nationkey").alias("id"), (F.col("m") / 10).alias("threshold"))
    bgc = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("/data/"), "c_name", F.lit(".gbk")).alias("orig_filename"))
    own = o.join(c, o.o_custkey == c.c_custkey)
    return sources.membership_labels(bgc, own.select(F.col("o_custkey").alias("bgc_id"), F.col("o_orderkey").alias("gcf_id")), own.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("clustering_id")), clustering)


@query("SELECT least(x, y) AS a, greatest(x, y) AS b, j AS jaccard FROM (SELECT DISTINCT 'p' || l_partkey AS x, 's' || l_suppkey AS y, l_discount * 10 AS j FROM lineitem) WHERE j >= 0.5")
def sketch_comparison(spark, sf):
    path = scratch_folder(spark, "comparison")
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("query_name"), F.lit("x").alias("query_md5"), F.concat(F.lit("s"), "l_suppkey").alias("match_name"), F.lit("y").alias("match_md5"), F.lit(1).alias("containment"), F.lit(1).alias("max_containment"), (F.col("l_discount") * 10).alias("jaccard"))
    li.unionByName(li.selectExpr("match_name AS query_name", "query_md5", "query_name AS match_name", "match_md5", "containment", "max_containment", "jaccard")).write.option("header", True).csv(path)
    return sources.read_sketch_comparison(spark, path, 0.5)[0]


@query("SELECT DISTINCT 'PF' || lpad(CAST(p_partkey % 500 AS VARCHAR), 5, '0') AS domain FROM part WHERE p_size > 3")
def domain_list(spark, sf):
    path = scratch_folder(spark, "domains")
    p = table(spark, sf, "part")
    accession = F.format_string("PF%05d", F.col("p_partkey") % 500)
    line = F.when(F.col("p_size") <= 3, F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(accession, F.lit(".7"))).otherwise(accession), F.lit("\t"), F.col("p_name")))
    p.select(line.alias("value")).write.text(path)
    return sources.read_domain_list(spark, path)


@query("SELECT format('PF{:05d}', p_partkey) AS accession, p_brand AS name, CAST(p_size AS INTEGER) AS length, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) / 2 END AS trusted_domain FROM part")
def profile_database(spark, sf):
    path = scratch_folder(spark, "profiles")
    p = table(spark, sf, "part")
    cut = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("TC    99.00 "), (F.col("p_size") / 2).cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("HMMER3/f [x]\nNAME  "), "p_brand", F.lit("\n"), F.format_string("ACC   PF%05d.3\n", "p_partkey"), F.lit("LENG  "), F.col("p_size").cast("string"), F.lit("\n"), cut, F.lit("HMM\n//"))
    p.select(text.alias("value")).write.text(path)
    return sources.read_profiles(spark, path).select("accession", "name", "length", "trusted_domain")


@query("SELECT min(link) AS link FROM (SELECT 'mibig_antismash_4.0_gbk_as' || page_id || '.tar.bz2' AS link FROM pages)")
def release_link(spark, sf):
    """The archive of a release among the links of pages."""
    p = table(spark, sf, "pages")
    link = lambda v: F.concat(F.lit(f'<a href="mibig_antismash_{v}_gbk_as'), F.col("page_id").cast("string"), F.lit('.tar.bz2">'))
    return sources.release_link(p.select(F.concat("html", link("3.1"), link("4.0"), link("400")).alias("value")), "4.0")
