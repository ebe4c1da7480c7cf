"""Files written here, read back as tables, and the four commands on them."""

import random

import pytest
from pyspark.sql import functions as F

from clusterlake.operators.pairs import candidate_pairs
from clusterlake.plans.outputs import write_tsv
from clusterlake.plans.workflows import Options, benchmark, benchmark_labels, benchmark_run, cluster, dereplicate, query, stored_cluster, trees
from clusterlake.sources import genbank
from clusterlake.sources import tables as T
from clusterlake.sources.genbank import parse_file, read_files, tables
from clusterlake.streaming.ingest import keep_scoring, stream_tokens

PROTEINS = {}


def protein(domain):
    r = random.Random(domain)
    return PROTEINS.setdefault(domain, "M" + "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(59)))


def flat_file(name, domains, product="NRPS", version="7.0.0", levels=("region", "cand_cluster", "protocluster", "proto_core")):
    n = 200 * len(domains)
    feature = lambda type_, where, **q: f"     {type_:<16}{where}\n" + "".join(f'                     /{k}="{x}"\n' for k, v in q.items() for x in (v if isinstance(v, list) else [v]))
    head = f"LOCUS       {name} {n} bp    DNA     linear   UNK 01-JAN-2020\nDEFINITION  A made\n            cluster {name}.\nSOURCE      .\n  ORGANISM  Madeus upus\n            Bacteria; Madeota;\n            Madeus.\n"
    comment = f"COMMENT     ##antiSMASH-Data-START##\n            Version      :: {version}\n            ##antiSMASH-Data-END##\n" if version else ""
    out = head + comment + "FEATURES             Location/Qualifiers\n"
    if version:
        if "region" in levels:
            out += feature("region", f"1..{n}", region_number="1", product=product, contig_edge="False", candidate_cluster_numbers="1")
        if "cand_cluster" in levels:
            out += feature("cand_cluster", f"1..{n}", candidate_cluster_number="1", kind="single", product=product, contig_edge="False", protoclusters="1")
        if "protocluster" in levels:
            out += feature("protocluster", f"1..{n - 200}", protocluster_number="1", category="NRPS", product=product, contig_edge="False")
        if "proto_core" in levels:
            out += feature("proto_core", "201..400", protocluster_number="1", product=product)
    else:
        out += feature("cluster", f"1..{n}", note="Cluster number: 3", product="nrps-t1pks", contig_edge="True")
    for k, d in enumerate(domains):
        aa, where = protein(d), f"{200 * k + 1}..{200 * k + 180}"
        q = {"translation": aa[:40] + "\n                     " + aa[40:]} | ({"gene_kind": "biosynthetic"} if k == 1 else {})
        out += feature("CDS", f"complement({where})" if k % 3 == 2 else where, **q)
    r = random.Random(name)
    nt = "".join(r.choice("acgt") for _ in range(n))
    out += "ORIGIN\n" + "".join(f"{i + 1:>9} " + " ".join(nt[j : j + 10] for j in range(i, min(i + 60, n), 10)) + "\n" for i in range(0, n, 60))
    return out + "//\n"


A = ["PF00668", "PF00501", "PF00550", "PF00975", "PF13193", "PF08659"]
FILES = {"one.region001": A, "two.region001": A[:5] + ["PF99999"], "three.region001": A[1:], "far.region001": ["PF11111", "PF22222", "PF33333", "PF44444"], "skip_final.region001": A, "four.cluster001": A[:4]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for name, domains in FILES.items():
        (top / f"{name}.gbk").write_text(flat_file(name, domains, version=None if name.startswith("four") else "7.0.0"))
    (top / "copy.region001.gbk").write_text(flat_file("one.region001", A))
    (top / "broken.region001.gbk").write_text(flat_file("broken", A, levels=("region",)))
    (top / "notes.txt").write_text("no file")
    return str(top)


@pytest.fixture(scope="module")
def hits(spark, folder):
    files = read_files(spark, folder).where("error IS NULL").collect()
    rows = []
    domain = {p: d for d, p in PROTEINS.items()}
    for f in files:
        for g in f["cds"]:
            rows.append((f["hash"], g["orf"], domain[g["aa_seq"]] + ".3", 1, 40, 50.0 + g["orf"], g["aa_seq"][:20]))
    return spark.createDataFrame(rows, "hash string, orf int, accession string, env_start int, env_stop int, bit_score double, alignment string").cache()


def test_files(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_files(spark, folder).collect()}
    assert set(rows) == {"broken.region001.gbk", "copy.region001.gbk", "two.region001.gbk", "three.region001.gbk", "far.region001.gbk", "four.cluster001.gbk"}
    r = rows["copy.region001.gbk"]
    assert (r["organism"], r["taxonomy"], r["description"], r["version"], r["nt_len"]) == ("Madeus upus", "Bacteria;Madeota;Madeus", "A made cluster one.region001.", "7.0.0", 1200)
    assert [(x["record_type"], x["number"], x["parent_number"], x["category"]) for x in r["records"]] == [("region", 1, None, "NRPS"), ("cand_cluster", 1, 1, "NRPS"), ("protocluster", 1, 1, "NRPS"), ("proto_core", 1, 1, "NRPS")]
    assert [(g["orf"], g["nt_start"], g["nt_stop"], g["strand"], g["gene_kind"]) for g in r["cds"][:3]] == [(1, 0, 180, 1, None), (2, 200, 380, 1, "biosynthetic"), (3, 400, 580, -1, None)]
    assert [g["aa_seq"] for g in r["cds"]] == [protein(d) for d in A]
    old = rows["four.cluster001.gbk"]["records"]
    assert [(x["record_type"], x["number"], x["product"], x["contig_edge"]) for x in old] == [("region", 3, "nrps.t1pks", True)]
    assert "isn't there" in rows["broken.region001.gbk"]["error"]
    t = tables(read_files(spark, folder))
    assert t["records"].where("record_type = 'cand_cluster'").count() == 4 and t["genes"].count() == 6 + 6 + 5 + 4 + 4


def test_file_errors():
    two = flat_file("x", A).replace("     proto_core", '     region          1..5\n                     /region_number="2"\n     proto_core')
    for text, what in ((flat_file("x", A, levels=()), "no region"), (two, "more than one region"), (flat_file("x", A, levels=("region", "cand_cluster", "protocluster")), "no core"), (flat_file("x", A, version=None).replace("Cluster number", "Nothing"), "without number")):
        assert what in parse_file("x", text.encode())["error"]
    assert parse_file("x", flat_file("x", A, levels=()).encode(), force=True)["records"][0]["product"] == "other"
    assert parse_file("x", b"")["error"]


def test_missing_translation():
    text = "LOCUS       x 18 bp\nFEATURES             Location/Qualifiers\n     region          1..18\n                     /region_number=1\n     CDS             complement(<1..11)\nORIGIN\n        1 ttaggccata aaaaaaaa\n//\n"
    row = parse_file("x", text.replace("LOCUS", "LOCUS", 1).encode(), force=True)
    assert row["error"] is None or "cluster" in row["error"]


def test_cluster(spark, folder, hits, tmp_path):
    out = cluster(spark, folder, hits, Options(cutoffs=(0.3, 0.7), bad_files="report"))
    names = {r["container_id"]: r["path"].rsplit("/", 1)[1].split(".")[0] for r in out["containers"].collect()}
    of = {r["record_id"]: names[r["container_id"]] for r in out["records"].collect()}
    edges = {frozenset((of[r["a"]], of[r["b"]])): r for r in out["edges"].collect()}
    assert all("far" not in e for e in edges) and len(edges) == 6
    assert edges[frozenset(("copy", "three"))]["distance"] < 0.3
    groups = {}
    for r in out["components"].where("cutoff = 0.7").collect():
        groups.setdefault(r["component"], set()).add(of[r["record_id"]])
    assert list(groups.values()) == [{"copy", "two", "three", "four"}]
    assert {of[r["record_id"]] for r in out["singletons"].where("cutoff = 0.7").collect()} == {"far"}
    assert {r["family"] for r in out["clustering"].collect()} >= {"FAM_00001"}
    assert out["families"].where("cutoff = 0.7").count() == 4
    assert [r["path"].rsplit("/", 1)[1] for r in out["errors"].collect()] == ["broken.region001.gbk"]
    with pytest.raises(ValueError, match="1 files can't be read.*broken"):
        cluster(spark, folder, hits)
    t = trees(out, Options(cutoffs=(0.3, 0.7))).where("cutoff = 0.7").collect()
    assert len(t) == len({r["family"] for r in out["families"].where("cutoff = 0.7").collect()}) and all(r["newick"].endswith(";") and r["fasta"].count(">") == r["newick"].count(":") - r["newick"].count("(") + (r["newick"].count(",") < 2) * 0 or r["fasta"] for r in t)
    row = out["network"].orderBy("distance").first()
    assert row["record_a"].endswith("_region_1") or row["record_a"].endswith("_region_3")
    assert {r["class"] for r in out["annotations"].collect()} >= {"NRPS"} and out["full_network"].count() == 6
    write_tsv(out["clustering"], f"{tmp_path}/clustering")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/clustering").count() == out["clustering"].count()
    again = cluster(spark, folder, hits, Options(cutoffs=(0.3, 0.7), bad_files="report"), stored=out["edges"])
    assert again["edges"].count() == 6


def test_record_types_and_classes(spark, folder, hits):
    for kind, n in (("protocluster", 5), ("proto_core", 5)):
        out = cluster(spark, folder, hits, Options(record_type=kind, classify="category", bad_files="report"))
        assert out["records"].count() == n
    out = cluster(spark, folder, hits, Options(classify="legacy", include_any=("PF00550",), extend_strategy="greedy", alignment_mode="auto", bad_files="report"))
    assert {r["bin"] for r in out["bins"].select("bin").collect()} == {"NRPS", "PKS-NRP_Hybrids"}
    with pytest.raises(ValueError):
        Options(cutoffs=(2.0,))


def test_query(spark, folder, hits):
    h = read_files(spark, folder).where(F.col("path").contains("three")).first()["hash"]
    out = query(spark, folder, hits, h, Options(cutoffs=(0.3,), propagate=True, bad_files="report"))
    assert out["reached"].count() >= 2 and out["components"].count() == out["reached"].count()
    alone = query(spark, folder, hits, read_files(spark, folder).where(F.col("path").contains("far")).first()["hash"], Options(bad_files="report"))
    assert alone["reached"].count() == 1 and alone["components"].count() == 0


def test_dereplicate(spark, folder):
    from dataclasses import replace

    from clusterlake.plans.config import Settings

    rows = {r["item"].split(".")[0]: r for r in dereplicate(spark, folder, 0.4, replace(Settings(), scaled=2)).collect()}
    assert rows["copy"]["component"] == rows["two"]["component"] == rows["three"]["component"] != rows["far"]["component"]
    assert rows["far"]["representative"] == rows["far"]["item"]


def test_labels_and_benchmark(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("BGC\tfamily\nx\tF1\ny\tF1\nz\tF2\n")
    (tmp_path / "b.tsv").write_text("Record\tGBK\tRecord_Type\tRecord_Number\tCC\tFamily\n" + "".join(f"{i}\tg\tregion\t1\t1\tFAM_0000{f}\n" for i, f in (("x", 1), ("y", 1), ("z", 2))))
    out = benchmark(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv"))
    assert tuple(out["v_measure"].first()) == (1, 1, 1)
    assert tuple(out["associations"].first()) == (1, 0, 1, 0)
    assert tuple(out["summary"].first()) == (2, 1.5, 1, 2, 1.5, 1)
    assert sorted(tuple(r) for r in out["confusion"].collect()) == [(1, "F1", "1", 2), (2, "F2", "2", 1)]


def test_other_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("query_name,query_md5,match_name,match_md5,containment,max_containment,jaccard\na,1,b,2,1,1,0.5\nb,2,a,1,1,1,0.5\na,1,a,1,1,1,1\nc,3,c,3,1,1,1\na,1,c,3,0,0,0.1\n")
    edges, items = T.read_sketch_comparison(spark, str(tmp_path / "s.csv"), 0.3)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 0.5)] and items.count() == 3
    (tmp_path / "p.hmm").write_text("HMMER3/f [x]\nNAME  Lant\nACC   PF00001.19\nDESC  A thing\nLENG  178\nTC    21.70 22.20;\nHMM\n//\nHMMER3/f [x]\nNAME  Two\nACC   PF00002.1\nLENG  9\nHMM\n//\n")
    rows = [tuple(r)[:6] for r in T.read_profiles(spark, str(tmp_path / "p.hmm")).orderBy("accession").collect()]
    assert rows == [("PF00001", "Lant", "A thing", 178, 21.7, 22.2), ("PF00002", "Two", None, 9, None, None)]
    (tmp_path / "d.txt").write_text("# note\nPF00001.2\tx\n\nPF00002\nPF00001\n")
    assert sorted(r[0] for r in T.read_domain_list(spark, str(tmp_path / "d.txt")).collect()) == ["PF00001", "PF00002"]
    for day in ("01", "02"):
        (tmp_path / f"2024-01-{day}_10-00-00").mkdir()
        (tmp_path / f"2024-01-{day}_10-00-00" / "x.tsv").write_text(f"day{day}\n")
    assert [r["value"] for r in T.latest_results(spark, str(tmp_path)).collect()] == ["day02"]


def test_stream(spark, tmp_path):
    schema = "bin string, record_id long, container_id long, token string"
    score = lambda p: p.select("bin", "a", "b")
    every = []
    for k in range(3):
        rows = [("m", 10 * k + i, 10 * k + i, t) for i in range(3) for t in ("x" if i else "y", f"z{i}")]
        every += rows
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        keep_scoring(stream_tokens(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", score, f"{tmp_path}/checkpoint").awaitTermination()
    want = candidate_pairs(spark.createDataFrame(every, schema)).select("a", "b")
    got = spark.read.parquet(f"{tmp_path}/store/edges").select("a", "b")
    assert sorted(got.collect()) == sorted(want.collect())


def test_command_line(spark, folder, hits, tmp_path):
    from clusterlake.__main__ import main

    hits.write.parquet(f"{tmp_path}/hits")
    tsv = lambda name: spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/{name}")
    some = ["-i", folder, "--hits", f"{tmp_path}/hits", "--bad-files", "report"]
    with pytest.raises(ValueError):
        main(["cluster", "-i", folder, "--hits", f"{tmp_path}/hits", "-o", f"{tmp_path}/none"])
    main(["cluster", *some, "-o", f"{tmp_path}/out", "--cutoffs", "0.3,0.7", "--record-type", "protocluster", "--trees"])
    every = tsv("out/clustering").count()
    assert every > 0 and tsv("out/errors").count() == 1 and tsv("out/trees").count() > 0
    main(["cluster", *some, "-o", f"{tmp_path}/culled", "--cutoffs", "0.3,0.7", "--record-type", "protocluster", "--cull-singletons"])
    assert 0 < tsv("culled/clustering").count() < every
    (tmp_path / "config.yml").write_text("EXTEND_MIN: 0.9\nSCALED: 2\n")
    (tmp_path / "domains.txt").write_text("PF00550.1\tx\nPF11111\n")
    weighted = ["--classify", "class", "--legacy-weights", "--config", f"{tmp_path}/config.yml", "--include-any", f"@{tmp_path}/domains.txt", "--force-gbk", "--include-gbk", "region"]
    main(["cluster", *some, "-o", f"{tmp_path}/weights", *weighted])
    assert {r["weights"] for r in tsv("weights/network").collect()} == {"NRPS"}
    main(["cluster", *some, "-o", f"{tmp_path}/one", "--store", f"{tmp_path}/store"])
    main(["cluster", *some, "-o", f"{tmp_path}/two", "--store", f"{tmp_path}/store"])
    assert sorted(tsv("one/full_network").collect()) == sorted(tsv("two/full_network").collect())
    main(["cluster", *some, "-o", f"{tmp_path}/three", "--store", f"{tmp_path}/store", "--config", f"{tmp_path}/config.yml"])
    main(["cluster", *some, "-o", f"{tmp_path}/four", "--config", f"{tmp_path}/config.yml"])
    assert sorted(tsv("three/full_network").collect()) == sorted(tsv("four/full_network").collect())
    h = read_files(spark, folder).where(F.col("path").contains("three")).first()["hash"]
    main(["query", *some, "-o", f"{tmp_path}/query", "--query-hash", h, "--record-type", "protocluster", "--record-number", "1", "--classify", "category", "--propagate"])
    assert tsv("query/reached").count() >= 2
    with pytest.raises(ValueError, match="no such record"):
        main(["query", *some, "-o", f"{tmp_path}/query", "--query-hash", h, "--record-type", "protocluster", "--record-number", "7"])
    main(["dereplicate", "-i", folder, "-o", f"{tmp_path}/derep", "--cutoff", "0.4", "--fasta", "--config", f"{tmp_path}/config.yml"])
    assert tsv("derep/representatives").count() > 0 and spark.read.text(f"{tmp_path}/derep/proteins").where("value LIKE '>%'").count() == tsv("derep/clustering").count() == tsv("derep/manifest").count()
    (tmp_path / "curated.tsv").write_text("BGC\tfamily\n" + "".join(f"{r['record']}\tF1\n" for r in tsv("out/clustering").select("record").distinct().collect()))
    (tmp_path / "runs" / "2024-01-02_10-00-00_c0.3" / "mix").mkdir(parents=True)
    (tmp_path / "runs" / "2024-01-02_10-00-00_c0.3" / "mix" / "mix_clustering_c0.3.tsv").write_text("#BGC Name\tFamily Number\nx\t1\ny\t2\n")
    (tmp_path / "xy.tsv").write_text("BGC\tfamily\nx\tF1\ny\tF1\n")
    main(["benchmark", "-g", f"{tmp_path}/xy.tsv", "-b", f"{tmp_path}/runs", "-o", f"{tmp_path}/bench"])
    assert [tuple(r) for r in tsv("bench/by_cutoff").collect()] == [("0.3", "2", "1.0", "0.0")]


def test_cluster_then_benchmark(spark, folder, hits, tmp_path):
    """benchmark reads what cluster wrote."""
    from clusterlake.__main__ import main

    hits.write.parquet(f"{tmp_path}/hits")
    main(["cluster", "-i", folder, "--hits", f"{tmp_path}/hits", "--bad-files", "report", "-o", f"{tmp_path}/out", "--cutoffs", "0.3,0.7"])
    (run,) = {p.name.rsplit("_c", 1)[0] for p in (tmp_path / "out" / "output_files").iterdir() if p.is_dir()}
    files = sorted(str(p.relative_to(tmp_path / "out" / "output_files")) for p in (tmp_path / "out" / "output_files").rglob("*") if p.is_file() and not p.name.startswith("."))
    own = [f"{run}_c{c}/{x}" for c in ("0.3", "0.7") for x in (f"mix/mix_c{c}.network", f"mix/mix_clustering_c{c}.tsv", "record_annotations.tsv")]
    assert files == sorted([*own, f"{run}_full.network"])
    lines = (tmp_path / "out" / "output_files" / f"{run}_c0.7" / "mix" / "mix_clustering_c0.7.tsv").read_text().splitlines()
    assert lines[0] == "Record\tGBK\tRecord_Type\tRecord_Number\tCC\tFamily" and len(lines) == 6
    families = [x.split("\t")[5] for x in lines[1:]]
    assert families == sorted(families) and families[0] == "FAM_00001" and set(families) == {f"FAM_{i:05d}" for i in range(1, len(set(families)) + 1)}
    network = (tmp_path / "out" / "output_files" / f"{run}_c0.7" / "mix" / "mix_c0.7.network").read_text().splitlines()
    assert len(network) == 7 and len({len(x.split("\t")) for x in network}) == 1
    (tmp_path / "curated.tsv").write_text("BGC\tfamily\n" + "".join(f"{x.split(chr(9))[0]}\t{x.split(chr(9))[5]}\n" for x in lines[1:]))
    main(["benchmark", "-g", f"{tmp_path}/curated.tsv", "-b", f"{tmp_path}/out/output_files", "-o", f"{tmp_path}/bench"])
    rows = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/bench/by_cutoff").orderBy("cutoff").collect()
    assert [(r["cutoff"], r["purity"], r["entropy"]) for r in rows][1] == ("0.7", "1.0", "0.0") and len(rows) == 2
    labels = {r["item"]: r["label"] for r in T.read_labels(spark, f"{tmp_path}/out/output_files/{run}_c0.7/mix/mix_clustering_c0.7.tsv").collect()}
    assert labels == {x.split("\t")[0]: str(int(x.split("\t")[5][4:])) for x in lines[1:]}
    write_tsv(spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out/clustering"), f"{tmp_path}/again")
    assert {r["label"] for r in T.read_labels(spark, f"{tmp_path}/again").collect()} <= {str(i) for i in range(1, 6)}
    with pytest.raises(ValueError, match="no clustering file"):
        T.read_run_labels(spark, f"{tmp_path}/out/clustering")


def test_sqlite_results(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "r.db") as c:
        c.executescript("CREATE TABLE bgc (id INTEGER PRIMARY KEY, orig_filename TEXT); CREATE TABLE gcf_membership (bgc_id INT, gcf_id INT); CREATE TABLE gcf (id INTEGER PRIMARY KEY, clustering_id INT); CREATE TABLE clustering (id INTEGER PRIMARY KEY, threshold REAL);")
        c.executemany("INSERT INTO bgc VALUES (?, ?)", [(i, f"a/x{i}.gbk") for i in range(1, 6)])
        c.executemany("INSERT INTO clustering VALUES (?, ?)", [(1, 0.3), (2, 0.3), (3, 0.5)])
        c.executemany("INSERT INTO gcf VALUES (?, ?)", [(1, 1), (2, 2), (3, 2), (4, 3)])
        c.executemany("INSERT INTO gcf_membership VALUES (?, ?)", [(1, 1), (1, 2), (2, 2), (3, 3), (1, 4), (2, 4)])
    rows = sorted(tuple(r) for r in T.read_sqlite_labels(spark, str(tmp_path / "r.db")).collect())
    assert rows == [(0.3, "x1", "2"), (0.3, "x2", "2"), (0.3, "x3", "3"), (0.5, "x1", "4"), (0.5, "x2", "4")]
    assert T.read_sqlite(spark, str(tmp_path / "r.db"), "bgc", "id long, orig_filename string", rows=2).count() == 5
    (tmp_path / "c.tsv").write_text("BGC\tfamily\nx1\tA\nx2\tA\nx3\tB\n")
    out = benchmark_labels(spark, str(tmp_path / "c.tsv"), T.read_sqlite_labels(spark, str(tmp_path / "r.db")))
    assert sorted(tuple(r) for r in out["by_cutoff"].collect()) == [(0.3, 2, 1.0, 0.0), (0.5, 1, 1.0, 0.0)]


def test_hybrids_are_merged():
    text = flat_file("x", A).replace('/protoclusters="1"', '/protoclusters="1"\n                     /protoclusters="2"').replace('/kind="single"', '/kind="chemical_hybrid"')
    more = '     protocluster    301..900\n                     /protocluster_number="2"\n                     /category="PKS"\n                     /product="T1PKS"\n                     /contig_edge="True"\n     proto_core      401..500\n                     /protocluster_number="2"\n                     /product="T1PKS"\n'
    rows = {(r["record_type"], r["number"]): r for r in parse_file("x", text.replace("     CDS", more + "     CDS", 1).encode())["records"]}
    assert set(rows) == {("region", 1), ("cand_cluster", 1), ("protocluster", 1), ("proto_core", 1)}
    r = rows["protocluster", 1]
    assert (r["nt_start"], r["nt_stop"], r["product"], r["category"], r["contig_edge"], r["parent_number"]) == (0, 1000, "NRPS.T1PKS", "NRPS.PKS", True, 1)
    assert (rows["proto_core", 1]["nt_start"], rows["proto_core", 1]["nt_stop"]) == (200, 500) and rows["region", 1]["category"] == "NRPS.PKS"


def test_flat_file_texts_are_made_once(spark, sf, monkeypatch):
    """Hashing and parsing read the written texts; before, each made all of them anew."""
    from clusterlake.plans import file_queries

    names, write = [], file_queries.written
    monkeypatch.setattr(file_queries, "written", lambda df, what: names.append(what) or write(df, what))
    assert file_queries.flat_file_genes(spark, sf).count() > 0
    assert names == ["contents", "files"]


def test_plain_features_and_others_read_alike():
    """Qualifiers in one pair of quotes take a short way; doubled, open and folded ones the long one."""
    text = "FEATURES             Location/Qualifiers\n     CDS             complement(3..8)\n                     /a=\"x \"\n                     /a=\"y\"\n                     /n=1\n                     /p\n     gene            join(1..3,<5..9)\n                     /a=\"p\"\"q\"\n                     /t=\"one\n                     two\"\n"
    assert genbank.parse_flat_file(text)["features"] == [("CDS", "complement(3..8)", {"a": ["x ", "y"], "n": ["1"], "p": [""]}), ("gene", "join(1..3,<5..9)", {"a": ['p"q'], "t": ["one two"]})]
    assert genbank.parse_location("complement(3..8)") == (2, 8, -1, [(2, 8)], False, False)
    assert genbank.parse_location("join(1..3,<5..9)") == (0, 9, 1, [(0, 3), (4, 9)], True, False)
