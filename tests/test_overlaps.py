"""The commands drop overlapping genes and hits while loading."""

from pyspark.sql import functions as F

from clusterlake.plans.workflows import Options, cluster, dereplicate, query
from clusterlake.sources.genbank import read_files
from tests.test_sources import flat_file, folder, hits  # noqa: F401

COLUMNS = ("distance", "jaccard", "adjacency", "dss")


def test_hits(spark, folder, hits):  # noqa: F811
    weak = hits.withColumn("accession", F.concat(F.lit("PF8"), F.substring("hash", 1, 4))).withColumn("bit_score", F.col("bit_score") - 20)
    scores = lambda out: sorted((r["a"], r["b"], *(r[c] for c in COLUMNS)) for r in out["edges"].collect())
    assert scores(cluster(spark, folder, hits.unionByName(weak), Options(bad_files="report"))) == scores(cluster(spark, folder, hits, Options(bad_files="report")))
    h = read_files(spark, folder).where(F.col("path").contains("three")).first()["hash"]
    assert scores(query(spark, folder, hits.unionByName(weak), h, Options(bad_files="report"))) == scores(query(spark, folder, hits, h, Options(bad_files="report")))


def test_genes(spark, tmp_path):
    text = flat_file("one.region001", ["PF00668", "PF00501", "PF00550", "PF00975"])
    shorter = "     CDS             11..130\n                     /translation=\"" + "W" * 39 + "\"\n"
    (tmp_path / "one.region001.gbk").write_text(text)
    (tmp_path / "two.region001.gbk").write_text(text.replace("ORIGIN", shorter + "ORIGIN").replace("one.region001", "two.region001"))
    rows = dereplicate(spark, str(tmp_path), 1.0, __import__("clusterlake.plans.config", fromlist=["Settings"]).Settings(scaled=1)).collect()
    assert len(rows) == 2 and len({r["component"] for r in rows}) == 1
