"""The data source of annotated files: what is read, pushed down, dealt out and streamed."""

import os
import shutil

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringContains
from pyspark.sql.types import StructType

from clusterlake.sources import datasource, genbank
from tests.test_sources import folder  # noqa: F401

COLUMNS = ("hash", "nt_len", "organism", "version", "error")


def rows(df):
    return sorted((r["path"].removeprefix("file:").replace("///", "/"), *(str(r[c]) for c in COLUMNS), len(r["records"]), len(r["cds"])) for r in df.collect())


def test_as_the_other_reader(spark, folder):  # noqa: F811
    want = rows(genbank.read_files(spark, folder))
    assert rows(datasource.read(spark, folder)) == want and len(want) > 4
    for small in ("1", "1000000"):
        assert rows(datasource.read(spark, folder, partitionBytes=small)) == want
    assert datasource.read(spark, folder, include="nothing").isEmpty()


def test_filters_are_pushed(spark, folder, capsys):  # noqa: F811
    df = datasource.read(spark, folder, "path LIKE '%three%' AND nt_len > 0")
    assert [r["path"].rsplit("/", 1)[1].split(".")[0] for r in df.collect()] == ["three"]
    df.explain("formatted")
    assert "PushedFilters: [StringContains(path,three)]" in capsys.readouterr().out
    every = genbank.read_files(spark, folder).where("version IS NOT NULL")
    for v in {r["version"] for r in every.select("version").distinct().collect()} | {"none"}:
        some = datasource.read(spark, folder, f"version = '{v}'")
        assert rows(some) == rows(every.where(F.col("version") == v))


def test_no_copy_is_parsed(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    shutil.copytree(folder, tmp_path / "in")
    names = sorted(p.name for p in (tmp_path / "in").iterdir())
    for i in range(5):
        shutil.copy(tmp_path / "in" / names[-1], tmp_path / "in" / f"again{i}.region001.gbk")
    parsed = []
    schema = StructType.fromDDL(genbank.SCHEMA)
    parse = genbank.parse_file
    monkeypatch.setattr(genbank, "parse_file", lambda path, *a: (parsed.append(path), parse(path, *a))[1])
    r = datasource.Reader({"path": str(tmp_path / "in")}, schema)
    some = [EqualTo(("error",), "x"), GreaterThan(("nt_len",), 1), StringContains(("path",), "region"), Not(StringContains(("path",), "far"))]
    assert list(r.pushFilters(some)) == some[:2]
    made = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert len(made) == len(parsed) == len({x["hash"] for x in made}) and not any("far" in p for p in parsed)
    parsed.clear()
    r = datasource.Reader({"path": str(tmp_path / "in")}, schema)
    assert list(r.pushFilters([EqualTo(("version",), "none")])) == [] and not [b for p in r.partitions() for b in r.read(p)] and not parsed
    sizes = [sum(n for _, n in p.files) for p in datasource.Reader({"path": str(tmp_path / "in"), "partitionbytes": "300000"}, schema).partitions()]
    assert len(sizes) > 3


def test_stream(spark, folder, tmp_path):  # noqa: F811
    spark.dataSource.register(datasource.GenBankFiles)
    files = sorted(os.listdir(folder))
    os.mkdir(tmp_path / "in")
    got = []

    def run():
        q = spark.readStream.format("genbank").load(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, nth: got.extend(r["path"].rsplit("/", 1)[1] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    want = []
    for part in (files[:2], files[2:], []):
        for f in part:
            shutil.copyfile(f"{folder}/{f}", tmp_path / "in" / f)
        run()
        want += [f for f in part if any(x in f for x in ("cluster", "region")) and "final" not in f and f.endswith(".gbk")]
        kept = {genbank.parse_file(f, (tmp_path / "in" / f).read_bytes())["hash"] for f in want}
        assert len(got) == len(set(got)) and set(got) <= set(want) and len({genbank.parse_file(f, (tmp_path / "in" / f).read_bytes())["hash"] for f in got}) == len(kept)
