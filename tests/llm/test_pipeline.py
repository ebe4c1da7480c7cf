"""The pipeline's stages one by one, each held against brute force on its own input."""

import duckdb
import pytest

import corpus_pipeline
from clusterlake.llm import common, quality
from tests.llm.test_llm import AWKWARD, DOCS, EXTRA, awkward, check_packing, fingerprint_by_force, removed_by_force  # noqa: F401


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("where", ["sf", "some", "none"])
def test_stages(spark, sf, awkward, where, tmp_path):  # noqa: F811
    folder = {"sf": sf, "some": awkward[0], "none": awkward[1]}[where]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "passages", "packing"]

    def step(name):
        nonlocal docs
        before = rows(docs)
        stages[name](spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        return before, rows(docs) if name != "packing" else docs

    before, after = step("language")
    assert set(after) == {d for d, r in before.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert all(after[d] == before[d] for d in after)

    before, after = step("quality")
    if where == "sf":
        bad = {d for d, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if q == 0}
        good = {d for d, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if q == 1}
        assert len(good & set(after)) >= 0.97 * len(good & set(before))
        assert len(bad & set(after)) <= 0.35 * max(1, len(bad & set(before)))
    assert quality.THRESHOLD == 0.3

    before, after = step("near_duplicates")
    prints = sorted((d, fingerprint_by_force(r["text"])) for d, r in before.items())
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert set(after) == {d for d in root if find(d) == d}

    before, after = step("passages")
    want = removed_by_force(sorted((d, r["text"]) for d, r in before.items()))
    assert set(after) == set(before)
    for d, (n, gone, _, _) in want.items():
        if gone:
            assert n - gone - 6 * want[d][2] <= len(after[d]["text"].encode()) <= n - gone
            assert after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert after[d] == before[d]

    before, out = step("packing")
    check_packing([r.asDict() for r in out.collect()], sorted((d, r["text"]) for d, r in before.items()))


def test_rows_without_an_id(spark):
    """Are judged like all others; a row repeated without an id stays once."""
    good = "This is a plain sentence about the sea and the ships on it. " * 8
    rows = [(None, "12 34 !!", None, None, None), (None, None, "en", "x", 3), (None, good, "en", None, 5), (None, good, "en", None, 5), (7, good + "More.", None, None, None), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, "")
    assert sorted((r["doc_id"] is None, r["text"]) for r in kept.collect()) == sorted([(True, good), (True, good), (False, good + "More.")])
    assert stages["near_duplicates"](spark, kept.where("doc_id IS NULL"), "").count() == 1


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_without(spark, monkeypatch, most):
    """Few ids are broadcast, many go by a filter that may err; both leave out the same rows."""
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 11)
    df = spark.range(3000).selectExpr("CASE WHEN id % 50 = 49 THEN NULL ELSE id END AS doc_id", "CAST(id AS STRING) AS text")
    gone = common.written(spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id"), "gone")
    left = common.without(df, "doc_id", gone)
    assert left.columns == ["doc_id", "text"]
    assert sorted(int(r["text"]) for r in left.collect()) == [k for k in range(3000) if k % 50 == 49 or k % 3]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None
