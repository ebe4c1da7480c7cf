"""Batches of documents against the levels that earlier ones left."""

import random

import pytest
from pyspark.sql import functions as F

from clusterlake.llm import suffixes
from clusterlake.llm.suffix_levels import StoredFamily
from tests.llm.test_llm import removed_by_force


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_batches(spark, tmp_path):
    r = random.Random(3)
    docs = [(k, r.choice(["", "x" * 150, prose(k, 40) + prose(r.randrange(12), 30) + prose(1000 + k, r.randrange(30))])) for k in range(60)] + [(60, prose(5, 30)), (61, "")]
    want = removed_by_force(docs)
    got, sizes = {}, []

    def each(row, kept, n, gone, spans):
        return {"doc_id": row["doc_id"], "gone": gone, "spans": spans, "kept": kept}

    for k in range(8):
        some = spark.createDataFrame(docs[8 * k : 8 * k + 8], "doc_id long, text string").repartition(2)
        family = StoredFamily(spark, f"file://{tmp_path}/family", 5)  # opened anew each time
        out = suffixes.deduplicated(some, F.col("text"), ["doc_id"], each, "doc_id long, gone long, spans long, kept binary", family=family)
        got |= {x["doc_id"]: (x["gone"], x["spans"]) for x in out.collect()}
        sizes.append(len(family.state["levels"]))
    assert got == {d: (w[1], w[2]) for d, w in want.items()}
    assert sum(g for g, _ in got.values()) > 2000
    assert max(sizes) <= 4  # levels merge
    levels = [x["contexts"] for x in StoredFamily(spark, f"file://{tmp_path}/family").state["levels"]]
    assert all(a > 2 * b for a, b in zip(levels, levels[1:]))
    kept = {p.name for p in (tmp_path / "family").iterdir() if p.name.startswith("level-")}
    assert len(kept) == len(levels)
    with pytest.raises(ValueError):
        StoredFamily(spark, f"file://{tmp_path}/family", 6)


def test_the_same_batch_again(spark, tmp_path):
    """All of it is there already."""
    docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(5)], "doc_id long, text string")
    each = lambda row, kept, n, gone, spans: {"doc_id": row["doc_id"], "left": len(kept)}
    left = []
    for _ in range(2):
        family = StoredFamily(spark, f"file://{tmp_path}/family")
        left.append({r["left"] for r in suffixes.deduplicated(docs, F.col("text"), ["doc_id"], each, "doc_id long, left long", family=family).collect()})
    assert 0 not in left[0] and left[1] == {0}
