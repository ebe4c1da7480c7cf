"""Rows that share a doc_id: they leave each other whole in op2, and one of repeated rows stays in the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from clusterlake.llm import queries, suffixes
from tests.llm.test_llm import DOCS, EXTRA


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def left_by_force(rows, n=100):
    """(doc_id, bytes, removed, hash of what is left) of each row: a string goes if it starts at a smaller (doc_id, start) in any row."""
    first = {}
    for d, t in rows:
        b = t.encode()
        for s in range(len(b) - n + 1):
            first[b[s : s + n]] = min(first.get(b[s : s + n], (d, s)), (d, s))
    out = []
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (d, s):
                gone[s : s + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


P, Q, R = prose(1, 40), prose(2, 40), prose(3, 60)
ROWS = [
    (5, R), (5, R), (5, R),  # repeated, and nowhere else
    (7, "x " + P + " y"), (7, "x " + P + " y"), (9, P), (3, "z" + Q), (4, Q), (4, Q),  # repeated, with a passage of others
    (11, prose(4, 30) + prose(5, 30)), (11, prose(6, 20) + prose(5, 30)), (11, prose(5, 30) + "!" + prose(5, 30)), (12, prose(5, 30)),  # one id, several texts
    (13, "ab" * 200), (13, "ab" * 200), (13, "b" + "ab" * 150), (14, prose(7, 60)),
]


def test_suffixes(spark, tmp_path):
    rows = ROWS + [(100 + k % 20, prose(8, 20 + k) + prose(k // 2, 30)) for k in range(60)]
    rows += rows[-20:]
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(d, t, "en", None, len(t), *EXTRA) for d, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in queries.queries()["op2_suffixes"](spark, str(tmp_path)).collect()]
    assert Counter(got) == left_by_force(rows)
    assert got.count((5, len(R), 0, hashlib.sha256(R.encode()).hexdigest())) == 3


@pytest.mark.parametrize("batch", [50, 500, 1 << 17])
def test_batches_of_overlapping_versions(batch, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", batch)
    r = random.Random(batch)
    base = [prose(k, 30).encode() for k in range(30, 34)]
    docs = [(r.randrange(4), v, b"".join(r.choice(base)[r.randrange(20) :] for _ in range(r.randint(1, 4)))) for v in range(24)]
    rows = suffixes.contexts([(d, t) for d, _, t in docs], 100, [v for _, v, _ in docs])
    order = np.arange(len(rows["h"]))
    r.shuffle(order)
    text = {(d, v): t for d, v, t in docs}
    body = b"".join(text[d, v][s : s + n + 99] for d, v, s, n in zip(*(rows[c][order].tolist() for c in ("doc", "v", "s", "n")), strict=True))
    got = suffixes.repeated([suffixes.packed(suffixes.CONTEXT, {n: rows[n][order] for n, _ in suffixes.CONTEXT})], [body], 100)
    have = {(d, v, k) for d, v, s, e in zip(*(got[c].tolist() for c in ("doc", "v", "s", "e")), strict=True) for k in range(s, e)}
    first = {}
    for d, _, t in docs:
        for s in range(len(t) - 99):
            first[t[s : s + 100]] = min(first.get(t[s : s + 100], (d, s)), (d, s))
    assert have == {(d, v, k) for d, v, t in docs for s in range(len(t) - 99) if first[t[s : s + 100]] < (d, s) for k in range(s, s + 100)}


def test_near_duplicates_and_passages(spark):
    a, b = prose(21, 80), prose(22, 80)
    rows = [(1, a), (2, R), (2, R), (2, R), (3, R), (4, b), (4, prose(23, 80)), (4, b), (6, prose(24, 80)), (6, a), (None, prose(25, 80))]
    docs = spark.createDataFrame([(d, t, "en", None, len(t), *EXTRA) for d, t in rows], DOCS).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    want = Counter([(1, a), (2, R), (4, b), (4, prose(23, 80)), (6, prose(24, 80)), (None, prose(25, 80))])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in stages["passages"](spark, kept, "").collect()) == want
