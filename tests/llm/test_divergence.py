"""The source audit against whole fractions: every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from clusterlake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value int, rank string"


def by_force(rows, top=200):
    n, docs, every = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang, source].update(found)
        docs[lang].update(set(found))
        every[lang].add(source)
    out = []
    for lang, sources in every.items():
        kept = [t for t, d in docs[lang].items() if d >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources - {s})
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x, -v, i) for part, some in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(some, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["Ab", "cd", "É", "éa", "日本", "x_y", "it's", "Z9z", "ÀB", "q", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))]
    out = [(" ".join(r.choices(words, [1000 / (i + 1 + 30 * (s == 1)) for i in range(len(words))], k=r.randint(0, 300))), "en", f"s{s}") for s in (0, 0, 0, 1, 2, 2, 3) for _ in range(12)]
    out += [(None, "en", "empty"), ("", "en", None), ("123 456", "fr", "a"), ("un deux", "fr", "b"), ("un un trois", "fr", "b"), ("same", None, "t"), ("same", None, "u"), ("same other", None, None), ("only one", "es", "z")]
    return out + out[:3]


@pytest.mark.parametrize("first", [divergence.FIRST, 1])
def test_audit(spark, rows, first, monkeypatch):
    monkeypatch.setattr(divergence.top_terms, "__defaults__", (divergence.LEAST_DOCS, divergence.TOP, first))
    monkeypatch.setattr(divergence, "PAIRS", 1000)
    df = spark.createDataFrame([(i % 9 or None, *r, 1, "x") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = sorted(map(tuple, divergence.audit(df, top=20).collect()))
    assert got == by_force(rows, 20)
    assert max(r[5] for r in got if r[2] == "term") == 20


def test_given_documents(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, divergence.op12_divergence(spark, sf).collect()))
    assert got == sorted(duckdb.sql(divergence.SQL).fetchall()) and got


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**15, 10**16, 7)], "n long, total long, size long").select(divergence.probability("n", "total", "size").alias("p"))
    assert df.first()["p"] == 1 + 10**9 * (9 * 10**15 + 1) // (10**16 + 7)


def test_few_terms_are_scored(spark, sf, monkeypatch):
    """Bounds leave most terms of the groups unscored."""
    post = divergence.written(divergence.postings(spark.read.parquet(f"{sf}/documents.parquet")), "postings")
    g = divergence.written(divergence.groups(post), "groups")
    tables = {"terms": 0, "buckets": []}
    write = divergence.written

    def noted(df, what):
        out = write(df, what)
        if what == "terms":
            tables["terms"] = out
        elif what == "buckets":
            tables["buckets"].append(out)
        return out

    monkeypatch.setattr(divergence, "written", noted)
    few = divergence.top_terms(post, g, top=5, first=1)
    assert few.where("rank > 5").isEmpty() and not few.isEmpty()
    scored = sum(tables["terms"].join(b, ["lang", "source", "bucket"], "left_semi").count() for b in tables["buckets"])
    assert 0 < scored < 0.5 * tables["terms"].count()
