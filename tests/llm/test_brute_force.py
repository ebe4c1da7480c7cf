"""Queries that SQL can't express against plain programs, row by row; and rows that repeat, have no id or are very long."""

import bisect
import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from clusterlake.llm import langid, ogg, quality, queries
from tests.llm.test_llm import DOCS, EXTRA, check_packing, documents


def plain_features(text):
    words = (text or "").split()
    if not words:
        return [0.0] * len(quality.NAMES)
    n, raw = len(words), text.encode()
    size = len(raw)
    count = lambda f: sum(1 for b in raw if f(b))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    marks, stops = count(lambda b: 33 <= b < 127 and not chr(b).isalnum()), count(lambda b: b in b".,")
    mean = sum(map(len, words)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, sum(map(len, lines)))
    long = [x for x in lines if len(x) > 20]
    odd_end = lambda w: not w[-1].isalnum() and w[-1] not in ".,;:!?"
    run = best = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    share = [c / size for c in collections.Counter(raw).values()]
    of = lambda some: sum(map(len, some)) / chars
    return [
        math.log(1 + n), mean, math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n), upper / max(1, upper + lower), count(lambda b: 48 <= b <= 57) / size, marks / size,
        raw.count(b"|") / n, raw.count(b"!") / n, stops / n, (marks - stops) / n, count(lambda b: b > 127) / size, len(set(words)) / n, max(collections.Counter(words).values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n, (len(set(zip(words, words[1:]))) if n > 1 else 1) / max(1, n - 1),
        math.log(1 + len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), raw.count(b" ") / size, -sum(p * math.log2(p) for p in share), sum(not w[-1].isalnum() for w in words) / n,
        of([x for x in lines if x == x.upper() != x.lower()]), of([x for x in lines if x.count("|") > 1]), of([x for x in long if sum(map(odd_end, x.split())) > 0.3 * len(x.split())]),
        of([x for x in long if len(x.split()) >= 8 and len(set(x.split())) < 0.35 * len(x.split())]), math.log(1 + best),
    ]


def plain_split(g, h, depth):
    """The tree by trying every cut."""
    whole = sum(g) ** 2 / (sum(h) + 1)
    best, at = whole + 1e-9, None
    for c in range(1, len(g)) if depth else ():
        if sum(h[:c]) >= 1 and sum(h[c:]) >= 1:
            gain = sum(g[:c]) ** 2 / (sum(h[:c]) + 1) + sum(g[c:]) ** 2 / (sum(h[c:]) + 1)
            if gain > best:
                best, at = gain, c
    if at is None:
        return [-sum(g) / (sum(h) + 1)] * len(g)
    return plain_split(g[:at], h[:at], depth - 1) + plain_split(g[at:], h[at:], depth - 1)


def test_trees():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(1, 12))
        g, h = r.normal(size=n) * 5, r.random(n) * 4
        assert np.allclose(quality.leaves(g, h, 2), plain_split(g.tolist(), h.tolist(), 2))


def test_quality_row_by_row(spark, sf):
    docs, labels = documents(sf), duckdb.sql(f"SELECT doc_id, avg(quality) FROM '{sf}/labels.parquet' GROUP BY 1").fetchall()
    x = {d: plain_features(t) for d, t in docs}
    learned = sorted((x[d], q >= 0.5) for d, q in labels if zlib.crc32(str(d).encode()) % 5)
    m = quality.Model(np.array([a for a, _ in sorted(learned, key=lambda r: r[0][::-1])]), np.array([q for _, q in sorted(learned, key=lambda r: r[0][::-1])], float))

    def score(row):
        b = [bisect.bisect_right(c.tolist(), v) for c, v in zip(m.cuts, row, strict=True)]
        s = m.constant + sum(t[k] for t, k in zip(m.mains, b, strict=True)) + sum(t[b[i], b[j]] for i, j, t in m.pairs)
        return 1 / (1 + math.exp(-s))

    rows = {r["doc_id"]: r for r in queries.queries()["op4_quality"](spark, sf).collect()}
    assert set(rows) == set(x)
    for d, row in x.items():
        assert abs(rows[d]["score"] - score(row)) < 1e-6
        assert rows[d]["predicted"] == (rows[d]["score"] >= 0.3) and rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)


def plain_words(text):
    low = text.lower().encode()
    return bytes(b if b > 127 or chr(b).isalpha() else 32 for b in low).split(b" ")


def plain_grams(word):
    out, s = [], b" " + word + b" "
    for k in range(len(word)):
        x = (s[k] * 0x9E3779B1 ^ s[k + 1] * 0x85EBCA77 ^ s[k + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
        out.append(((x ^ x >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 17)
    return out


def test_language_row_by_row(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()
    counts = collections.defaultdict(collections.Counter)
    for d, t, lang in docs:
        if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            for w in plain_words(t):
                counts[lang].update(plain_grams(w))
    langs = sorted(counts)
    total = {k: sum(c.values()) for k, c in counts.items()}
    log = {k: lambda g, k=k: math.log((counts[k][g] + langid.SMOOTH) / (total[k] + langid.SMOOTH * langid.BUCKETS)) for k in langs}
    rows = {r["doc_id"]: r for r in queries.queries()["op7_language"](spark, sf).collect()}
    assert set(rows) == {d for d, *_ in docs}
    for d, t, _ in docs:
        words = [w for w in plain_words(t or "") if w]
        if not any(map(str.isalpha, t or "")):
            assert rows[d]["lang_pred"] == "und" and rows[d]["score"] == 0
            continue
        best, back = None, []
        for w in words:
            s = np.array([sum(log[k](g) for g in plain_grams(w)) for k in langs])
            if best is not None:
                jump = best.max() - langid.SWITCH
                back.append(np.where(best >= jump, np.arange(len(langs)), best.argmax()))
                s = s + np.maximum(best, jump)
            best = s
        now, size = int(best.argmax()), collections.Counter()
        for k in range(len(words) - 1, -1, -1):
            size[langs[now]] += len(words[k])
            now = int(back[k - 1][now]) if k else now
        pred = max(sorted(size), key=size.get)
        assert rows[d]["lang_pred"] == pred and abs(rows[d]["score"] - size[pred] / sum(size.values())) < 1e-9, d


def test_media_features_row_by_row(spark, sf):
    rows = {r["doc_id"]: r for r in queries.queries()["op5_media"](spark, sf).collect()}
    for d, t in documents(sf):
        raw = (t or "").encode()
        x = [b - 128 for b in raw + b"\xff" * (-len(raw) % 576 if raw else 576)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        rms = math.sqrt(sum(v * v for v in x) / len(x))
        assert rows[d]["feature"] == f"seconds={len(x) / 8000:.3f};mean={sum(x) / len(x):.4f};rms={rms:.4f};crossings={crossings};peak={max(map(abs, x))}"
        assert rows[d]["seconds"] == len(x) / 8000 and rows[d]["streams"] == 2


def test_a_media_file_byte_by_byte():
    """The pages of a small file, put together by hand."""
    media = ogg.store(b"abc")
    payload = b"abc" + b"\xff" * 573
    assert media.count(b"OggS") == 4 or media.count(b"OggS") == 3
    at, packets = 0, collections.defaultdict(bytes)
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        serial, n = media[at + 14 : at + 18], media[at + 26]
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        crc = 0
        for k, c in enumerate(media[at:end]):
            crc ^= (0 if 22 <= k < 26 else c) << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        assert int.from_bytes(media[at + 22 : at + 26], "little") == crc
        packets[serial] += media[at + 27 + n : end]
        at = end
    assert any(p.endswith(payload) for p in packets.values())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents that repeat with their id, have no id, or are five megabytes long."""
    top = tmp_path_factory.mktemp("odd")
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
    prose = " ".join(word() for _ in range(120))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(60_000))
    long += "\n" + long[:1_000_000] + "x" * 200_000
    rows = [(1, prose), (1, prose), (2, prose), (None, prose), (None, prose), (None, None), (3, ""), (3, ""), (4, "ab " * 400), (5, long), (6, "Released under the MIT License.")]
    spark.createDataFrame([(d, t, "en", None, None, *EXTRA) for d, t in rows], DOCS).repartition(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    assert len(long) > 5_000_000
    return str(top), rows


@pytest.mark.parametrize("name", [n for n in sorted(queries.WHERE) if n not in ("op6_chat", "op9_top_k", "op12_divergence", "op13_html")])
def test_odd_rows(spark, odd, name):
    got = [r.asDict() for r in queries.queries()[name](spark, odd[0]).collect()]
    rows = odd[1]
    if name == "op1_packing":
        check_packing(got, [(d, t) for d, t in rows if d in (2, 4, 5)])
        assert sum(r["start"] == 0 for r in got) == len(rows)
        return
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    own = {"op3_simhash": "fingerprint", "op4_quality": "score", "op5_media": "media_sha256", "op7_language": "lang_pred", "op8_licenses": "own", "op10_byte_bpe": "ids_sha256", "op11_alignment": "groups_sha256"}.get(name)
    if own:  # what depends on the text alone
        assert {r[own] for r in by[1]} == {r[own] for r in by[2]} and {r[own] for r in by[2]} <= {r[own] for r in by[None]}
    if name == "op2_suffixes":
        whole = hashlib.sha256(rows[0][1].encode()).hexdigest()
        assert [(r["n_removed"], r["kept_sha256"]) for r in by[1]] == [(0, whole)] * 2 and by[2][0]["n_removed"] == len(rows[0][1])
        assert by[5][0]["n_removed"] > 1_000_000 and all(r["n_removed"] == 0 for r in by[None])
    if name == "op3_simhash":
        assert {r["component_id"] for r in by[1] + by[2]} == {1} and {r["component_id"] for r in by[3]} == {3}
    if name == "op10_byte_bpe":
        assert all(r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows if d is not None for r in by[d])
