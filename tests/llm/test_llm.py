"""The training-data operators against brute force, on small whole tables and on awkward ones."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers as tokenizers
from clusterlake.llm import byte_bpe, chat, langid, licenses, ogg, packing, quality, queries, simhash, suffixes, vafile

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, kind int, data string, score double"
#: Columns whose names the operators use themselves.
EXTRA = (7, 8, "x", 0.5)
AWKWARD = ["", None, " ", "\n\t ", "a", "Ab ab AB", "x" * 5000, "word " * 3000, "The same text twice.", "The same text twice.", "日本語 のテキスト", "naïve café\x00\x01 end", "é" * 700, "1234 !!! ???"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder with an awkward documents table, nulls in any column and extra columns among them, and one with an empty one."""
    top = tmp_path_factory.mktemp("awkward")
    rows = [(i, t, None if i % 3 else "en", None, None, *EXTRA) for i, t in enumerate(AWKWARD)]
    labels = [(i, i % 2, None) for i in range(10)] + [(3, None, 1), (None, 1, 0)]
    for name, r, l in (("some", rows, labels), ("none", [], [])):
        spark.createDataFrame(r, DOCS).coalesce(1).write.parquet(f"{top}/{name}/documents.parquet")
        spark.createDataFrame(l, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{top}/{name}/labels.parquet")
        e = [(1, [0.5, 0.25], 1), (20, [1.0, -1.0], 1), (40, [1.0], 2), (60, None, 1), (80, [float("nan"), 1.0], 1), (100, [None, 1.0], 1), (3, [0.5, 0.25], 1)]
        spark.createDataFrame(e if r else [], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{top}/{name}/embeddings.parquet")
        w = [(1, None, None), (1, None, None), (None, "http://a.example.org/", "<p>x"), (2, "http://[", "<article><p>a &amp; b</p></article><nav>c</nav>")]
        spark.createDataFrame([(*x, 1, "y") for x in w] if r else [], "page_id long, url string, html string, host int, slots string").coalesce(1).write.parquet(f"{top}/{name}/pages.parquet")
        c = [(1, 0, "user", None), (1, 1, "assistant", "a<|done|>b%25<"), (1, 1, "assistant", ""), (2, 5, None, "x"), (None, 0, "user", "y"), (3, 0, "assistant", "[INST]</s><s>%3C<<||")]
        spark.createDataFrame(c if r else [], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{top}/{name}/conversations.parquet")
    return f"{top}/some", f"{top}/none"


def documents(sf):
    p = f"{sf}/documents.parquet"
    import os

    return duckdb.sql(f"SELECT doc_id, text FROM '{p + '/*.parquet' if os.path.isdir(p) else p}' ORDER BY doc_id").fetchall()


def got(df):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: json.dumps(r, default=str, sort_keys=True))


@pytest.mark.parametrize("name", sorted(queries.WHERE))
def test_empty_and_awkward_tables(spark, awkward, name):
    run = queries.queries()[name]
    assert len(got(run(spark, awkward[1]))) == (name == "op6_chat")
    rows = got(run(spark, awkward[0]))
    if name in ("op1_packing",):
        assert {r["doc_id"] for r in rows} == set(range(len(AWKWARD)))
    elif name == "op12_divergence":
        assert rows == []  # each language has one source, and no term in three documents
    elif name == "op13_html":
        assert sorted(str(r["page_id"]) for r in rows) == ["1", "1", "2", "None"] and {r["text"] for r in rows} == {"", "x", "a & b"}
    elif name in ("op9_top_k",):
        assert {(r["query_id"], r["vec_id"]) for r in rows} == {(q, v) for q in (20, 40) for v in (1, 3, 20, 40) if q != v}
        assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 40] == [20, 1, 3]
    elif name == "op6_chat":
        assert {r["conv_id"]: r["n_turns"] for r in rows} == {-1: 2, 1: 3, 2: 1, None: 1, 3: 1}
    else:
        assert sorted(r["doc_id"] for r in rows) == list(range(len(AWKWARD)))


def check_packing(rows, docs, max_len=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + max_len]), zlib.crc32(ids[s : s + max_len].tobytes())) for k, s in enumerate(range(0, len(ids), max_len))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in fill.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= max_len
    return len(fill)


def best_fit(lengths, size):
    import bisect

    left, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, x)
        rest = size if i == len(left) else left.pop(i)
        n += rest == size and i == len(left)
        if rest - x:
            bisect.insort(left, rest - x)
    return n


def test_packing(spark, sf, awkward):
    for where in (sf, awkward[0]):
        rows = got(queries.queries()["op1_packing"](spark, where))
        n = check_packing(rows, documents(where))
        assert n <= best_fit([r["length"] for r in rows], 4096)
        assert n < sum(r["length"] for r in rows) / 4096 + 2


def test_packing_plan():
    r = random.Random(1)
    for _ in range(100):
        size = r.choice([5, 37, 100])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 300))]
        plan = packing.best_fit_plan(Counter(lengths), size)
        fill = defaultdict(list)
        for length, _, n, each, first, offset in plan.tolist():
            for k in range(n):
                fill[first + k // each].append((offset + k % each * length, length))
        assert sorted(x for v in fill.values() for _, x in v) == sorted(lengths)
        left, count = [], 0
        for x in sorted(lengths, reverse=True):
            fits = [c for c in left if c >= x]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - x)
            else:
                count += 1
                left.append(size - x)
        assert len(fill) == count


@pytest.mark.parametrize("seed", range(4))
def test_word_tokenizer_is_the_library(seed, monkeypatch):
    """Every class of word at random: all of Latin-1, digits with marks, letters whose case folding changes their length, marks that combine, contractions, special tokens, long runs."""
    if seed == 3:
        monkeypatch.setattr(packing, "KEPT", 20)  # stores that are full again and again
    t = packing.WordTokenizer(open(tokenizers.path("word_bpe_49k.json"), "rb").read())
    r = random.Random(seed)
    parts = ["\x01", "...", "a", "The", " ", "  ", "\n", "\t", "é", "É", "9", "!", "'s", "'S", " Word", "日本", "😀", "\x1c", "\x85", "Σ", "İ", "ß", "ẞ", "<|endoftext|>", "<|", "|>", "²", "ª", "it's", "e\u0301", "\u00ad", "\u00b5", "×", "÷"]
    parts += ["x" * 300, "Ab" * 130, "12", "3.14", "a1b2", "$9,99", "-", "_", "Ÿ", "Ā", "½", "'ll", "ﬀ", "ſ", "\u00a0", "\u3000", "\u2028", "ΑΣ", "ǅ", "K"] + [chr(i) for i in range(256)]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    assert t.fast
    for text, ids in zip(texts, t.ids(texts), strict=True):
        assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids, text
    some = pa.array([None, *texts[:400], None, ""]).slice(1)
    got = [x for data, offsets in packing.parts_of(some, 3000) for x in np.split(*(lambda ids, n: (ids, np.cumsum(n)[:-1]))(*t.batch(data, offsets)))]
    assert [x.tolist() for x in got] == [t.library.encode(x or "", add_special_tokens=False).ids for x in some.to_pylist()]


def removed_by_force(docs, n=100):
    seen, out = set(), {}
    for doc, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - n + 1):
            x = b[s : s + n]
            if x in seen:
                gone[s + 1 : s + n + 1] = True
            else:
                seen.add(x)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out[doc] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(spark, sf, awkward):
    for where in (sf, awkward[0]):
        want = removed_by_force(documents(where))
        rows = got(queries.queries()["op2_suffixes"](spark, where))
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
        assert sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize("seed", range(6))
def test_suffix_kernels(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(suffixes, "CHUNK", r.choice([300, 1000, 1 << 20]))
    monkeypatch.setattr(suffixes, "BATCH", r.choice([50, 500, 1 << 17]))
    base = [bytes(r.choice(b"abcd \n\x00\xff") for _ in range(r.randint(1, 400))) for _ in range(6)]
    docs = []
    for d in range(25):
        parts = []
        for _ in range(r.randint(0, 5)):
            x = bytearray(r.choice(base))
            if r.random() < 0.5:
                x[r.randrange(len(x))] = 65
            parts.append(bytes(x) if r.random() < 0.6 else r.choice([b"a", b"ab", b"With "]) * r.randint(1, 150))
        docs.append((d, b"".join(parts)))
    rows = suffixes.contexts(docs)
    rows["text"] = rows["doc"]
    text = dict(docs)
    found, rest = [], {n: rows[n] for n, _ in suffixes.CONTEXT}
    if seed % 3:  # else the family has to find all repeats, copies of whole contexts too
        keep, again = suffixes.combined(rows, [t for _, t in docs], 100)
        found.append(suffixes.covers(rows, again, 100))
        rest = {n: rows[n][keep] for n, _ in suffixes.CONTEXT}
    bodies = lambda r: [text[d][s : s + n + 99] for d, s, n in zip(*(r[c].tolist() for c in ("doc", "s", "n")), strict=True)]
    monkeypatch.setattr(suffixes, "TOGETHER", r.choice([100, 1 << 20]))
    if seed % 2:
        rest, body = suffixes.by_place(rest, bodies(rest), 100)
        assert body == bodies(rest) and rest["n"].max() <= suffixes.PLACES
    for b in range(3):
        i = np.flatnonzero(rest["h"] % np.uint64(3) == b)
        found.append(suffixes.repeated([suffixes.packed(suffixes.CONTEXT, rest, i)], [b"".join(bodies({n: rest[n][i] for n, _ in suffixes.CONTEXT}))], 100))
        assert seed % 3 or not len(i) or len(found[-1]["doc"])  # the index finds repeats
    runs = defaultdict(list)
    for f in found:
        for d, s, e in zip(*(np.asarray(f[c]).tolist() for c in ("doc", "s", "e")), strict=True):
            runs[d].append((s, e))
    seen = set()
    for d, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        kept, n, spans = suffixes.kept_parts(t, runs[d])
        assert kept == bytes(c for c, g in zip(t, gone, strict=True) if not g)
        assert n == sum(gone)
        assert spans == sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))


def test_hashes_alone_remove_nothing(monkeypatch):
    """Contexts whose hashes are equal though their bytes differ."""
    monkeypatch.setattr(suffixes.Hashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(suffixes, "gram_hashes", lambda b: np.zeros(max(0, len(b) - suffixes.GRAM + 1), np.uint64))
    r = random.Random(1)
    docs = [(k, bytes(r.choice(b"abcdefgh") for _ in range(150))) for k in range(20)]
    docs.append((20, docs[3][1]))
    rows = suffixes.contexts(docs)
    rows["text"] = rows["doc"]
    keep, again = suffixes.combined(rows, [t for _, t in docs], 100)
    assert set(rows["doc"][again]) <= {20}
    some = {n: rows[n][keep] for n, _ in suffixes.CONTEXT}
    body = b"".join(dict(docs)[d][s : s + n + 99] for d, s, n in zip(*(some[c].tolist() for c in ("doc", "s", "n")), strict=True))
    got = suffixes.repeated([suffixes.packed(suffixes.CONTEXT, some)], [body], 100)
    assert set(np.asarray(got["doc"]).tolist()) <= {20}


def test_hot_anchors(spark, sf, monkeypatch):
    """All anchors that repeat in the sample, which is everything here, are hot."""
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1 << 14)
    seen = []
    monkeypatch.setattr(suffixes, "hot_anchors", lambda docs, n, f=suffixes.hot_anchors: seen.append(f(docs, n)) or seen[-1])
    rows = got(queries.queries()["op2_suffixes"](spark, sf))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == removed_by_force(documents(sf))
    assert len(seen[0]) > 10


def test_bucket_of_a_document_is_sparks(spark):
    ids = [0, 1, -1, 7, 2**40 + 3, -(2**62), 2**63 - 1]
    want = {r["id"]: r["b"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.pmod(F.hash("id"), F.lit(13)).alias("b")).collect()}
    assert suffixes.spread(np.array(ids), 13).tolist() == [want[i] for i in ids]


def fingerprint_by_force(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf, awkward):
    for where in (sf, awkward[0]):
        docs = [(d, fingerprint_by_force(t)) for d, t in documents(where)]
        root = {d: d for d, _ in docs}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, (a, x) in enumerate(docs):
            for b, y in docs[:i]:
                if (x ^ y).bit_count() <= 3:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
        rows = got(queries.queries()["op3_simhash"](spark, where))
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{x:016x}", find(d)) for d, x in docs}


def test_simhash_links():
    g = np.random.default_rng(4)
    base = g.integers(0, 2**64, 100, np.uint64)
    fp = np.unique(np.array([int(base[g.integers(0, 100)]) ^ sum(1 << int(b) for b in g.choice(64, g.integers(0, 5), replace=False)) for _ in range(1500)], np.uint64))
    n = len(fp)
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = simhash.least_labels(n, a, b)
    have = simhash.least_labels(n, np.arange(n), simhash.linked(np.zeros(n, np.int64), fp))
    assert (have == want).all()


def test_simhash_of_a_hot_key(spark, monkeypatch):
    """Thousands of fingerprints around one, which share most keys; tasks hold few rows at a time."""
    monkeypatch.setattr(simhash, "HOT", 50)
    monkeypatch.setattr(simhash, "LINKED", 300)
    g = np.random.default_rng(9)
    fp = np.unique(np.array([0x0123456789ABCDEF ^ sum(1 << int(b) for b in g.choice(64, g.integers(0, 9), replace=False)) for _ in range(1500)], np.uint64))
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = simhash.least_labels(len(fp), a, b)
    rows = simhash.near_components(spark.createDataFrame([(k, int(x)) for k, x in enumerate(fp.view(np.int64))], "doc_id long, fp long")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want.tolist()))
    assert 1 < len(set(want.tolist())) < len(fp)


def test_quality(spark, awkward):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in got(queries.queries()["op4_quality"](spark, sf))}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(rows[d], q) for d, q in labels if rows[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.95


def test_additive_model_learns_an_interaction():
    g = np.random.default_rng(0)
    x = g.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.Model(x[:3000], y[:3000])
    assert (m.pairs[0][0], m.pairs[0][1]) == (1, 0)
    assert np.mean((m.score(x[3000:]) > 0.5) == y[3000:]) > 0.95
    assert quality.Model(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_ogg(spark, sf, awkward):
    for where in (sf, awkward[0]):
        rows = {r["doc_id"]: r for r in got(queries.queries()["op5_media"](spark, where))}
        for d, t in documents(where):
            b = (t or "").encode()
            p = b + b"\xff" * (-len(b) % 576 if b else 576)
            m = ogg.store(b)
            r = rows[d]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())


def test_ogg_pages():
    def slow(b):
        r = 0
        for c in b:
            r ^= c << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
        return r

    assert ogg.checksum(b"some bytes") == slow(b"some bytes")
    packets = [b"h", b"a" * 255, b"b" * 70000, b"", b"c" * 255 * 255, b"d"]
    media = b"".join(ogg.pages_of(7, packets, [0, 1, 2, 3, 4, 5]))
    s = ogg.demultiplex(media)[7]
    assert s["packets"] == packets
    assert s["marks"][-1] == (5, 6)
    for at in (0, 5, 22, 30, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ogg.BadPage):
            ogg.demultiplex(bytes(broken))
    with pytest.raises(ogg.BadPage):
        ogg.demultiplex(media[:-3])
    x = ogg.load(ogg.store(b"z" * 60000))
    assert x["seconds"] == x["payload"].__len__() / 8000
    assert x["starts"] == [k * 576 / 8000 for k in range(len(x["payload"]) // 576)]


def same_as_sql(spark, sf, name, tables):
    for t in tables:
        p = f"{sf}/{t}.parquet"
        import os

        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = duckdb.sql(queries.oracle_sql()[name])
    cols = sorted(rel.columns)
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


def test_chat(spark, sf, awkward):
    same_as_sql(spark, sf, "op6_chat", ["conversations"])
    same_as_sql(spark, awkward[0], "op6_chat", ["conversations"])


def test_chat_parts(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    rows = [
        (1, 0, "user", [part(type="text", text="see <|image:1|> "), part(type="image", ref="a.png", width=28, height=15), part(text=" and "), part(type="audio", ref="b.wav", seconds=2.0)]),
        (1, 1, "assistant", [part(type="text", text="fine</s>")]),
        (1, 2, "user", [part(type="document", ref="c.pdf", pages=3)]),
        (1, 3, "assistant", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.read_back(chat.format_conversations(df)).first()
    assert "%3C|image:1|> <|image:1|> and <|audio:2|>" in r["formatted"]
    assert [(a["place"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 50), (3, "document", "c.pdf", 1536)]
    assert r["placeholder_tokens"] == 1590
    assert list(r["loss_texts"]) == ["fine</s>", ""]
    assert [t["text"] for t in r["turns"]] == ["see <|image:1|> <|image:1|> and <|audio:2|>", "fine</s>", "<|document:3|>", ""]
    for s in r["loss"]:
        assert "<|turn|>" not in r["formatted"][s["start"] : s["start"] + s["length"]]


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in got(queries.queries()["op7_language"](spark, sf))}
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall()
    assert np.mean([rows[d]["lang_pred"] == x for d, x in lang if rows[d]["held_out"]]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in rows.items())


def test_language_spans(spark, awkward):
    rows = [("the cat sat on the mat with her", "en"), ("le chat est sur la table avec lui", "fr"), ("кот сидит на столе", "ru")] * 5
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    text = "the cat sat on the mat with her " * 3 + "le chat est sur la table avec lui " * 3 + "кот на столе"
    found = langid.spans(model, [text, "", "the mat"], 2.0)
    assert [x[0] for x in found[0]] == ["en", "fr", "ru"]
    assert [x[1] for x in found[0]] == [24, 24, 3]
    assert found[1] == [] and found[2][0][0] == "en"
    out = {r["doc_id"]: r["lang_pred"] for r in queries.queries()["op7_language"](spark, awkward[0]).collect()}
    assert [out[i] for i in range(4)] == ["und"] * 4 and out[13] == "und" and out[4] == "en"


def viterbi_by_force(scores, switch):
    n, k = scores.shape
    best, back = scores[0].astype(float), []
    for t in range(1, n):
        step = best[None, :] - switch * (1 - np.eye(k))
        back.append(step.argmax(1))
        best = step.max(1) + scores[t]
    return best.max()


def test_viterbi():
    g = np.random.default_rng(5)
    m = langid.Model(["a", "b", "c"], np.ones((langid.BUCKETS, 3)), np.ones((len(langid.NAMES), 3)))
    for _ in range(50):
        texts = ["w " * int(g.integers(0, 12)) for _ in range(5)]
        w = langid.Words(texts)
        s = g.normal(size=(len(w.length), 3)).astype(np.float32) * 3
        label = m.label(w, s, 2.0)
        for d in range(5):
            i = np.flatnonzero(w.doc == d)
            assert len(i) == len(texts[d].split())
            if len(i):
                total = s[i, label[i]].sum() - 2.0 * np.count_nonzero(np.diff(label[i]))
                assert abs(total - viterbi_by_force(s[i], 2.0)) < 1e-3


def test_licenses(spark, sf, awkward):
    rows = {r["doc_id"]: r for r in got(queries.queries()["op8_licenses"](spark, sf))}
    lines = {"Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "GNU General Public License, version 3.": "GPL-3.0", "under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for d, t in documents(sf):
        own = [k for line, k in lines.items() if line in t]
        assert (rows[d]["own"] in own) if own else rows[d]["own"] is None, (d, own, rows[d])
    files = [r for r in rows.values() if r["is_file"]]
    for r in rows.values():
        here = r["path"].rsplit("/", 1)[0]
        above = [f for f in files if f"{here}/".startswith(f["path"].rsplit("/", 1)[0] + "/")]
        near = max((f["path"].count("/") for f in above), default=0)
        want = min((f["path"], f["own"]) for f in above if f["path"].count("/") == near)[1] if above else None
        assert r["license"] == (r["own"] or want)


def test_license_cosines(spark):
    texts = [(1, "code\nReleased under the MIT License.\nmore code"), (2, licenses.TEMPLATES["GPL-3.0"][1]), (3, "the license of nothing"), (4, None), (5, "")]
    rows = {r["id"]: r for r in licenses.statements(spark.createDataFrame(texts, "id long, text string")).collect()}
    assert {k: r["license"] for k, r in rows.items()} == {1: "MIT", 2: "GPL-3.0"}
    assert rows[1]["cosine"] == rows[2]["cosine"] == 1.0 and rows[2]["share"] == 1.0
    words = lambda s: [w for w in __import__("re").split("[^a-z0-9]+", s.lower()) if w and w not in licenses.STOP]
    text = "This program is free software, under the GNU General Public License, published by the Free Software Foundation: version 3 of the License, or any later version. Redistribute it and modify it."
    docs = [text, "a program"]
    df = Counter(w for d in docs for w in set(words(d)))
    idf = lambda w: math.log(3 / (1 + df.get(w, 0))) + 1
    known = {w for v in licenses.TEMPLATES.values() for s in v for w in words(s)}
    vec = lambda s: {w: n * (idf(w) if w in known else math.log(3) + 1) for w, n in Counter(words(s)).items()}
    a = vec(text)
    best = max(sum(a[w] * x for w, x in vec(s).items() if w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in vec(s).values())) for v in licenses.TEMPLATES.values() for s in v)
    row = licenses.statements(spark.createDataFrame(list(enumerate(docs)), "id long, text string")).collect()
    assert abs(row[0]["cosine"] - best) < 1e-5 if best >= licenses.COSINE else not row


def test_top_k(spark, sf):
    same_as_sql(spark, sf, "op9_top_k", ["embeddings"])


def test_top_k_of_repeats_and_ties(spark, tmp_path):
    """Repeated rows, null ids, empty and short vectors, a vector that a third of the rows have, an id with many rows."""
    g = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in g.integers(-3, 4, 4) / 2]) for i in g.integers(0, 200, 300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(150)] + [(40, [1.0, 1.0, 1.0, 1.0])] * 30 + [(60, []), (61, []), (80, [3.0]), (None, [9.0, 9.0, 9.0, 9.0]), (20, None)] + rows[:40]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    same_as_sql(spark, str(tmp_path), "op9_top_k", ["embeddings"])


def test_chat_of_long_texts_and_repeats(spark, tmp_path):
    """A text of five megabytes, full of control strings; repeated rows, ties and nulls."""
    long = "a</s>[INST]<|turn|> %3C é\n" * 200_000
    assert len(long) > 5_000_000
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", long), (1, 1, "assistant", long[:40]), (2, 0, "user", long[:1000]), (2, 0, "user", long[:1000]), (None, 3, None, None), (None, None, "assistant", "y")]
    spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql(spark, str(tmp_path), "op6_chat", ["conversations"])


@pytest.mark.parametrize("n", [1, 5, 300])
def test_approximation_bounds(n):
    g = np.random.default_rng(0)
    for most in (3, 500, 10**6, 2**40):
        v, q = g.integers(-most, most, (n, 16)), g.integers(-100, 100, (20, 16))
        a, exact = vafile.Approximation.of(v), q @ v.T
        assert a.cell.dtype == np.uint8 and a.low.shape == (16, vafile.CELLS)
        wide = []
        for fine in (False, True):
            low, high = a.bounds(q, False, fine), a.bounds(q, True, fine)
            assert (low <= exact).all() and (exact <= high).all()
            wide.append((high - low).mean())
            some = np.array([0, n - 1])
            assert (a.bounds(q, True, fine, some) == high[:, some]).all()
        assert wide[1] <= wide[0] and (most < 500 or n < 300 or 0 < wide[1] < wide[0] / 8)
        counts = [len(np.unique(a.cell[:, j] // vafile.FINE)) for j in range(16)]
        assert n < 300 or most < 500 or min(counts) == vafile.CELLS  # quantiles


def test_search_reads_few_exact_vectors(spark):
    """Numbers far wider apart than a cell: cells leave some pairs open, their parts few, and the result is that of all scores."""
    g = np.random.default_rng(1)
    numbers = {i: [int(x) for x in g.integers(-50_000, 50_000, 8)] for i in range(3000)}
    v = spark.createDataFrame(list(numbers.items()), "id long, v array<long>")
    exact, cells = vafile.approximation_file(v, 5)
    assert exact.count() == 3000 and cells.where("vectors IS NOT NULL").count() == 0
    asked = vafile.written(vafile.blocks(v.where("id % 100 = 0").withColumn("row", F.col("id")), 8, False), "asked")
    bounded = vafile.least_scores(cells, asked, 3, 5)
    assert vafile.candidates(cells, bounded, 3).count() < 30 * 60
    m = np.array([numbers[i] for i in range(3000)])
    got = [tuple(r) for r in vafile.top_k(v.where("id % 100 = 0"), v, 5).collect()]
    want = []
    for i in range(0, 3000, 100):
        s = m @ m[i]
        s[i] = -(2**62)
        want += [(i, r, int(j), int(s[j])) for r, j in enumerate(np.lexsort((np.arange(3000), -s))[:5], 1)]
    assert sorted(got) == sorted(want)


def test_byte_bpe(spark, sf, awkward):
    import tiktoken

    ranks = byte_bpe.parse_ranks(open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for where in (sf, awkward[0]):
        rows = {r["doc_id"]: r for r in got(queries.queries()["op10_byte_bpe"](spark, where))}
        for d, t in documents(where):
            ids = own.encode_ordinary(t or "")
            r = rows[d]
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe_boundaries(monkeypatch):
    c = byte_bpe.Codec(open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), tokenizers.PATTERN)
    r = random.Random(1)
    for k in range(200):
        monkeypatch.setattr(byte_bpe, "BLANKS", r.choice([2, 3, 65_536]))
        blanks = [" " * 2, " " * 5, "\n" * 3, " \n\t ", "\u3000\xa0 ", "\x1c\x1c"] if k % 2 else []
        t = "".join(r.choice([*blanks, "a", "The", " ", "  ", "\n", "é", "9", "!", "'s", " word", " über", "日本", "😀", "\x1c"]) for _ in range(r.randint(0, 2000)))
        want = c.library.encode_ordinary(t)
        assert c.encode(t) == want
        assert sum((c.library.encode_ordinary(s) for s in c.segments(t, 50)), []) == want
    monkeypatch.undo()
    t = "x" * 20000 + "ab" * 9000 + " hello" + " " * 70_000 + "end" + "\n" * 70_000
    assert c.encode(t) == c.library.encode_ordinary(t)
    for t in ("a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "日本" * 500_000, "ab1!" * 300_000):  # the library alone gives up on the first two
        assert c.decode(c.encode(t)) == t.encode()
