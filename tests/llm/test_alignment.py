"""Two tokenizers aligned, against a plain program over whole texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers as tokenizers
from clusterlake.llm import align

A_FILE, B_FILE = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abcXYZ  \n\t.,'’!?-_0123456789éüßñ日本語ก️​\xa0 \x85\x1c▁﷽ﬁ①😀\x00\r") + ["<|endoftext|>", "</s>", "<unk>", "<s>", "'s", "'ll", " the", " and", "<0x41>", "  ", "   "]


@pytest.fixture(scope="module")
def plain():
    """The bytes and ids of both tokenizers' tokens of a text."""
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands_for = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(printable)))}

    def tokens(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return x, [bytes(stands_for[c] for c in a.id_to_token(i)) for i in x], y, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]

    return tokens


def by_force(texts, plain):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    found, count = [], Counter()
    for t in texts:
        x, xs, y, ys = plain(t) if t else ([], [], [], [])
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            found.append(None)
            continue
        groups, i, j, m, n = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if m == n and m:
                groups.append(([], []))
            if m <= n:
                groups[-1][0].append(x[i])
                m, i = m + len(xs[i]), i + 1
            else:
                groups[-1][1].append(y[j])
                n, j = n + len(ys[j]), j + 1
        links = [(p, q) for g, h in groups for p in g for q in h]
        count.update(set(links))
        found.append((len(x), len(y), len(groups), links, ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)))
    best: dict = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if f is None else (*f[:3], len(f[3]), sum(count[k] == best[k[0]] for k in f[3]), sum(count[k] for k in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found]


def test_random_texts_by_words(plain):
    with open(A_FILE, "rb") as f, open(B_FILE, "rb") as g:
        own = align.Aligner(f.read(), g.read())
    assert own.by_words
    r = random.Random(3)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    want = by_force(texts, plain)
    got = list(own.align(texts))
    assert [(*g[:4], g[4]) for g in got] == [(*w[:4], w[6]) for w in want]
    assert sum(w[0] == 0 for w in want) < 1000
    assert all(sum(g[6].tolist()) == g[3] for g in got)


def test_labels_and_groups():
    import numpy as np

    labels = align.label_string(np.array([1, 2, 1, 3]), np.array([3, 1, 1, 1, 1]))
    assert labels == b"a.**bb*"
    assert align.groups_of(labels).tolist() == [[2, 1], [1, 1], [1, 3]]


def test_a_group_of_many_links():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = r.integers(0, 30, 300), r.integers(0, 20, 200)
    sizes = np.array([[100, 90], [1, 1], [199, 109]])
    keys, times = align.linked(a, b, sizes, 1000)
    want = Counter(int(x) * 1000 + int(y) for s, e, u, v in ((0, 100, 0, 90), (100, 101, 90, 91), (101, 300, 91, 200)) for x in a[s:e] for y in b[u:v])
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want and keys.tolist() == sorted(want)


@pytest.mark.parametrize("head", [align.HEAD, 500, 0])
def test_documents(spark, sf, plain, head):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(7, docs[0][1]), (7, docs[0][1]), (None, docs[1][1]), (None, None), (8, ""), (9, "▁ is spelled otherwise"), (10, "x" * 50_000), (11, " " * 3000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_best int, key string").repartition(5)
    got = align.align_texts(df, A_FILE, B_FILE, head).collect()
    assert Counter(map(tuple, got)) == Counter((d, *w) for (d, _), w in zip(docs, by_force([t for _, t in docs], plain), strict=True))
