"""A quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins at quantiles. Cyclic boosting fits shallow trees to one feature after the other, then to pairs of
features; a tree's leaves are added to lookup tables over the bins, so that a score is a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm.common import crc_mod, kept_rows, small_batches, table

#: Labelled rows to learn from, at most: those of least hash.
SAMPLE = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, LEAST = 32, 120, 0.15, 10, 40, 20
THRESHOLD = 0.3
NAMES = [
    "log_words", "word_length", "word_length_sd", "upper", "digits", "marks", "bars", "exclaims", "commas_stops", "other_marks", "high_bytes",
    "distinct_words", "top_word", "same_next", "same_second", "distinct_pairs", "lines", "line_words", "repeated_lines", "blank_share",
    "byte_entropy", "marked_words", "upper_lines", "barred_lines", "symbol_lines", "dull_lines", "longest_run",
]
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_ENDS = np.isin(np.arange(256), list(b".,"))
_COUNTED = {c: i for i, c in enumerate("|!")}


def features(text: str | None) -> list[float]:
    """Of the whole text alone; all zero for a null or empty one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, seen = len(raw), hist[hist > 0] / len(raw)
    length = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    second = sum(map(str.__eq__, words, words[2:]))
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = int(hist[_MARK].sum())
    upper = barred = symbol = dull = 0
    for x in lines:
        k = len(x)
        upper += k * (x.upper() == x and x.lower() != x)
        barred += k * (x.count("|") >= 2)
        if k > 20:
            w = x.split()
            symbol += k * (sum(not c[-1].isalnum() and c[-1] not in ".,;:!?" for c in w) > 0.3 * len(w))
            dull += k * (len(w) >= 8 and len(set(w)) < 0.35 * len(w))
    chars = max(1, sum(map(len, lines)))
    run = best = 1
    if same:
        for a, b in zip(words, words[1:], strict=False):
            run = run + 1 if a == b else 1
            best = max(best, run)
    return [
        float(np.log1p(n)), float(length.mean()), float(length.std()), hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / size, marks / size, hist[124] / n, hist[33] / n, hist[_ENDS].sum() / n,
        (marks - hist[_ENDS].sum()) / n, hist[128:].sum() / size, len(counts) / n, max(counts.values()) / n, same / n, second / n, pairs / max(1, n - 1), float(np.log1p(len(lines))),
        n / len(lines), 1 - len(set(lines)) / len(lines), hist[32] / size, float(-(seen * np.log2(seen)).sum()), sum(not w[-1].isalnum() for w in words) / n,
        upper / chars, barred / chars, symbol / chars, dull / chars, float(np.log1p(best)),
    ]


def leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins with gradient sums g and weight sums h: the best split, then the best in each half."""
    total = -g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), total)
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= 1) & (hr >= 1), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1)
    cut = int(gain.argmax()) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return np.full(len(g), total)
    return np.concatenate((leaves(g[:cut], h[:cut], depth - 1), leaves(g[cut:], h[cut:], depth - 1)))


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best pair of cuts of a grid of sums: four leaves."""
    G, H = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    a = [G[:-1, :-1], G[:-1, -1:] - G[:-1, :-1], G[-1:, :-1] - G[:-1, :-1]]
    w = [H[:-1, :-1], H[:-1, -1:] - H[:-1, :-1], H[-1:, :-1] - H[:-1, :-1]]
    a.append(G[-1, -1] - sum(a))
    w.append(H[-1, -1] - sum(w))
    gain = sum(x**2 / (y + 1) for x, y in zip(a, w, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(g)
    for k, (r, c) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[r, c] = -a[k][i, j] / (w[k][i, j] + 1)
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + 1)), step


class Model:
    """cuts for each feature, a constant, a table for each feature, and tables for pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
        self.mains = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = (y.sum() + 1) / (n + 2)
        self.constant = float(np.log(share / (1 - share)))
        if n < LEAST or y.min() == y.max():
            return
        b = self.bins(x)
        score = np.full(n, self.constant)

        def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return np.bincount(at, p - y, size), np.bincount(at, p * (1 - p), size)

        for _ in range(ROUNDS):
            for j, t in enumerate(self.mains):
                step = RATE * leaves(*sums(b[j], len(t)), depth=2)
                t += step
                score += step[b[j]]
        # Pairs by the gain of one four-leaf tree over what the mains leave.
        found = []
        for i in range(f):
            for j in range(i):
                shape = len(self.mains[i]), len(self.mains[j])
                g, h = (v.reshape(shape) for v in sums(b[i] * shape[1] + b[j], shape[0] * shape[1]))
                found.append((quadrants(g, h)[0], i, j))
        self.pairs = [(i, j, np.zeros((len(self.mains[i]), len(self.mains[j])))) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                at = b[i] * t.shape[1] + b[j]
                step = RATE * quadrants(*(v.reshape(t.shape) for v in sums(at, t.size)))[1]
                t += step
                score += step[b[i], b[j]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        s = np.full(len(x), self.constant)
        for j, t in enumerate(self.mains):
            s += t[b[j]]
        for i, j, t in self.pairs:
            s += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def feature_rows(df: DataFrame, extra: str) -> DataFrame:
    """(extra, x array<double>) of whole texts."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=[extra, "x"])

    return df.select(df[extra].cast("double").alias(extra), "text").mapInArrow(run, f"{extra} double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most sample labelled documents that are not held out, those of least hash; several labels of one document are averaged, a null one is none. With too few rows, or one class, the model is a constant."""
    y = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id"), "y").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)
    return Model(x[order], (rows.column("y").to_numpy()[order] >= 0.5).astype(float))


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of whole texts, null and empty ones too."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].alias("text")).mapInArrow(run, "doc_id long, score double")


def good_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose score reaches the threshold, with all columns as they are; rows without an id are judged like others."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, "text", lambda texts: sent.value.score(np.array([features(t) for t in texts.to_pylist()], float).reshape(-1, len(NAMES))) >= threshold)


def held_out() -> F.Column:
    return F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have features of zero and a score like any other. Several labels of one document are averaged, 0.5 counts as 1; repeated rows and rows without an id (which are never held out) get a row each; an empty table gives an empty result, and without labels the score is a constant; labels, lang, source and other columns are not inputs."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
