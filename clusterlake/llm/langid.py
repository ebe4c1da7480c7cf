"""Language identification of spans and whole texts.

A model has, for each learned language, log probabilities of the byte n-grams of words, and the scripts that its words are written in.
The script of a word's first letter narrows the candidates; each candidate's score of the word is the sum over its n-grams; Viterbi
over the words, with a penalty for each switch, gives each word a language, and runs of one language are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm.common import crc_mod, kept_rows, small_batches, table

BUCKETS, GRAM, SWITCH, SMOOTH = 1 << 15, 3, 12.0, 0.5
#: Letters of texts that are labelled together, so that memory is bounded.
AT_ONCE = 2 << 20
#: A language keeps the scripts of at least this share of its words.
SCRIPT_SHARE = 0.01
#: First code points of script ranges (Unicode blocks), and the script from there on.
SCRIPTS = [
    (0x00, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"),
    (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"),
    (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])
#: ASCII that is no letter becomes a blank.
_BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Words:
    """The words of some texts: bytes between blanks of the lower-cased texts, in one array, and their n-grams."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "replace").translate(_BLANK) for t in texts]
        b = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
        size = np.array([len(r) + 1 for r in raw], np.int64)
        blank = b == 32
        first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1  # of each word
        last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        self.doc = np.searchsorted(np.cumsum(size), first - 1, "right")
        self.n_docs, self.length = len(texts), last - first
        x = b.astype(np.uint32)
        gram = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
        gram = ((gram ^ (gram >> 15)) * np.uint32(0x27D4EB2F)) >> np.uint32(17)
        # Grams start at the blank before a word and at each of its letters but the last.
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        at = np.repeat(first - 1 - self.start, self.length) + np.arange(self.length.sum())
        self.gram = gram[at].astype(np.int32)
        lead, nxt, third = (b[np.minimum(first + i, len(b) - 1)].astype(np.int64) for i in range(3))
        code = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | nxt & 63, np.where(lead < 0xF0, (lead & 15) << 12 | (nxt & 63) << 6 | third & 63, 0x10000)))
        self.script = _NUMBER[np.searchsorted(_STARTS, code, "right") - 1]


class Model:
    """languages, log probabilities [BUCKETS, languages], and which script each language has [scripts, languages]."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = grams.sum(0, keepdims=True)
        self.table = np.log((grams + SMOOTH) / (total + SMOOTH * BUCKETS)).astype(np.float32)
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0, keepdims=True))

    def word_scores(self, w: Words) -> np.ndarray:
        """[words, languages]; far below all others where the language doesn't have the word's script, unless none has."""
        if not len(w.length):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.empty((len(w.length), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.table[:, k][w.gram], w.start)
        allowed = self.allowed[w.script]
        out[~allowed & allowed.any(1, keepdims=True)] -= 1e4
        return out

    def label(self, w: Words, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The language number of each word. All documents go forward together, one word at a time, the longest last."""
        n, langs = scores.shape
        count = np.bincount(w.doc, minlength=w.n_docs)
        start = np.concatenate(([0], np.cumsum(count)))[:-1]
        order = np.argsort(-count, kind="stable")
        longest = count[order]
        alive = np.searchsorted(-longest, -np.arange(1, longest.max(initial=0) + 1), "right")  # documents with more words than t
        begin = start[order]
        stay = np.zeros((n, langs), bool)
        top = np.zeros(n, np.int16)
        state = np.zeros((len(order), langs), np.float32)
        for t, m in enumerate(alive):
            at = begin[:m] + t
            s = state[:m]
            if t:
                best = s.argmax(1)
                jump = s[np.arange(m), best] - switch
                top[at] = best
                stay[at] = s >= jump[:, None]
                np.maximum(s, jump[:, None], out=s)
                s -= s.max(1, keepdims=True)
            s += scores[at]
        out = np.zeros(n, np.int16)
        now = state.argmax(1).astype(np.int16)
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            at = begin[:m] + t
            out[at] = now[:m]
            if t:
                now[:m] = np.where(stay[at, now[:m]], now[:m], top[at])
        return out


def fit(df: DataFrame) -> Model:
    """Learns from all rows of (text, lang) with neither null. Each task sends its n-gram counts; what reaches the driver are BUCKETS counts and the scripts for each language."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            texts = b.column(0).to_pylist()
            for lang in set(langs):
                w = Words([texts[i] for i in np.flatnonzero(langs == lang)])
                got = grams.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                got[:BUCKETS] += np.bincount(w.gram, minlength=BUCKETS)
                got[BUCKETS:] += np.bincount(w.script, minlength=len(NAMES))
        for lang, got in grams.items():
            i = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int64()), pa.array(got[i])], names=["lang", "i", "n"])

    rows = df.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, i long, n long")
    got = rows.groupBy("lang", "i").agg(F.sum("n").alias("n")).toArrow()
    names, i, n = (got.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "i", "n"))
    languages = sorted(set(names))
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    if languages:
        counts[i, np.searchsorted(np.array(languages, object), names)] = n
    return Model(languages, counts[:BUCKETS], counts[BUCKETS:])


def spans(model: Model, texts: list[str], switch: float = SWITCH) -> list[list[tuple[str, int, int]]]:
    """For each text, runs of words of one language: (language, words, letter bytes)."""
    w = Words(texts)
    label = model.label(w, model.word_scores(w), switch)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(w.doc) != 0) | (np.diff(label) != 0)))) if len(label) else np.zeros(0, np.int64)
    sizes = np.add.reduceat(w.length, cut) if len(cut) else []
    words = np.diff(np.concatenate((cut, [len(label)])))
    out: list[list] = [[] for _ in texts]
    for c, n, size in zip(cut, words, sizes, strict=True):
        out[w.doc[c]].append((model.languages[label[c]], int(n), int(size)))
    return out


def labelled(model: Model, texts: list[str | None], switch: float = SWITCH) -> tuple[list[str], list[float], list[list]]:
    """(language, score, spans) of each text; of equals, the language that comes first in the alphabet. About AT_ONCE letters are worked on at a time."""
    pred, score, every = [], [], []
    i = 0
    while i < len(texts):
        some, size = [], 0
        while i < len(texts) and (not some or size < AT_ONCE):
            some.append(texts[i] if has_letter(texts[i]) and model.languages else "")
            size += len(some[-1])
            i += 1
        found = spans(model, some, switch) if model.languages else [[] for _ in some]
        for t, s in zip(some, found, strict=True):
            share: dict[str, int] = {}
            for lang, _, n in s:
                share[lang] = share.get(lang, 0) + n
            best = max(sorted(share), key=share.get) if share and t else "und"
            pred.append(best)
            score.append(share.get(best, 0) / max(1, sum(share.values())))
        every += found
    return pred, score, every


def predict(df: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of whole texts: the language of most bytes of words, and its share of them.

    A text that is null or has no letter is `und` with score 0, as is any text when no language was learned.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, found = labelled(sent.value, b.column(1).to_pylist(), switch)
            cols = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                cols.append(pa.array([[{"lang": a, "words": n, "bytes": z} for a, n, z in s] for s in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("bytes", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,words:long,bytes:long>>" * with_spans
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].alias("text")).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))


def with_language(docs: DataFrame) -> DataFrame:
    """Rows of docs that language_of() doesn't call `und`, with all columns as they are; rows without an id are judged like others."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out())))
    return kept_rows(docs, "text", lambda texts: np.array([x != "und" for x in labelled(sent.value, texts.to_pylist())[0]], bool))


def language_of(docs: DataFrame) -> DataFrame:
    """predict() with a model of the documents that are not held out."""
    return predict(docs, fit(docs.where(~held_out())))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter are `und`, with score 0; of languages with equal shares, the first in the alphabet. Texts with a null lang are not learned from; repeated rows and rows without an id (which are never held out) get a row each; an empty table gives an empty result, and without a language to learn all are `und`; lang, source and other columns are not inputs."""
    out = language_of(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
