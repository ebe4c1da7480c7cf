"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens that links."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm.common import small_batches, table, written

#: Id pairs with their counts that are sent to the workers at most (some 20 MB); the documents' other pairs are joined.
HEAD = 1_000_000
#: Pairs that a task adds up before it passes them on, and that one group unfolds at a time.
HELD = 2_000_000
#: A word of up to so many characters is cut into tokens once for a worker, which keeps so many of them.
WORD, WORDS = 64, 200_000
#: Label of a byte: no token ends there, one of A, one of B, one of both.
NONE, A_END, B_END, BOTH = b".", b"a", b"b", b"*"
_MARKS = np.frombuffer(NONE + A_END + B_END + BOTH, np.uint8)
_SPAN = re.compile(rb"[^*]*\*")
#: Fixed value: how a byte-level tokenizer cuts words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are letters, digits, white space or none of these to every pattern engine.
_PLAIN = re.compile("[\\n -~À-ÖØ-öø-ÿ]*")
#: A space after a visible character and before an ASCII letter.
_WORDS = re.compile(r"(?<=\S) (?=[A-Za-z])")
_BUILT: dict = {}


def label_string(a_lengths: np.ndarray, b_lengths: np.ndarray) -> bytes:
    """One label for each byte of a text whose tokens have these lengths in bytes, of the same sum."""
    marks = np.zeros(int(a_lengths.sum()), np.uint8)
    marks[np.cumsum(a_lengths) - 1] |= 1
    marks[np.cumsum(b_lengths) - 1] |= 2
    return _MARKS[marks].tobytes()


class _Counts(dict):
    """Tokens of A and of B that end in a span of labels, as one number, the former in its upper half."""

    def __missing__(self, span: bytes) -> int:
        both = span.count(BOTH)
        found = span.count(A_END) + both << 32 | span.count(B_END) + both
        if len(span) <= 16:
            self[span] = found
        return found


def groups_of(labels: bytes, seen: _Counts | None = None) -> np.ndarray:
    """(groups, 2): the tokens of A and B in each span up to where both end."""
    counts = seen if seen is not None else _Counts()
    spans = _SPAN.findall(labels.translate(None, NONE))
    both = np.fromiter(map(counts.__getitem__, spans), np.int64, len(spans))
    return np.stack((both >> 32, both & 0xFFFFFFFF), axis=1)


def linked(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, width: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys a * width + b of the token pairs that share a group, distinct and sorted, and how often each is linked; with of, numbers that are added to the keys of a group.

    Groups of few links are unfolded; in one of many, equal ids are counted first, so that its links are products of counts.
    """
    na, nb = sizes[:, 0], sizes[:, 1]
    links = na * nb
    of = np.zeros(len(sizes), np.int64) if of is None else of
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    keys, times = [], []
    few = np.flatnonzero(links <= 4096)
    upto = np.cumsum(links[few])
    begin = 0
    while begin < len(few):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HELD, "right")))
        g = few[begin:end]
        m = links[g]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        of_b = np.repeat(nb[g], m)
        k = a[np.repeat(first_a[g], m) + at // of_b].astype(np.int64) * width + b[np.repeat(first_b[g], m) + at % of_b] + np.repeat(of[g], m)
        k, t = np.unique(k, return_counts=True)
        keys.append(k)
        times.append(t)
        begin = end
    for g in np.flatnonzero(links > 4096):
        x, p = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
        y, q = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        keys.append((x.astype(np.int64)[:, None] * width + y).ravel() + of[g])
        times.append((p[:, None] * q).ravel())
    return (keys[0], times[0]) if len(keys) == 1 else merged(keys, times)


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their times."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, t = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(t, first) if len(k) else t


class Aligner:
    """Tokens of two tokenizers of a text, and their groups. Words of both tokenizers are apart at a space between a visible and an ASCII letter, where each has a token end, so that a text is aligned by words."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        at_byte = _byte_level()
        vocabulary = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(at_byte[c] for c in piece) if all(c in at_byte for c in piece) else piece.encode()
        self.quick = quick_encoder(json.loads(a_json), self.a_bytes)
        self.lossless = self.quick is not None  # every byte is a piece, and nothing changes a text before it is cut
        self.width = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.by_words = not any(re.search("[^▁]▁", x) for x in names)  # no piece of B goes on over a space
        self.words: tuple[dict, dict] = {}, {}
        self.spans = _Counts()
        self.lengths = [np.array([len(x) for x in each], np.int64) for each in (self.a_bytes, self.b_bytes)]
        self.shown = {(side, end): np.array([f"{i}{end}" for i in range(n)], object) for side, n in enumerate(map(len, (self.a_bytes, self.b_bytes))) for end in ",|;"}

    def words_of(self, text: str) -> list[str]:
        """Parts of space + text, each without its first space."""
        if not self.by_words:
            return [text]
        return _WORDS.split(text)

    def fresh(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of the tokens of A and of B of words, as numbers of four bytes; None where the two don't spell the same bytes.

        Words that begin and end as those within a text do are cut as one text, which is much faster; each ends where tokens do.
        """
        out: dict[str, tuple[bytes, bytes] | None] = {}
        inner = [w for w in words if w and w[0].isascii() and w[0].isalpha() and not w[-1].isspace()] if self.by_words else []
        for some in (inner[i : i + 500] for i in range(0, len(inner), 500)):
            whole = " ".join(some)
            found = self.cut(whole, np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in some]) + np.arange(1, len(some) + 1))
            out.update(zip(some, found if found is not None else [self.cut(w, None) for w in some], strict=True))
        return [out[w] if w in out else self.cut(w, None) for w in words]

    def ids_of_a(self, text: str) -> list[int]:
        """A's ids of space + text: a byte-level BPE by the tiktoken library, which is much faster, for plain characters, and by its own library for all others."""
        if self.quick is not None and _PLAIN.fullmatch(text):
            return self.quick.encode_ordinary(" " + text)
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids

    def cut(self, text: str, ends: np.ndarray | None) -> list[tuple[bytes, bytes]] | tuple[bytes, bytes] | None:
        """The ids of a text's tokens, one pair of strings or, with ends, one for each part that ends at so many bytes of space + text; None if the tokens don't spell these bytes, or a part doesn't end with a token."""
        parts = []
        whole = (" " + text).encode()
        for side, (ids, spelled) in enumerate(((self.ids_of_a(text), self.a_bytes), (self.b.encode(text), self.b_bytes))):
            flat = np.array(ids, "<i4")
            if (side == 1 or not self.lossless) and b"".join(map(spelled.__getitem__, ids)) != whole or int(self.lengths[side][flat].sum()) != len(whole):
                return None
            packed = flat.tobytes()
            if ends is None:
                parts.append([packed])
                continue
            at = np.cumsum(self.lengths[side][flat])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            stops = (4 * (last + 1)).tolist()
            parts.append([packed[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)])
        found = list(zip(*parts, strict=True))
        return found if ends is not None else found[0]

    def align(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of each text. All texts' tokens lie in one row of bytes, as the words of a text do: where one ends, tokens of both end."""
        parts = [self.words_of(t) if t else [] for t in texts]
        every = set().union(*parts)
        if len(self.words[0]) + len(every) > WORDS:
            self.words = {}, {}
        new = list(every - self.words[0].keys())
        # Long words are many bytes and rarely come again: they are kept for this call alone.
        known = self.words if all(len(w) <= WORD for w in new) else tuple({w: own[w] for w in every if w in own} for own in self.words)
        for w, found in zip(new, self.fresh(new), strict=True):
            if found is not None:
                for side in (0, 1):
                    known[side][w] = found[side]
                    if len(w) <= WORD:
                        self.words[side][w] = found[side]
        tokens: list[list[bytes]] = [[], []]
        count = np.zeros((2, len(texts)), np.int64)
        for i, (text, words) in enumerate(zip(texts, parts, strict=True)):
            try:
                own = [b"".join(map(k.__getitem__, words)) for k in known]
            except KeyError:  # a word is spelled otherwise: the whole text decides
                own = self.cut(text, None) or (b"", b"")
            for side in (0, 1):
                tokens[side].append(own[side])
                count[side, i] = len(own[side]) // 4
        a, b = (np.frombuffer(b"".join(t), "<i4") for t in tokens)
        sizes = groups_of(label_string(self.lengths[0][a], self.lengths[1][b]), self.spans) if len(a) else np.zeros((0, 2), np.int64)
        ends = np.cumsum(sizes, axis=0)
        last = np.searchsorted(ends[:, 0], np.cumsum(count[0]), "right")  # groups up to the end of each text
        groups = np.diff(last, prepend=0)
        links = np.concatenate(([0], np.cumsum(sizes[:, 0] * sizes[:, 1])))
        span = len(self.a_bytes) * self.width
        keys, times = linked(a, b, sizes, self.width, np.repeat(np.arange(len(texts)), groups) * span) if len(a) else merged([], [])
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
        shown = self.as_text(a, b, sizes, ends)
        at = np.concatenate(([0], np.cumsum(count[0] + count[1])))
        for i in range(len(texts)):
            n = int(groups[i])
            if not n:
                yield 0, 0, 0, 0, "", *merged([], [])
                continue
            sha = hashlib.sha256()
            for k in range(at[i], at[i + 1], 1 << 20):
                stop = min(k + (1 << 20), int(at[i + 1]))
                piece = "".join(shown[k:stop].tolist())
                sha.update((piece[:-1] if stop == at[i + 1] else piece).encode())
            own = slice(cuts[i], cuts[i + 1])
            yield int(count[0, i]), int(count[1, i]), n, int(links[last[i]] - links[last[i] - n]), sha.hexdigest(), keys[own] - i * span, times[own]

    def as_text(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens of all groups as text, each followed by what divides it from the next: commas within a side, a bar after A's side, a semicolon after the group."""
        out = np.empty(len(a) + len(b), object)
        group = np.arange(len(sizes))
        before = ends - sizes
        for side, (ids, end) in enumerate(((a, "|"), (b, ";"))):
            other = before[:, 1] if side == 0 else ends[:, 0]
            place = np.arange(len(ids)) + np.repeat(other[group], sizes[:, side])
            out[place] = self.shown[side, ","][ids]
            at_end = ends[:, side] - 1
            out[place[at_end]] = self.shown[side, end][ids[at_end]]
        return out


def quick_encoder(a: dict, spelled: list[bytes]):
    """The vocabulary of a byte-level tokenizer's file for the tiktoken library, or None if its merges are not what that library does: by pattern and in the order of the ids that they make, of pieces that are merged in one way each."""
    import tiktoken

    model, pre = a["model"], a.get("pre_tokenizer") or {}
    ids = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", ())]
    plain = a.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or ids != list(range(256, 256 + len(ids))) or len(spelled) != 256 + len(ids):
        return None
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(spelled)}, special_tokens={})


def _byte_level() -> dict[str, int]:
    """Printable stand-ins of bytes in a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others for the next ones from 256 on."""
    own = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c <= 0xFF]
    return {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}


def aligner(a_json: bytes, b_model: bytes) -> Aligner:
    """One for each Python worker."""
    key = hash((a_json, b_model))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Aligner(a_json, b_model)
    return _BUILT[key]


def aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, width, keys binary, times binary): tokens, groups and links of each text, and its distinct pairs of linked ids as sorted numbers a * width + b of 8 bytes, with the number of links of each."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    schema = f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        for b in batches:
            for at in range(0, b.num_rows, 50):
                part = b.slice(at, 50)
                rows = [(*x[:5], *(np.ascontiguousarray(v, "<i8").tobytes() for v in x[5:])) for x in own.align(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2, strict=True))], names=names)

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias("text")).mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, n): documents that hold a pair of ids linked. Tasks add up before they pass on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if size:
                k, n = np.unique(np.concatenate(held), return_counts=True)
                for at in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 100_000]), pa.array(n[at : at + 100_000].astype(np.int64))], names=["key", "n"])

        for b in batches:
            for x in b.column(0):
                held.append(np.frombuffer(x.as_py(), "<i8"))
                size += len(held[-1])
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        yield from out()

    return found.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def audited(found: DataFrame, width: int, head: int = HEAD) -> DataFrame:
    """found with n_best and count_sum: links whose pair's count is the highest of its A id, and the sum of the counts of all links.

    found: a table of aligned() that is written, as it is read twice. The most common pairs, up to head, are sent to the workers; what
    documents hold of others, which few documents hold each, is joined by pair and added up by document. Both ways are exact.
    """
    spark = found.sparkSession
    n = written(pair_counts(found), "pairs")
    highest = n.groupBy(F.expr(f"key div {width}").alias("a")).agg(F.max("n").alias("highest"))  # a row for each id of A's vocabulary
    n = written(n.withColumn("a", F.expr(f"key div {width}")).join(F.broadcast(highest), "a").select("key", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    steps = n.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # a few hundred at most
    least, size = None, 0
    for s in steps:
        size += s["m"]
        if size > head:
            break
        least = s["least"]
    common = n.where(F.col("n") >= least if least is not None else F.lit(False)).orderBy("key").toArrow()
    sent = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("key", "n", "best")))
    row = found.withColumn("_r", F.monotonically_increasing_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in ("keys", "times")) + ", n_best long, count_sum long, _r long"
    names = [x.split()[0] for x in schema.split(", ")]

    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(sent.value[0], keys)
        at[at == len(sent.value[0])] = 0
        return at, sent.value[0][at] == keys if len(sent.value[0]) else np.zeros(len(keys), bool)

    def pairs_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, t in zip(b.column("keys"), b.column("times"), strict=True):
            yield np.frombuffer(k.as_py(), "<i8"), np.frombuffer(t.as_py(), "<i8")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, count, best = sent.value
        for b in batches:
            sums = []
            for keys, times in pairs_of(b):
                at, known = places(keys)
                at, times = at[known], times[known]
                sums.append((int(times[best[at]].sum()), int((times * count[at]).sum())))
            own = {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else b.column(c) for c in names], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, (keys, times) in zip(b.column("_r").to_pylist(), pairs_of(b), strict=True):
                left = np.flatnonzero(~places(keys)[1])
                for i in range(0, len(left), 100_000):
                    some = left[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r, np.int64)), pa.array(keys[some]), pa.array(times[some])], names=["_r", "key", "t"])

    out = row.mapInArrow(scored, schema)
    if size > len(common):  # some pairs are not among those sent
        rare = n if least is None else n.where(F.col("n") < least)
        more = row.select("_r", "keys", "times").mapInArrow(others, "_r long, key long, t long").join(rare, "key")
        more = more.groupBy("_r").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_b"), F.sum(F.col("t") * F.col("n")).alias("_s"))
        out = out.join(more, "_r", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_s", F.lit(0))).drop("_b", "_s")
    return out.drop("_r")


def align_texts(docs: DataFrame, a_file: str, b_file: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents (doc_id, text), whole texts.

    Texts that are null or empty, or that a tokenizer doesn't spell byte by byte, have no tokens. Repeated rows and rows without an id
    are documents of their own; an empty table gives an empty result; other columns are not read.
    """
    with open(b_file, "rb") as f:
        import sentencepiece

        width = sentencepiece.SentencePieceProcessor(model_proto=f.read()).get_piece_size()
    found = written(aligned(docs, a_file, b_file), "aligned")
    return audited(found, width, head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no tokens: zeros, and an empty string in place of a digest. Repeated rows and rows without an id give a row each and count as documents; ties for the highest count all count; an empty table gives an empty result; other columns are not read."""
    import public_tokenizers as tokenizers

    return align_texts(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
