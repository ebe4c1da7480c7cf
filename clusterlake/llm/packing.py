"""Tokenising documents and packing them into sequences by best-fit decreasing.

Best-fit decreasing looks only at lengths, and pieces of one length are alike; so are open sequences with one remaining capacity.
The plan is therefore made from the histogram of piece lengths (at most MAX_LEN entries, whatever the number of documents): a segment
tree over the remaining capacities finds the tightest class of open sequences in logarithmic time, and a whole run of equal pieces
is placed in it at once. Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tiktoken._tiktoken import CoreBPE
from tokenizers import Tokenizer

from clusterlake.llm.common import small_batches, table, written

MAX_LEN, END_ID = 4096, 1
#: Marks the end of a word for the byte-pair encoder.
END = "\x01"
#: Pieces that one worker keeps with their ids, twice (a full store becomes the older one, from which pieces in use come back); the longest that is kept, the longest that the byte-pair encoder gets, and the text bytes worked on at once.
KEPT, KEPT_BYTES, LONGEST, AT_ONCE = 100_000, 64, 256, 1 << 20
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
_TOKENIZERS: dict = {}


def byte_classes() -> np.ndarray:
    """The class of each byte of a text of blanks and ASCII; what begins a longer character is odd, and so is an apostrophe, which may begin a contraction."""
    c = np.full(256, ODD, np.uint8)
    for b in range(128):
        x = chr(b)
        c[b] = BLANK if x in " \t\n\v\f\r" else LETTER if x.isalpha() else DIGIT if x.isdigit() else MARK if x in string.punctuation and x != "'" else ODD
    return c


class WordTokenizer:
    """ids of texts by a tokenizer file whose matches never hold white space.

    A word is what stands between two blanks; its ids don't depend on what stands around it. Words of Latin-1 letters, digits and ASCII
    marks are cut into the pattern's matches by the classes of their bytes; the distinct matches of many texts go through a byte-pair
    encoder built from the same file. All other words, long ones included, go through the tokenizers library as they are.
    """

    CLASS = byte_classes()

    def __init__(self, content: bytes):
        self.library = Tokenizer.from_str(content.decode())
        model = json.loads(content)
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 - 2 else "<u4")
        # In the byte-level alphabet each byte is one character; printable bytes are themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        # The end of a word is a control character. Ids of single symbols rank first, so a last byte joins its end before anything else.
        ranks, ends = {}, np.zeros(max(vocab.values()) + 2, bool)
        for token, i in vocab.items():
            ended = token.endswith(suffix)
            raw = bytes(byte[c] for c in (token[: -len(suffix)] if ended else token))
            if END.encode() not in raw:
                ranks[raw + END.encode() * ended], ends[i] = i, ended
        ranks[END.encode()] = max(vocab.values()) + 1  # never left over
        self.ends = ends
        last = max(i for raw, i in ranks.items() if len(raw) == 2 and raw[1:] == END.encode())
        self.fast = last < min(i for raw, i in ranks.items() if len(raw) - raw.endswith(END.encode()) > 1)
        self.bpe = CoreBPE(ranks, {}, "[^ ]+")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids_of(self, pieces: list[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of distinct pieces, of those not known yet by encode()."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        out = list(map(self.known.get, pieces))
        lacking = [i for i, x in enumerate(out) if x is None]
        if lacking and self.older:
            for i in lacking:
                out[i] = self.older.get(pieces[i])
        new = [i for i in lacking if out[i] is None]
        if new:
            for i, x in zip(new, encode([pieces[i] for i in new]), strict=True):
                out[i] = x
        for i in lacking:
            if len(pieces[i]) <= KEPT_BYTES:
                self.known[pieces[i]] = out[i]
        return out

    def by_encoder(self, pieces: list[bytes]) -> list[bytes]:
        """Of lower-cased matches of the pattern, all together: the id that ends a word parts them."""
        ids = np.array(self.bpe.encode_ordinary(((END + " ").encode().join(pieces) + END.encode()).decode()), self.dtype)
        raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def by_library(self, words: list[bytes]) -> list[bytes]:
        return [np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, self.dtype).tobytes() for w in words]

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their number for each text) of UTF-8 texts, which are data[offsets[i]:offsets[i + 1]]."""
        n = len(data)
        c = self.CLASS[data]
        # Two bytes from U+00C0 on are a letter, but for the signs of multiplication and division.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        c[lead] = c[lead + 1] = LETTER
        c[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = ODD  # may begin a special token
        first = np.zeros(n + 1, bool)  # of a text
        first[offsets] = True
        cut = first[:n].copy()
        cut[1:] |= (c[1:] != c[:-1]) | (c[1:] == DIGIT)
        start = np.flatnonzero(cut)
        size = np.diff(start, append=n)
        kind = c[start]
        plain = kind != BLANK
        strange = (kind == ODD) | (size > LONGEST) & plain
        begin = end = np.zeros(0, np.int64)
        if strange.any():  # then all of the word is
            new = first[start] | ~plain
            new[1:] |= ~plain[:-1]
            word = np.cumsum(new) - 1
            odd = np.zeros(word[-1] + 1, bool)
            odd[word[strange]] = True
            edge = np.append(start[new], n)
            begin, end = edge[:-1][odd], edge[1:][odd]
            plain &= ~odd[word]
        low = data.copy()
        low[(data >= 0x41) & (data <= 0x5A)] += 0x20
        low[lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)] + 1] += 0x20
        keep = np.repeat(plain, size)
        start, size = start[plain], size[plain]
        at = np.append(0, np.cumsum(size)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(low[keep].tobytes())]).dictionary_encode()
        ids = self.ids_of(found.dictionary.to_pylist(), self.by_encoder if self.fast else self.by_library)
        which = found.indices.to_numpy().astype(np.int64)
        if len(begin):
            raw = data.tobytes()
            words = [raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            number = {w: len(ids) + i for i, w in enumerate(dict.fromkeys(words))}
            # Apart from pieces, which are in lower case: no piece begins with a blank.
            ids += self.ids_of([b" " + w for w in number], lambda x: self.by_library([w[1:] for w in x]))
            which = np.concatenate((which, np.array([number[w] for w in words], np.int64)))
            start = np.concatenate((start, begin))
            order = np.argsort(start, kind="stable")
            start, which = start[order], which[order]
        pool = np.frombuffer(b"".join(ids), self.dtype)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        count = length[which]
        total = np.append(0, np.cumsum(count))
        out = pool[np.arange(total[-1]) + np.repeat((np.cumsum(length) - length)[which] - total[:-1], count)]
        return out, np.diff(total[np.searchsorted(start, offsets)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each of the whole texts. A special token that holds a blank would not survive the cut; there are none such."""
        raw = [t.encode() for t in texts]
        ids, n = self.batch(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64))
        return np.split(ids.astype("<u4"), np.cumsum(n)[:-1]) if raw else []


def word_tokenizer(content: bytes) -> WordTokenizer:
    key = zlib.crc32(content)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(content)
    return _TOKENIZERS[key]


def parts_of(texts: pa.Array, size: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts as (UTF-8 bytes, offsets), about size bytes at a time; a null is an empty text."""
    t = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8)
    data = np.frombuffer(t.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def tokenized_pieces(df: DataFrame, tokenizer_file: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and part and nth, which give a piece its place among those of its length that its task made.

    A null or empty text has the end id only. Documents longer than max_len ids are cut into pieces of max_len.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer_file, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = word_tokenizer(content.value), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for b in batches:
            docs, rows, nth_doc = b.column(0).to_pylist(), [], 0
            for data, offsets in parts_of(b.column(1)):
                ids, n = t.batch(data, offsets)
                stop = np.cumsum(n + 1)
                every = np.full(len(ids) + len(n), end_id, "<u4")
                ended = np.zeros(len(every), bool)
                ended[stop - 1] = True
                every[~ended] = ids
                raw = every.tobytes()
                for end, size in zip(stop.tolist(), (n + 1).tolist(), strict=True):
                    for piece, at in enumerate(range(0, size, max_len)):
                        k = min(max_len, size - at)
                        i = end - size + at
                        rows.append((docs[nth_doc], piece, at, k, zlib.crc32(raw[4 * i : 4 * (i + k)]), part, int(seen[k])))
                        seen[k] += 1
                    nth_doc += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].alias("text")).mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which have an open sequence, and which is the least of at least n."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            value = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == value:
                break
            self.any[i] = value

    def tightest(self, n: int) -> int:
        """The least marked capacity of at least n, or -1."""
        i = n + self.leaves
        if self.any[i]:
            return n
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def best_fit_plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> np.ndarray:
    """Runs (length, rank of the first piece, pieces, pieces a sequence, first sequence, offset of the first), by length and rank.

    The same packing as best-fit decreasing piece by piece: the tightest sequence is filled with equal pieces until no more fit, as
    after each it is the tightest still. Open sequences are kept as ranges of consecutive numbers.
    """
    tree = CapacityTree(max_len)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(max_len + 1)]  # by capacity: (first sequence, how many)
    runs, fresh = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                each = max_len // length
                first, n, capacity = fresh, -(-left // each), max_len
                fresh += n
            else:
                each = capacity // length
                first, n = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, max_len - capacity))
                add(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than fill a sequence
                runs.append((length, rank, left, left, first + full, max_len - capacity))
                add(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(capacity, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces (with length, part and nth). Sequences are gapless from 0; none is longer than max_len.

    Collected: the histogram of lengths, max_len rows at most. Sent to the tasks: the plan, whose ranges are bounded by max_len too.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(histogram, max_len))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # One row for each length and task: a length that a third of all pieces have is still spread over all tasks.
    ranges = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        keys = (p[:, 0] << 44) + p[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("nth").to_numpy() + b.column("before").to_numpy()
            r = p[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(p) else p
            k = rank - r[:, 1]
            new = {"sequence_id": r[:, 4] + k // r[:, 3], "offset": r[:, 5] + k % r[:, 3] * length}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(v, pa.int64()) for v in new.values())], names=[*kept, *new])

    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    rows = pieces.join(ranges, ["part", "length"]).select(*kept, "nth", "before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept).schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, max_len: int = MAX_LEN) -> DataFrame:
    """Tokenises and packs whole documents; see tokenized_pieces and pack. An empty table gives an empty result; repeated rows are packed each; other columns are not read."""
    return pack(written(tokenized_pieces(docs, tokenizer_file, max_len), "pieces"), max_len)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id only. Pieces of equal length are placed in the order of tasks and rows; repeated rows and rows without an id are packed each; an empty table gives an empty result; other columns are not read."""
    import public_tokenizers as tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))
