"""Exact removal of repeated passages: every byte covered by a string of MIN_LEN bytes that also starts earlier.

The suffixes to compare are dealt out so that equal strings meet. Each string of MIN_LEN bytes has one anchor: the GRAM bytes in it
with the least hash, the leftmost of equals; it is a function of the string alone. The strings that share an anchor form a context,
at most 2 * MIN_LEN bytes around it. Contexts are dealt out by their anchor's hash; an anchor that occurs once can't repeat and goes no
further. The suffixes of all other contexts go to the index family of their bucket, in the order of documents: each batch gets a suffix
array (suffixes are as long as the strings compared), is merge-scanned against the levels that earlier batches left, and becomes a
level; levels of about equal size merge, so that there are few. The family alone decides what repeats, byte by byte. Only copies of a
context within one task's documents are left out before, after their bytes were compared, so that hot passages don't pile up.

Anchors that are frequent all over are known from a sample of documents (SAMPLE of them, by the hash of their ids, whatever the size of
the corpus); their strings are dealt out by the place of the anchor in the string and the hash of most of the string, in place of meeting
at their anchor. The sample decides only which way a string goes, never whether it is compared.

A string starts earlier if its doc_id is smaller or, of one doc_id, its start is. Rows that share a doc_id are told apart by a version
of it; a string never covers one at the same doc_id and start, so that repeated rows leave each other whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm.common import partitions, small_batches, table, written

MIN_LEN, GRAM = 100, 32
#: Bytes hashed at once, anchors that a task holds before it sends them on, suffixes in a batch of the index.
CHUNK, HELD, BATCH = 1 << 20, 300_000, 1 << 17
#: An anchor with HOT different contexts among SAMPLE documents or so is hot; its strings are dealt out together for PLACES starts.
HOT, SAMPLE, PLACES = 16, 8192, 16
#: Strings whose suffixes are compared together: contexts of different anchors have none in common.
TOGETHER = 200_000
#: Bytes of input for each bucket.
BUCKET_BYTES = 4 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BASE = 0xC6BC279692B5CC83 | 1
_VALUES = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)

ANCHOR = [("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("v", "<i8"), ("s", "<u4"), ("n", "u1"), ("rel", "u1")]
COVER = [("doc", "<i8"), ("v", "<i8"), ("s", "<u4"), ("e", "<u4")]
CONTEXT = [("h", "<u8"), ("doc", "<i8"), ("v", "<i8"), ("s", "<u4"), ("n", "u1"), ("rel", "u1")]


def packed(kind: list, rows: dict[str, np.ndarray], at: np.ndarray | slice = slice(None)) -> bytes:
    """Columns one after the other, which compresses better than rows."""
    return b"".join(rows[n][at].astype(t).tobytes() for n, t in kind)


def unpacked(kind: list, blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in kind)
    out: dict[str, list] = {n: [] for n, _ in kind}
    for b in blobs:
        n, at = len(b) // width, 0
        for name, t in kind:
            out[name].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(out[n]) if blobs else np.zeros(0, t) for n, t in kind}


def spread(doc: np.ndarray, n: int) -> np.ndarray:
    """pmod(hash(doc), n) as Spark computes it: Murmur3 of a long, seed 42."""
    x = doc.astype(np.int64).view(np.uint64)
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    h = np.full(len(x), 42, np.uint32)
    for k in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        k = turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % n


def by_bucket(kind: list, rows: dict[str, np.ndarray], bucket: np.ndarray, label: int) -> pa.RecordBatch:
    """One row (kind, bucket, data) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    sorted_ = {n: v[order] for n, v in rows.items()}
    out = [(label, int(b[i]), packed(kind, sorted_, slice(i, j))) for i, j in stretches(b)]
    return record_batch(out, {"kind": pa.int32(), "bucket": pa.int32(), "data": pa.binary()})


def stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True) if len(x) else ()


def record_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


ROWS = "kind int, bucket int, data binary"
ANCHORS, COVERS, COMPARE = 0, 1, 2
#: The bucket of covers that aren't sorted by document yet, and bytes of them that a task holds.
UNSORTED, COVERS_HELD = -1, 16 << 20


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (32) bytes from each place on."""
    x = b.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] << np.uint64(8 * n) | x[n:]
    for n, m in ((8, _M[0]), (16, _M[1])):
        x = (x ^ x >> np.uint64(29)) * m
        x = x[:-n] * _M[2] + x[n:]
    x = (x ^ x >> np.uint64(32)) * _M[3]
    return x ^ x >> np.uint64(32)


class Hashes:
    """Hashes of any range of a byte array, by sums of powers; the same for equal bytes wherever they stand."""

    powers = None

    def __init__(self, b: np.ndarray):
        if Hashes.powers is None or len(Hashes.powers[0]) <= len(b):
            n = max(len(b) + 1, CHUNK + MIN_LEN + 1)
            inverse = pow(_BASE, -1, 2**64)
            Hashes.powers = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (np.uint64(_BASE), np.uint64(inverse)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[b] * Hashes.powers[0][: len(b)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * Hashes.powers[1][start]
        x = (x ^ x >> np.uint64(31)) * _M[1]
        return x ^ x >> np.uint64(33)


def contexts(docs: list[tuple[int, bytes]], min_len: int = MIN_LEN, versions: list[int] | None = None) -> dict[str, np.ndarray]:
    """ANCHOR rows of documents, whose versions are 0 if not given: of each anchor, its hash h, the hash c of its context, the first start s of its n strings, and how far after s it is."""
    out: dict[str, list] = {n: [] for n, _ in ANCHOR}

    def add(ids: np.ndarray, vs: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, b: np.ndarray) -> None:
        """ids, versions, sizes and the place of their first byte in its document, of parts that follow each other in b."""
        begin = np.cumsum(sizes) - sizes
        fits = sizes >= min_len
        if not fits.any():
            return
        h = gram_hashes(b)
        w = min_len - GRAM + 1
        least = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        count = np.where(fits, sizes - min_len + 1, 0)
        start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())  # all starts of strings that don't leave their part
        a = anchor[start]
        first = np.flatnonzero(np.concatenate(([True], np.diff(a) != 0)))
        n = np.diff(np.concatenate((first, [len(a)])))
        a, s = a[first], start[first]
        part = np.searchsorted(begin, s, "right") - 1
        c = Hashes(b).of(s, s + n + min_len - 1) + (a - s).astype(np.uint64) * _M[0] + n.astype(np.uint64) * _M[2]
        rows = {"h": h[a], "c": c, "doc": ids[part], "v": vs[part], "s": s - begin[part] + offsets[part], "n": n, "rel": a - s}
        for k, v in rows.items():
            out[k].append(v)

    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            ids, vs, offsets = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3])
            add(ids, vs, np.array([len(x) for *_, x in held]), offsets, np.frombuffer(b"".join(x for *_, x in held), np.uint8))
        held, size = [], 0

    for (doc, text), v in zip(docs, versions or [0] * len(docs), strict=True):
        for at in range(0, max(0, len(text) - min_len + 1), CHUNK):  # parts overlap, so that each string is whole in one
            part = text[at : at + CHUNK + min_len - 1]
            if size + len(part) > CHUNK + min_len:
                flush()
            held.append((doc, v, at, part))
            size += len(part)
    flush()
    return {n: np.concatenate(out[n]).astype(t) if out[n] else np.zeros(0, t) for n, t in ANCHOR}


def first_of_equal(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by anchor, context, document and start; in that order, whether a row is a first of its anchor and context (none has a smaller document or start), and which row is one.

    Of rows that are equal in all, the order has one. Rows that differ in the version alone are firsts together.
    """
    order = np.lexsort((rows["v"], rows["s"], rows["doc"], rows["c"], rows["h"]))
    new = lambda *names: np.concatenate(([True], np.logical_or.reduce([(x := rows[n][order])[1:] != x[:-1] for n in names])))[: len(order)]
    order = order[new("h", "c", "doc", "s", "v")]
    begin = np.flatnonzero(new("h", "c"))
    of = np.repeat(order[begin], np.diff(np.concatenate((begin, [len(order)]))))
    return order, (rows["doc"][order] == rows["doc"][of]) & (rows["s"][order] == rows["s"][of]), of


def same_bytes(data: bytes, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[x:x + size] and data[y:y + size] are equal, for each of x, y and size. Parts that overlap and go on alike are compared as one."""
    out = np.ones(len(x), bool)
    order = np.argsort(x, kind="stable")
    x, y, end = x[order], y[order], (x + size)[order]
    cut = np.concatenate(([True], (x[1:] - y[1:] != x[:-1] - y[:-1]) | (x[1:] > end[:-1])))[: len(x)]
    for i, j in stretches(np.cumsum(cut)):
        p, q, stop = int(x[i]), int(y[i]), int(end[j - 1])
        if data[p:stop] != data[q : q + stop - p]:
            for k in range(i, j):
                out[order[k]] = data[x[k] : end[k]] == data[y[k] : y[k] + end[k] - x[k]]
    return out


def covers(rows: dict[str, np.ndarray], at: np.ndarray, min_len: int) -> dict[str, np.ndarray]:
    s = rows["s"][at].astype(np.int64)
    return {"doc": rows["doc"][at], "v": rows["v"][at], "s": s, "e": s + rows["n"][at] + (min_len - 1)}


def combined(rows: dict[str, np.ndarray], texts: list[bytes], min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that go on, and rows whose context has the bytes of an earlier one of these texts. rows have the text's number in `text`."""
    order, first, of = first_of_equal(rows)
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1].astype(np.int64)
    place = begin[rows["text"]] + rows["s"]
    x, y = order[~first], of[~first]
    same = same_bytes(b"".join(texts), place[x], place[y], rows["n"][x].astype(np.int64) + (min_len - 1))
    return np.sort(np.concatenate((order[first], x[~same]))), np.sort(x[same])


def find_anchors(docs: DataFrame, hot: np.ndarray, buckets: int, doc_buckets: int, min_len: int) -> DataFrame:
    """ANCHORS rows by anchor, and COVERS rows and the COMPARE rows of hot anchors by document, of (doc_id, version, data binary). What repeats within one task's documents is combined there."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        texts: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = {n: np.concatenate([x[n] for x in held]) for n in held[0]}
            keep, again = combined(rows, texts, min_len)
            is_hot = np.isin(rows["h"][keep], sent.value)
            few = {n: rows[n][keep[~is_hot]] for n, _ in ANCHOR}
            yield by_bucket(ANCHOR, few, (few["h"] % np.uint64(buckets)).astype(np.int64), ANCHORS)
            if is_hot.any():
                many = {n: rows[n][keep[is_hot]] for n, _ in CONTEXT}
                yield by_bucket(CONTEXT, many, spread(many["doc"], doc_buckets), COMPARE)
            gone = covers(rows, again, min_len)
            yield by_bucket(COVER, gone, spread(gone["doc"], doc_buckets), COVERS)

        for ids, vs, some in long_texts(batches, min_len):
            rows = contexts(list(enumerate(some)), min_len)
            held.append(rows | {"doc": ids[rows["doc"]], "v": vs[rows["doc"]], "text": rows["doc"] + len(texts)})
            texts += some
            if sum(len(x["h"]) for x in held) >= HELD:
                yield from flush()
                held, texts = [], []
        if held:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def long_texts(batches: Iterator[pa.RecordBatch], min_len: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, versions, texts) of each batch's documents that have an id and at least min_len bytes."""
    for b in batches:
        some = [(d, v, t) for d, v, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if d is not None and t is not None and len(t) >= min_len]
        if some:
            ids, vs, texts = zip(*some, strict=True)
            yield np.array(ids, np.int64), np.array(vs, np.int64), list(texts)


def hot_anchors(docs: DataFrame, min_len: int) -> np.ndarray:
    """Sorted hashes of anchors with HOT different contexts in the sample: at most SAMPLE documents' anchors over HOT."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in long_texts(batches, min_len):
            rows = contexts(list(enumerate(texts)), min_len)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].view(np.int64)) for c in ("h", "c")], names=["h", "c"])

    small_batches(docs.sparkSession)
    hot = sample.mapInArrow(run, "h long, c long").distinct().groupBy("h").count().where(F.col("count") >= HOT).select("h").toArrow()
    return np.sort(hot.column("h").to_numpy().astype(np.int64).view(np.uint64))


def meet(anchors: DataFrame, doc_buckets: int) -> DataFrame:
    """COMPARE rows, by document, of the anchors that have several contexts; rows that are by document already go along, apart from the rest, to reach the same table."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() != ANCHORS:
            return t.select(["kind", "bucket", "data"])
        rows = unpacked(ANCHOR, t.column("data").to_pylist())
        _, group, n = np.unique(rows["h"], return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[group] > 1)
        some = {n: rows[n][at] for n, _ in CONTEXT}
        return pa.Table.from_batches([by_bucket(CONTEXT, some, spread(some["doc"], doc_buckets), COMPARE)])

    key = F.when(F.col("kind") == ANCHORS, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    return anchors.withColumn("key", key).groupBy("key").applyInArrow(lambda t: run(t), ROWS)


def with_texts(docs: DataFrame, rows: DataFrame, doc_buckets: int, each: Callable, schema: str) -> DataFrame:
    """Hands each bucket's documents, as a table, and the data of rows to each()."""
    keyed = docs.withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(doc_buckets)))

    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        return each(texts, found.column("data").to_pylist())

    return keyed.groupBy("bucket").cogroup(rows.select("bucket", "data").groupBy("bucket")).applyInArrow(run, schema)


def by_place(rows: dict[str, np.ndarray], body: list[bytes], min_len: int) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Contexts as rows of at most PLACES strings each, whose anchor is low .. low + PLACES - 1 bytes after their start, by low and the hash of the bytes that all such strings have. Equal strings have their anchor at the same place, so that they meet."""
    size = np.array([len(x) for x in body], np.int64)
    begin = np.cumsum(size) - size
    joined = b"".join(body)
    hashes = Hashes(np.frombuffer(joined, np.uint8))
    first, n, rel = (rows[c].astype(np.int64) for c in ("s", "n", "rel"))
    out: dict[str, list] = {c: [] for c, _ in CONTEXT}
    parts: list[bytes] = []
    for low in range(0, min_len, PLACES):
        s0 = np.maximum(0, rel - (low + PLACES - 1))  # starts, from the context's first on
        s1 = np.minimum(n - 1, rel - low)
        ok = np.flatnonzero(s0 <= s1)
        common = begin[ok] + rel[ok] - low
        h = hashes.of(common, common + min_len - (PLACES - 1)) + np.uint64((low + 1) * int(_M[1]) & 2**64 - 1)
        new = {"h": h, "doc": rows["doc"][ok], "v": rows["v"][ok], "s": first[ok] + s0[ok], "n": (s1 - s0 + 1)[ok], "rel": (rel - s0)[ok]}
        for c, x in new.items():
            out[c].append(x)
        parts += [joined[i:j] for i, j in zip((begin + s0)[ok].tolist(), (begin + s1 + min_len)[ok].tolist(), strict=True)]
    return {c: np.concatenate(out[c]).astype(t) for c, t in CONTEXT}, parts


def gather(docs: DataFrame, compare: DataFrame, hot: np.ndarray, buckets: int, doc_buckets: int, min_len: int) -> DataFrame:
    """COMPARE rows by anchor, with the bytes of contexts, and COVERS rows by document of contexts whose bytes an earlier one of the same bucket of documents has."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def bodies(rows: dict[str, np.ndarray], text: dict) -> list[bytes]:
        return [text[d, v][a : a + n + min_len - 1] for d, v, a, n in zip(*(rows[c].tolist() for c in ("doc", "v", "s", "n")), strict=True)]

    def each(texts: pa.Table, data: list[bytes]) -> pa.Table:
        rows = unpacked(CONTEXT, data)
        text = {(d, v): t for d, v, t in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "version", "data")), strict=True) if d is not None and t is not None}
        is_hot = np.isin(rows["h"], sent.value)
        body = bodies(rows, text)
        if is_hot.any():
            i = np.flatnonzero(is_hot).tolist()
            more, strings = by_place({n: rows[n][is_hot] for n, _ in CONTEXT}, [body[k] for k in i], min_len)
            body = [body[k] for k in np.flatnonzero(~is_hot).tolist()] + strings
            rows = {n: np.concatenate((rows[n][~is_hot], more[n])).astype(t) for n, t in CONTEXT}
        order = np.lexsort((rows["v"], rows["s"], rows["doc"]))
        first: dict[tuple, tuple] = {}
        keep, again = [], []
        for k, h, rel, d, s in zip(order.tolist(), *(rows[c][order].tolist() for c in ("h", "rel", "doc", "s")), strict=True):
            (keep if first.setdefault((h, rel, body[k]), (d, s)) == (d, s) else again).append(k)
        keep = np.array(keep, np.int64)
        bucket = (rows["h"][keep] % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        keep, bucket = keep[by], bucket[by]
        out = [(COMPARE, int(bucket[i]), packed(CONTEXT, rows, keep[i:j]), b"".join(body[k] for k in keep[i:j].tolist())) for i, j in stretches(bucket)]
        gone = covers(rows, np.array(again, np.int64), min_len)
        if len(again):
            out.append((COVERS, int(spread(gone["doc"][:1], doc_buckets)[0]), packed(COVER, gone), None))
        return pa.Table.from_batches([record_batch(out, {"kind": pa.int32(), "bucket": pa.int32(), "data": pa.binary(), "body": pa.binary()})])

    return with_texts(docs, compare, doc_buckets, each, ROWS + ", body binary")


class IndexFamily:
    """Suffix arrays of what came so far, the largest first; each at most half as large as the one before it, so that there are few."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    @staticmethod
    def equal(x: np.ndarray) -> np.ndarray:
        """Whether each but the first is equal to its predecessor."""
        b = x.view(np.uint8).reshape(len(x), x.itemsize)
        some = np.flatnonzero((b[1:, :8] == b[:-1, :8]).all(1))
        out = np.zeros(max(0, len(x) - 1), bool)
        out[some] = (b[some + 1] == b[some]).all(1)
        return out

    def add(self, suffixes: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Whether each suffix (in the order of documents) is equal to an earlier one, of this batch or before. Suffixes of one place, if places are given, aren't earlier than each other."""
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        array = suffixes[order]
        same = np.concatenate(([False], self.equal(array)))[: len(array)]
        group = np.cumsum(~same) - 1
        if place is not None:
            first = order[~same]
            again = place[order] != place[first][group]
        else:
            again = same
        array = array[~same]
        known = np.zeros(len(array), bool)
        for level in self.levels:
            both = np.concatenate((level, array))
            o = np.argsort(both, kind="stable")  # a merge: both parts are sorted
            known[o[1:][self.equal(both[o])] - len(level)] = True
        new = array[~known]
        while self.levels and len(self.levels[-1]) < 2 * len(new):
            new = np.sort(np.concatenate((self.levels.pop(), new)), kind="stable")
        if len(new):
            self.levels.append(new)
        out = np.empty(len(suffixes), bool)
        out[order] = again | known[group]
        return out


def overlapping(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether one of the n starts from s on, in an order by document and s, is at or before one of an earlier row of the same document."""
    if not len(doc):
        return np.zeros(0, bool)
    rank = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) << 33
    end = np.maximum.accumulate(rank + s + n)
    return np.concatenate(([False], (rank + s)[1:] < end[:-1]))


def whole_contexts(rows: dict[str, np.ndarray], body: np.ndarray, begin: np.ndarray, order: np.ndarray, min_len: int) -> np.ndarray:
    """Of rows in an order by document and start, whether their whole context is equal to an earlier one, by an index family of contexts."""
    size = rows["n"].astype(np.int64) + (min_len - 1)
    width = int(size.max(initial=0)) + 2
    place = np.cumsum(np.concatenate(([True], (np.diff(rows["doc"][order]) != 0) | (np.diff(rows["s"][order].astype(np.int64)) != 0)))[: len(order)])
    index, out = IndexFamily(), np.zeros(len(order), bool)
    i = 0
    while i < len(order):
        j = int(np.searchsorted(place, place[min(len(order), i + BATCH // 64 + 1) - 1], "right"))  # versions of a place in one batch
        at = order[i:j]
        n = size[at]
        row = np.repeat(np.arange(len(at)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.zeros((len(at), width), np.uint8)
        text[row, within] = body[np.repeat(begin[at], n) + within]
        text[:, -2], text[:, -1] = rows["rel"][at] + 1, rows["n"][at]  # neither is 0
        out[i:j] = index.add(text.view(f"S{width}").ravel(), place[i:j])
        i = j
    return out


def repeated(data: list[bytes], bodies: list[bytes], min_len: int) -> dict[str, np.ndarray]:
    """COVER rows of the contexts of one bucket, those of TOGETHER strings or so at a time."""
    rows = unpacked(CONTEXT, data)
    body = np.frombuffer(b"".join(bodies), np.uint8)
    size = rows["n"].astype(np.int64) + (min_len - 1)
    begin = np.cumsum(size) - size
    parts = 1 + int(rows["n"].sum(dtype=np.int64)) // TOGETHER
    part = ((rows["h"] * _M[0]) >> np.uint64(40)) % np.uint64(parts)
    out = [repeated_in(rows, body, begin, np.flatnonzero(part == k), min_len) for k in range(parts)]
    return {c: np.concatenate([x[c] for x in out]) for c in ("doc", "v", "s", "e")}


def repeated_in(rows: dict[str, np.ndarray], body: np.ndarray, begin: np.ndarray, some: np.ndarray, min_len: int) -> dict[str, np.ndarray]:
    """Of some rows, contexts that are equal to an earlier one as a whole, and what is repeated of all others."""
    order = some[np.lexsort((rows["s"][some], rows["doc"][some]))]
    copy = whole_contexts(rows, body, begin, order, min_len)
    gone = covers(rows, order[copy], min_len)
    out = [tuple(gone[c] for c in ("doc", "v", "s", "e"))]
    order = order[~copy]
    n = rows["n"].astype(np.int64)
    index = IndexFamily()
    done = np.cumsum(n[order])
    over = overlapping(rows["doc"][order], rows["s"][order].astype(np.int64), n[order])
    whole = np.flatnonzero(~over)  # where a batch may begin
    i = 0
    while i < len(order):
        full = np.searchsorted(done, (done[i - 1] if i else 0) + BATCH) + 1
        after = np.searchsorted(whole, full)
        j = int(whole[after]) if after < len(whole) else len(order)
        at = order[i:j]
        i = j
        count = n[at]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(begin[at], count) + within
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, min_len)[start]).view(f"S{min_len}").ravel()
        if not over[j - len(at) : j].any():
            hit = np.flatnonzero(index.add(suffixes))
        else:  # versions of a document
            doc, s = np.repeat(rows["doc"][at], count), np.repeat(rows["s"][at].astype(np.int64), count) + within
            by = np.lexsort((s, doc))
            doc, s = doc[by], s[by]
            place = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]))))
            hit = np.sort(by[index.add(suffixes[by], place)])
        if not len(hit):
            continue
        context = np.repeat(np.arange(len(at)), count)[hit]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(context) != 0))))
        last = np.concatenate((cut[1:], [len(hit)])) - 1
        c = at[context[cut]]
        out.append((rows["doc"][c], rows["v"][c], rows["s"][c] + within[hit[cut]], rows["s"][c] + within[hit[last]] + min_len))
    return dict(zip(("doc", "v", "s", "e"), map(np.concatenate, zip(*out, strict=True)), strict=True))


def bucket_count(docs: DataFrame) -> int:
    """So many that a bucket's share of the input is BUCKET_BYTES at most, by the size of the files that docs are read from; one for each shuffle partition at least. Not more, since each bucket of documents sends a row to each of anchors."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES) if size < 1 << 52 else 0)  # more: not known


def removed(docs: DataFrame, n: int, min_len: int = MIN_LEN) -> DataFrame:
    """COVERS rows (bucket, data) of (doc_id, version, data binary), in n buckets of documents."""
    hot = hot_anchors(docs, min_len)
    found = written(meet(find_anchors(docs, hot, n, n, min_len), n), "contexts")
    contexts_ = gather(docs, found.where(F.col("kind") == COMPARE), hot, n, n, min_len)

    def run(t: pa.Table) -> pa.Table:
        passed = [(COVERS, b, d) for k, b, d in zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True) if k == COVERS]
        if passed:
            return pa.Table.from_batches([record_batch(passed, {"kind": pa.int32(), "bucket": pa.int32(), "data": pa.binary()})])
        rows = repeated(t.column("data").to_pylist(), t.column("body").to_pylist(), min_len)
        return pa.Table.from_batches([record_batch([(COVERS, UNSORTED, packed(COVER, rows))] if len(rows["doc"]) else [], {"kind": pa.int32(), "bucket": pa.int32(), "data": pa.binary()})])

    # What is found covered already goes along, apart from the rest, to reach the same table.
    key = F.when(F.col("kind") == COMPARE, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    more = written(contexts_.withColumn("key", key).groupBy("key").applyInArrow(lambda t: run(t), ROWS), "repeats")
    sorted_ = more.where(F.col("bucket") != UNSORTED).unionByName(more.where(F.col("bucket") == UNSORTED).mapInArrow(by_document(n), ROWS))
    return found.where(F.col("kind") == COVERS).unionByName(sorted_).select("bucket", "data")


def by_document(n: int) -> Callable:
    """Deals rows of covers of any documents out to the buckets of these; what a task reads goes there together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = unpacked(COVER, held)
            return by_bucket(COVER, rows, spread(rows["doc"], n), COVERS)

        for b in batches:
            for data in b.column(2).to_pylist():
                held.append(data)
                size += len(data)
                if size > COVERS_HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def kept_parts(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of data without the sorted or unsorted, overlapping runs; the bytes removed; and the maximal runs removed."""
    left, at, spans, end = [], 0, 0, -1
    for s, e in sorted(runs):
        e = min(e, len(data))
        if s >= e:
            continue
        spans += s > end
        if s > at:
            left.append(data[at:s])
        at, end = max(at, e), max(end, e)
    left.append(data[at:])
    kept = b"".join(left)
    return kept, len(data) - len(kept), spans


def deduplicated(docs: DataFrame, text_col: Column, keep: list[Column | str], each: Callable, schema: str, min_len: int = MIN_LEN, family=None) -> DataFrame:
    """each(row of the columns to keep, kept bytes, number of bytes, removed, spans) for each row; a null text counts as empty. What the columns are called doesn't matter.

    With a family (see suffix_levels.StoredFamily), what documents added to it before have is removed as well; docs are then added to it.
    """
    row = F.struct(*keep)
    data = docs.select(row.alias("row"), F.coalesce(text_col.cast("binary"), F.lit(b"")).alias("data"), F.col("doc_id").cast("long").alias("doc_id"))
    #: Ids of several rows, whose texts are told apart; all others have version 0, which costs nothing to send.
    shared = written(data.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared")), "shared")
    version = F.when(F.col("shared"), F.xxhash64("data")).otherwise(F.lit(0).cast("long"))
    data = data.join(shared, "doc_id", "left").select("row", "data", "doc_id", version.alias("version"))
    n = bucket_count(docs)
    plain = data.select("doc_id", "version", "data")
    runs = removed(plain, n, min_len)
    if family is not None:
        runs = runs.unionByName(family.seen(plain, n))
        family.add(plain)

    def bucket(texts: pa.Table, blobs: list[bytes]) -> pa.Table:
        rows = unpacked(COVER, blobs)
        order = np.lexsort((rows["s"], rows["v"], rows["doc"]))
        found: dict[tuple[int, int], list] = {}
        for d, v, s, e in zip(*(rows[c][order].tolist() for c in ("doc", "v", "s", "e")), strict=True):
            of = found.setdefault((d, v), [])
            if of and s <= of[-1][1]:
                if e > of[-1][1]:
                    of[-1] = (of[-1][0], e)
            else:
                of.append((s, e))
        out = []
        for x in texts.to_pylist():
            kept, gone, spans = kept_parts(x["data"], found.get((x["doc_id"], x["version"]), []))
            out.append(each(x["row"], kept, len(x["data"]), gone, spans))
        return pa.Table.from_pylist(out, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return with_texts(data, runs, n, bucket, schema)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty. Documents without an id neither lose bytes nor make others lose any; repeated rows lose the same bytes, none for each other's sake; of rows that share an id but not the text, the later start of a string goes."""

    def each(row: dict, kept: bytes, n: int, gone: int, spans: int) -> dict:
        return {"doc_id": row["doc_id"], "n_bytes": n, "n_removed": gone, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, F.col("text"), ["doc_id"], each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
