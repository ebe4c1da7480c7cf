"""SimHash fingerprints, and components of those that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm.common import small_batches, table, written
from clusterlake.operators.components import connected_components

WORDS, SEED, RADIUS = 3, 42, 3
#: Reference fingerprints; distances to them are compared before two fingerprints are.
PIVOTS = 16
#: Shingles whose bits are counted at once.
AT_ONCE = 100_000
#: Rows that a task links at once, whole keys of them, and rows of one key that are dealt out further.
LINKED, HOT = 200_000, 4_096


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The majority of each bit over the hashes of all word shingles, repeats included; 0 for a text with no word."""
    w = text.lower().split()  # bytes: A-Z only, and blanks \\x20 and \\x09-\\x0D
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(w, lambda at, x: at + len(x) + 1, initial=0))
    starts = ends[: max(1, len(w) - words + 1)]
    stops = ends[words:] or ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        h = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of each row; the fingerprint as a signed number. Null and empty texts have fingerprint 0."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x or b"", words) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, about half of all bits apart from each other."""
    return np.random.default_rng(0).integers(0, 2**64, n, np.uint64, endpoint=False)


def least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 the least node reachable over the edges (a, b), going on from earlier labels."""
    p = np.arange(n) if label is None else label
    while True:
        x, y = p[a], p[b]
        if (x == y).all():
            return p
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while not ((q := p[p]) == p).all():
            p = q


def linked(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label of each row: rows of one key whose fingerprints are linked, directly or over others of that key, share one.

    Within a key, rows are ordered by distance to the first pivot, so that only a window of them can be near; of those, the pairs
    whose distances to any other pivot differ by more than radius are discarded, and the rest verified bit by bit.
    """
    n = len(fp)
    far = np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in pivots()], axis=1)
    order = np.lexsort((far[:, 0], key))
    k, f, d = key[order], fp[order], far[order]
    label, near = np.arange(n), np.arange(n)
    shift, edges, held = 1, [], 0
    while len(near):
        near = near[near + shift < n]
        near = near[(k[near] == k[near + shift]) & (d[near + shift, 0] - d[near, 0] <= radius)]
        i = near[label[near] != label[near + shift]]
        i = i[np.abs(d[i] - d[i + shift]).max(axis=1, initial=0) <= radius]
        i = i[np.bitwise_count(f[i] ^ f[i + shift]) <= radius]
        edges.append((i, i + shift))
        held += len(i)
        if held > 4 * n or shift % 64 == 0:
            label, edges, held = least_labels(n, *map(np.concatenate, zip(*edges, strict=True)), label), [], 0
        shift += 1
    if edges:
        label = least_labels(n, *map(np.concatenate, zip(*edges, strict=True)), label)
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def dealt_further(key: np.ndarray, fp: np.ndarray, row: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, row), in which rows of keys with more than HOT of them stand once for each of radius + 1 blocks of the bits, with a key of the block's bits: two rows within the radius still share a key, as at least one block is equal. The bits are dealt to blocks in another way each time, until no key is hot or after three times."""
    for level in range(3):
        _, group, n = np.unique(key, return_inverse=True, return_counts=True)
        hot = n[group] > HOT
        if not hot.any():
            break
        block = np.random.default_rng(level).permutation(64) % (radius + 1)
        parts = [(key[~hot], fp[~hot], row[~hot])]
        for b in range(radius + 1):
            mask = sum(1 << int(i) for i in np.flatnonzero(block == b))
            x = (key[hot].astype(np.uint64) + np.uint64(b + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ (fp[hot] & np.uint64(mask)) * np.uint64(0xC2B2AE3D27D4EB4F)
            parts.append(((x ^ x >> np.uint64(29)).view(np.int64), fp[hot], row[hot]))  # keys that collide cost time, no more
        key, fp, row = map(np.concatenate, zip(*parts, strict=True))
    return key, fp, row


def block_keys(fp: str, radius: int = RADIUS) -> list[Column]:
    """Keys of which two fingerprints within the radius share at least one: one of radius + 1 blocks of the bits, and one of as many blocks of the remaining bits, are equal (pigeonhole)."""
    parts = radius + 1
    width = 64 // parts
    rest_width = (64 - width) // parts
    out = []
    for i in range(parts):
        block = F.shiftrightunsigned(F.col(fp), i * width).bitwiseAND((1 << width) - 1)
        low = F.col(fp).bitwiseAND((1 << (i * width)) - 1)
        high = F.shiftleft(F.shiftrightunsigned(F.col(fp), (i + 1) * width), i * width) if i < parts - 1 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(parts):
            sub = F.shiftrightunsigned(rest, j * rest_width).bitwiseAND((1 << rest_width) - 1)
            out.append(F.shiftleft(F.lit(i * parts + j).cast("long"), width + rest_width).bitwiseOR(F.shiftleft(block, rest_width)).bitwiseOR(sub))
    return out


def near_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp): the least doc_id among those reachable over links of at most radius bits.

    Rows of one fingerprint are reduced to their least doc_id first, whatever their number; these are dealt out by block keys and
    linked on the workers, which send on a star of links for each local component, never all pairs.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    keyed = distinct.where("first is not null").select("fp", "first", F.explode(F.array(*block_keys("fp", radius))).alias("key"))

    def links(fp: np.ndarray, first: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        key, bits, first = dealt_further(key, fp.view(np.uint64), first, radius)
        label = linked(key, bits, radius)
        nodes, at = np.unique(first, return_inverse=True)  # a document may be in several groups of this task
        star = least_labels(len(nodes), at, at[label])
        i = np.flatnonzero(star != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[star[i]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:  # sorted by key
            held.append([b.column(i).to_numpy() for i in range(3)])
            if sum(len(x[0]) for x in held) >= LINKED:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[2], rows[2][-1]))  # the last key may go on
                if cut:
                    yield links(*(x[:cut] for x in rows))
                held = [[x[cut:] for x in rows]]
        if held and len(held[0][0]):
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    components = connected_components(dealt.mapInArrow(run, "a long, b long"))
    of = distinct.join(components.withColumnRenamed("id", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of whole texts; nulls and empty texts share fingerprint zero and are linked like others. Rows without doc_id get no component of their own. Repeated rows stay."""
    out = near_components(written(fingerprints(df, words), "fingerprints"), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, and texts without a word, have fingerprint zero and are linked like others. Repeated rows get a row each; rows without an id get the component of their fingerprint, null where no row of it has an id; an empty table gives an empty result; other columns are not read."""
    return near_duplicates(table(spark, sf_dir, "documents"))
