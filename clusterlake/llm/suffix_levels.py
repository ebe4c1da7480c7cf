"""A family of suffix indexes that outlives a corpus: levels are tables, which batches of documents to come are merge-scanned against.

A level holds the contexts of its batches' documents (see suffixes) with their bytes, dealt to buckets by anchor. A new batch becomes a
level of its own; then, while the last level is at least half as large as the one before it, the two are merged, so that there are few
levels, and each context is written anew a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm import suffixes as S
from clusterlake.llm.common import small_batches, written
from clusterlake.plans.scratch import remove

LEVEL = "bucket int, data binary, body binary"
#: Contexts of a level come before those of any document: their ids begin here.
BEFORE = -(1 << 62)


def all_contexts(docs: DataFrame, buckets: int, min_len: int) -> DataFrame:
    """LEVEL rows of all contexts of (doc_id, version, data binary); copies within a task once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vs, texts in S.long_texts(batches, min_len):
            rows = S.contexts(list(enumerate(texts)), min_len)
            rows = rows | {"text": rows["doc"], "doc": ids[rows["doc"]], "v": vs[rows["doc"]]}
            keep, _ = S.combined(rows, texts, min_len)
            bucket = (rows["h"][keep] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keep, bucket = keep[order], bucket[order]
            out = []
            for i, j in S.stretches(bucket):
                at = keep[i:j]
                body = b"".join(texts[t][s : s + n + min_len - 1] for t, s, n in zip(*(rows[c][at].tolist() for c in ("text", "s", "n")), strict=True))
                out.append((int(bucket[i]), S.packed(S.CONTEXT, rows, at), body))
            yield S.record_batch(out, {"bucket": pa.int32(), "data": pa.binary(), "body": pa.binary()})

    return docs.mapInArrow(run, LEVEL)


def chosen(rows: dict[str, np.ndarray], bodies: list[bytes], h: np.ndarray, min_len: int) -> tuple[dict[str, np.ndarray], bytes]:
    """Rows with one of the anchors h, and their bytes."""
    size = rows["n"].astype(np.int64) + (min_len - 1)
    begin = np.cumsum(size) - size
    at = np.flatnonzero(np.isin(rows["h"], h))
    body = b"".join(bodies)
    return {n: v[at] for n, v in rows.items()}, b"".join(body[i : i + k] for i, k in zip(begin[at].tolist(), size[at].tolist(), strict=True))


class StoredFamily:
    """Levels below a folder that driver and executors share. levels.json names them, with their contexts, and is replaced as a whole, so that an add() that is cut off leaves the family as it was."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, min_len: int = S.MIN_LEN):
        self.spark, self.folder = spark, folder.rstrip("/")
        state = self._read()
        if state is None:
            state = {"buckets": buckets or S.partitions(spark), "min_len": min_len, "levels": []}
        elif buckets not in (None, state["buckets"]) or min_len != state["min_len"]:
            raise ValueError("the levels were made with other buckets or another length")
        self.state = state

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self) -> dict | None:
        if not self._fs().exists(self._path("levels.json")):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/levels.json").collect()))

    def _write(self) -> None:
        fs, new = self._fs(), self._path(f"levels-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.delete(self._path("levels.json"), False)
        fs.rename(new, self._path("levels.json"))

    def level(self, name: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.folder}/{name}")

    def _save(self, rows: DataFrame) -> dict:
        name = f"level-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        width = sum(np.dtype(t).itemsize for _, t in S.CONTEXT)
        n = self.level(name).agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("n")).first()["n"] // width
        return {"name": name, "contexts": n}

    def seen(self, docs: DataFrame, doc_buckets: int) -> DataFrame:
        """COVERS rows (bucket, data) of what (doc_id, version, data binary) repeats of documents added before."""
        min_len, buckets = self.state["min_len"], self.state["buckets"]
        none = self.spark.createDataFrame([], "bucket int, data binary")
        if not self.state["levels"]:
            return none
        new = written(all_contexts(docs, buckets, min_len), "batch")

        def scan(key, fresh: pa.Table, old: pa.Table) -> pa.Table:
            a, b = (S.unpacked(S.CONTEXT, t.column("data").to_pylist()) for t in (fresh, old))
            common = np.intersect1d(a["h"], b["h"])
            a, body_a = chosen(a, fresh.column("body").to_pylist(), common, min_len)
            b, body_b = chosen(b, old.column("body").to_pylist(), common, min_len)
            b["doc"] = BEFORE + np.arange(len(b["h"]))
            found = S.repeated([S.packed(S.CONTEXT, b), S.packed(S.CONTEXT, a)], [body_b, body_a], min_len)
            late = {n: v[found["doc"] >= BEFORE + len(b["h"])] for n, v in found.items()}
            return pa.Table.from_batches([S.by_bucket(S.COVER, late, S.spread(late["doc"], doc_buckets), S.COVERS)]).select(["bucket", "data"])

        out = none
        for level in self.state["levels"]:
            met = new.groupBy("bucket").cogroup(self.level(level["name"]).groupBy("bucket")).applyInArrow(scan, "bucket int, data binary")
            out = out.unionByName(written(met, "seen"))
        return out

    def add(self, docs: DataFrame) -> None:
        """Makes a level of (doc_id, version, data binary), and merges levels of about equal size."""
        levels, gone = [*self.state["levels"], self._save(all_contexts(docs, self.state["buckets"], self.state["min_len"]))], []
        while len(levels) > 1 and levels[-2]["contexts"] <= 2 * levels[-1]["contexts"]:
            pair = levels[-2:]
            gone += pair
            levels[-2:] = [self._save(self.level(pair[0]["name"]).unionByName(self.level(pair[1]["name"])))]
        self.state = self.state | {"levels": levels}
        self._write()
        for x in gone:
            remove(self.spark, f"{self.folder}/{x['name']}")
