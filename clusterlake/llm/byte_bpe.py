"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clusterlake.llm.common import small_batches, table

#: Texts beyond this many characters are split before the pattern runs over them.
SPLIT_AT = 65_536
#: Runs of white space from this length on are cut by rule: the library's pattern engine keeps a state for each of their characters, and gives up at a million.
BLANKS = 65_536
#: The white space of the pattern's engine (Unicode's property of that name).
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space after a visible character and before a letter: with ` ?\p{L}+` and white space matched by `\s+(?!\S)|\s+`, no match crosses the point before it.
_SAFE = re.compile(r"(?<=\S) (?=[^\W\d_])")
_BUILT: dict = {}


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}


class Codec:
    """encode() and decode() by the tiktoken library. Null is the caller's affair; an empty text has no ids."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=parse_ranks(content), special_tokens={})

    @staticmethod
    def segments(text: str, size: int = SPLIT_AT) -> Iterator[str]:
        """Cuts at safe boundaries, so that each segment's matches are the matches of the whole text."""
        start = 0
        while len(text) - start > size:
            m = _SAFE.search(text, start + size)
            if m is None:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.segments(text):
            at = 0
            # With `\s+(?!\S)|\s+`, a run of white space is a match but for its last character, if something follows; all of it at the end.
            for m in re.finditer(f"[{_BLANK}]{{{BLANKS},}}", part) if len(part) >= BLANKS else ():
                stop = m.end() - (m.end() < len(part))
                out += self.library.encode_ordinary(part[at : m.start()]) + self.library._encode_single_piece(part[m.start() : stop].encode())
                at = stop
            out += self.library.encode_ordinary(part[at:])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes; these need not be UTF-8 for a part of a text's ids."""
        return self.library.decode_bytes(ids)


def codec(content: bytes, pattern: str) -> Codec:
    """One codec for each Python worker."""
    key = hash((content, pattern))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Codec(content, pattern)
    return _BUILT[key]


def encode_texts(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) for each row, whole texts; null and empty texts have no ids and no bytes.

    The driver reads the rank file (its size is fixed, about a megabyte) and sends it to each worker once. Ties, repeated rows
    and columns besides the two read don't matter; an empty table gives an empty result.
    """
    return _mapped(df, rank_file, pattern, id_col, text_col, f"{id_col} long, ids array<int>, decoded binary", lambda key, ids, back: (key, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())))


def _mapped(df, rank_file, pattern, id_col, text_col, schema, columns) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    with open(rank_file, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 100):  # ids of a hundred texts at a time
                part = b.slice(at, 100)
                ids = [c.encode(t) if t else [] for t in part.column(1).to_pylist()]
                out = columns(part.column(0), ids, [c.decode(i) for i in ids])
                yield pa.RecordBatch.from_arrays(list(out), names=names)

    source = df.select(df[id_col].cast("long").alias(id_col), df[text_col].alias("text"))
    names = [x.strip().split()[0] for x in re.sub(r"<.*?>", "", schema).split(",")]
    return source.mapInArrow(run, schema)


def digests(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """encode_texts, reduced on the worker to counts and digests, so that ids and bytes don't go back through Spark."""

    def columns(key, ids, back):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return key, pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(",".join(map(str, i)).encode()) for i in ids], pa.string()), pa.array([sha(x) for x in back], pa.string())

    return _mapped(df, rank_file, pattern, "doc_id", "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text counts as empty: no ids, digests of nothing. Repeated rows and rows without an id give a row each; an empty table gives an empty result; other columns are not read."""
    import public_tokenizers as tokenizers

    return digests(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
