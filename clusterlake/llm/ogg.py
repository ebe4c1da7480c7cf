"""Media columns: lossless storage of byte payloads in Ogg, and reading it back.

Pages carry a checksum, lacing values and a granule position (RFC 3533). Two logical streams are interleaved: stream one holds the
samples, in packets of FRAME 8-bit samples, stream two the number of payload bytes that were not padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clusterlake.llm.common import small_batches, table

FRAME, RATE = 576, 8000
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
SAMPLES, LENGTH = b"PCM8\x00", b"BYTES\x00"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class BadPage(ValueError):
    """A page whose capture pattern, size or checksum is wrong."""


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, most significant bit first, no start or final inversion), by zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> Iterator[bytes]:
    """One logical stream. Its first packet has a page of its own; packets may go on over pages. A page's granule is that of the last packet that ends on it, or -1."""
    number = 0
    lacing, body, granule, flags = bytearray(), [], -1, FIRST
    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        rest = len(packet)
        sizes = [255] * (rest // 255) + [rest % 255]
        done = 0
        for i, n in enumerate(sizes):
            if len(lacing) == 255:
                yield page(flags, granule, serial, number, bytes(lacing), b"".join(body))
                number, lacing, body, granule, flags = number + 1, bytearray(), [], -1, CONTINUED if i else 0
            lacing.append(n)
            body.append(packet[done : done + n])
            done += n
        granule = at
        last = k == len(packets) - 1
        if k == 0 or last:
            yield page(flags | LAST * last, granule, serial, number, bytes(lacing), b"".join(body))
            number, lacing, body, granule, flags = number + 1, bytearray(), [], -1, 0


def store(data: bytes) -> bytes:
    """data, with bytes 255 up to a positive multiple of FRAME, as an Ogg file. Equal data, equal file."""
    payload = data + b"\xff" * ((-len(data)) % FRAME if data else FRAME)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    serial = zlib.crc32(payload)
    one = pages_of(serial, [SAMPLES + struct.pack("<II", RATE, FRAME), *frames], [0, *range(FRAME, len(payload) + 1, FRAME)])
    two = pages_of(serial ^ 0xFFFFFFFF, [LENGTH + struct.pack("<Q", len(data))], [0])
    return b"".join((next(one), *two, *one))


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page, its checksum verified."""
    at = 0
    while at < len(media):
        try:
            magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        except struct.error:
            raise BadPage(f"cut header at byte {at}") from None
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise BadPage(f"no whole page at byte {at}")
        raw = media[at:end]
        if checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            raise BadPage(f"wrong checksum at byte {at}")
        yield flags, granule, serial, number, lacing, raw[27 + n :]
        at = end


def demultiplex(media: bytes) -> dict[int, dict]:
    """By serial: packets and, for each page on which a packet ends, its granule position and the packets so far. A lost page or a packet that is never ended is an error."""
    streams: dict[int, dict] = {}
    for flags, granule, serial, number, lacing, body in read_pages(media):
        if flags & FIRST:
            streams[serial] = {"packets": [], "marks": [], "open": b"", "going": False, "next": 0, "ended": False}
        s = streams.get(serial)
        if s is None or number != s["next"] or bool(flags & CONTINUED) != s["going"]:
            raise BadPage(f"page {number} of stream {serial:08x} is out of order")
        s["next"] += 1
        at, ended = 0, False
        parts = [s["open"]]
        for n in lacing:
            parts.append(body[at : at + n])
            at += n
            if n < 255:
                s["packets"].append(b"".join(parts))
                parts, ended = [], True
        s["open"], s["going"] = b"".join(parts), bool(lacing) and lacing[-1] == 255
        if ended and granule >= 0:
            s["marks"].append((granule, len(s["packets"])))
        s["ended"] |= bool(flags & LAST)
    if any(s["going"] or not s["ended"] for s in streams.values()):
        raise BadPage("a stream isn't ended")
    return streams


def load(media: bytes) -> dict:
    """payload, n_bytes, seconds (from the last granule position) and packet times of a file made by store()."""
    streams = demultiplex(media)
    samples = next(s for s in streams.values() if s["packets"][0].startswith(SAMPLES))
    length = next(s for s in streams.values() if s["packets"][0].startswith(LENGTH))
    rate, frame = struct.unpack_from("<II", samples["packets"][0], len(SAMPLES))
    payload = b"".join(samples["packets"][1:])
    granule, count = samples["marks"][-1]
    if granule != len(payload) or count != len(samples["packets"]):
        raise BadPage("the last granule position isn't the number of samples")
    starts = [(g - (last - k) * frame) / rate for (g, last), (_, first) in zip(samples["marks"][1:], samples["marks"], strict=False) for k in range(first, last)]
    return {"payload": payload, "n_bytes": struct.unpack_from("<Q", length["packets"][0], len(LENGTH))[0], "seconds": granule / rate, "starts": starts, "streams": len(streams)}


def features(payload: bytes, seconds: float) -> str:
    """Loudness and crossings of the 8-bit samples around their middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    energy = int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"seconds={seconds:.3f};mean={int(x.sum()) / len(x):.4f};rms={(energy / len(x)) ** 0.5:.4f};crossings={crossings};peak={int(np.abs(x).max())}"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): each whole text as an Ogg file; null is stored as empty."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([store(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["id", "media"])

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("binary").alias("text")).mapInArrow(run, "id long, media binary").withColumnRenamed("id", id_col)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, streams int"


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digests and features of media files, read back page by page. A row whose media is null has null in each column but the id; a broken file is an error that names the byte."""
    small_batches(df.sparkSession)

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 9
        x = load(media)
        p = x["payload"]
        return x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(p, x["seconds"]), x["seconds"], x["streams"]

    def run(batches):
        for b in batches:
            rows = [one(m) for m in b.column(1).to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32()]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[media_col].alias("media")).mapInArrow(run, DIGEST)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are stored as empty ones: one frame of bytes 255. Equal texts have equal files, repeated rows and rows without an id a row each; an empty table gives an empty result; other columns are not read."""
    return read_media(store_texts(table(spark, sf_dir, "documents")))
