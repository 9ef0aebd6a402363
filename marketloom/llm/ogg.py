"""Ogg media columns (operator 3): multiplex, verify, demultiplex, reassemble, time.

`to_ogg` stores a text's padded UTF-8 bytes as 8-bit samples of one logical stream, beside a second logical stream of block
checksums; the pages of both are interleaved. `read_ogg` takes the stored bytes alone: it checks the checksum of every page and the
page sequence, splits the logical streams by serial number, reassembles packets from the lacing values over page borders, and
derives times from granule positions.

Defined cases: a null text is empty; an empty text is 64 zero bytes; equal texts give equal media; repeated rows give a row each;
a text of any length is split into pages of at most 65,025 bytes; an empty table gives no rows; other columns are ignored.
Damaged media raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices

#: Fixed values of the container format.
MAGIC, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
LACED, SEGMENTS = 255, 255

#: Fixed values of this module's two streams: serial numbers, packet size, sample rate and the first packets' marks.
SAMPLES, CHECKS, BLOCK, RATE = 1, 2, 16_384, 8_000
MARKS = {SAMPLES: b"loom-pcm8", CHECKS: b"loom-crc32"}

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The format's CRC (polynomial 0x04C11DB7, most significant bit first, no inversion), got from zlib's reflected one.

    Reversing the bits of every byte and of the result turns one into the other; the start value cancels zlib's inversions.
    """
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(n: int) -> bytes:
    """Segment lengths of a packet of n bytes; the last one is under 255."""
    return bytes([LACED]) * (n // LACED) + bytes([n % LACED])


def pages(serial: int, packets: Iterable[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream; packets: (bytes, granule position at its end). The first packet stands on a page of its own."""
    number, table, body, granule, open_packet = 0, bytearray(), bytearray(), -1, False
    packets = list(packets)

    def page(flags: int) -> bytes:
        head = HEADER.pack(MAGIC, 0, flags, granule, serial, number, 0, len(table)) + bytes(table)
        data = bytearray(head + bytes(body))
        data[22:26] = struct.pack("<I", checksum(bytes(data)))
        return bytes(data)

    continued = False
    for k, (packet, position) in enumerate(packets):
        left, at = lacing(len(packet)), 0
        while left:
            part = left[: SEGMENTS - len(table)]
            table += part
            size = sum(part)
            body += packet[at : at + size]
            at, left = at + size, left[len(part) :]
            if not left:
                granule = position
            last = k == len(packets) - 1 and not left
            if left or last or k == 0 or len(table) == SEGMENTS:
                yield page(CONTINUED * continued | FIRST * (number == 0) | LAST * last)
                number, continued, granule = number + 1, bool(left), -1
                table.clear()
                body.clear()


def multiplex(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """First pages of all streams, then their other pages in turn."""
    waiting = [pages(serial, packets) for serial, packets in streams.items()]
    out = [next(x) for x in waiting]
    while waiting:
        for x in list(waiting):
            if (page := next(x, None)) is None:
                waiting.remove(x)
            else:
                out.append(page)
    return b"".join(out)


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """By serial number, the packets and the granule position of the page that each ends on (-1: not stated there)."""
    found: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError("cut page header")
        magic, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        table = media[at + HEADER.size : at + HEADER.size + count]
        end = at + HEADER.size + count + sum(table)
        if magic != MAGIC or version or end > len(media):
            raise ValueError("no whole page here")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError("page checksum differs")
        s = found.setdefault(serial, {"next": 0, "packets": [], "part": [], "ended": False, "open": False})
        if number != s["next"] or s["ended"] or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != s["open"]:
            raise ValueError("page out of sequence")
        place, start = at + HEADER.size + count, at + HEADER.size + count
        for size in table:
            place += size
            if size < LACED:
                s["part"].append(media[start:place])
                s["packets"].append([b"".join(s["part"]), -1])
                s["part"], start = [], place
        if start < place or (table and table[-1] == LACED):
            s["part"].append(media[start:place])
        if granule >= 0:
            s["packets"][-1][1] = granule
        s["open"] = bool(table) and table[-1] == LACED
        s["next"], s["ended"], at = number + 1, bool(flags & LAST), end
    if any(s["open"] or not s["ended"] for s in found.values()):
        raise ValueError("a stream has no end")
    return {serial: [(p, g) for p, g in s["packets"]] for serial, s in found.items()}


def store(payload: bytes) -> bytes:
    samples, checks = [(MARKS[SAMPLES] + struct.pack("<I", RATE), 0)], [(MARKS[CHECKS], 0)]
    for start in range(0, len(payload), BLOCK):
        block = payload[start : start + BLOCK]
        samples.append((block, start + len(block)))
        checks.append((struct.pack("<I", zlib.crc32(block)), start + len(block)))
    return multiplex({SAMPLES: samples, CHECKS: checks})


def load(media: bytes) -> tuple[bytes, str]:
    """The payload and its features: streams, packets, seconds by the last granule position, mean and deviation of samples, zero share."""
    streams = demultiplex(media)
    (head, _), *samples = streams[SAMPLES]
    (mark, _), *checks = streams[CHECKS]
    if not head.startswith(MARKS[SAMPLES]) or mark != MARKS[CHECKS] or len(samples) != len(checks):
        raise ValueError("not the two streams of this module")
    if any(struct.pack("<I", zlib.crc32(block)) != check for (block, _), (check, _) in zip(samples, checks, strict=True)):
        raise ValueError("a block differs from its check")
    payload = b"".join(block for block, _ in samples)
    if samples[-1][1] != len(payload):
        raise ValueError("the last granule position is not the number of samples")
    rate = struct.unpack_from("<I", head, len(MARKS[SAMPLES]))[0]
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values, n = np.arange(256), len(payload)
    total, square = int(counts @ values), int(counts @ values**2)
    mean = total / n
    return payload, (
        f"streams={len(streams)};packets={len(samples)};seconds={samples[-1][1] / rate:.6f};"
        f"mean={mean:.6f};deviation={max(0.0, square / n - mean * mean) ** 0.5:.6f};zeros={counts[0] / n:.6f}"
    )


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        media = [store(x + bytes(-len(x) % 64 if x else 64)) for x in raw]
        yield pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches):
        rows = []
        for media in batch.column(2).to_pylist():
            payload, feature = load(media)
            rows.append((len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), feature))
        made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", *names])


def to_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (binary)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def read_ogg(media: DataFrame) -> DataFrame:
    """Digests and features read back from the media column."""
    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_loaded, f"doc_id long, n_bytes long, {kinds}")
