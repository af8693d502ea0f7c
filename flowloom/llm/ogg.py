"""Media columns: texts kept as 8-bit samples in Ogg files, written and read page by page.

A payload (UTF-8 bytes, padded with zero bytes to a multiple of 64) becomes packets of one logical stream and a second
stream holds one packet with the payload's length; their pages are multiplexed. The reader trusts nothing of the
writer: it finds each page by its capture pattern, verifies its checksum, puts packets together from the lacing
values (over page ends too), tells the streams apart by serial number, sees missing pages by their sequence numbers,
and derives times from granule positions (samples so far, or -1 where no packet ends on a page).

Checksums: an Ogg page's CRC is the unreflected CRC-32 from 0; zlib's is the reflected one. Turning round the bits of
each byte and of the result makes one of the other.

Cases: a null or empty text is a payload of 64 zero bytes. A page with a wrong checksum is left out and counted, and
packets that it broke are dropped. Equal texts give equal files: serial numbers come from the payload. A text of any
length is split over pages. Repeated rows give repeated rows, an empty table none. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import blocks, short_batches, table

CAPTURE = b"OggS"
#: Capture pattern, version, flags, granule position, serial number, page number, checksum, lacing values.
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: First bytes of the two streams' first packets. Ours.
SAMPLES, LENGTH = b"\x80PCM-U8 ", b"\x80LENGTH "
Page = namedtuple("Page", "flags granule serial number lacing body")
Stream = namedtuple("Stream", "serial packets ends lost")


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7 of a page whose checksum field is zero."""
    r = zlib.crc32(page.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(TURNED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; its first packet has the first page for itself. granules: position at each packet's end."""
    out: list[bytes] = []
    lacing, body, flags, granule = bytearray(), bytearray(), FIRST, -1

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, flags, granule
        out.append(page(flags | LAST * last, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, flags, granule = bytearray(), bytearray(), CONTINUED * goes_on, -1

    for i, packet in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while at < len(values):
            if len(lacing) == 255:
                flush(False, at > 0)
            take = values[at : at + 255 - len(lacing)]
            body += packet[255 * at : 255 * (at + len(take))]
            lacing += take
            at += len(take)
        granule = granules[i]
        if i == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return out


def write(payload: bytes, rate: int, packet: int) -> bytes:
    """One Ogg file with the payload's samples and a stream that tells their number."""
    serial = int.from_bytes(hashlib.blake2b(payload, digest_size=4).digest(), "little")
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    ends = [min(len(payload), i + packet) for i in range(0, len(payload), packet)]
    a = pages(serial, [SAMPLES + struct.pack("<IB", rate, 1), *parts], [0, *ends])
    b = pages(serial ^ 0xFFFFFFFF, [LENGTH, struct.pack("<Q", len(payload))], [0, len(payload)])
    # First pages of all streams come before all others; then the pages take turns.
    rest = [x for i in range(max(len(a), len(b))) for s in (a, b) for x in s[i : i + 1] if i]
    return b"".join([a[0], b[0], *rest])


def read_pages(media: bytes) -> tuple[list[Page], int]:
    """The pages with a right checksum, and how many have a wrong one."""
    out, bad, at = [], 0, media.find(CAPTURE)
    while at >= 0:
        if at + HEAD.size > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        raw = media[at:end]
        if version == 0 and len(lacing) == n and end <= len(media) and checksum(raw[:22] + bytes(4) + raw[26:]) == crc:
            out.append(Page(flags, granule, serial, number, lacing, raw[HEAD.size + n :]))
            at = media.find(CAPTURE, end)
        else:
            bad += 1
            at = media.find(CAPTURE, at + 1)
    return out, bad


def demultiplex(found: list[Page]) -> dict[int, Stream]:
    """Packets of each logical stream, the granule position at each packet's end (None where its page says none), and pages lost."""
    by: dict[int, list[Page]] = {}
    for p in found:
        by.setdefault(p.serial, []).append(p)
    out = {}
    for serial, own in by.items():
        packets, ends, lost, due, held = [], [], 0, 0, None
        for p in own:
            lost += p.number - due
            if p.number != due:
                held = None
            due, at, skip = p.number + 1, 0, bool(p.flags & CONTINUED) and held is None
            if not p.flags & CONTINUED:
                held = None
            size, done = 0, 0
            for v in p.lacing:
                size += v
                if v < 255:
                    whole = (held or b"") + p.body[at : at + size]
                    if not skip:
                        packets.append(whole)
                        ends.append(None)
                        done += 1
                    held, skip, at, size = None, False, at + size, 0
            if size or p.lacing[-1:] == b"\xff":
                held = None if skip else (held or b"") + p.body[at:]
            if done and p.granule >= 0:
                ends[-1] = p.granule
        out[serial] = Stream(serial, packets, ends, lost)
    return out


def read(media: bytes) -> tuple[bytes, str]:
    """The payload and what was seen on the way: streams, pages, packets, faults, time and level of the samples."""
    found, bad = read_pages(media)
    streams = demultiplex(found)
    payload, rate, told, last = b"", 1, -1, 0
    for s in streams.values():
        if s.packets and s.packets[0].startswith(SAMPLES):
            rate = struct.unpack_from("<I", s.packets[0], len(SAMPLES))[0]
            payload = b"".join(s.packets[1:])
            last = max((e for e in s.ends if e is not None), default=0)
        elif len(s.packets) > 1 and s.packets[0] == LENGTH:
            told = struct.unpack("<Q", s.packets[1])[0]
    samples = np.frombuffer(payload, np.uint8)
    lost, packets = sum(s.lost for s in streams.values()), sum(len(s.packets) for s in streams.values())
    level = f"mean={int(samples.sum(dtype=np.int64)) // max(1, len(samples))};peak={samples.max(initial=0)}"
    whole = "yes" if not bad and not lost and told == len(payload) == last else "no"
    return payload, f"streams={len(streams)};pages={len(found)};packets={packets};bad={bad};lost={lost};whole={whole};ms={1000 * last // rate};{level}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000, packet: int = 4096) -> DataFrame:
    """id, n_bytes and media, the Ogg file of each text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))

    def run(batches):
        for b in blocks(batches, "bytes"):
            raw = b.column("bytes").to_pylist()
            media = [write(x + bytes(-len(x) % 64 or 64 * (not x)), rate, packet) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return short_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def read_column(media: DataFrame) -> DataFrame:
    """media's columns, the payload read back, and feature. `media` is a column of Ogg files; null gives nulls."""
    names = media.columns

    def run(batches):
        for b in blocks(batches, "media"):
            got = [read(x) if x is not None else (None, None) for x in b.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.string())], [*names, "payload", "feature"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{schema}, payload binary, feature string")


def op10_media_columns(spark, sf_dir):
    out = read_column(media_column(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
