"""Ogg pages: written with checksums and lacing values, verified, demultiplexed and timed when read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwork.llm.common import columns_added, utf8

#: Payloads are padded to a multiple of this.
UNIT = 576
#: Samples in a packet: a multiple of UNIT.
PACKET = 64 * UNIT
RATE = 8000
#: Logical streams, to which packets are dealt in turn.
STREAMS = 2
_HEAD = struct.Struct("<4sBBqIIIB")
_INTRO = struct.Struct("<8sIBB")
_MAGIC = b"\x7fPCM8\x00\x01\x00"
_FLIPPED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A page or packet that doesn't hold together."""


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04c11db7, most significant bit first, from 0. zlib's runs the other way over flipped bits."""
    crc = zlib.crc32(page.translate(_FLIPPED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[tuple[int, bytes]]:
    """(granule position, page) for a logical stream's packets, each with the granule position at its end.

    The first packet has a page to itself; a packet may run on over pages of 255 segments.
    """
    segments: list[tuple[bytes, int]] = []
    for k, (data, granule) in enumerate(packets):
        full, rest = divmod(len(data), 255)
        cut = [(data[i * 255 : i * 255 + 255], -1) for i in range(full)] + [(data[full * 255 : full * 255 + rest], granule)]
        segments += cut + [(b"", -2)] * (k == 0)
    groups: list[list[tuple[bytes, int]]] = [[]]
    for s in segments:
        if s[1] == -2 or len(groups[-1]) == 255:
            groups.append([])
        if s[1] != -2:
            groups[-1].append(s)
    groups = [g for g in groups if g]
    seen, open_packet = 0, False
    for n, g in enumerate(groups):
        ends = [x for _, x in g if x >= 0]
        granule = ends[-1] if ends else -1
        flags = open_packet | 2 * (n == 0) | 4 * (n == len(groups) - 1)
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, n, 0, len(g)) + bytes(len(x) for x, _ in g)
        page = head + b"".join(x for x, _ in g)
        yield max(granule, seen), page[:22] + checksum(page).to_bytes(4, "little") + page[26:]
        seen, open_packet = max(granule, seen), g[-1][1] < 0


def encode(payload: bytes, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """8-bit samples as an Ogg file of several logical streams, their pages interleaved by time. A granule is a sample of the whole."""
    dealt: list[list[tuple[bytes, int]]] = [[(_INTRO.pack(_MAGIC, rate, streams, s), 0)] for s in range(streams)]
    for n, at in enumerate(range(0, len(payload), PACKET)):
        part = payload[at : at + PACKET]
        dealt[n % streams].append((part, at + len(part)))
    pages = [(n > 0, granule, s, n, page) for s, packets in enumerate(dealt) for n, (granule, page) in enumerate(_pages(packets, s + 1))]
    return b"".join(p[-1] for p in sorted(pages, key=lambda p: p[:4]))


def pages_of(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, sequence number, flags, granule position, lacing values, body) of each page, its checksum verified."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("page header cut off")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(data):
            raise OggError("not a whole page")
        page = data[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError("checksum")
        yield serial, number, flags, granule, lacing, page[27 + n :]
        at = end


def packets_of(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Per logical stream its packets, reassembled from lacing values, each with the granule position of the page it ends on."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    for serial, number, flags, granule, lacing, body in pages_of(data):
        if number != expected.get(serial, 0) or bool(flags & 2) != (serial not in expected) or serial in ended:
            raise OggError("page order")
        if bool(flags & 1) != bool(parts.get(serial)):
            raise OggError("continuation")
        expected[serial] = number + 1
        ended |= {serial} if flags & 4 else set()
        out, open_parts, at = streams.setdefault(serial, []), parts.setdefault(serial, []), 0
        for size in lacing:
            open_parts.append(body[at : at + size])
            at += size
            if size < 255:
                out.append((b"".join(open_parts), granule))
                open_parts.clear()
    if any(parts.values()) or ended != set(streams):
        raise OggError("stream cut off")
    return streams


def decode(data: bytes) -> tuple[bytes, dict[str, int]]:
    """The samples, put together from the logical streams, and what pages and granule positions tell."""
    streams = packets_of(data)
    intro = {s: _INTRO.unpack(p[0][0]) for s, p in streams.items()}
    if any(x[0] != _MAGIC for x in intro.values()):
        raise OggError("not 8-bit samples")
    rate, count = next(iter(intro.values()))[1:3]
    by_place = {x[3]: [p for p, _ in streams[s][1:]] for s, x in intro.items()}
    if sorted(by_place) != list(range(count)):
        raise OggError("a logical stream is missing")
    total = sum(map(len, by_place.values()))
    payload = b"".join(by_place[n % count][n // count] for n in range(total))
    last = max(g for p in streams.values() for _, g in p)
    if last != len(payload):
        raise OggError("granule positions")
    return payload, {"streams": count, "packets": total, "rate": rate, "us": last * 1_000_000 // rate}


def features(payload: bytes, facts: dict[str, int]) -> str:
    """Exact figures of the samples and the container, as text."""
    x = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    rest = {"sum": int(x.sum(dtype=np.int64)), "peak": int(x.max(initial=0)), "crossings": crossings}
    return ";".join(f"{k}={v}" for k, v in {**facts, **rest}.items())


FIELDS = [
    *[T.StructField(c, T.LongType()) for c in ("n_bytes", "payload_bytes")], T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data and bytes 255 up to a positive multiple of unit."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def ogg_columns(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the Ogg file of each text, as bytes in column media. Null and empty texts: one padded unit."""
    return columns_added(documents, [text_col], [T.StructField("media", T.BinaryType())], lambda: lambda col: {"media": [encode(padded(x)) for x in utf8(col)]})


def ogg_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and figures of the payload that is read back from the stored Ogg file.

    Null and empty texts have n_bytes 0 and one padded unit; rows are treated one by one, so null ids, repeated rows and
    empty tables need nothing special; other columns are left out.
    """

    def make():
        def apply(column):
            rows = []
            for text in utf8(column):
                media = encode(padded(text))
                payload, facts = decode(media)
                digest = lambda x: hashlib.sha256(x).hexdigest()
                rows.append((len(text), len(payload), digest(payload), zlib.crc32(payload[-32:]), len(media), digest(media), features(payload, facts)))
            return {f.name: [r[i] for r in rows] for i, f in enumerate(FIELDS)}

        return apply

    return columns_added(documents, [text_col], FIELDS, make, keep=[id_col])
