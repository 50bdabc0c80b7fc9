import random

import pytest

from loomwork.llm import media
from tests.llm.helpers import awkward


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, media.PACKET, media.PACKET * 3 + 5, 400_000])
def test_round_trip(size):
    payload = media.padded(random.Random(size).randbytes(size))
    back, facts = media.decode(media.encode(payload))
    assert back == payload and len(payload) % 576 == 0 and facts["us"] == len(payload) * 125


def test_damage_is_seen():
    data = bytearray(media.encode(media.padded(b"x" * 5000)))
    for at in (3, 30, 100, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(media.OggError):
            media.decode(bytes(broken))
    with pytest.raises(media.OggError):
        media.decode(bytes(data[:-1]))


def test_checksum_is_oggs():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
                crc &= 0xFFFFFFFF
        return crc

    for data in (b"", b"a", b"OggS" + bytes(range(200))):
        assert media.checksum(data) == slow(data)


def test_rows(spark):
    docs = awkward(spark, clashing=True)
    rows = media.ogg_digests(docs).collect()
    assert len(rows) == docs.count()
    ones = [r for r in rows if r.n_bytes == 3]
    assert len(ones) == 4 and len({r[1:] for r in ones}) == 1
    assert {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {576}
    assert media.ogg_digests(docs.limit(0)).count() == 0
    assert media.decode(media.ogg_columns(docs).where("doc_id = 2").first().media)[0] == b"\xff" * 576
