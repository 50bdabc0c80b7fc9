import base64
import hashlib
import json

import pytest

from loomwork.llm import warc


def table(spark):
    rows = [(5, "http://a/?x=1 2", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "u\r\nX: y", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1 \U0001f642"), (3, "http://b", "same"), (None, "n", "alone"), (8, "l", "long " * 200_000)]
    rows += [(100 + i, f"http://p/{i}", f"page {i % 7} " * 50) for i in range(60)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")


def expected(rows):
    first, out, before = {}, [], set()
    for i, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        own = first.setdefault(d, i)
        again = (i, d) in before
        before.add((i, d))
        out.append((i, len(b), d, "revisit" if own != i or again else "response", own if own != i or again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(warc.ROLL_BYTES, warc.RANGE_BYTES), (2000, 5000)])
def test_round_trip(spark, tmp_path, sizes):
    pages = table(spark)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(pages, folder, *sizes)
    got = warc.read_archives(manifest, folder, pages.schema["page_id"].dataType)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == expected([tuple(r) for r in pages.collect()])
    texts = {r.page_id: r.html for r in pages.collect()}
    assert all(r.payload.decode() == (texts[r.page_id] or "") for r in got.where("record_type = 'response'").collect())
    names = {r.name for r in manifest.collect()}
    assert {p.name for p in (tmp_path / "a").iterdir()} == names | {warc.LISTING} and (len(names) > 5) == (sizes[0] == 2000)
    assert {json.loads(x)["name"] for x in (tmp_path / "a" / warc.LISTING).read_text().splitlines()} == names
    warc.write_archives(pages.repartition(5), f"file://{tmp_path}/b", *sizes)  # the same files from other partitions
    assert all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)


def test_damage_is_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archives(table(spark), folder)
    data = next((tmp_path / "a").glob("*.gz")).read_bytes()
    import io

    with pytest.raises(Exception):  # noqa: B017
        list(map(warc.parsed, warc.members(io.BytesIO(data[:-20]))))
    with pytest.raises(warc.WarcError):
        warc.parsed(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:X\r\n\r\nabc\r\n\r\n")


def test_empty(spark):
    assert warc.archived(table(spark).limit(0)).count() == 0


def test_ranges_follow_the_ids(spark, monkeypatch):
    """An outlying id, null ids alone, and ids that are no numbers: many ranges, in order."""
    monkeypatch.setattr(warc, "SAMPLED", 8)
    text = "x" * 500
    for ids, kind in (([*range(2000), 2**60], "long"), ([None] * 2000, "long"), ([f"p{i:05d}" for i in range(2000)], "string")):
        rows = spark.createDataFrame([(i, f"{k} {text}") for k, i in enumerate(ids)], f"page_id {kind}, html string").selectExpr("page_id", "sha1(html) AS sha", "length(html) AS bytes")
        dealt, shards = warc._ranges(rows, 50_000)
        found = [tuple(r) for r in dealt.groupBy("_shard").agg({"bytes": "sum", "page_id": "min"}).orderBy("_shard").selectExpr("_shard", "`sum(bytes)`", "`min(page_id)`").collect()]
        assert 12 <= shards <= 40 and len(found) == shards and max(b for _, b, _ in found) < 200_000
        assert kind == "long" and ids[0] is None or [i for *_, i in found] == sorted(i for *_, i in found)


def test_what_lost_attempts_leave_is_swept(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".pages-00000000-00000.warc.gz.0123").write_bytes(b"cut off")
    warc.write_archives(table(spark), f"file://{tmp_path}/a")
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".pages")]
