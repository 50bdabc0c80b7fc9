"""WARC archives: a deterministic sharded writer, and a reader that verifies what it reads.

Pages are dealt by ranges of their ids, whose bounds depend on the rows alone, and sorted in each range. A task writes a
range's files, rolled by compressed size, under temporary names; a table that Spark commits lists those of the attempts that
counted, and only these get their final names. What an attempt that is lost, or runs twice, leaves behind is swept then, and a
manifest beside the files is written last.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import shared_dir, written

#: A file is closed once so many compressed bytes are in it.
ROLL_BYTES = 64 << 20
#: Payload bytes of a range, about.
RANGE_BYTES = 32 << 20
#: Ranges, and keys for each of them that their bounds are taken from, at most; a table of more than MOST_RANGES * RANGE_BYTES (512 GB) has larger ranges.
MOST_RANGES, SAMPLED = 1 << 14, 24
#: Records of smaller payloads are never revisits.
REVISIT_BYTES = 0
#: The date of every record: pages carry none, and the same pages must give the same files.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: Any) -> str:
    return "<urn:x-page:" + ("" if page_id is None else urllib.parse.quote(str(page_id), safe="")) + ">"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member, whose header fields are made anew. The same input gives the same bytes."""
    fields = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: Any, url: str | None, payload: bytes, refers_to: Any, revisit: bool) -> bytes:
    uri = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else _uri(page_id)[1:-1]
    headers = [("WARC-Record-ID", _uri(page_id)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    http = _HTTP % len(payload)
    if revisit:
        return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))], http)
    return record("response", headers, http + payload)


class Roller:
    """Files of a range, each begun with a warcinfo record and closed at the size limit."""

    def __init__(self, filesystem, folder: str, shard: int, roll_bytes: int) -> None:
        self.filesystem, self.folder, self.shard, self.roll_bytes = filesystem, folder, shard, roll_bytes
        self.number, self.out, self.done = 0, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records = self.filesystem.open_output_stream(self.temporary, compression=None), 0, 0
            info = f"software: loomwork\r\nformat: WARC file version 1.1\r\nfile: {self.name}\r\n".encode()
            self._put(record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.number, self.name, self.temporary, self.records, self.size))
            self.out, self.number = None, self.number + 1


#: The manifest beside the files: a JSON line for each.
LISTING = "manifest.jsonl"
MANIFEST = "shard long, number long, name string, temporary string, records long, bytes long"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _ranges(rows: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """rows with _shard, by ranges of (page_id, sha), null ids first, each of about range_bytes; rows with the same id and payload aren't parted.

    Bounds are quantiles, by bytes, of the rows whose key's hash is a multiple of a number that grows with the table: the
    same rows give the same bounds, however ids are spread, and the sample is bounded.
    """
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    wanted = min(MOST_RANGES, max(1, -(-size.bytes // range_bytes)))
    every = max(1, size.n // (SAMPLED * wanted))
    keys = rows.where(F.pmod(F.xxhash64("page_id", "sha"), F.lit(every)) == 0).groupBy("page_id", "sha").agg(F.sum("bytes").alias("bytes"))
    sample = keys.orderBy(F.asc_nulls_first("page_id"), "sha").collect() if wanted > 1 else []
    share, used, bounds = sum(r.bytes for r in sample) / wanted, 0, []
    for r in sample:
        if used and used + r.bytes > share:
            bounds.append((r.page_id is not None, r.page_id, r.sha))
            used = 0
        used += r.bytes
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shas = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "sha"))
            shard = [bisect_right(shared.value, (i is not None, i, s)) for i, s in zip(ids, shas, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], names=[*batch.schema.names, "_shard"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_shard", T.LongType())])), len(bounds) + 1


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into folder, and returns the manifest of its files.

    Of rows with equal payloads of revisit_bytes or more, that with the smallest page_id is the response, the others
    revisit it; a row that is repeated in full revisits the first. Null html: an empty payload; null url: the page's own
    urn; null ids stand before all others in their range, and are a response only if no row with an id has that payload.
    An empty table gives no files. Other columns are left out.
    """
    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    slim = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").cast("long").alias("bytes"))
    firsts = slim.where(F.col("bytes") >= revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    later = slim.join(firsts, "sha").where("first is not null and (page_id is null or page_id <> first)").select("page_id", "sha", "first").distinct()
    # What a page revisits comes as a row just before it, so that pages move once.
    empty = lambda name: F.lit(None).cast(rows.schema[name].dataType if name in rows.columns else "string").alias(name)
    ahead = written(later, "revisits").select("page_id", "sha", "first", empty("url"), empty("html"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("bytes"))
    body = rows.select("page_id", F.sha1("html").alias("sha"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("first"), "url", "html", F.lit(1).alias("own"), F.octet_length("html").cast("long").alias("bytes"))
    both, shards = _ranges(body.unionByName(ahead), range_bytes)
    dealt = both.repartitionById(shards, F.col("_shard").cast("int")).sortWithinPartitions("_shard", F.asc_nulls_first("page_id"), "sha", "own", "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, where = _filesystem(folder)
        roller = before = known = None
        done: list[tuple] = []
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                for r in part.to_pylist():
                    if roller is None or roller.shard != r["_shard"]:
                        if roller:
                            roller.close()
                            done += roller.done
                        roller, before, known = Roller(target, where, r["_shard"], roll_bytes), None, None
                    key = (r["page_id"], r["sha"])
                    if not r["own"]:
                        known = (*key, r["first"])
                        continue
                    payload = r["html"].encode("utf-8", "surrogatepass")
                    seen = len(payload) >= revisit_bytes and (known is not None and known[:2] == key or before == key)
                    refers = known[2] if seen and known is not None and known[:2] == key else r["page_id"]
                    roller.write(page_record(r["page_id"], r["url"], payload, refers, seen))
                    before = key
        if roller:
            roller.close()
            done += roller.done
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    manifest = written(dealt.mapInArrow(run, MANIFEST), "manifest")
    _committed(manifest, folder)
    return manifest


def _committed(manifest: DataFrame, folder: str) -> None:
    """Gives the manifest's files their final names, drops temporary files that it doesn't name, and at last writes the manifest beside the files. A file that has its name already is left, so this may run again."""
    from pyarrow import fs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, where = _filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if target.get_file_info(r["temporary"]).type == fs.FileType.File:
                    target.move(r["temporary"], f"{where}/{r['name']}")
            yield batch.select(["name"])

    manifest.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    target, where = _filesystem(folder)
    for info in target.get_file_info(fs.FileSelector(where)):
        if info.base_name.startswith(".pages-") and info.type == fs.FileType.File:
            target.delete_file(info.path)
    unfinished = f"{where}/.{LISTING}.{uuid.uuid4().hex}"
    with target.open_output_stream(unfinished, compression=None) as out:
        for r in manifest.select("name", "records", "bytes").orderBy("name").toLocalIterator():  # a line for each file
            out.write((json.dumps(r.asDict()) + "\n").encode())
    target.move(unfinished, f"{where}/{LISTING}")


# ---- reading -------------------------------------------------------------------------------------------------------


class WarcError(ValueError):
    """A record that doesn't hold together."""


def members(stream: BinaryIO, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one by one."""
    data = b""
    unpack, parts = zlib.decompressobj(31), []
    while True:
        data = data or stream.read(step)
        if not data:
            break
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise WarcError("file cut off")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of a record, its length and digests verified."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", -1))] if found else b""
    if not lines[0].startswith("WARC/1.") or rest != block + b"\r\n\r\n" or fields.get("warc-block-digest") != "sha1:" + digest(block):
        raise WarcError("record")
    return fields, block


def _page(uri: str | None) -> str | None:
    text = re.fullmatch(r"<urn:x-page:(.*)>", uri or "<urn:x-page:>")[1]
    return urllib.parse.unquote(text) or None


def read_archives(manifest: DataFrame, folder: str, id_type: T.DataType) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every page record in the manifest's files; payload is null for revisits."""
    schema = "page text string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers string".replace("page text", "page")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, where = _filesystem(folder)
        names = ("page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers")
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with source.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for fields, block in map(parsed, members(stream)):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        stated = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                        own = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != stated or digest(payload) != own):
                            raise WarcError("payload")
                        rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], payload if kind == "response" else None, stated, own, kind, _page(fields.get("warc-refers-to"))))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = manifest.select("name").repartition(max(1, min(manifest.count(), 10_000)))
    out = files.mapInArrow(run, schema)
    return out.select(F.col("page").cast(id_type).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the pages' archives, in the shared folder if none is given, and returns what reading them back yields, without the payloads."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder, roll_bytes, range_bytes)
    return read_archives(manifest, folder, pages.schema["page_id"].dataType).drop("payload", "url")
